"""Evaluation texts in training text, by latent semantic retrieval.

The items are the stated query set: they are taken in blocks of a bounded number
of words, and every block is held against all documents.

1. One scan, for all blocks, normalises and tokenises the documents and keeps every
   document as ids of the items' vocabulary, unknown words as -1. All that follows
   reads that table; a block's own ids are looked up in an array.
2. Documents are cut into passages. Passage frequencies, then a randomised SVD of
   the TF-IDF matrix (passages x vocabulary), are computed in a few passes: each
   partition multiplies its rows with the current basis, the partial products are
   added in levels of bounded width, and only vocabulary x rank numbers reach the
   driver.
3. Windows of the documents and of the items are projected and scaled to unit
   length, and pairs with a high cosine are candidates. Equal windows have equal
   vectors, so all of them are.
4. Candidates are checked: for verbatim leaks word by word; for paraphrases by
   the longest common subsequence and by how many of the passage's telling
   words (its answer: words with digits, and the rarest words) turn up. As a
   document must hold so many of a passage's words, and of its telling words, an
   index from words to item passages says beforehand which it can leak at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import Scratch

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without tags, case and accents."""
    if not text:
        return []
    s = (_TAG.sub(" ", text) if "<" in text else text).lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return _WORD.findall(s)


@dataclass(frozen=True)
class Block:
    """Items of a block as word ids, and the vocabulary."""

    vocabulary: dict[str, int]
    items: list[tuple[int, np.ndarray]]


def item_blocks(items: DataFrame, block_words: int = 200_000) -> Iterator[Block]:
    """Items in blocks of at most ``block_words`` words (one item at least). Null and
    empty texts have no passages. Items arrive one partition at a time."""
    vocabulary: dict[str, int] = {}
    some: list[tuple[int, np.ndarray]] = []
    n = 0
    for r in items.select("item_id", "text").toLocalIterator():
        w = words(r.text)
        if not w:
            continue
        if some and n + len(w) > block_words:
            yield Block(vocabulary, some)
            vocabulary, some, n = {}, [], 0
        some.append((r.item_id, np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], dtype=np.int32)))
        n += len(w)
    if some:
        yield Block(vocabulary, some)


def known_words(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n_words, ids): each document as ids of the vocabulary, -1 for other words; ids
    is null where no word is known. Null and empty texts have no row."""
    kept = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the distinct words of the query set

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = kept.value.get
        for b in batches:
            doc_ids, sizes, ids = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = np.array(list(map(get, words(text), repeat(-1))), dtype=np.int32)
                if len(w):
                    doc_ids.append(doc)
                    sizes.append(len(w))
                    ids.append(w if (w >= 0).any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_words", "ids"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, ids array<int>")


def all_words(items: DataFrame) -> dict[str, int]:
    """The vocabulary of all items: distinct words of the query set, on the driver."""
    vocabulary: dict[str, int] = {}
    for r in items.select("text").toLocalIterator():
        for x in words(r.text):
            vocabulary.setdefault(x, len(vocabulary))
    return vocabulary


@dataclass(frozen=True)
class Corpus:
    """The documents as ids of all items' words, written once, and their vocabulary."""

    known: Scratch
    vocabulary: dict[str, int]

    def lookup(self, block: Block) -> np.ndarray:
        """From the corpus' ids to the block's; -1, the last one, is the unknown word in both."""
        to = np.full(len(self.vocabulary) + 1, -1, dtype=np.int32)
        for x, i in block.vocabulary.items():
            to[self.vocabulary[x]] = i
        return to


def corpus(docs: DataFrame, items: DataFrame) -> Corpus:
    vocabulary = all_words(items)
    return Corpus(Scratch(known_words(docs, vocabulary), "known-words"), vocabulary)


def _passages(b: pa.RecordBatch, to: np.ndarray, window: int, size: int, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, word, times) of the block's words in a batch of documents, each cut into passages
    of ``window`` words, some ``at_once`` words at a time. ``to``: Corpus.lookup."""
    lists = b.column("ids")
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = to[lists.flatten().to_numpy()]
    if not len(flat):
        return
    starts = np.concatenate([[0], ends[:-1]])
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + at_once, side="right")))
        ids = flat[starts[i] : ends[j - 1]]
        sizes = ends[i:j] - starts[i:j]
        passages = -(-sizes // window)
        first = np.cumsum(passages) - passages
        within = np.arange(len(ids)) - np.repeat(starts[i:j] - starts[i], sizes)
        row = np.repeat(first, sizes) + within // window
        known = ids >= 0
        key, times = np.unique(row[known].astype(np.int64) * size + ids[known], return_counts=True)
        yield key // size, key % size, times
        i = j


def _tree_sum(parts: DataFrame, n: int, width: int = 32) -> DataFrame:
    """Adds ``parts(strip, part, g)``, arrays of doubles as bytes, per strip: ``width`` of the
    ``n`` partitions at a time, so that no task holds more than that many arrays."""

    def total(p: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(x) for x in p["g"])
        return pd.DataFrame({"strip": p["strip"].iloc[:1], "part": p["part"].iloc[:1] // width, "g": [g.tobytes()]})

    while True:
        parts = parts.groupBy("strip", F.expr(f"part div {width}")).applyInPandas(total, "strip int, part long, g binary")
        n = -(-n // width)
        if n <= 1:
            return parts


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def passage_frequencies(known: DataFrame, lookup: Broadcast, size: int, window: int) -> np.ndarray:
    """In how many passages each word of the block is, over all documents."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size)
        for b in batches:
            for _, word, _ in _passages(b, lookup.value, window, size):
                n += np.bincount(word, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_partition()], pa.int64()), pa.array([n.tobytes()], pa.binary())], names=["strip", "part", "g"])

    ids = known.select("ids")
    rows = _tree_sum(ids.mapInArrow(partial, "strip int, part long, g binary"), ids.rdd.getNumPartitions()).collect()  # one row: a number per word of the block
    return np.frombuffer(rows[0].g).copy() if rows else np.zeros(size)


def latent_basis(known: DataFrame, lookup: Broadcast, idf: np.ndarray, window: int, rank: int = 64, passes: int = 2, seed: int = 5, extra: np.ndarray | None = None) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF matrix of all passages, by
    randomised subspace iteration. ``extra``: further rows (the items), held on the driver."""
    size = len(idf)
    rank = min(rank, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    strip_rows = 4096
    ids = known.select("ids")
    for _ in range(passes):
        basis = known.sparkSession.sparkContext.broadcast((q.astype(np.float32), idf.astype(np.float32)))  # vocabulary x rank

        def partial(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            q, idf = basis.value
            g = np.zeros((size, rank))
            for b in batches:
                for row, word, times in _passages(b, lookup.value, window, size):
                    if not len(row):
                        continue
                    x = times.astype(np.float32) * idf[word]
                    x /= np.sqrt(np.bincount(row, x * x))[row].astype(np.float32)
                    # Rows are in order: sums over a passage, then, by word, over all passages.
                    cut_ = np.flatnonzero(np.diff(row, prepend=-1))
                    y = np.add.reduceat(q[word] * x[:, None], cut_)
                    at = np.repeat(np.arange(len(cut_)), np.diff(np.append(cut_, len(row))))
                    by = np.argsort(word, kind="stable")
                    cut_ = np.flatnonzero(np.diff(word[by], prepend=-1))
                    g[word[by][cut_]] += np.add.reduceat(y[at[by]] * x[by, None], cut_)
            part = range(0, size, strip_rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.int32()), pa.array([_partition()] * len(part), pa.int64()), pa.array([g[i : i + strip_rows].tobytes() for i in part], pa.binary())], names=["strip", "part", "g"])

        rows = _tree_sum(ids.mapInArrow(partial, "strip int, part long, g binary"), ids.rdd.getNumPartitions()).collect()
        g = np.zeros((size, rank))
        for r in rows:
            x = np.frombuffer(r.g).reshape(-1, rank)
            g[r.strip : r.strip + len(x)] = x
        if extra is not None:
            g += extra.T @ (extra @ q)
        q = np.linalg.qr(g)[0] if np.abs(g).sum() > 0 else q
    return q


def _project(ids: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Unit vectors of all windows of ``length`` words; a word's vector is added in
    the window's order, so that equal windows have equal vectors to the last bit."""
    e = weights[ids]
    n = len(ids) - length + 1
    v = e[:n].copy()
    for k in range(1, length):
        v += e[k : k + n]
    v = np.concatenate([v, np.full((n, 1), 1e-6)], axis=1)  # never zero
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _windows(ids: np.ndarray, length: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, length)


@dataclass(frozen=True)
class Model:
    """A block's latent space: word weights (idf times basis), idf, and the way from the corpus' ids."""

    weights: np.ndarray
    idf: np.ndarray
    lookup: Broadcast


def fit(c: Corpus, n: int, block: Block, window: int, rank: int) -> Model:
    """``n``: passages of the corpus (``passages``)."""
    size = len(block.vocabulary)
    lookup = c.known.spark.sparkContext.broadcast(c.lookup(block))  # a number for each word of the query set
    idf = np.log((n + 1) / (passage_frequencies(c.known.df, lookup, size, window) + 1)) + 1
    starts = [(w, i) for _, w in block.items for i in range(0, len(w), window)]
    extra = np.zeros((len(starts), size))
    for r, (w, i) in enumerate(starts):
        np.add.at(extra[r], w[i : i + window], idf[w[i : i + window]])
    extra /= np.maximum(np.linalg.norm(extra, axis=1, keepdims=True), 1e-12)
    return Model(latent_basis(c.known.df, lookup, idf, window, rank, extra=extra) * idf[:, None], idf, lookup)


def passages(c: Corpus, window: int) -> int:
    return c.known.df.agg(F.sum(F.ceil(F.col("n_words") / window))).first()[0] or 0


def leaks(docs: DataFrame, items: DataFrame, run: int = 12, rank: int = 48, min_cosine: float = 0.999, block_words: int = 200_000) -> DataFrame:
    """(doc_id, item_id): pairs that share a run of at least ``run`` consecutive words.

    ``docs(doc_id, text)``, ``items(item_id, text)``. Null, empty and shorter
    texts share nothing; repeated rows of either table give a pair once; texts
    of any length are read as a whole.
    """
    spark = docs.sparkSession
    out = None
    c = corpus(docs, items)
    n = passages(c, run)
    for block in item_blocks(items, block_words):
        m = fit(c, n, block, run, rank)
        wins, owner, vecs = [], [], []
        for item, w in block.items:
            if len(w) >= run:
                wins.append(_windows(w, run))
                vecs.append(_project(w, m.weights, run))
                owner.append(np.full(len(vecs[-1]), item))
        if not wins:
            continue
        # Unit vectors of cosine c are sqrt(2 - 2c) apart, and so at most that in any one coordinate:
        # sorted by the coordinate that spreads most, only a narrow band needs multiplying.
        V, W, O = np.concatenate(vecs), np.concatenate(wins), np.concatenate(owner)
        axis = int(V.std(axis=0).argmax())
        by = np.argsort(V[:, axis], kind="stable")
        band = float(np.sqrt(2 - 2 * min_cosine)) + 1e-5
        # Bounded by block_words: rank + run + 3 numbers per window.
        q = spark.sparkContext.broadcast((V[by], W[by], O[by], m.weights, axis, band, m.lookup.value))

        def search(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            qv, qw, qi, weights, axis, band, to = q.value
            qx = qv[:, axis].copy()
            for b in batches:
                lens = pa.compute.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False)
                flat = to[b.column("ids").flatten().to_numpy()]
                doc = np.repeat(b.column("doc_id").to_numpy(), lens)
                found = set()
                # Maximal runs of known words within a document: a leak lies in one of at least ``run`` words.
                known = flat >= 0
                begins = known & ~np.concatenate([[False], known[:-1]])
                ends_ = known & ~np.append(known[1:], False)
                borders = np.cumsum(lens)[:-1]
                begins[borders] |= known[borders]
                ends_[borders - 1] |= known[borders - 1]
                start, end = np.flatnonzero(begins), np.flatnonzero(ends_) + 1
                long = end - start >= run
                start, end = start[long], end[long]
                w, d, v = [], [], []
                held = 0
                for i, j in zip(start, end, strict=True):
                    w.append(_windows(flat[i:j], run))
                    d.append(np.full(len(w[-1]), doc[i]))
                    v.append(_project(flat[i:j], weights, run))
                    held += len(w[-1])
                    if held >= 4096 or j == end[-1]:
                        W, D, V = np.concatenate(w), np.concatenate(d), np.concatenate(v)
                        w, d, v, held = [], [], [], 0
                        # Windows that repeat (copies) are searched once.
                        _, one, back = np.unique(W, axis=0, return_index=True, return_inverse=True)
                        back = back.ravel()
                        along = np.argsort(V[one, axis], kind="stable")
                        hit_w, hit_q = [], []
                        for k in range(0, len(one), 128):
                            some = along[k : k + 128]
                            part = V[one[some]]
                            lo, hi = np.searchsorted(qx, [part[0, axis] - band, part[-1, axis] + band])
                            x, y = np.nonzero(part @ qv[lo:hi].T >= min_cosine)
                            hit_w.append(some[x])
                            hit_q.append(y + lo)
                        hw, hq = np.concatenate(hit_w), np.concatenate(hit_q)
                        ok = (W[one[hw]] == qw[hq]).all(axis=1)
                        items_of: dict[int, set[int]] = {}
                        for x, y in zip(hw[ok].tolist(), qi[hq[ok]].tolist(), strict=True):
                            items_of.setdefault(x, set()).add(y)
                        if items_of:
                            for r in np.flatnonzero(np.isin(back, list(items_of))):
                                found.update((int(D[r]), y) for y in items_of[int(back[r])])
                a = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in a], pa.int64()), pa.array([y for _, y in a], pa.int64())], names=["doc_id", "item_id"])

        x = c.known.df.where("ids is not null").select("doc_id", "ids").mapInArrow(search, "doc_id long, item_id long")
        out = x if out is None else out.unionByName(x)
    if out is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id")).limit(0)
    return out.distinct()


def _lcs(same: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs. ``same[i, j, p]``: word i
    of the one and word j of the other passage of pair p are equal."""
    row = np.zeros((same.shape[1] + 1, same.shape[2]), dtype=np.int16)
    for line in same:
        before = row[0]
        for j, eq in enumerate(line, 1):
            up = row[j].copy()
            np.maximum(np.maximum(up, row[j - 1]), before + eq, out=row[j])
            before = up
    return row[-1]


def _any_of(bits: np.ndarray, length: int) -> np.ndarray:
    """The bits set anywhere in each window of ``length`` rows, by doubling."""
    span = 1
    while 2 * span <= length:
        bits = bits[:-span] | bits[span:]
        span *= 2
    return bits[: len(bits) - (length - span)] | bits[length - span :]


class _Index:
    """From words to the item passages that hold them, with how many of a passage's positions
    each word fills, and how many telling ones. A document can only pass for passages of
    whose positions its words fill ``min_lcs`` (a common subsequence is no longer), and
    of whose telling positions they fill ``min_answer``."""

    def __init__(self, padded: np.ndarray, told: np.ndarray, size: int, min_lcs: float, min_answer: float):
        j, k = np.nonzero(padded >= 0)
        key, at = np.unique(padded[j, k].astype(np.int64) * len(padded) + j, return_inverse=True)
        self.passage = key % len(padded)
        self.filled, self.telling = np.bincount(at, minlength=len(key)), np.bincount(at, told[j, k], minlength=len(key))
        self.first = np.searchsorted(key // len(padded), np.arange(size + 1))
        # A passage without telling words is looked at for its words alone.
        self.least_filled, self.least_telling = min_lcs * (padded >= 0).sum(axis=1) - 1e-9, min_answer * told.sum(axis=1) - 1e-9

    def passages(self, ids: np.ndarray) -> np.ndarray:
        w = np.unique(ids[ids >= 0])
        n, at = self.first[w + 1] - self.first[w], self.first[w]
        some = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = self.passage[some]
        count = lambda x: np.bincount(of, x[some], minlength=len(self.least_filled))
        return np.flatnonzero((count(self.filled) >= self.least_filled) & (count(self.telling) >= self.least_telling))


def paraphrases(docs: DataFrame, items: DataFrame, window: int = 24, stride: int = 12, rank: int = 48, min_cosine: float = 0.4, min_lcs: float = 0.6, min_answer: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): per document and item the best
    pair of passages that passes all three thresholds.

    Passages are windows of ``window`` words: of items every ``stride`` words (a last
    window reaches the end), of documents every word, so that no copy lies between
    two windows; shorter texts are one passage. Both passages are projected and then
    scaled to unit length, so the cosine is that of the latent space; it says nothing
    of words that no item has, which the other two thresholds see. lcs_share is the
    longest common subsequence over the item passage's words, answer_share the part
    of the item passage's telling words found in the document passage: words with a
    digit and the quarter with the highest idf. Null and empty texts match nothing,
    repeated rows of either table give a pair once.
    """
    spark = docs.sparkSession
    out = None
    c = corpus(docs, items)
    n_passages = passages(c, window)
    for block in item_blocks(items, block_words):
        m = fit(c, n_passages, block, window, rank)
        telling = np.zeros(len(m.idf), dtype=bool)
        for x, i in block.vocabulary.items():
            telling[i] = any(c.isdigit() for c in x)
        telling |= m.idf >= np.quantile(m.idf, 0.75)
        ps = [(item, w[i : i + window]) for item, w in block.items for i in _starts(len(w), window, stride)]
        owner, size = np.array([item for item, _ in ps]), np.array([len(w) for _, w in ps])
        padded = np.stack([np.pad(w, (0, window - len(w)), constant_values=-2) for _, w in ps])
        told = np.where(padded >= 0, telling[padded], False)
        # The last row is the unknown word, -1.
        weights = np.concatenate([m.weights, np.zeros((1, m.weights.shape[1]))])
        qv = np.concatenate([_project(w, weights, len(w)) for _, w in ps])
        index = _Index(padded, told, len(m.idf), min_lcs, min_answer)
        q = spark.sparkContext.broadcast((weights, qv, owner, size, padded, told, index, m.lookup.value))  # bounded by the query set

        def search(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            weights, qv, owner, size, padded, told, index, to = q.value
            told_bits = np.packbits(told, axis=1)
            for b in batches:
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                held: list[tuple[np.ndarray, ...]] = []

                def check(doc: np.ndarray, w: np.ndarray, j: np.ndarray, cosine: np.ndarray, answer: np.ndarray) -> np.ndarray:
                    lcs = np.concatenate([np.zeros(0), *[_lcs(w[k : k + 8192].T[:, None, :] == padded[j[k : k + 8192]].T[None, :, :]) for k in range(0, len(w), 8192)]]) / size[j]
                    ok = np.flatnonzero(lcs >= min_lcs)
                    for d, i, *x in zip(doc[ok].tolist(), owner[j[ok]].tolist(), lcs[ok].round(6).tolist(), cosine[ok].astype(float).round(6).tolist(), answer[ok].round(6).tolist(), strict=True):
                        if tuple(x) > best.get((d, i), (-1.0,)):  # noqa: B023
                            best[d, i] = tuple(x)  # noqa: B023
                    return lcs

                def flush() -> None:
                    """Of a document's windows and one passage, that with most words in common first;
                    others only if their words in common leave room for a longer subsequence."""
                    *parts, common = [np.concatenate(x) for x in zip(*held, strict=True)]  # noqa: B023
                    doc, j = parts[0], parts[2]
                    order = np.lexsort((-common, j, doc))
                    first = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(j[order]) != 0))
                    head = order[first]
                    reached = check(*[x[head] for x in parts])[np.cumsum(first) - 1]
                    rest = order[~first & (common[order] / size[j[order]] >= reached - 1e-9)]
                    check(*[x[rest] for x in parts])
                    held.clear()  # noqa: B023

                n = 0
                for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                    ids = to[ids.values.to_numpy()]
                    some = index.passages(ids)
                    if not len(some):
                        continue
                    long = min(window, len(ids))
                    # A common subsequence is no longer than the known words of a window.
                    known = np.concatenate([[0], np.cumsum(ids >= 0)])
                    at = np.flatnonzero(known[long:] - known[:-long] >= min_lcs * size[some].min() - 1e-9)
                    # A long document is taken in stretches, the shorter the more passages it may leak.
                    stretch = max(64, 2_000_000 // (len(some) * window))
                    for k in range(0, len(at), stretch):
                        a = at[k : k + stretch]
                        part, rel = ids[a[0] : a[-1] + long], a - a[0]
                        # Which positions of each passage have their word in each window, as bits: words in common bound the subsequence.
                        seen = _any_of(np.packbits(part[:, None, None] == padded[some], axis=2), long)[rel]
                        t = told_bits[some]
                        n_told = np.bitwise_count(t).sum(axis=1, dtype=np.int64)
                        common = np.bitwise_count(seen).sum(axis=2, dtype=np.int64)
                        answer = np.where(n_told > 0, np.bitwise_count(seen & t).sum(axis=2, dtype=np.int64) / np.maximum(n_told, 1), 1.0)
                        ok = (common >= min_lcs * size[some] - 1e-9) & (answer >= min_answer)
                        if not ok.any():
                            continue
                        s = _project(part, weights, long)[rel] @ qv[some].T
                        x, y = np.nonzero(ok & (s >= min_cosine))
                        if len(x):
                            w = np.full((len(x), window), -3, dtype=np.int32)
                            w[:, :long] = _windows(ids, long)[a[x]]
                            held.append((np.full(len(x), doc), w, some[y], s[x, y], answer[x, y], common[x, y]))
                            n += len(x)
                            if n >= 8192:
                                flush()
                                n = 0
                if held:
                    flush()
                a = sorted(best.items())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in a], pa.int64()), pa.array([k[1] for k, _ in a], pa.int64()), *[pa.array([v[i] for _, v in a], pa.float64()) for i in (1, 0, 2)]], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        x = c.known.df.where("ids is not null").select("doc_id", "ids").mapInArrow(search, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
        out = x if out is None else out.unionByName(x)
    if out is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), *[F.lit(0.0).alias(c) for c in ("cosine", "lcs_share", "answer_share")]).limit(0)
    # Repeated document rows give a pair once.
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "answer_share")).alias("b"))
    return best.select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share")


def _starts(n: int, window: int, stride: int) -> list[int]:
    if n <= window:
        return [0] if n else []
    s = list(range(0, n - window + 1, stride))
    return s if s[-1] == n - window else [*s, n - window]
