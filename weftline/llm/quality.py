"""Per-document text statistics, and which documents are lists, tables or junk.

A document is cut into lines, lines are joined into blocks, and every block is
judged: tables by delimiters that stand in the same number (and order), or by
gaps that begin or end in the same columns, down consecutive lines; lists by
marks, keys and entries that do not fill the line, or, where entries take several
lines and look like sentences one by one, by an indentation or a line length
that returns after the same number of lines (indentation periodicity, line-length
autocorrelation); junk by what its characters and words are made of; prose by
common words and sentences: wrapped prose fills its lines (each next word would
not have fitted), entries do not. The kind with most characters is the document's.

Everything is per document, in Arrow batches, in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("prose", "list", "table", "junk")

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LINE = re.compile(r"\r\n|\r|\n")
_MARK = re.compile(r"\s*(?:[-*•‣·–+]|\(?\d{1,4}[.)]|\(?[a-z][.)])\s+\S")
_KEYED = re.compile(r"\s*[A-Z][\w-]*(?: \w+)?: +\S")
_END = re.compile(r"[.!?…][\"'”’)\]]*\s*$")
_SEP = re.compile(r"\s*\|?(?:\s*:?-{2,}:?\s*\|?)+\s*$")
_SENTENCE = re.compile(r"[^\W\d_]{2,}[.!?][\"'”’)]?(?:\s|$)")
_DNA = re.compile(r"[ACGTUN]{15,}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}[\s:]){5,}[0-9a-fA-F]{0,2}")
_CODE = re.compile(r"[A-Za-z0-9+/_=-]{24,}$")
_LOCANT = re.compile(r"(?<![\d.])\d,\d(?=-)")
_VOWEL = re.compile(r"[aeiouyäöüáéíóúàèêâîôûœæøå]", re.IGNORECASE)
# Counted by runs, not by characters.
_LETTERS, _DIGITS, _UPPER, _ALNUM, _FOREIGN = (re.compile(x) for x in ("[A-Za-z]+", r"\d+", "[A-Z]+", r"[^\W_]+", r"[^\x00-\x7f]+"))
_ODD = re.compile(r"[^\w.,;:'\"()\-–’“”%/|\t]|_")


def _length(rx: re.Pattern[str], s: str) -> int:
    return sum(map(len, rx.findall(s)))


#: Delimiters of table rows: a character, or two blanks.
_DELIMS = ("|", "\t", ";", ",", "  ")
_GAP = re.compile(r" {2,}")

STATISTICS = ("n_chars", "n_words", "mean_word_length", "symbol_share", "digit_share", "upper_share", "ended_line_share", "common_share", "distinct_word_share", "n_lines", "mean_line_length", "line_autocorrelation", "indent_share", "indent_period", "delimiter_alignment", "mark_share")


def _columns(line: str) -> tuple[int, ...]:
    """How often each delimiter occurs in a line. Commas and semicolons count without
    a blank after them, at the end only after others (an empty last cell);
    locants such as 3,4- are no delimiters; n blanks are n/2 delimiters."""
    if "," in line and line.count(",") > line.count(", "):
        s = _LOCANT.sub("_", line)
    else:
        s = line
    out = [s.count("|"), s.count("\t")]
    for d in ";,":
        n = s.count(d) - s.count(d + " ") if d in s else 0
        out.append(n if n > 1 or not s.endswith(d) else 0)
    out.append(sum(len(x) // 2 for x in _GAP.findall(line)) if "  " in line else 0)
    return tuple(out)


def _autocorrelation(x: np.ndarray, lag: int = 1) -> float:
    """Of line lengths; 0 for fewer than lag + 2 lines, 1 where all are equal."""
    if len(x) < lag + 2:
        return 0.0
    d = x - x.mean()
    v = float((d * d).sum())
    return float((d[:-lag] * d[lag:]).sum() / v) if v > 0 else 1.0


def _period(indents: np.ndarray) -> int:
    """The distance (2 to 8 lines) after which indents repeat best, 0 if they never do."""
    if len(indents) < 4 or not indents.any():
        return 0
    best, at = 0.0, 0
    for lag in range(2, min(8, len(indents) // 2) + 1):
        if (a := _autocorrelation(indents, lag)) > best + 0.05:
            best, at = a, lag
    return at if best > 0.4 else 0


def _length_period(lens: np.ndarray) -> int:
    """The distance (2 to 8 lines) after which line lengths return, 0 if they do not: their
    autocorrelation there is high, and far above that of neighbouring lines."""
    if len(lens) < 8 or lens.min() == lens.max():
        return 0
    near = _autocorrelation(lens, 1)
    found = [(_autocorrelation(lens, lag), lag) for lag in range(2, min(8, len(lens) // 3) + 1)]
    best, at = max(found, key=lambda x: (x[0], -x[1]))
    return at if best >= 0.5 and best >= near + 0.5 else 0


def _gaps(line: str) -> tuple[frozenset[int], frozenset[int]]:
    """Columns in which the gaps of a line (two blanks or more, within it) begin, and end."""
    found = [m.span() for m in _GAP.finditer(line.rstrip(), len(line) - len(line.lstrip()))] if "  " in line else []
    return frozenset(a for a, _ in found), frozenset(b for _, b in found)


def _aligned(lines: list[str], row: list[bool]) -> None:
    """Marks runs of three or more lines whose gaps have two columns in common, at the
    left (ends of gaps) or the right of cells, or one in four or more short lines."""
    gaps = [_gaps(x) for x in lines]
    if sum(bool(a) for a, _ in gaps) < 3:
        return
    for side in (0, 1):
        for least, rows, width in ((2, 3, None), (1, 4, 40)):
            i = 0
            while i < len(lines):
                same, j = gaps[i][side], i + 1
                if len(same) >= least:
                    while j < len(lines) and len(both := same & gaps[j][side]) >= least:
                        same, j = both, j + 1
                    if j - i >= rows and (width is None or all(len(x) < width for x in lines[i:j])):
                        row[i:j] = [True] * (j - i)
                i = j


def _tables(lines: list[str]) -> tuple[list[bool], float]:
    """Which lines are rows of a table, and the share of lines so aligned: runs of three
    or more lines in which one delimiter occurs equally often (twice, or once in
    short rows of single words), or whose gaps stand in the same columns."""
    cols = [_columns(x) for x in lines]
    row = [False] * len(lines)
    for k, d in enumerate(_DELIMS):
        i = 0
        while i < len(lines):
            n = cols[i][k]
            j = i + 1
            if n:
                while j < len(lines) and cols[j][k] == n:
                    j += 1
                tight = n >= 2 or d in "|\t"
                # Two columns are believed where cells are short.
                if j - i >= 3 and (tight or all(len(x) < 40 for x in lines[i:j])) and (tight or j - i >= 4):
                    for x in range(i, j):
                        row[x] = True
            i = j
    _aligned(lines, row)
    return row, sum(row) / len(lines) if lines else 0.0


def _garbled(s: str, ws: list[str], common: float) -> bool:
    """Junk, by what a stretch of text is made of."""
    bare = s.replace(" ", "")
    if not bare:
        return False
    n = len(bare)
    if common >= 0.3 and len(ws) >= 5 and _SENTENCE.search(s):
        return False  # common words and the end of a sentence: readable
    letters = _length(_LETTERS, bare)
    if s[0] == ">" and s[1:2] != " " and len(s) < 40 and len(ws) <= 3:
        return True  # the header of a sequence
    if _length(_DNA, s) > 0.6 * n or _length(_HEX, s) > 0.6 * len(s):
        return True
    if n >= 24 and " " not in s.strip() and _CODE.fullmatch(s.strip()) and len(set(bare)) > 8:
        return True
    odd = len(_ODD.findall(bare))
    if n >= 12 and (odd > 0.2 * n or (not bare.isascii() and odd + _length(_FOREIGN, bare) > 0.4 * n)):
        return True
    if n >= 20 and letters < 0.5 * n and (n - letters - _length(_DIGITS, bare)) > 0.3 * n and "|" not in s and "\t" not in s:
        return True
    low = [w for w in ws if w.islower() and len(w) >= 3]
    if len(low) >= 4 and sum(not _VOWEL.search(w) for w in low) > 0.6 * len(low):
        return True
    return len(ws) >= 12 and len({w.lower() for w in ws}) < 0.25 * len(ws) and common < 0.2


def judge(text: str, common: frozenset[str], statistics: bool = True) -> tuple[dict[str, int], dict[str, float]]:
    """Characters per kind, and the statistics of a text (empty if not wanted)."""
    raw = _LINE.split(text)
    plain = [_TAG.sub(" ", x) if "<" in x else x for x in raw]
    lines = [x for x in plain if x.strip()]
    chars = dict.fromkeys(KINDS, 0)
    ws_of = [_WORD.findall(x) for x in lines]
    hits = [sum(w.lower() in common for w in ws) for ws in ws_of]
    row, aligned = _tables(lines)
    kind: list[str] = [""] * len(lines)
    for i, s in enumerate(lines):
        ws = ws_of[i]
        share = hits[i] / len(ws) if ws else 0.0
        if row[i]:
            kind[i] = "table"
        elif _garbled(s.strip(), ws, share):
            kind[i] = "junk"
    # A header, or a last row cut short, belongs to the table it touches.
    for i, s in enumerate(lines):
        if not kind[i] and _SEP.match(s) and any(kind[j] == "table" for j in (i - 1, i + 1) if 0 <= j < len(lines)):
            kind[i] = "table"
    # A short rest belongs to the encoded matter before it.
    for i in range(1, len(lines)):
        if not kind[i] and kind[i - 1] == "junk" and len(ws_of[i]) <= 2 and " " not in lines[i].strip():
            kind[i] = "junk"
    alone = [bool(_MARK.match(x)) or bool(_KEYED.match(x)) for x in lines]
    # A mark counts beside another one; alone among other lines it is a number or a dash that a wrap moved to the front.
    marks = [m and (len(lines) == 1 or any(alone[k] for k in (i - 1, i + 1) if 0 <= k < len(lines))) for i, m in enumerate(alone)]
    i = 0
    while i < len(lines):
        if kind[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and not kind[j]:
            j += 1
        _judge_stretch(lines, ws_of, hits, marks, kind, i, j)
        i = j
    for s, k in zip(lines, kind, strict=True):
        chars[k] += len(s.strip())
    return chars, _statistics(text, raw, lines, ws_of, hits, marks, aligned) if statistics else {}


def _strung(s: str, n: int, hits: int) -> bool:
    """Entries strung together: the denser the commas, the more common words are allowed."""
    commas = s.count(", ") + s.count("; ")
    return commas >= 3 and (commas >= n / 6 and hits < 0.15 * n or commas >= n / 4 and hits < 0.25 * n)


def _judge_stretch(lines: list[str], ws_of: list[list[str]], hits: list[int], marks: list[bool], kind: list[str], a: int, b: int) -> None:
    """Lists, prose and word salad among the lines a..b, none of which is decided yet."""
    width = max(len(x) for x in lines[a:b])
    i = a
    while i < b:
        s, ws = lines[i], ws_of[i]
        if marks[i] and not (len(ws) > 14 and _END.search(s) and hits[i] >= 0.15 * len(ws)):
            kind[i] = "list"
        elif len(ws) >= 6 and len(_SENTENCE.findall(s)) <= 1 and _strung(s, len(ws), hits[i]):
            kind[i] = "list"
        elif len(ws) >= 12 and hits[i] < 0.12 * len(ws) and not _SENTENCE.search(s) and s.count(",") < len(ws) / 12:
            kind[i] = "junk"
        i += 1
    # Lines without marks: entries, if several in a row neither end as sentences nor fill the line.
    i = a
    while i < b:
        if kind[i]:
            i += 1
            continue
        j = i
        while j < b and not kind[j]:
            j += 1
        block = range(i, j)
        loose = [k for k in block if not _END.search(lines[k]) and len(ws_of[k]) <= 10]
        # Narrow columns of words are no wrapped text.
        filled = sum(len(lines[k]) + 1 + len((lines[k + 1].split() or [""])[0]) > 0.92 * width for k in range(i, j - 1)) if width >= 40 else 0
        n = sum(len(ws_of[k]) for k in block)
        share = sum(hits[k] for k in block) / n if n else 0.0
        listed = j - i >= 3 and len(loose) >= 0.8 * (j - i) and filled <= 0.5 * (j - i - 1) and share < 0.25
        if not listed and j - i >= 6 and share < 0.25 and sum(bool(_END.search(lines[k])) for k in block) <= 0.6 * (j - i):
            # Entries of several lines: not wrapped text, and what stands in a line returns.
            full = sum(len(lines[k]) + 1 + len((lines[k + 1].split() or [""])[0]) > 0.92 * width for k in range(i, j - 1))
            if full <= 0.5 * (j - i - 1):
                lens = np.array([len(lines[k]) for k in block], dtype=float)
                listed = _period(np.array([len(lines[k]) - len(lines[k].lstrip()) for k in block], dtype=float)) > 0 or _length_period(lens) > 0
        beside = j - i < 3 and len(loose) == j - i and share < 0.2 and any(0 <= k < len(kind) and kind[k] == "list" for k in (i - 1, j)) and n <= 12 * (j - i)
        for k in block:
            kind[k] = "list" if listed or beside else "prose"
        i = j


def _statistics(text: str, raw: list[str], lines: list[str], ws_of: list[list[str]], hits: list[int], marks: list[bool], aligned: float) -> dict[str, float]:
    ws = [w for x in ws_of for w in x]
    n, lens = max(1, len("".join(text.split()))), np.array([len(x) for x in lines], dtype=float)
    indents = np.array([len(x) - len(x.lstrip()) for x in lines], dtype=float)
    k = max(1, len(lines))
    return {
        "n_chars": float(len(text)), "n_words": float(len(ws)), "mean_word_length": sum(map(len, ws)) / max(1, len(ws)),
        "symbol_share": (n - _length(_ALNUM, text)) / n, "digit_share": _length(_DIGITS, text) / n, "upper_share": _length(_UPPER, text) / n,
        "ended_line_share": sum(bool(_END.search(x)) for x in lines) / k, "common_share": sum(hits) / max(1, len(ws)), "distinct_word_share": len({w.lower() for w in ws}) / max(1, len(ws)),
        "n_lines": float(len(lines)), "mean_line_length": float(lens.mean()) if len(lens) else 0.0, "line_autocorrelation": _autocorrelation(lens),
        "indent_share": float((indents > 0).mean()) if len(lines) else 0.0, "indent_period": float(_period(indents)), "delimiter_alignment": aligned, "mark_share": sum(marks) / k,
    }


def text_quality(docs: DataFrame, common_words: DataFrame, statistics: bool = True) -> DataFrame:
    """One row per document: doc_id, kind, characters per kind (c_prose, ...), and the
    statistics unless they are not wanted (they take a third of the time).

    ``docs(doc_id, text)``, ``common_words(word)`` (a fixed list per language, used
    for all languages together). Null and blank texts have kind null and zero
    statistics. Ties between kinds go to prose, then list, then table.
    """
    spark = docs.sparkSession
    # A published list of a few hundred words per language, not data that grows.
    common = spark.sparkContext.broadcast(frozenset(r.word.lower() for r in common_words.where("word is not null").select("word").distinct().collect()))

    wanted = STATISTICS if statistics else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.value
        for b in batches:
            kinds, chars, stats = [], [], []
            for t in b.column("text").to_pylist():
                c, s = judge(t or "", words, statistics)
                chars.append(c)
                stats.append(s)
                kinds.append(max(KINDS, key=lambda k: c[k]) if any(c.values()) else None)  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(kinds, pa.string()), *[pa.array([c[k] for c in chars], pa.int64()) for k in KINDS], *[pa.array([s[k] for s in stats], pa.float64()) for k in wanted]],
                names=["doc_id", "kind", *[f"c_{k}" for k in KINDS], *wanted])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kind string, " + ", ".join([f"c_{k} long" for k in KINDS] + [f"{k} double" for k in wanted])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
