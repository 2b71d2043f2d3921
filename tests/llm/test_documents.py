import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import leak, mixing, quality, tokens

ITEM = "Given the pedigree above, estimate how likely carriers are to pass ZC96 onwards if the marrow shows café-au-lait signs only"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("a clashing column"))


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_words():
    assert leak.words("<p>A <em>Café-au-lait</em>\nO'Neil_x  n°1</p>") == ["a", "cafe", "au", "lait", "o", "neil", "x", "n", "1"]
    assert leak.words(None) == [] and leak.words("  ") == []


def brute(texts, qs, n=12):
    gram = lambda t: {tuple(w[i : i + n]) for w in [leak.words(t)] for i in range(len(w) - n + 1)}
    g = [gram(q) for q in qs]
    return {(d, i) for d, t in enumerate(texts) for x in [gram(t)] for i, y in enumerate(g) if x & y}


def test_leaks_are_exact(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    qs = [ITEM, ITEM + " or the liver", None, "", "too short to share", *[" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(6)]]
    w = ITEM.split()
    texts = [f"Before. {ITEM.upper()} After.", "x " + " ".join(w[:11]) + " y", "x " + " ".join(w[2:14]) + " y", ITEM.replace("café", "<b>cafe</b>").replace(" ", "\n"), None, "", "nothing here", "pad " * 20_000 + ITEM, ITEM, ITEM]
    texts += [" ".join(rng.choice(vocab) for _ in range(30)) + " " + " ".join((qs[5 + k % 6].split())[5 : 5 + 9 + k % 6]) for k in range(12)]
    want = brute(texts, qs)
    got = {tuple(r) for r in leak.leaks(docs(spark, texts), items(spark, qs)).collect()}
    assert got == want and len(want) > 8
    in_blocks = {tuple(r) for r in leak.leaks(docs(spark, texts), items(spark, qs), block_words=50).collect()}
    assert in_blocks == want


def test_leaks_of_nothing(spark):
    assert leak.leaks(docs(spark, [None, ""]), items(spark, [ITEM])).count() == 0
    assert leak.leaks(docs(spark, [ITEM]), items(spark, [None, "short"])).count() == 0
    assert leak.leaks(docs(spark, [ITEM]).limit(0), items(spark, [ITEM])).count() == 0


def test_paraphrases(spark):
    near = ITEM.replace("estimate how likely", "say how probable").replace("onwards if", "further when")
    other = "The weather in the valley was mild and the river ran low for most of the summer that year and nobody minded"
    got = {(r.doc_id, r.item_id) for r in leak.paraphrases(docs(spark, [near, other, None, ITEM]), items(spark, [ITEM, other[:0]])).collect()}
    assert got == {(0, 0), (3, 0)}


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] + 1 if x == y else max(old[j], row[-1]))
    return row[-1]


def test_paraphrases_of_a_vocabulary_far_above_the_rank(spark):
    rng = random.Random(3)
    qs = [[f"t{i}q{k}" if k % 3 else f"shared{rng.randrange(400)}" for k in range(60)] for i in range(40)]
    texts = []
    for i in range(12):
        part = qs[i][(at := rng.randrange(30)) : at + 26]
        for k in rng.sample(range(26), i % 6):
            part[k] = f"new{k}"
        texts.append([f"pad{k}" for k in range(rng.randrange(40))] + part + ["after"] * rng.randrange(40))
    texts += [[f"pad{k}" for k in range(80)], [f"shared{rng.randrange(400)}" for _ in range(80)]]
    assert len({x for q in qs for x in q}) > 20 * 48
    starts = lambda n, step: sorted({*range(0, n - 23, step), n - 24})
    want = set()
    for d, t in enumerate(texts):
        for i, q in enumerate(qs):
            # All words with a digit are telling, so the answer share is that of the words in common.
            if any(subsequence(t[a : a + 24], q[b : b + 24]) >= 0.6 * 24 for b in starts(len(q), 12) for a in starts(len(t), 1)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in leak.paraphrases(docs(spark, [" ".join(t) for t in texts]), items(spark, [" ".join(q) for q in qs])).collect()}
    assert len(want) >= 10 and got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("replaced", [0.0, 0.1, 0.2, 0.3])
def test_planted_items_with_words_replaced(spark, replaced):
    """300 items set whole into 300 of 400 documents of the same vocabulary."""
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bdfgklmn" for b in ("ala", "ero", "imi", "otu", "upa", "ane", "iro", "ulo") for c in ("s", "x", "tis", "ma", "lin", "ter", "vin", "zol", "", "n9", "k", "d")]
    rng.shuffle(vocab)
    common = [1 / (k + 2) for k in range(len(vocab))]
    text = lambda n: rng.choices(vocab, common, k=n)
    qs = [text(rng.randrange(40, 110)) for _ in range(300)]
    texts = []
    for i in range(400):
        t = text(rng.randrange(60, 140))
        if i < 300:
            part = [rng.choice(vocab) if rng.random() < replaced else w for w in qs[i]]
            at = rng.randrange(len(t))
            t = t[:at] + part + t[at:]
        texts.append(" ".join(t))
    got = {(r.doc_id, r.item_id) for r in leak.paraphrases(docs(spark, texts), items(spark, [" ".join(q) for q in qs])).collect()}
    recall, precision = len(got & {(i, i) for i in range(300)}) / 300, len(got & {(i, i) for i in range(300)}) / len(got)
    print("replaced", replaced, "recall", recall, "precision", precision)
    assert recall >= (1.0 if replaced == 0 else 0.9) and precision >= 0.9


def test_bits_of_windows():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 256, (40, 2, 3)).astype(np.uint8) & rng.integers(0, 256, (40, 2, 3)).astype(np.uint8)
    for n in (1, 2, 3, 7, 24, 40):
        want = np.stack([np.bitwise_or.reduce(bits[i : i + n]) for i in range(41 - n)])
        assert (leak._any_of(bits, n) == want).all()


def test_sums_in_levels(spark):
    parts = spark.createDataFrame([(s, p, np.array([1.0, float(p)]).tobytes()) for s in (0, 4096) for p in range(100)], "strip int, part long, g binary")
    for width in (3, 32, 1000):
        assert {r.strip: np.frombuffer(r.g).tolist() for r in leak._tree_sum(parts, 100, width).collect()} == {0: [100.0, 4950.0], 4096: [100.0, 4950.0]}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "s", "Hello world, hello."), (2, None, None), (3, "s", ""), (4, "s", "é" * 10_000), (5, "s", "<|endoftext|>")], "doc_id long, source string, text string")
    n = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df).collect()}
    assert n[1] == 5 and n[2] == 0 and n[3] == 0 and 1000 < n[4] <= 20_000 and n[5] > 1


def test_rates_and_mixture(spark):
    sizes = spark.createDataFrame([(i, " A " if i % 2 else "a", 10) for i in range(400)] + [(1000 + i, "b", 10) for i in range(50)] + [(2000 + i, "c", 10) for i in range(550)] + [(3000, None, 7)], "doc_id long, source string, n_tokens long")
    w = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 4), ("d", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rates = {r.source: r for r in mixing.source_rates(sizes, w).collect()}
    assert rates["a"].size == 4000 and rates["a"].rate == pytest.approx(0.5 * 10007 / 4000) and not rates["a"].short
    assert rates["b"].rate == 4.0 and rates["b"].short and rates["d"].size == 0 and rates["d"].short and rates["d"].rate == 0.0
    r = mixing.source_rates(sizes, w)
    m = mixing.mix(sizes, r).collect()
    assert sorted((x.doc_id, x.source, x.copy_no) for x in m) == sorted((x.doc_id, x.source, x.copy_no) for x in mixing.mix(sizes, r).collect())
    per = {}
    for x in m:
        per.setdefault(x.source, {}).setdefault(x.doc_id, []).append(x.copy_no)
    assert set(per) == {"a", "b"} and all(sorted(c) == [1, 2, 3, 4] for c in per["b"].values()) and all(sorted(c) in ([1], [1, 2]) for c in per["a"].values())
    report = {x.source: x for x in mixing.share_report(mixing.mix(sizes, r), r).collect()}
    assert abs(report["a"].share_of_all - 0.5) < 0.03 and report["b"].used == 2000 and report["d"].used == 0
    assert mixing.mix(sizes.limit(0), mixing.source_rates(sizes.limit(0), w)).count() == 0


COMMON = ["the", "of", "and", "in", "to", "is", "was", "for", "with", "that", "it", "on", "as", "by", "at", "not", "had"]
PROSE = "The liver was not read as normal, and it had to be seen again in the spring. Most of the patients had to wait for that.\n"
CASES = [
    (PROSE * 3, "prose"), ("- " + "\n- ".join(f"drug{i}, acute type {i}" for i in range(9)), "list"), ("\n".join(f"AB{i}C\ndalnarpril{i}" for i in range(6)), "list"), (", ".join(f"GENE{i}, mild osteoma type {i}" for i in range(12)), "list"),
    ("\n".join(f"Gene: XY{i}" for i in range(8)), "list"), ("id,symbol,n\n" + "\n".join(f"{i},AB{i},9{i}8" for i in range(8)), "table"), ("| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x{i} |" for i in range(6)), "table"), ("a\tb\tc\n" + "\n".join(f"{i}\t\tx" for i in range(5)), "table"),
    ("n  id  score\n" + "\n".join(f"{i}  K{i}    7.1" if i % 2 else f"{i}  K{i}  2  7.1" for i in range(6)), "table"), (">seq\n" + "\n".join("ACGT" * 15 for _ in range(5)), "junk"), ("\n".join(" ".join(f"{(i * 7 + j * 31) % 256:02x}" for j in range(16)) for i in range(6)), "junk"),
    ("rash " * 40, "junk"), ("#&?[+ {+]</+&?{ %&% [&% %%{^ [# ?]{%^!!* {&/@$$* " * 3, "junk"), ("xkcdf qwrtp lkjhg zxcvb mnbvc pqrst hgfds wrtyp plkmn bvcxz", "junk"), ("modest marrow robust sclerosis mirrors weakness bladder recessive muscle seizures adrenal uneven trophy hypotonia", "junk"),
    (None, None), (" \n ", None), (PROSE + "\n".join(f"- entry{i}" for i in range(60)), "list"), (PROSE * 40 + "- a1\n- b2\n- c3", "prose"),
]


def test_kinds(spark):
    df = docs(spark, [t for t, _ in CASES])
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.text_quality(df, words).collect()}
    assert {CASES[i][0] and CASES[i][0][:30]: r.kind for i, r in got.items()} == {t and t[:30]: k for t, k in CASES}
    r = got[0]
    assert r.n_lines == 3 and r.ended_line_share == 1.0 and r.n_words == 78 and 0.3 < r.common_share < 0.7 and r.mean_word_length == pytest.approx(sum(map(len, PROSE.replace(",", "").replace(".", "").split())) / 26)
    assert got[5].delimiter_alignment == 1.0 and got[1].mark_share == 1.0 and got[15].n_words == 0
    assert quality.text_quality(df.limit(0), words).count() == 0


def test_tables_padded_to_fixed_columns():
    common = frozenset(COMMON)
    rng = random.Random(6)
    cell = lambda n: "".join(rng.choice("bdklmnrt") + rng.choice("aeiou") for _ in range(rng.randrange(2, n // 2 - 1)))
    rows = [[cell(16), cell(20), cell(14), cell(10)] for _ in range(12)]
    left = "\n".join("".join(c.ljust(n) for c, n in zip(r, (18, 22, 16, 10), strict=True)).rstrip() for r in rows)
    right = "\n".join("".join(c.rjust(n) for c, n in zip(r, (18, 22, 16, 12), strict=True)) for r in rows)
    for text in (left, right):
        chars = quality.judge(text, common)[0]
        assert max(chars, key=chars.get) == "table", chars
    loose = "\n".join(f"The liver was {cell(16)} not read  and it {cell(12)} had to be  seen again in {cell(14)}" + ("." if i % 2 else "  for the spring.") for i in range(6))
    assert quality.judge(loose, common)[0]["prose"] == sum(map(len, loose.split("\n")))


def _entries(indent: str):
    """Entries of two lines: a name, and what looks like a sentence."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdklmnrt") + rng.choice("aeiou") for _ in range(3))
    return "\n".join(f"{word()} {word()[:3]}\n{indent}" + " ".join(word() for _ in range(9)) + f" the {word()}." for _ in range(9))


def test_indentation_and_line_lengths_decide(monkeypatch):
    common = frozenset(COMMON)
    kind = lambda t: max(quality.KINDS, key=quality.judge(t, common)[0].get)
    rng = random.Random(9)
    # Lines of any length in which only the indentation returns.
    flat = "\n".join(("    " if k % 3 else "") + " ".join("".join(rng.choice("bdklmnrt") + rng.choice("aeiou") for _ in range(3)) for _ in range(rng.randrange(3, 11))) + ("." if k % 2 else "") for k in range(18))
    by_length, by_indent = _entries(""), flat
    assert kind(by_length) == kind(by_indent) == "list"
    with monkeypatch.context() as m:
        m.setattr(quality, "_length_period", lambda x: 0)
        assert kind(by_length) != "list" and kind(by_indent) == "list"
    with monkeypatch.context() as m:
        m.setattr(quality, "_period", lambda x: 0)
        assert kind(by_indent) != "list" and kind(by_length) == "list"
    # Paragraphs of equally many lines, the first one indented, are prose.
    wrapped = "\n".join(("   " if k % 4 == 0 else "") + "The liver was not read as normal, and it had to be seen again" for k in range(16))
    assert kind(wrapped) == "prose"
