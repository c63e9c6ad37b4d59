"""Spelling variants against all pairs of words, and counts against plain text handling."""

import random
import re
import zlib
from collections import Counter

from tests.llm.helpers import AWKWARD, documents, low
from wattloom.llm import spelling


def counts(rows, drop_every=None, min_length=6, min_count=5):
    out = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if drop_every and i is not None and h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, ratio=5):
    forms, out = {}, {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        forms[w], out[w] = form, (w, form, n, len(others), words[form] if form else None)
    return sorted((w, f, root(w, forms), n, k, m) for w, f, n, k, m in out.values())


def root(word, forms):
    while forms[word]:
        word = forms[word]
    return word


def found(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_counts(spark):
    texts = ["ÀÉÿ×÷ Strasse Übergang naïve cóoperate", "z" * 70 + "é" * 40, "日本語abcdefg日本 abcdefgx", "ABCDEFÉ abcdefé ABCDEFé"]
    rows = AWKWARD + [(100 + i, t, "a") for i, t in enumerate(texts)] + [(i, LONGER, "a") for i in range(200, 240)]
    for drop in (None, 2, 7):
        for shortest, least in ((6, 1), (1, 1), (6, 5)):
            got = spelling.word_counts(documents(spark, rows), drop_every=drop, min_length=shortest, min_count=least)
            want = {w: n for w, n in counts(rows, drop, shortest, least).items() if w}
            assert {r["word"]: r["n"] for r in got.collect()} == want
    assert spelling.word_counts(documents(spark, [])).count() == 0
    assert spelling.word_counts(documents(spark, [(1, None, "a"), (2, "", "a"), (None, "1 2 3", "a")])).count() == 0


LONGER = "letters lettérs letter lettters q" + "uv" * 60 + " endings"


def test_pairs_over_many_runs(spark):
    """A small alphabet, equal letters in a row, prefixes of each other: every pair once, however words are cut into runs."""
    r = random.Random(4)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(700)}
    words |= {"a" * k for k in range(6, 30)} | {"aaaaaab", "baaaaaa", "aaabaaa"}
    words = {w: r.choice([5, 6, 30, 150, 5000, 100_000]) for w in words}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    want = variants(words)
    for segment in (3, 50, 100_000):
        assert found(spelling.spelling_variants(df, segment=segment)) == want
    assert any(w != x and y != x for w, x, y, *_ in want if x)


def test_no_words_and_one(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(none).count() == 0
    assert found(spelling.spelling_variants(spark.createDataFrame([("lonely", 7)], "word string, n long"))) == [
        ("lonely", None, "lonely", 7, 0, None)
    ]
