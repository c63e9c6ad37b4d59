"""Fitting samples without a filter by length, many languages, stray fetch times, clashing names, a plain forward pass."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents
from wattloom.llm import language, mixing, toxicity, urllists
from wattloom.llm.sampling import keyed, sample
from wattloom.llm.wordtext import WordTable, letter_words


def test_long_rows_stand_in_where_short_ones_are_missing(spark):
    docs = documents(spark, [(i, f"short {i} " * 5, "a") for i in range(40)] + [(100 + i, f"long{i} " * 300, "a") for i in range(30)])
    labelled = keyed(docs, "doc_id", "text").withColumn("y", (F.col("k") >= 100).cast("int"))
    texts, ys = sample(docs, labelled, 10, 200)
    assert ys.count(0) == 10 and sum(len(t) for t, y in zip(texts, ys) if y) == 10 * 200
    assert all("long" in t for t, y in zip(texts, ys) if y)
    assert sample(docs, labelled, 10, 200) == (texts, ys)
    few, _ = sample(docs, labelled, 10, 200, total=1000)
    assert sum(map(len, few)) <= 1000
    whole, ys = sample(docs, labelled, 10, 10_000)
    assert len(whole) == 20 and all(len(t) > 1000 for t, y in zip(whole, ys) if y)
    assert sample(documents(spark, []), keyed(documents(spark, []), "doc_id", "text").withColumn("y", F.lit(1)), 10, 200) == ([], [])


def test_toxic_rows_that_are_all_long(spark):
    r = random.Random(3)

    def text(n, bad):
        out = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]
        for _ in range(4 * bad):
            out[r.randrange(n)] = r.choice(["vilest", "rotter"])
        return " ".join(out)

    rows = [(i, text(2000, True) if i % 2 else text(60, False), "a") for i in range(160)]
    docs = documents(spark, rows)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts, ys = toxicity.fit_rows(docs, labels)
    assert ys.count(1) == 80 and ys.count(0) == 80
    net = toxicity.train(docs, labels)
    out = toxicity.score(docs, net, out="s").collect()
    assert sum((x["s"] >= toxicity.THRESHOLD) == (x["doc_id"] % 2 == 1) for x in out) >= 140


def test_long_texts_of_a_language_are_learned(spark):
    rows = [(i, "the cat and the dog " * 10, "en") for i in range(30)] + [(50 + i, "der Hund und die Katze " * 1300, "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(*language.fit_rows(docs))
    assert model.languages == ["de", "en"]
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_two_hundred_languages():
    r = random.Random(1)
    vocabulary = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for _ in range(200)]
    model = language.fit([" ".join(words * 3) for words in vocabulary], [f"l{k:03}" for k in range(200)])
    table = WordTable(200, model.scores)
    found = language.label_texts(model, table, [" ".join(words) for words in vocabulary])
    assert [lang for lang, *_ in found] == [f"l{k:03}" for k in range(200)]


def test_stray_fetch_times(spark, monkeypatch):
    """Captures far ahead, in milliseconds and in microseconds: never more rows than entries and stretches asked for."""
    sizes, plain = [], urllists.written

    def counted(df, name):
        out = plain(df, name)
        if name == "intervals":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(urllists, "written", counted)
    entries = spark.range(100).select(
        F.lit("l").alias("list_name"), F.lit(False).alias("allow"), F.lit("bad.org").alias("pattern"),
        F.lit(True).alias("added"), (F.lit(1_600_000_000) + F.col("id") * 86_400).alias("at"),
    )
    for stray in (1_700_000_000, 253_402_300_799, 1_700_000_000_000, 1_700_000_000_000_000, -5):
        captures = spark.createDataFrame([(1, "http://bad.org/a", 1_650_000_000), (2, "http://bad.org/a", stray)], "entry long, url string, fetched long")
        out = urllists.judge(captures, entries)
        assert {x["entry"]: x["blocked"] for x in out.collect()} == {1: True, 2: stray > 0}
        assert sizes.pop() <= 200


def test_mixing_with_clashing_names(spark):
    docs = documents(spark, AWKWARD)
    want = sorted(map(str, mixing.mix(docs).select("doc_id", "size", "taken").collect()))
    for name in ("__source", "__size", "__draw", "__doc_0", "words"):
        docs = docs.withColumn(name, F.lit("mine"))
    out = mixing.mix(docs)
    assert sorted(map(str, out.select("doc_id", "size", "taken").collect())) == want
    assert out.select("__source", "words").distinct().collect() == [("mine", "mine")]


def test_scores_against_a_plain_forward_pass():
    """Word by word, window by window, in plain loops: the greatest window score of each text."""
    net = toxicity.Network.fresh(7)
    net.out[:] = np.linspace(-1, 1, len(net.out))
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 8))) for _ in range(n)) for n in (1, 5, 31, 32, 33, 56, 57, 130)]
    table = WordTable(6 * toxicity.HIDDEN, net.entries)
    got = toxicity.score_texts(net, table, [*texts, "", "1 2 3"])
    assert got[-2:].tolist() == [0.0, 0.0]
    for text, score in zip(texts, got):
        words = letter_words(text)
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        best = max(plain_logit(net, words[s : s + toxicity.WINDOW]) for s in starts if words[s : s + toxicity.WINDOW])
        assert math.isclose(score, 1 / (1 + math.exp(-best)), rel_tol=1e-3, abs_tol=1e-4)


def plain_logit(net, words):
    """One window through the network with vectors of one word at a time."""
    size = toxicity.HIDDEN
    entry = net.entries(words).astype(float)
    squash = lambda x: 1 / (1 + np.exp(-x))
    sides = []
    for d in (0, 1):
        state, seen = np.zeros(size), []
        for x in entry[:: -1 if d else 1]:
            x = x[3 * size * d : 3 * size * (d + 1)]
            h = state @ net.recur2[d]
            keep, reset = squash(x[:size] + h[:size]), squash(x[size : 2 * size] + h[size : 2 * size])
            new = np.tanh(x[2 * size :] + reset * h[2 * size :])
            state = keep * state + (1 - keep) * new
            seen.append(state)
        sides.append(seen[:: -1 if d else 1])
    states = np.array([np.r_[a, b] for a, b in zip(*sides)])
    weight = np.exp(np.tanh(states @ net.attend) @ net.query)
    return float((weight @ states / weight.sum()) @ net.out + net.shift[0])
