"""Windows, grid, de-duplication, joins, folds, metrics, neighbours against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wattloom.operators import cells, keys, knn, labels as lab
from wattloom.operators.previous import in_segments, with_previous
from wattloom.operators.counters import counter_steps
from wattloom.operators.dedup import drop_repeats
from wattloom.operators.folds import deal_runs, with_folds
from wattloom.operators.grid import grid_max, grid_sum, on_grid
from wattloom.operators.metrics import fold_metrics, summary


@pytest.fixture(scope="module")
def skewed(spark):
    """Samples of 5 pods; one holds a third of all rows."""
    rng = random.Random(1)
    rows, n = [], 0
    for pod, size in (("hot", 300), ("b", 200), ("c", 200), ("d", 199), (None, 1)):
        for t in rng.sample(range(1000), size):
            rows.append((n, "ns", pod, t + rng.random(), round(rng.uniform(0, 50), 2)))
            n += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id int, namespace string, pod string, ts double, value double")


def steps_by_hand(rows):
    by = defaultdict(list)
    for i, ns, pod, ts, v in rows:
        by[pod].append((ts, i, v))
    out = {}
    for series in by.values():
        last = None
        for ts, i, v in sorted(series):
            out[i] = None if last is None else max(v - last, 0.0)
            last = v
    return out


@pytest.mark.parametrize("limit", [None, 10**6, 150, 7, 1])
def test_counter_steps(skewed, limit):
    rows, df = skewed
    out = counter_steps(df, order=("ts", "id"), max_group_rows=limit)
    assert out.columns == df.columns + ["energy_step_j"]
    got = {r["id"]: r["energy_step_j"] for r in out.collect()}
    assert got == steps_by_hand(rows)


def test_counter_fixture(spark):
    df = spark.createDataFrame([("n", "p", float(t), v) for t, v in enumerate([10.0, 15.0, 12.0, 20.0])],
                               "namespace string, pod string, ts double, value double")
    got = [r[0] for r in counter_steps(df).orderBy("ts").select("energy_step_j").collect()]
    assert got == [None, 5.0, 0.0, 8.0]


@pytest.mark.parametrize("step,lookback", [(60, 300), (60, 20), (7, 50), (100, 100)])
def test_grid(skewed, step, lookback):
    rows, df = skewed
    start, end = 105.0, 903.0
    want = {}
    for pod in {r[2] for r in rows}:
        series = sorted((ts, v) for _, _, p, ts, v in rows if p == pod)
        for n in range(int((end - start) // step) + 1):
            at = start + n * step
            seen = [(ts, v) for ts, v in series if at - lookback < ts <= at]
            if seen:
                want[pod, at] = seen[-1][1]
    out = on_grid(df, ["namespace", "pod"], start, end, step, lookback=lookback, tie_break="id")
    assert {(r["pod"], r["ts"]): r["value"] for r in out.collect()} == want
    total = grid_sum(df, ["namespace"], ["namespace", "pod"], start=start, end=end, step=step, lookback=lookback)
    sums, tops = defaultdict(float), {}
    for (_, at), v in want.items():
        sums[at] += v
        tops[at] = max(v, tops.get(at, v))
    assert {r["ts"]: r["value"] for r in total.collect()} == pytest.approx(dict(sums))
    top = grid_max(df, ["namespace"], ["namespace", "pod"], start=start, end=end, step=step, lookback=lookback)
    assert {r["ts"]: r["value"] for r in top.collect()} == tops


def repeats_by_hand(rows, ttl):
    last, kept = {}, set()
    for i, _, pod, ts, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if pod not in last or ts - last[pod] > ttl:
            kept.add(i)
        last[pod] = ts
    return kept


@pytest.mark.parametrize("ttl", [1, 3.5, 10])
def test_drop_repeats(skewed, ttl):
    rows, df = skewed
    out = drop_repeats(df, ["pod"], tie_break=["id"], ttl=ttl)
    assert out.columns == df.columns
    assert {r["id"] for r in out.collect()} == repeats_by_hand(rows, ttl)


def test_drop_repeats_fixture(spark):
    df = spark.createDataFrame([("k", float(t)) for t in (0, 5, 14, 30)], "k string, ts double")
    assert sorted(r["ts"] for r in drop_repeats(df, ["k"]).collect()) == [0.0, 30.0]


def test_power_energy(spark):
    ddl = "namespace string, pod string, ts double, avg_power_w double"
    power = spark.createDataFrame([("n", "a", 1.0, 5.0), ("n", "b", 1.0, 6.0)], ddl)
    energy = spark.createDataFrame([("n", "a", 1.0, 9.0), ("n", "c", 1.0, 7.0)],
                                   ddl.replace("avg_power_w", "energy_step_j"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(lab.join_power_energy(power, energy)) == [("n", "a", 1.0, 5.0, 9.0), ("n", "b", 1.0, 6.0, None)]
    none = power.filter("false")
    assert rows(lab.join_power_energy(none, energy)) == [("n", "a", 1.0, None, 9.0), ("n", "c", 1.0, None, 7.0)]
    assert rows(lab.join_power_energy(power, None)) == [("n", "a", 1.0, 5.0, None), ("n", "b", 1.0, 6.0, None)]
    with pytest.raises(ValueError):
        lab.join_power_energy(none, energy.filter("false"))


def test_owners_and_rollup(spark):
    owners = spark.createDataFrame([("n", "a", "ReplicaSet", "x-0123456789", 1.0)],
                                   "ns string, pod string, owner_kind string, owner_name string, ts double")
    dump = spark.createDataFrame([("n", "a", "Job", "j")],
                                 "namespace string, pod string, owner_kind string, owner_name string")
    steps = spark.createDataFrame([("n", "a", 1.0, 5.0, None), ("n", "a", 2.0, 7.0, None), (None, "a", 2.0, 7.0, 1.0)],
                                  "namespace string, pod string, ts double, avg_power_w double, energy_step_j double")
    chosen = lab.choose_owners(owners, dump)
    timed = lab.with_owner(steps, chosen).filter("namespace = 'n'").orderBy("ts").collect()
    assert [(r["workload_kind"], r["workload_name"]) for r in timed] == [("Deployment", "x"), ("Pod", "a")]
    static = lab.with_owner(steps, lab.choose_owners(owners.filter("false"), dump))
    out = lab.rollup(static).collect()
    assert [tuple(r) for r in out] == [("n", "Job", "j", "a", 6.0, 0.0)]
    with pytest.raises(ValueError):
        lab.choose_owners(owners.filter("false"), dump, "prom")


def test_aliases(spark):
    df = spark.createDataFrame([("n", "p", "u")], "container_namespace string, podname string, pod_uid string")
    assert lab.rename_aliases(df).columns == ["namespace", "pod", "pod_uid"]
    kept = spark.createDataFrame([("n", "m")], "namespace string, ns string")
    assert lab.rename_aliases(kept).columns == ["namespace", "ns"]


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "y double")
    assert [r[0] for r in lab.finite(df, "y").collect()] == [1.0]


def test_join_features_and_report(spark):
    left = spark.createDataFrame([("n", "a", 1), ("n", "a", 2), ("n", "b", 3), (None, "a", 4)],
                                 "namespace string, canon_name string, l int")
    right = spark.createDataFrame([("n", "a", "h2"), ("n", "a", "h1"), ("n", "c", "h3")],
                                  "namespace string, canon_name string, _spec_hash string")
    got = sorted((r["l"], r["_spec_hash"]) for r in keys.join_features(left, right).collect())
    assert got == [(1, "h1"), (1, "h2"), (2, "h1"), (2, "h2")]
    one = keys.join_features(left, right, dedupe_features=True)
    assert sorted((r["l"], r["_spec_hash"]) for r in one.collect()) == [(1, "h1"), (2, "h1")]
    assert tuple(keys.join_report(left, right).first()) == (2, 2, 1)
    assert tuple(keys.join_report(left.filter("false"), right.filter("false")).first()) == (0, 0, 0)
    assert [tuple(r) for r in keys.shared_keys(left, right).collect()] == [("n", "a")]
    assert [tuple(r) for r in keys.sample_keys(left, ["canon_name"], 1).collect()] == [("a",)]


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "x string, y int")
    got = {(r["column"], r["value"]): r["rows"] for r in keys.profile(df, ["x", "y"]).collect()}
    assert got == {("x", "a"): 2, ("x", None): 1, ("y", "1"): 1, ("y", "2"): 2}


def test_dealing_by_runs_is_dealing_one_by_one():
    rng = random.Random(1)
    for _ in range(2000):
        folds = rng.randint(2, 5)
        runs = [(size, rng.randint(1, 25)) for size in sorted(rng.sample(range(1, 40), rng.randint(1, 8)), reverse=True)]
        got = [order[k % len(order)] for _, first, last, order in deal_runs(runs, folds) for k in range(last - first + 1)]
        loads, want = [0] * folds, []
        for size, n in runs:
            for _ in range(n):
                want.append(loads.index(min(loads)))
                loads[want[-1]] += size
        assert got == want


def test_folds(spark):
    rows = [(g, i) for g, n in (("a", 50), ("b", 30), ("c", 30), ("d", 10), ("e", 9), ("f", 1), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    out = with_folds(df, "g", 3)
    per_group = out.groupBy("g").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_group) and out.count() == len(rows)
    fold = {r["g"]: r["fold"] for r in out.collect()}
    assert fold == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 2, None: 2, "f": 1}
    sizes = {r["fold"]: r["n"] for r in with_folds(df, "g", 3).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 10
    assert with_folds(df.filter("g in ('a', 'b')"), "g").select("fold").distinct().count() == 2
    with pytest.raises(ValueError):
        with_folds(df.filter("g = 'a'"), "g")


def test_metrics(spark):
    rows = [(0, 1.0, 2.0), (0, 3.0, 3.0), (1, 5.0, 5.0), (1, 5.0, 5.0), (2, 5.0, 5.0), (2, 5.0, 6.0), (3, 1.0, 1.0)]
    out = fold_metrics(spark.createDataFrame(rows, "fold int, target double, prediction double"))
    got = {r["fold"]: (r["mae"], r["r2"]) for r in out.collect()}
    assert got[0] == (0.5, 0.5) and got[1] == (0.0, 1.0) and got[2] == (0.5, 0.0)
    assert math.isnan(got[3][1])
    total = summary(out.filter("fold < 3")).first()
    assert total["mae_mean"] == pytest.approx(1 / 3) and total["mae_std"] == pytest.approx(np.std([0.5, 0, 0.5]))


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors with exact copies, scaled copies and zero vectors; one vector has a third of all rows."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)).astype("float32")
    rows = []
    for i in range(300):
        if i % 3 == 0:
            v = base[0]
        elif i % 50 == 1:
            v = base[0] * 0
        elif i % 7 == 0:
            v = base[i % 60] * 2
        else:
            v = base[i % 60] + (rng.normal(size=6).astype("float32") if i % 2 else 0)
        rows.append((int(rng.integers(10**9)) * 1000 + i, [float(x) for x in v], float(i % 17), i % 4))
    return rows, spark.createDataFrame(rows, "id bigint, v array<float>, y double, fold int").repartition(3)


def nearest_by_hand(rows, k, exclude):
    x = np.array([r[1] for r in rows], dtype="float64")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    d = np.round(1 - u @ u.T, 9)
    # equal vectors may differ in the last bit of a product: share one distance per pair of vectors
    first = {}
    where = [first.setdefault(tuple(r[1]), i) for i, r in enumerate(rows)]
    out = {}
    for i, r in enumerate(rows):
        order = sorted(
            (d[where[i], where[j]], s[0]) for j, s in enumerate(rows) if not (exclude and s[3] == r[3])
        )[:k]
        out[r[0]] = [s for _, s in order]
    return out


@pytest.mark.parametrize("exclude", [None, "fold"])
@pytest.mark.parametrize("limits", [knn.Limits(), knn.Limits(0, 16, 20, 8), knn.Limits(0, 1000, 1000, 1), knn.Limits(0, 16, 20, 8, 400)])
@pytest.mark.parametrize("k", [1, 5])
def test_neighbours(vectors, exclude, limits, k):
    rows, df = vectors
    entries = knn.training_entries(df, "v", "id", "y", k, exclude)
    assert entries.agg(F.max(F.size("ids"))).first()[0] == k
    found = knn.with_neighbours(df, entries, k, "v", exclude, limits=limits)
    assert found.columns == df.columns + ["neighbours"]
    got = {r["id"]: list(r["neighbours"]["ids"]) for r in found.collect()}
    want = nearest_by_hand(rows, k, exclude)
    assert got == want
    y = {r[0]: r[2] for r in rows}
    means = {r["id"]: r["prediction"] for r in knn.with_prediction(found).collect()}
    assert means == pytest.approx({i: np.mean([y[j] for j in n]) for i, n in want.items()})


def test_neighbours_edges(spark, vectors):
    _, df = vectors
    few = knn.training_entries(df.limit(2), "v", "id", "y", 5)
    got = knn.with_neighbours(df, few, 5, "v")
    assert {len(r["neighbours"]["ids"]) for r in got.collect()} == {2}
    nulls = df.limit(1).withColumn("v", F.lit(None).cast("array<float>"))
    for limits in (knn.Limits(), knn.Limits(0)):
        out = knn.with_prediction(knn.with_neighbours(nulls, few, 5, "v", limits=limits))
        assert [r["prediction"] for r in out.collect()] == [None]
    with pytest.raises(ValueError):
        knn.with_neighbours(df, few.filter("false"), 5, "v")
    ranked = knn.neighbour_rows(got, ["id"]).collect()
    assert len(ranked) == 600 and {r["rank"] for r in ranked} == {1, 2}


def clusters(spark, n=1200, centers=12, width=8):
    r = np.random.default_rng(5)
    middle = r.normal(size=(centers, width))
    x = middle[np.arange(n) % centers] + r.normal(scale=0.02, size=(n, width))
    return spark.createDataFrame([(i, v.tolist(), float(i), i % 3) for i, v in enumerate(x)], "id bigint, v array<double>, y double, fold int")


def test_a_table_is_cut_once_and_far_cells_are_not_met(spark, monkeypatch):
    df = clusters(spark)
    entries = knn.training_entries(df, "v", "id", "y", 5, "fold")
    built, asked = [], []
    build, meet = cells.CellIndex.build, cells.CellIndex._meet
    monkeypatch.setattr(cells.CellIndex, "build", staticmethod(lambda *a: built.append(1) or build(*a)))
    monkeypatch.setattr(cells.CellIndex, "_meet", lambda self, q, k: asked.append(q.count()) or meet(self, q, k))
    searcher = knn.Searcher(entries, 5, knn.Limits(0, 50, 100))
    first = searcher.search(df, "v", "fold").collect()
    second = searcher.search(df, "v", "fold").collect()
    assert len(built) == 1 and len(searcher.index.cells) == 24
    assert sorted(map(repr, first)) == sorted(map(repr, second))
    assert asked[0] + asked[1] < 1200 * 12  # of 1200 x 24 meetings
    plain = knn.with_neighbours(df, entries, 5, "v", "fold").collect()
    assert {r["id"]: r["neighbours"]["ids"] for r in first} == {r["id"]: r["neighbours"]["ids"] for r in plain}


def test_candidates_are_cut_before_the_shuffle(spark):
    df = clusters(spark, 200)
    out = knn.Searcher(knn.training_entries(df, "v", "id", "y"), 5, knn.Limits(0, 50, 100)).search(df, "v")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2  # in every task, and after the shuffle


def test_wide_vectors_make_small_blocks():
    assert knn.Limits().rows_of(64, 4096) == 4096
    assert knn.Limits().rows_of(10_000, 20_000) * 10_000 * 8 <= 64 << 20


def test_nearest_cells_only(spark):
    df = clusters(spark)
    searcher = knn.Searcher(knn.training_entries(df, "v", "id", "y"), 5, knn.Limits(0, 50, 100))
    probes = searcher.probes_for(df, 0.9, "v")
    assert probes and probes < 24
    exact = {r["id"]: set(r["neighbours"]["ids"]) for r in searcher.search(df, "v").collect()}
    found = {r["id"]: set(r["neighbours"]["ids"]) for r in searcher.search(df, "v", probes=probes).collect()}
    assert all(len(found[i]) == 5 for i in exact)
    assert sum(len(found[i] & exact[i]) for i in exact) >= 0.88 * 5 * len(exact)


def test_near_copies_keep_their_own_targets(spark):
    """Vectors that a product cannot tell apart, and one vector written at two lengths."""
    base = [0.3, 0.4, 0.5, 0.6]
    near = [0.3, 0.4, 0.5, 0.6001]
    rows = [(1, near, 100.0), (2, base, 7.0), (3, [3 * x for x in base], 9.0)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, y double")
    for limits in (knn.Limits(), knn.Limits(0)):
        entries = knn.training_entries(df, "v", "id", "y", 1)
        found = knn.with_prediction(knn.with_neighbours(df, entries, 1, "v", limits=limits))
        got = {r["id"]: r["prediction"] for r in found.collect()}
        assert got[1] == 100.0 and got[2] == 7.0


@pytest.mark.parametrize("kind", ["stray", "one_time", "no_time"])
def test_previous_row_of_busy_keys(spark, kind):
    """A time far off, rows that share one time, and missing times; segments never exceed the limit."""
    time = {"stray": lambda i: 0.0 if i == 7 else 1e9 + i, "one_time": lambda i: 5.0, "no_time": lambda i: None if i % 3 else float(i)}[kind]
    rows = [("a", time(i), i, float(i * i % 101)) for i in range(1000)] + [(None, float(i), i, 1.0 + i) for i in range(120)] + [("b", 1.0, 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, t double, id bigint, v double").repartition(5, "id")
    found = with_previous(df, ["k"], ["t", "id"], {"last": "v"}, max_group_rows=50)
    got = {(r["k"], r["id"]): r["last"] for r in found.collect()}
    want, before = {}, {}
    for k, _, i, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0.0, x[2])):
        want[k, i], before[k] = before.get(k), v
    assert got == want
    sizes = in_segments(df, ["k"], ["t", "id"], 50).groupBy("__segment").count()
    assert sizes.agg(F.max("count")).first()[0] == 50


def test_close_queries_meet_close_entries_only(monkeypatch):
    r = np.random.default_rng(7)
    v = r.normal(size=(40, 8))[r.integers(0, 40, 4000)] + r.normal(scale=0.01, size=(4000, 8))
    entries = pd.DataFrame({"features": list(v), "exclude": np.nan, "ids": [[i] for i in range(4000)], "ys": [[1.0]] * 4000})
    block, met, products = knn.Block(entries, 5), [], knn.Block._products
    monkeypatch.setattr(knn.Block, "_products", lambda self, q, x, c: met.append(products(self, q, x, c)) or met[-1])
    asked = np.concatenate([v[:1000], v[:1000]])  # equal queries are searched once
    row, ids, _, _ = block.search(list(asked))
    assert sum(m.size for m in met) < 0.3 * 2000 * 4000
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(np.square(unit[:1000, None] - unit[None]).sum(axis=2), axis=1, kind="stable")[:, :5]
    assert (ids.reshape(2000, 5)[:1000] == want).all() and (ids.reshape(2000, 5)[1000:] == want).all()


def test_a_query_goes_to_a_shard_once(spark, monkeypatch):
    """However many cells are met, queries are not repeated per cell; no entry counts twice."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(r.normal(size=(600, 16)))], "id bigint, v array<double>, y double")
    cut, shards = [], cells.CellIndex._shards
    monkeypatch.setattr(cells.CellIndex, "_shards", lambda self, *a: cut.append(shards(self, *a)) or cut[-1])
    searcher = knn.Searcher(knn.training_entries(df, "v", "id", "y"), 5, knn.Limits(0, 16, 50))
    got = {x["id"]: x["neighbours"]["ids"] for x in searcher.search(df, "v").collect()}
    assert len(searcher.index.cells) > 30 and all(p["shard"].nunique() <= 2 for p, _ in cut)
    plain = {x["id"]: x["neighbours"]["ids"] for x in knn.with_neighbours(df, searcher.entries, 5, "v").collect()}
    assert got == plain
