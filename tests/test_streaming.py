"""Streams against their batch counterparts, over several micro-batches and restarts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from wattloom.operators.dedup import drop_repeats
from wattloom.streaming.dedup import StreamCounts, drop_repeats_stream
from wattloom.plans.model import KnnModel
from wattloom.plans.score import score_requests
from wattloom.streaming.jobs import fresh_events, read_failed, requests_of_events, score_events
from wattloom.sources.objects import stream_changes

DDL = "id int, k string, ts timestamp"


def drain(df, tmp_path, name="out"):
    writer = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
    writer.option("path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def put(spark, rows, path, n):
    """One file of rows, younger than the ones before it."""
    with open(path / f"{n:03}.json", "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    time.sleep(0.05)


def stream(spark, path, files=1):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", files).json(str(path))


def iso(seconds):
    return f"2024-01-01T{int(seconds) // 3600:02}:{int(seconds) // 60 % 60:02}:{seconds % 60:09.6f}Z"


def test_fixture_and_expiry(spark, tmp_path):
    """One key at 0, 5, 14, 30, 330 s, each in a micro-batch of its own."""
    src = tmp_path / "in"
    src.mkdir()
    for n, t in enumerate([0, 5, 14, 30, 330]):
        put(spark, [{"id": n, "k": "a", "ts": iso(t)}], src, n)
    out = drain(drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"]), tmp_path)
    assert sorted(r["id"] for r in out.collect()) == [0, 3, 4]


def test_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(
        [{"id": i, "k": rng.choice(["hot", "hot", "hot", "b", "c"]), "ts": iso(rng.uniform(0, 400))} for i in range(150)],
        key=lambda r: r["ts"],
    )
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        part = rows[n * 50 : n * 50 + 50]
        rng.shuffle(part)
        put(spark, part, src, n)
    out = drain(drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"]), tmp_path)
    batch = spark.read.schema(DDL).json(str(src)).withColumn("t", F.unix_micros("ts") / 1e6)
    want = {r["id"] for r in drop_repeats(batch, ["k"], "t", ["id"]).collect()}
    assert {r["id"] for r in out.collect()} == want and len(want) > 10


def test_late_first_sightings_come_out(spark, tmp_path):
    """Each file a micro-batch, partly out of order; every key is new but one, whose late row is a repeat."""
    src = tmp_path / "in"
    src.mkdir()
    times = [(0, "a", 3000), (1, "b", 3005), (2, "c", 600), (3, "d", 3600), (4, "e", 0), (5, "a", 2990), (6, "f", 3599)]
    for n, (i, k, t) in enumerate(times):
        put(spark, [{"id": i, "k": k, "ts": iso(t)}], src, n)
    out = drain(drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"]), tmp_path)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 4, 6]


def test_one_far_future_event_forgets_nothing(spark, tmp_path):
    """A stray time a year ahead, then repeats of the other keys in later micro-batches."""
    src = tmp_path / "in"
    src.mkdir()
    put(spark, [{"id": 0, "k": "a", "ts": iso(100)}, {"id": 1, "k": "b", "ts": iso(101)}], src, 0)
    put(spark, [{"id": 2, "k": "stray", "ts": iso(100).replace("2024", "2025")}], src, 1)
    for n in range(2, 5):
        put(spark, [{"id": 10 * n, "k": "a", "ts": iso(100 + n)}, {"id": 10 * n + 1, "k": "b", "ts": iso(101 + n)}], src, n)
    out = drain(drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"]), tmp_path)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2]


def by_arrival(rows, ttl=10):
    """Kept ids and number of late rows, one row after the other; rows are (file, time, id, key)."""
    seen, kept, late, start, last = {}, [], 0, {}, None
    for file, t, i, k in sorted(rows):
        if file != last:
            start, last = dict(seen), file
        late += k in start and t < start[k]
        if k not in seen or t - seen[k] > ttl:
            kept.append(i)
        seen[k] = max(t, seen.get(k, t))
    return sorted(kept), late


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_into_batches_keeps_the_same_rows(spark, tmp_path, seed):
    """Files out of order, handed over one, two or all at a time: one result, and one count of late rows."""
    rng = random.Random(seed)
    rows = [(n, round(rng.uniform(0, 120) + 25 * rng.choice([n, 4 - n]), 3), n * 100 + j, rng.choice("aaabcd")) for n in range(5) for j in range(30)]
    src = tmp_path / "in"
    src.mkdir()
    for n in range(5):
        put(spark, [{"file": f, "ts": iso(t), "id": i, "k": k} for f, t, i, k in rows if f == n], src, n)
    want, late = by_arrival(rows)
    assert late > 10
    for files in (1, 2, 9):
        counts = StreamCounts()
        spark.streams.addListener(counts)
        read = spark.readStream.schema(DDL + ", file int").option("maxFilesPerTrigger", files).json(str(src))
        out = drain(drop_repeats_stream(read, ["k"], "ts", ["id"], arrival=["file"]), tmp_path / str(files))
        assert sorted(r["id"] for r in out.collect()) == want
        for _ in range(50):  # progress is told by another thread
            if counts.total.get("repeats") == {"kept": len(want), "late": late}:
                break
            time.sleep(0.1)
        spark.streams.removeListener(counts)
        assert counts.total["repeats"] == {"kept": len(want), "late": late}


def test_work_follows_the_rows_of_a_batch(spark, tmp_path):
    """Many live keys, then one row: one value of state is written."""
    src = tmp_path / "in"
    src.mkdir()
    put(spark, [{"id": i, "k": f"k{i}", "ts": iso(100)} for i in range(4000)], src, 0)
    df = drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"])
    drain(df, tmp_path)
    put(spark, [{"id": 9999, "k": "k17", "ts": iso(200)}], src, 1)
    writer = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
    query = writer.option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsUpdated"] == 1
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "out")).count() == 4001


def test_rows_without_time_or_key(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(spark, [{"id": 0, "k": None, "ts": iso(1)}, {"id": 1, "k": None, "ts": iso(2)}, {"id": 2, "k": "a", "ts": None}, {"id": None, "k": "a", "ts": iso(3)}, {"id": 3, "k": "a", "ts": iso(3)}], src, 0)
    out = drain(drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"]), tmp_path)
    assert sorted((r["id"] is None, r["id"] or 0) for r in out.collect()) == [(False, 0), (True, 0)]


def test_restart_keeps_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(spark, [{"id": 0, "k": "a", "ts": iso(100)}], src, 0)
    df = drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"])
    drain(df, tmp_path)
    put(spark, [{"id": 1, "k": "a", "ts": iso(105)}, {"id": 2, "k": "a", "ts": iso(120)}], src, 1)
    assert sorted(r["id"] for r in drain(df, tmp_path).collect()) == [0, 2]


def test_simple_mode(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(spark, [{"id": i, "k": k, "ts": iso(t)} for i, (k, t) in enumerate([("a", 0), ("a", 3), ("b", 4)])], src, 0)
    out = drain(drop_repeats_stream(stream(spark, src), ["k"], "ts", exact=False), tmp_path)
    assert sorted(r["k"] for r in out.collect()) == ["a", "b"]


def test_event_selection(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def event(n, kind, ns, change="ADDED", version="1"):
        meta = {"namespace": ns, "name": "w", "resource_version": version}
        return {"type": change, "kind": kind, "ts": iso(n), "object": {"metadata": meta}}

    rows = [event(0, "Deployment", "a"), event(1, "Deployment", "a"), event(2, "Deployment", "a", version="2"),
            event(3, "Pod", "a"), event(4, "Job", "b"), event(5, "Job", "a", "DELETED"), event(6, "Job", "a", "MODIFIED")]
    put(spark, rows, src, 0)
    fresh = fresh_events(stream_changes(spark, str(src)), ("Deployment", "Job"), ["a"])
    got = drain(fresh, tmp_path).select("key_kind", "key_version").collect()
    assert sorted(tuple(r) for r in got) == [("Deployment", "1"), ("Deployment", "2"), ("Job", "1")]


def test_a_failing_event_costs_only_itself(spark, tmp_path):
    """One batch of 40 objects, two of which break the encoder: 38 are scored, two are kept aside and scored later."""
    src = tmp_path / "in"
    src.mkdir()

    def event(n):
        meta = {"namespace": "a", "name": f"w{n}", "resource_version": "1"}
        spec = {"template": {"spec": {"containers": [{"name": "c", "image": "i"}]}}}
        return {"type": "ADDED", "kind": "Deployment", "ts": iso(n), "object": {"kind": "Deployment", "metadata": meta, "spec": spec}}

    put(spark, [event(n) for n in range(40)], src, 0)

    class Breaking:
        broken = ("w7", "w31")

        def transform(self, rows, keep=()):
            stop = F.when(F.col("workload_name").isin(*self.broken), F.raise_error(F.lit("bad row"))).otherwise(F.lit(1.0))
            return rows.select(*keep, F.array(stop.cast("double"), F.lit(0.5)).alias("features"))

    train = spark.createDataFrame([(1, [1.0, 0.5], 3.0)], "id int, features array<double>, y double")
    model = KnnModel.fit(train, "y", id="id")
    requests = requests_of_events(stream_changes(spark, str(src)))
    out = str(tmp_path / "scores")
    score_events(requests, Breaking(), model, out, str(tmp_path / "c"), once=True, tolerate_failures=True).awaitTermination()
    scored = spark.read.parquet(out)
    assert {r["workload_name"] for r in scored.collect()} == {f"w{n}" for n in range(40)} - set(Breaking.broken)
    left = read_failed(spark, out)
    assert sorted(r["workload_name"] for r in left.collect()) == ["w31", "w7"]
    Breaking.broken = ("none",)
    assert {r["prediction"] for r in score_requests(left, Breaking(), model, keep=["ts"]).collect()} == {3.0}
