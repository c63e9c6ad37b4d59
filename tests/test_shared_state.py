"""Keys that share values of state: as many requests for state as buckets, and the results of one value per key."""

import random

import pytest
from pyspark.sql import Row, functions as F

from tests.test_streaming import by_arrival, iso, put, stream
from wattloom.streaming.dedup import BUCKETS, KEY, SECONDS, _Repeats, drop_repeats_stream


def run(df, path):
    """All files drained, and the query."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", str(path / "checkpoint"))
    query = writer.option("path", str(path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(path / "out")), query


def test_state_is_asked_for_by_bucket(spark, tmp_path):
    """20,000 new keys in a micro-batch: one value of state each took most of the time."""
    src = tmp_path / "in"
    src.mkdir()
    put(spark, [{"id": i, "k": f"k{i}", "ts": iso(100)} for i in range(20_000)], src, 0)
    out, query = run(drop_repeats_stream(stream(spark, src), ["k"], "ts", ["id"]), tmp_path)
    assert out.count() == 20_000
    assert query.lastProgress["stateOperators"][0]["numRowsUpdated"] <= BUCKETS < 20_000


@pytest.mark.parametrize("files", [1, 5])
def test_keys_in_one_bucket_do_not_meet(spark, tmp_path, files):
    """Two columns of keys, nulls and texts that look like JSON among them, in two buckets."""
    rng = random.Random(3)
    names = [(None, 1), ("null", 1), ("a", 1), ("a", None), ('a","k1":2', 1), ("a", 2), ("", 1), ("ü", 12)]
    rows = [(n, round(rng.uniform(0, 120) + 30 * n, 3), n * 100 + j, rng.randrange(len(names))) for n in range(5) for j in range(60)]
    src = tmp_path / "in"
    src.mkdir()
    for n in range(5):
        part = [{"id": i, "k": names[k][0], "m": names[k][1], "ts": iso(t), "file": f} for f, t, i, k in rows if f == n]
        put(spark, part, src, n)
    schema = "id long, k string, m int, ts timestamp, file int"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(str(src))
    marked = drop_repeats_stream(read, ["k", "m"], "ts", ["id"], arrival=["file"], buckets=2)
    assert marked.schema["ts"].dataType.typeName() == "timestamp" and marked.columns == read.columns
    out, query = run(marked, tmp_path)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    assert sorted(r["id"] for r in out.collect()) == by_arrival(rows)[0]
    given = {i: iso(t)[:26] for _, t, i, _ in rows}
    times = out.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t")).collect()
    assert all(r["t"] == given[r["id"]] for r in times)


def test_each_key_of_a_bucket_expires_by_itself():
    """Kept for 10 s of wall clock after it was last moved, whatever else is in its bucket."""

    class State:
        held = None

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

    class Clock:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    named = Row("k", KEY, SECONDS)
    work = _Repeats(5.0, 10.0, (), (), ("k",))
    work.named, work.last = Row("k", "late"), State()

    def came(now, *rows):
        return sorted(r["k"] for r in work.handleInputRows((0,), iter([named(k, k, t) for k, t in rows]), Clock(now)))

    assert came(0, ("a", 100.0)) == ["a"]
    assert came(8_000, ("b", 100.0), ("a", 101.0)) == ["b"]
    assert came(9_999, ("b", 100.5)) == []
    assert came(12_000, ("c", 100.0), ("b", 101.0)) == ["c"]
    assert came(18_500, ("a", 101.5), ("c", 101.0), ("b", 101.0)) == ["a"]
    assert sorted(work.last.held[0]) == ["a", "b", "c"]
    assert came(28_499, ("d", 1.0)) == ["d"]
    assert sorted(work.last.held[0]) == ["a", "c", "d"]  # b was last moved at 12 s
