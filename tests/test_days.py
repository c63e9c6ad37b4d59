"""Tables laid out by day: what is written, replaced and read."""

import os

import pytest
from pyspark.sql import functions as F

from wattloom.plans.labels import labels_from_samples
from wattloom.sources.days import day_of, in_days, read_days, write_by_day

DAY = 86400
DDL = "namespace string, pod string, container string, ts double, value double"


def folders(path):
    return sorted(f[4:] for f in os.listdir(path) if f.startswith("day="))


def files_read(df):
    """Files that the scans of a plan choose by folder."""
    leaves, total = df._jdf.queryExecution().sparkPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        scan = leaves.apply(k)
        if scan.getClass().getSimpleName() == "FileSourceScanExec":
            total += scan.selectedPartitions().totalNumberOfFiles()
    return total


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "samples")
    # ten days of hourly samples of two containers, most of them on day 3, and awkward times
    rows = [("n", "p", c, h * 3600.0 + 1, float(h)) for h in range(240) for c in "ab"]
    rows += [("n", f"q{k}", "a", 3.0 * DAY + k, 1.0) for k in range(500)]
    rows += [("n", "p", "a", t, 7.0) for t in (None, float("nan"), float("inf"), -1.0, 1e18, 253402300799.0)]
    write_by_day(spark.createDataFrame(rows, DDL), path, keys=["namespace", "pod"])
    return path, rows


def test_days_of_times(spark):
    times = spark.createDataFrame([(0.0,), (-0.5,), (86399.9,), (1e300,), (None,), (-62135596800.0,)], "t double")
    got = [str(r[0]) for r in times.select(day_of(F.col("t"))).collect()]
    assert got == ["1970-01-01", "1969-12-31", "1970-01-01", "None", "None", "0001-01-01"]


def test_every_row_is_kept(spark, samples):
    path, rows = samples
    back = read_days(spark, path)
    assert back.count() == len(rows) and back.filter("day is null").count() == 4
    assert folders(path) == ["1969-12-31", *(f"1970-01-{d:02}" for d in range(1, 11)), "9999-12-31", "__HIVE_DEFAULT_PARTITION__"]


def test_ranges_read_their_days_only(spark, samples):
    path, rows = samples
    every = files_read(read_days(spark, path))
    for lo, hi, days in ((2 * DAY, 4 * DAY - 1, {3, 4}), (2 * DAY + 5, 2 * DAY + 5, {3}), (20 * DAY, 30 * DAY, set())):
        got = read_days(spark, path, lo, hi)
        assert files_read(got) == len(days) < every
        assert {int(str(r[0])[-2:]) for r in got.select("day").distinct().collect()} == days
        inside = [r for r in rows if r[3] is not None and lo <= r[3] <= hi]
        assert got.filter(F.col("ts").between(lo, hi)).count() == len(inside)
    assert read_days(spark, path, start=9 * DAY).filter("ts = 1e18").count() == 1
    assert read_days(spark, path, end=DAY - 1).filter("ts = -1").count() == 1
    plain = spark.createDataFrame(rows, DDL)
    assert in_days(plain, 0, 1).count() == len(rows)


def test_a_day_written_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda n, v: spark.createDataFrame([("n", "p", "a", n * DAY + 5.0, v)], DDL)
    write_by_day(day(0, 1.0).union(day(1, 2.0)), path)
    write_by_day(day(1, 3.0), path)
    write_by_day(day(1, 3.0), path)
    assert sorted(r["value"] for r in read_days(spark, path).collect()) == [1.0, 3.0]
    write_by_day(day(0, 1.0).limit(0), path)
    assert read_days(spark, path).count() == 2
    only_null = str(tmp_path / "nulls")
    write_by_day(spark.createDataFrame([("n", "p", "a", None, 1.0)], DDL), only_null)
    assert read_days(spark, only_null).first()["day"] is None


def test_labels_read_the_days_of_their_range(spark, samples):
    path, rows = samples
    dump = spark.createDataFrame([("n", "p", "Job", "j")], "namespace string, pod string, owner_kind string, owner_name string")
    start, end = 5 * DAY, 6 * DAY - 1
    day_table, plain = spark.read.parquet(path), spark.createDataFrame(rows, DDL).coalesce(4)
    make = lambda t: labels_from_samples(t, t, None, dump, start, end, "1h", lookback=2 * 3600)
    got = make(day_table)
    # the range and its look-back touch two days, each read for power and for energy
    assert files_read(got) == 4 < 2 * files_read(day_table)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, make(plain).collect()))
    assert got.count() == 24
