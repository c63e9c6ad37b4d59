"""Large lists in one file, cut at any byte."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wattloom.sources.items import read_items
from wattloom.sources.objects import read_large_dump
from wattloom.sources.series import flatten_series, read_large_response


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def things(n):
    r = random.Random(n)
    odd = ['plain', 'a "quoted" }, { one', "back\\slash\\", "},{", '"items":[', "ä}日本{", "line\nbreak"]
    return [{"metadata": {"name": f"w{i}", "note": r.choice(odd)}, "items": [{"x": {"y": i}}, {"x": []}], "n": i} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 4])
@pytest.mark.parametrize("kind_first", [True, False])
def test_items_across_splits(spark, tmp_path, small_splits, indent, kind_first):
    for f, n in (("a", 60), ("b", 1), ("c", 0)):
        whole = {"kind": "PodList", "metadata": {"a": {"b": 1}}, "items": things(n)}
        if not kind_first:
            whole = dict(reversed(whole.items()))
        (tmp_path / f"{f}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=False))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 4
    out = read_large_dump(spark, str(tmp_path)).collect()
    assert {r["kind"] for r in out} == {"Pod"}
    got = sorted(json.dumps(json.loads(r["object"]), sort_keys=True) for r in out)
    assert got == sorted(json.dumps(x, sort_keys=True) for x in things(60) + things(1))


def test_response_across_splits(spark, tmp_path, small_splits):
    series = [{"metric": {"pod": f"p{i}", "namespace": "a}b"}, "values": [[t, str(i + t)] for t in range(5)]} for i in range(50)]
    (tmp_path / "r.json").write_text(json.dumps({"status": "success", "data": {"resultType": "matrix", "result": series}}))
    out = flatten_series(read_large_response(spark, str(tmp_path))).collect()
    assert sorted((r["pod"], r["namespace"], r["ts"], r["value"]) for r in out) == sorted(
        (f"p{i}", "a}b", float(t), float(i + t)) for i in range(50) for t in range(5)
    )
    assert read_items(spark, str(tmp_path), "result", 3).filter(F.col("kind").isNotNull()).count() == 0
