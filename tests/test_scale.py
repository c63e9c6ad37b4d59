"""Plans that must keep their shape, so that they hold at any size."""

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wattloom.operators import knn
from wattloom.operators.cells import CellIndex
from wattloom.operators.counters import counter_steps
from wattloom.operators.grid import on_grid
from wattloom.operators.labels import with_owner
from wattloom.operators.vector_blocks import matrix_of
from wattloom.registry import QUERIES, specs
from wattloom.session import configure, scratch_path, scratch_root, shuffles_removed, spread, written
from wattloom.sources import items


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_vectors_are_cut_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    text = plan(knn.training_entries(df, "embedding", "vec_id", "label"))
    partial, exchange = text.index("Partial"), text.index("Exchange")
    assert "WindowGroupLimit" in text and exchange < partial
    assert text.count("Exchange hashpartitioning") == 1


def test_no_join_without_keys(spark):
    """No registered query pairs all rows with all rows."""
    for name in ("knn_partitioned", "cv_metrics_partitioned", "label_builder", "label_feature_join", "join_diagnostics"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_owner_map_is_not_forced_to_broadcast(spark, no_auto_broadcast):
    labels = spark.range(10).select(F.lit("n").alias("namespace"), F.col("id").cast("string").alias("pod"), F.lit(1.0).alias("ts"))
    owners = labels.select("namespace", "pod", F.lit("Job").alias("owner_kind"), F.lit("j").alias("owner_name"))
    assert "BroadcastHashJoin" not in plan(with_owner(labels, owners))


def test_busy_keys_are_segmented(spark, no_auto_broadcast):
    df = spark.range(1000).select((F.col("id") > 900).cast("string").alias("k"), F.col("id").cast("double").alias("ts"), F.col("id").alias("v"))
    out = counter_steps(df, ["k"], ["ts"], "v", max_group_rows=100)
    text = plan(out)
    assert "hashpartitioning(k" in text and "__segment" in text
    assert "SortMergeJoin" not in text  # the rows themselves are shuffled once, by key and segment


def test_samples_collapse_before_they_spread(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("s"), F.col("id").cast("double").alias("ts"), F.lit(1.0).alias("value"))
    text = plan(on_grid(df, ["s"], 0.0, 100.0, 10))
    assert text.index("Generate explode(sequence") < text.index("partial_max_by")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["time_bounds"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text


def test_tasks_follow_the_work(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    searcher = knn.Searcher(knn.training_entries(df, "embedding", "vec_id", "label"))
    assert searcher.partitions_for(0) == 1
    assert searcher.partitions_for(10**9) >= 1000


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_rows_that_make_much_work_are_spread(spark):
    """A file of few bytes stays in one task otherwise."""
    narrow = spark.range(0, 20_000, 1, 1)
    assert spread(narrow).rdd.getNumPartitions() == 4
    assert spread(narrow.limit(10)).rdd.getNumPartitions() == 1


def test_manifests_are_not_sent_to_the_driver(spark):
    """Their size is not that of the part table they are made from."""
    text = plan(specs.part_events(spark, SF))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_one_list_is_written_without_a_sort(spark):
    path = scratch_path(spark, "list")
    rows = spark.range(0, 5000, 1, 6).select(F.to_json(F.struct("id")).alias("value"))
    items.write_one_list(rows, '{"kind":"NList","items":[', "]}", path)
    files = spark.read.text(path, wholetext=True).collect()
    assert len(files) == 1 and sorted(x["id"] for x in json.loads(files[0][0])["items"]) == list(range(5000))
    empty = scratch_path(spark, "list")
    items.write_one_list(rows.filter("false"), "[", "]", empty)
    assert json.loads(spark.read.text(empty, wholetext=True).first()[0]) == []


def test_python_workers_are_shared_by_functions_and_local_rows(spark):
    """Workers of one parent process; each parent keeps a worker per core.  ``createDataFrame`` of a list runs in them too."""
    rows = configure(spark).range(0, 8, 1, 2)
    parents = rows.mapInPandas(lambda batches: (pd.DataFrame({"p": [os.getppid()]}) for _ in batches), "p long")
    local = spark.sparkContext.parallelize(range(8), 2).map(lambda _: os.getppid())
    assert len({r["p"] for r in parents.collect()} | set(local.collect())) == 1


def test_cells_of_a_query_are_looked_up_once(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    seen, other = spark.sparkContext.accumulator(0), CellIndex._other_cells

    def counted(self):
        inside = other(self).func

        @F.pandas_udf("array<int>")
        def look(vectors: pd.Series, bound: pd.Series, met: pd.Series) -> pd.Series:
            seen.add(len(vectors))
            return inside(vectors, bound, met)

        return look

    monkeypatch.setattr(CellIndex, "_other_cells", counted)
    entries = knn.training_entries(df, "embedding", "vec_id", "label")
    knn.with_neighbours(df, entries, features="embedding", limits=knn.Limits(0, 64, 200)).count()
    assert seen.value == df.count()


def test_queries_of_a_meeting_are_bounded():
    """Eight cells in one shard, each met by other queries."""
    cells = pd.DataFrame({"cell": range(8), "blocks": 1, "n": 10, "free": 10, "low": [[0.0]] * 8, "high": [[1.0]] * 8})
    index = CellIndex(None, cells, np.eye(8), 8, knn.Limits(meet_bytes=8 * 8 * 100))
    pieces, tasks = index._shards(np.full(8, 100), 800, 1)
    assert pieces["shard"].nunique() == 1 and tasks >= 800 / 100


def shuffled_bytes(df):
    """Of every exchange that ran for these rows."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "Exchange":
            total += node.metrics().get("dataSize").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_what_a_search_sends_grows_with_the_rows(spark):
    """Queries are not sent once per shard, nor entries once per part of the queries."""
    r, sent = np.random.default_rng(11), []
    for n in (500, 2000):
        rows = [(i, x.tolist(), float(i)) for i, x in enumerate(r.normal(size=(n, 32)))]
        df = spark.createDataFrame(rows, "id bigint, v array<double>, y double")
        limits = knn.Limits(0, 32, 100, task_bytes=8 * 32 * 1000, meet_bytes=8 * 32 * 50)
        searcher = knn.Searcher(knn.training_entries(df, "v", "id", "y"), limits=limits)
        found = searcher.search(df, "v")
        sent.append(shuffled_bytes(found))
        got = {x["id"]: x["neighbours"]["ids"] for x in found.collect()}
    assert sent[1] < 6 * sent[0]  # 4 times the rows, 16 times the pairs
    plain = {x["id"]: x["neighbours"]["ids"] for x in knn.with_neighbours(df, searcher.entries, 5, "v").collect()}
    assert got == plain


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_packed_rows_keep_labels_and_ids(spark, kind):
    r = np.random.default_rng(12)
    v = r.normal(size=(12, 6))[r.integers(0, 12, 700)] + r.normal(scale=0.3, size=(700, 6))
    v[100:160] = v[100]  # one vector for many rows
    df = spark.createDataFrame([(i, x.tolist(), float(i), i % 3) for i, x in enumerate(v)], "id bigint, v array<double>, y double, fold int")
    df = df.withColumn("id", F.col("id").cast(kind)).withColumn("y", F.when(F.col("id") != "7", F.col("y")))
    df = df.withColumn("fold", F.when(F.col("id") != "9", F.col("fold")))
    entries = knn.training_entries(df, "v", "id", "y", 4, "fold")
    small = knn.Limits(0, 20, 40, task_bytes=8 * 6 * 100, meet_bytes=8 * 6 * 30)
    plain, packed = (knn.Searcher(entries, 4, limits).search(df, "v", "fold").collect() for limits in (knn.Limits(), small))
    assert len(packed) == len(plain) == 700
    want = {x["id"]: x["neighbours"] for x in plain}
    for x in packed:
        found = x["neighbours"]
        assert (found["ids"], found["ys"]) == (want[x["id"]]["ids"], want[x["id"]]["ys"])
        assert found["distances"] == pytest.approx(want[x["id"]]["distances"], abs=1e-6)


def test_vectors_of_different_length_are_no_matrix():
    kind = pa.list_(pa.float32())
    rows = pa.chunked_array([pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]], kind), pa.array([[5.0, 6.0]], kind)])
    assert matrix_of(rows.slice(1)).tolist() == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    for odd in ([[1.0], [2.0, 3.0, 4.0]], [[1.0, 2.0], None]):
        with pytest.raises(ValueError):
            matrix_of(pa.chunked_array([pa.array(odd, kind)]))


def test_shuffles_go_when_a_table_is_written(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    rows = spark.range(1000).repartition(3, "id")
    inside = []
    with shuffles_removed(spark):
        inside.append(spark.conf.get(key))
    assert inside == ["true"] and spark.conf.get(key) == before
    assert written(rows, "once").count() == written(rows, "twice").count() == rows.count() == 1000


def test_whole_texts_come_in_small_batches(spark):
    """Ten thousand long texts in one batch would be held several times by either side of a Python function."""
    texts = configure(spark).range(0, 60, 1, 1).select(F.repeat(F.lit("words "), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    got = texts.mapInArrow(sizes, "rows long, bytes long").agg(F.sum("rows"), F.max("bytes")).first()
    assert got[0] == 60 and got[1] < 6 << 20
