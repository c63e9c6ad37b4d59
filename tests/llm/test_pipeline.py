"""The pipeline's stages one by one, each judged on what it was given, and the registered queries' shapes."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm.helpers import low, reach, simhash
from wattloom.llm.common import written
from wattloom.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_queries_and_sql():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near_dedup"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    con = duckdb.connect()
    toxic = dict(con.execute(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        gone = set(before) - set(after)
        if name != "mixing":
            assert out.columns == docs.columns
            assert all(after[i] == before[i] for i in after)
        if name == "toxicity":
            assert len(gone) < len(before) / 4
            assert sum(toxic.get(i) == 0 for i in gone) <= 2
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                best[low(r["text"])] = max(i, best.get(low(r["text"]), i))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            prints = {i: simhash(r["text"]) for i, r in before.items()}
            label = reach(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
            least = {}
            for i, f in prints.items():
                least[label[f]] = min(i, least.get(label[f], i))
            assert set(after) == set(least.values())
        elif name == "mixing":
            taken, targets = {}, {}
            for r in after.values():
                taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
                targets[r["source"]] = r["target"]
            assert not gone
            assert all(abs(taken[s] - targets[s]) <= 0.05 * targets[s] + 5 for s in targets)
        docs, before = out, after


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_without_documents(spark, stage):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, empty, SF).count() == 0
