"""Shards against a plain version over awkward rows, hot sources and small tables."""

import hashlib
import random

from tests.llm.helpers import AWKWARD, documents
from wattloom.llm import sharding


def plain(rows, shards):
    """Rows (id, text, source) to sorted (id, shard, slot)."""
    drawn = lambda i: hashlib.md5(f"{sharding.SEED}:{'null' if i is None else i}".encode()).hexdigest()
    placed = []
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    for place, source in enumerate(sources):
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (drawn(r[0]), r[0] is not None, r[0] or 0))
        placed += [((k + 0.5) / len(own), place, k, r[0]) for k, r in enumerate(own)]
    out, seen = [], {}
    for at, (_, _, _, i) in enumerate(sorted(placed, key=lambda x: x[:3])):
        shard = at * shards // len(rows)
        seen[shard] = seen.get(shard, -1) + 1
        out.append((i, shard, seen[shard]))
    return sorted(out, key=repr)


def test_shards(spark):
    docs = documents(spark, AWKWARD)
    for shards in (1, 3, 24):
        out = sharding.assign_shards(docs, shards)
        assert out.columns == [*docs.columns, "shard", "slot"]
        assert sorted(((r["doc_id"], r["shard"], r["slot"]) for r in out.collect()), key=repr) == plain(AWKWARD, shards)
    again = sharding.assign_shards(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sharding.assign_shards(docs).collect()))
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def test_clashing_names(spark):
    docs = documents(spark, AWKWARD)
    for name in ("shard", "slot", "row", "rank", "at", "first", "__part", "of", "share", "lot"):
        docs = docs.withColumn(name, docs["n_chars"])
    out = sharding.assign_shards(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(AWKWARD)
    assert {r["rank"] for r in out.collect()} == {1}


def test_every_shard_has_the_mixture(spark):
    r = random.Random(2)
    rows = [(i, "t" * r.randrange(5), r.choice("aaaaaabbcd")) for i in range(5000)]
    out = sharding.assign_shards(documents(spark, rows), 24).collect()
    sizes, mixes = {}, {}
    for x in out:
        sizes[x["shard"]] = sizes.get(x["shard"], 0) + 1
        mixes[x["shard"], x["source"]] = mixes.get((x["shard"], x["source"]), 0) + 1
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    own = {s: sum(1 for _, _, t in rows if t == s) for s in "abcd"}
    assert all(abs(mixes.get((k, s), 0) - own[s] / 24) <= 4 for k in range(24) for s in own)
    for k in range(24):
        assert sorted(x["slot"] for x in out if x["shard"] == k) == list(range(sizes[k]))


def test_written_shards(spark, tmp_path):
    out = sharding.assign_shards(documents(spark, AWKWARD), 3)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in back.collect() if r["text"] and r["doc_id"]) == sorted(
        (r["doc_id"], r["text"], r["shard"], r["slot"]) for r in out.collect() if r["text"] and r["doc_id"]
    )
    assert back.count() == len(AWKWARD)
