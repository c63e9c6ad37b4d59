"""The manifest against plain hashing: every proof, folded after tampering, over small and deep trees."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, LONG, documents, low, sha
from wattloom.llm import merkle, midstate


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def level(nodes):
    return [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]


def climb(nodes, at, now):
    """Root of the tree over ``nodes``, siblings of place ``at`` on the way, root with that place replaced."""
    proof = []
    while len(nodes) > 1:
        first = at // 8 * 8
        run = nodes[first : first + 8]
        proof += run[: at - first] + run[at - first + 1 :]
        now = sha("".join(run[: at - first] + [now] + run[at - first + 1 :]))
        nodes, at = level(nodes), at // 8
    return nodes[0], proof, now


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        leaf = sha("".join(map(field, r)))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        changed = sha("".join(map(field, (*r[:4], low(r[4]) if hit and r[4] is not None else r[4]))))
        groups.setdefault(r[2], []).append((r[0], leaf, changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [climb([x[1] for x in groups[g]], 0, "")[0] for g in order]
    out = []
    for k, g in enumerate(order):
        for at, (i, leaf, changed) in enumerate(groups[g]):
            subroot, proof, now = climb([x[1] for x in groups[g]], at, changed)
            root, more, folded = climb(tops, k, now)
            out.append((i, leaf, subroot, root, sha("".join(proof + more)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def given(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_hash_states():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(40)]
    states = midstate.from_bytes(np.frombuffer(b"".join(digests), np.uint8))
    now = np.repeat(midstate.START, 40, axis=1)
    for n in range(1, 4):
        now = midstate.from_bytes(midstate.to_bytes(midstate.step(now, midstate.hex_blocks(states))))
        out = midstate.to_bytes(midstate.close(now, np.full(40, n)))
        assert [d.tobytes().hex() for d in out] == [sha(d.hex() * n) for d in digests]


def test_awkward_rows(spark):
    rows = [(i, s, "en" if i != 3 else None, 1, t) for i, t, s in AWKWARD]
    docs = documents(spark, AWKWARD).withColumn("at", F.lit("x")).withColumn("block", F.lit("y"))
    docs = docs.withColumn("lang", F.when(~docs["doc_id"].eqNullSafe(3), "en"))
    assert found(merkle.verify_documents(docs)) == plain(rows)
    assert merkle.verify_documents(given(spark, [])).count() == 0
    assert found(merkle.verify_documents(given(spark, [(1, "a", None, None, None)]))) == plain([(1, "a", None, None, None)])


def test_one_group_of_many_blocks(spark):
    """Five levels in one language, other languages of 1, 8, 9 and 64 rows, more languages than one node has children."""
    sizes = {"big": 5000, "a": 1, "Ä": 8, "é": 9, None: 64, **{f"l{k}": 2 for k in range(10)}}
    rows, i = [], 0
    for lang, n in sizes.items():
        for k in range(n):
            rows.append((i if k % 50 or not k else (1 << 60) + i, "s", lang, k, LONG if i == 17 else f"Text {k % 7}"))
            i += 1
    out = found(merkle.verify_documents(given(spark, rows)))
    assert out == plain(rows)
    assert {v for *_, v in out} == {True, False}
