"""A manifest of a dataset: hash trees whose nodes keep the hash state before each child, and folds that resume there."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattloom.llm import midstate
from wattloom.llm.common import lower_az, written
from wattloom.operators.ranks import with_rank

ARITY = 8
#: Levels that one task builds or folds for one block of leaves.
LEVELS = 4
BLOCK = ARITY**LEVELS
#: The fields of a leaf in the documents' manifest.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the roots of the others; these are numbered from 0.
TOP = -1

_NODE = "tree long, level int, at long, digest binary, children binary, states binary"


def field(value: Column) -> Column:
    """A field in a leaf's message: its length in bytes, a colon and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered(text: str | Column = "text", id_col: str | Column = "doc_id") -> Column:
    """The text, A-Z lower-cased where three divides the checksum of the id: a known change to be detected."""
    text = F.col(text) if isinstance(text, str) else text
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when((F.crc32(id_col.cast("string")) % 3 == 0) & text.isNotNull(), lower_az(text)).otherwise(text)


@dataclass
class Manifest:
    """``leaves``: ``tree, at, size, leaf`` and the columns carried along; ``nodes``: level by level digest, children and
    the state before each child; ``roots``: ``tree, group, size, subroot``; ``root``: that of all, null for no rows."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: str | None

    def save(self, path: str) -> None:
        for name in ("leaves", "nodes", "roots"):
            getattr(self, name).write.parquet(f"{path}/{name}")


def _count(size: int, level: int) -> int:
    """Nodes of a level of a tree over ``size`` leaves."""
    return -(-size // ARITY**level)


def _grow(block: pd.DataFrame) -> pd.DataFrame:
    """The nodes above one block of consecutive nodes, up to LEVELS levels, while the tree has more than one."""
    block = block.sort_values("at")
    tree, size, level = int(block["tree"].iloc[0]), int(block["size"].iloc[0]), int(block["level"].iloc[0])
    first, parts = int(block["at"].iloc[0]), []
    digests = midstate.from_bytes(np.frombuffer(b"".join(block["digest"]), np.uint8))
    for _ in range(LEVELS):
        if _count(size, level) == 1:
            break
        n = digests.shape[1]
        parents = -(-n // ARITY)
        children = np.minimum(ARITY, n - ARITY * np.arange(parents))
        blocks = midstate.hex_blocks(digests)
        state, states = np.repeat(midstate.START, parents, axis=1), np.zeros((parents, ARITY, 32), np.uint8)
        for slot in range(ARITY):
            there = np.flatnonzero(children > slot)
            states[there, slot] = midstate.to_bytes(state[:, there])
            state[:, there] = midstate.step(state[:, there], blocks[:, there * ARITY + slot])
        below = midstate.to_bytes(digests)
        digests, level, first = midstate.close(state, children), level + 1, first // ARITY
        done = midstate.to_bytes(digests)
        for k in range(parents):
            own = below[k * ARITY : k * ARITY + children[k]].tobytes()
            parts.append((tree, level, first + k, done[k].tobytes(), own, states[k, : children[k]].tobytes()))
    return pd.DataFrame(parts, columns=["tree", "level", "at", "digest", "children", "states"])


def build_nodes(leaves: DataFrame) -> DataFrame:
    """Nodes of all trees over ``tree, at, size, digest`` (binary), four levels a round."""
    now, level, rounds = leaves.withColumn("level", F.lit(0)).filter("size > 1"), 0, []
    sizes = leaves.filter("at = 0").select("tree", "size")
    while True:
        block = F.expr(f"at DIV {BLOCK}").alias("block")
        grown = now.groupBy("tree", block).applyInPandas(lambda key, rows: _grow(rows), _NODE)
        rounds.append(written(grown, "nodes"))
        level += LEVELS
        now = rounds[-1].filter(F.col("level") == level).join(sizes, "tree").filter(F.col("size") > ARITY**level)
        now = now.select("tree", "at", "size", "digest", "level")
        if not now.limit(1).count():
            break
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def _tree_roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, subroot``: the highest node of each tree, a lone leaf itself."""
    alone = leaves.filter("size = 1").select("tree", F.hex("digest").alias("digest"), F.lit(0).alias("level"))
    top = nodes.filter("at = 0").select("tree", F.hex("digest").alias("digest"), "level")
    best = alone.unionByName(top).groupBy("tree").agg(F.max_by("digest", "level").alias("subroot"))
    return best.withColumn("subroot", F.lower("subroot"))


def build_manifest(rows: DataFrame) -> Manifest:
    """A tree for each ``group`` of rows ``group, id, leaf`` (lower-case hex) and one over their roots.

    Leaves of a group stand in the order of ids, nulls first, rows of one id by their digest, so equal rows may
    stand for each other.  Groups are ordered bytewise, null first.  Both orders are range sorts, and a task never
    gets more than a block of 4,096 nodes, so a group with a third of all rows is many tasks' work.  No rows: no
    trees and no root.  Other columns of ``rows`` are carried along with the leaves.
    """
    spark = rows.sparkSession
    ranked = with_rank(rows, "group", "id", "leaf", out="rank", name="leaves")
    sizes = ranked.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    sizes = with_rank(sizes, "group", out="tree", name="trees").withColumnRenamed("group", "of")
    placed = ranked.join(sizes, F.col("group").eqNullSafe(F.col("of"))).withColumn("at", F.col("rank") - F.col("first"))
    leaves = written(placed.drop("of", "rank", "first", "group"), "manifest")
    digests = leaves.select("tree", "at", "size", F.unhex("leaf").alias("digest"))
    nodes = build_nodes(digests)
    roots = written(sizes.join(_tree_roots(digests, nodes), "tree").select("tree", F.col("of").alias("group"), "size", "subroot"), "roots")
    total = roots.count()
    over = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(total).cast("long").alias("size"), F.unhex("subroot").alias("digest"))
    above = build_nodes(over)
    root = _tree_roots(over, above).collect()  # one row
    return Manifest(leaves, nodes.unionByName(above), roots, root[0]["subroot"] if root else None)


def _joined(children: np.ndarray, slot: int) -> bytes:
    """Hex text of all children but one."""
    return (children[:slot].tobytes() + children[slot + 1 :].tobytes()).hex().encode()


def _resume(now: np.ndarray, states: np.ndarray, children: np.ndarray, counts: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Digests of parents after one child is replaced by ``now``: from the state before it over it and what stands right."""
    state = midstate.step(midstate.from_bytes(states[np.arange(len(slot)), slot]), midstate.hex_blocks(now))
    for ahead in range(1, ARITY):
        more = np.flatnonzero(slot + ahead < counts)
        if not len(more):
            break
        right = midstate.hex_blocks(midstate.from_bytes(children[more, slot[more] + ahead]))
        state[:, more] = midstate.step(state[:, more], right)
    return midstate.close(state, counts)


def _fold(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
    """Fold every leaf of a block to the root over the block's nodes and the nodes above it."""
    at = leaves["at"].to_numpy()
    now = midstate.from_bytes(np.frombuffer(bytes.fromhex("".join(leaves["changed"].to_pylist())), np.uint8))
    proofs = [hashlib.sha256() for _ in at]
    for _, level in nodes.to_pandas().groupby("step", sort=True):
        width = int(level["width"].iloc[0])  # leaves, or trees, under one child
        place = level["place"].to_numpy(np.int64)  # of each node in its level
        by_place = np.argsort(place)
        base = np.full(len(at), int(level["tree"].iloc[0])) if level["top"].iloc[0] else at
        own = by_place[np.searchsorted(place[by_place], base // (width * ARITY))]
        slot = base // width % ARITY
        counts = np.array([len(c) // 32 for c in level["children"]])
        states, children = (np.zeros((len(level), ARITY, 32), np.uint8) for _ in range(2))
        for k, (s, c) in enumerate(zip(level["states"], level["children"])):
            states[k, : counts[k]] = np.frombuffer(s, np.uint8).reshape(-1, 32)
            children[k, : counts[k]] = np.frombuffer(c, np.uint8).reshape(-1, 32)
        pieces = {}
        for i, (k, s) in enumerate(zip(own.tolist(), slot.tolist())):
            if (k, s) not in pieces:
                pieces[k, s] = _joined(children[k, : counts[k]], s)
            proofs[i].update(pieces[k, s])
        now = _resume(now, states[own], children[own], counts[own], slot)
    folded = pa.array([d.tobytes().hex() for d in midstate.to_bytes(now)], pa.string())
    kept = leaves.drop_columns(["changed", "block"]).append_column("proof_sha256", pa.array([p.hexdigest() for p in proofs], pa.string()))
    return kept.append_column("folded_root", folded)


def _levels_above(size: Column, lowest: int) -> Column:
    """A row for each level from ``lowest`` that a tree over ``size`` leaves has."""
    return F.explode(F.filter(F.sequence(F.lit(lowest), F.lit(20)), lambda x: size > F.pow(F.lit(ARITY), x - 1))).alias("level")


def fold(manifest: Manifest) -> DataFrame:
    """``leaves`` with ``proof_sha256, folded_root``: each leaf alone replaced by its ``changed`` digest.

    A task folds the leaves of a block together; it gets the nodes of that block and, of the levels above it and of
    the tree over the roots, the one node on the way.
    """
    leaves = manifest.leaves.withColumn("block", F.expr(f"at DIV {BLOCK}"))
    blocks = leaves.filter(f"at % {BLOCK} = 0").select("tree", "block", "size")
    is_top = F.col("tree") == TOP
    own = manifest.nodes.filter(~is_top & (F.col("level") <= LEVELS)).withColumn(
        "block", F.expr(f"CAST(at * power({ARITY}, level) AS BIGINT) DIV {BLOCK}")
    )
    high = manifest.nodes.filter(~is_top & (F.col("level") > LEVELS))
    way = blocks.select("tree", "block", _levels_above(F.col("size"), LEVELS + 1))
    way = way.withColumn("at", F.expr(f"block DIV CAST(power({ARITY}, level - {LEVELS}) AS BIGINT)"))
    crown = blocks.select("tree", "block", _levels_above(F.lit(manifest.roots.count()), 1))
    crown = crown.withColumn("at", F.expr(f"tree DIV CAST(power({ARITY}, level) AS BIGINT)"))
    crown = crown.join(manifest.nodes.filter(is_top).drop("tree"), ["level", "at"])
    steps = own.unionByName(way.join(high, ["tree", "level", "at"])).withColumn("top", F.lit(False))
    steps = steps.unionByName(crown.withColumn("top", F.lit(True))).select(
        "tree",
        "block",
        (F.col("level") + F.when(F.col("top"), 100).otherwise(0)).alias("step"),
        F.expr(f"CAST(power({ARITY}, level - 1) AS BIGINT)").alias("width"),
        F.col("at").alias("place"),
        "top",
        "states",
        "children",
    )
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.leaves.drop("changed").schema]
    both = leaves.groupBy("tree", "block").cogroup(steps.groupBy("tree", "block"))
    return both.applyInArrow(_fold, ", ".join([*kinds, "proof_sha256 string", "folded_root string"]))


def verify_documents(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: every row's proof, checked after tampering.

    Nulls are fields of their own, unlike empty ones; a null id or language comes first; rows without an id are
    not tampered with.  Repeated rows are leaves of their own; whole texts of any length enter the digest; columns
    not named in ``fields`` do not.  An empty table gives no rows.
    """
    values = [F.col(f"`{c}`") for c in fields]
    changed = [tampered(F.col(f"`{text_col}`"), F.col(f"`{id_col}`")) if c == text_col else F.col(f"`{c}`") for c in fields]
    rows = docs.select(
        F.col(group_col).cast("string").alias("group"),
        F.col(id_col).alias("id"),
        leaf_digest(*values).alias("leaf"),
        leaf_digest(*changed).alias("changed"),
    )
    manifest = build_manifest(rows)
    folded = fold(manifest).join(manifest.roots.select("tree", "subroot"), "tree")
    return folded.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.lit(manifest.root)).alias("verified"),
    )
