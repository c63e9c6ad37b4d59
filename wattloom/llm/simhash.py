"""Near duplicates by SimHash, found in the space of bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits, and each segment is mapped to its number of set
bits.  The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints.  So
within ``radius`` bits, one half of the vector (16 segments) is at most ``radius / 2`` apart.  The grid cells are
the half vectors themselves; each fingerprint goes to all cells within ``radius / 4`` (rounded up) of its own, and
two that are close enough share a cell, the one halfway.  Fingerprints of a cell are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wattloom.llm.common import LOWER_BYTES, small_or_not, text_of, unused, written
from wattloom.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
SHORT_RUN = 32  # cells with more fingerprints are searched from neighbour to neighbour


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in bytes; zero without words."""
    words = text.translate(LOWER_BYTES).split()  # bytes split at the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[i : i + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64)
        columns = [batch.column(0), batch.column(2), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, fp`` for every row, as a written table; ``digest`` is a hash of the text as it stands."""
    names = [StructField("id", docs.schema[id_col].dataType), StructField("digest", LongType()), StructField("fp", LongType())]
    schema = StructType(names)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_of(text_col)).alias("digest"))
    return written(narrow.mapInArrow(_fingerprints, schema), "fingerprints")


def _counts(half: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 two-bit segments of 32-bit numbers, packed two bits each."""
    low = np.uint64(0x55555555)
    return (half & low) + ((half >> np.uint64(1)) & low)


def _cells(steps: int):
    """Each fingerprint with every cell of either half within ``steps`` of its own."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                fp = whole["fp"].to_numpy()[at : at + 2000]
                bits = fp.view(np.uint64)
                for half, part in enumerate((bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))):
                    seen_cells, seen_fp = _counts(part), fp
                    for _ in range(steps):
                        cells, fps = [seen_cells], [seen_fp]
                        for segment in range(16):
                            one = np.uint64(1 << (2 * segment))
                            count = (seen_cells >> np.uint64(2 * segment)) & np.uint64(3)
                            up, down = count < 2, count > 0
                            cells += [seen_cells[up] + one, seen_cells[down] - one]
                            fps += [seen_fp[up], seen_fp[down]]
                        seen_cells, seen_fp = np.concatenate(cells), np.concatenate(fps)
                    # codes fill 32 bits without their top pair 11, so the half fits beside them
                    cell = seen_cells.astype(np.int64) | np.int64(half << 32)
                    rows = pd.DataFrame({"cell": cell, "fp": seen_fp})
                    yield rows if steps < 2 else rows.drop_duplicates()

    return spread


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the given ones: each node with the least of its group."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _walk(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all fingerprints of one large cell that are linked within it.

    Goes from neighbour to neighbour and compares with those not reached yet only, so a dense group costs one
    pass over it; no more edges than fingerprints come out.
    """
    left, starts, ends = np.unique(fp), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for one in front[:256]:
                hit |= _near(left, one, radius)
            new, left, front = left[hit], left[~hit], front[256:]
            starts.append(np.full(len(new), root))
            ends.append(new)
            front = np.concatenate([front, new])
    return np.concatenate([*starts, left]), np.concatenate([*ends, left])


def _links(radius: int):
    """Rows arrive sorted by cell; out come edges that join what is linked within each cell."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(cell: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            of = np.repeat(sizes, sizes)
            a, b = [], []
            for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
                x, y = _walk(fp[s : s + n].view(np.uint64), radius)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            short = (of > 1) & (of <= SHORT_RUN)
            c, f = cell[short], fp[short]
            for lag in range(1, SHORT_RUN):
                at = np.flatnonzero(c[lag:] == c[:-lag])
                if not len(at):
                    break
                x, y = f[at], f[at + lag]
                hit = _near(x.view(np.uint64), y.view(np.uint64), radius)
                a.append(x[hit])
                b.append(y[hit])
            if not a or not sum(map(len, a)):
                return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
            x, y = _spanning(np.concatenate(a), np.concatenate(b))
            return pd.DataFrame({"a": x, "b": y})

        for batch in batches:
            cell = np.concatenate([cell, batch["cell"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy()])
            if len(cell) < 100_000 or cell[0] == cell[-1]:
                continue
            last = int(np.searchsorted(cell, cell[-1]))
            yield edges(cell[:last], fp[:last])
            cell, fp = cell[last:], fp[last:]
        if len(cell):
            yield edges(cell, fp)

    return compare


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` over distinct fingerprints (column ``fp``) with the components of all links within ``radius``.

    Only enough links to join a component come out, never all pairs of a group.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius must be between 0 and 8 bits")
    cells = distinct.select("fp").mapInPandas(_cells(-(-radius // 4)), "cell long, fp long")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInPandas(_links(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row, and ``digest``, the hash of its text.

    Fingerprints with at most ``radius`` differing bits are linked; ``component_id`` is the smallest id that can be
    reached.  Null, empty and blank texts have fingerprint zero, which links like any other.  Rows that repeat an
    id or a text each come out.  A null id takes part but is never a ``component_id`` unless nothing else is in
    the component (then it is null).  An empty table gives an empty result; other columns are not looked at.
    """
    marked = fingerprints(docs, id_col, text_col)
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    found = components(written(linked(distinct, radius), "links"))
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    labelled = written(labelled, "labels")
    least = written(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "components")
    named = written(labelled.join(least, "component").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "digest",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component only; all columns stay.

    Rows that share an id are judged each by its own text; rows with a null id stay if nothing else is in their
    component.
    """
    key_id, key_digest = unused(docs, "__id", "__digest")
    decided = near_duplicates(docs, id_col, text_col)
    gone = decided.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "digest").distinct()
    gone = small_or_not(written(gone, "near-copies")).toDF(key_id, key_digest)
    match = docs[id_col].eqNullSafe(gone[key_id]) & (F.xxhash64(text_of(text_col)) == gone[key_digest])
    return docs.join(gone, match, "left_anti")
