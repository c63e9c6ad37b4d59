"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

Every scan partition sends the sorted, distinct fingerprints of its texts to the owners of their ranges, as gaps
in Golomb-Rice code.  Owners answer each message with a bitmap of the fingerprints that occur elsewhere too.
Only texts behind a set bit (suspects) are shuffled; equal bytes decide.  A fingerprint has ten bits more than
are needed to number the rows, so about one row in a thousand is a suspect for nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wattloom.llm.common import LOWER_BYTES, lower_az, same, small_or_not, unused, written

SPARE_BITS = 10
MESSAGE_ROWS = 1 << 18  # fingerprints a task holds before it sends them
OWNER_ROWS = 1 << 19  # fingerprints an owner should get


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct integers as gaps: all unary quotients, then all k-bit remainders."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    quotient = (gaps >> k).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.int64)
    rest = ((gaps[:, None] >> shifts) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def rice_decode(payload: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8))
    stop = len(bits) - n * k
    ends = np.flatnonzero(bits[:stop] == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1 if n else 0
    rest = bits[start : start + n * k].reshape(n, k).astype(np.int64)
    weights = np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)
    return np.cumsum((quotient.astype(np.int64) << k) + rest @ weights)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        low = [(t.as_py() or b"").translate(LOWER_BYTES) for t in texts]
        sha = pa.array([hashlib.sha256(t).hexdigest() for t in low], pa.string())
        fp = pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in low], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sha, fp], names=["id", "sha", "fp"])


def _messages(bits: int, owners: int):
    shift = 63 - bits

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, rows, number = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            span = -(-(1 << bits) // owners)
            owner = values // span
            cuts = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(values)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                local = values[a:b] - owner[a] * span
                k = max(0, int(math.log2(max(1.0, span / (b - a) * math.log(2)))))
                mark = np.packbits(counts[a:b] > 1).tobytes()
                out.append((f"{task}-{number}", int(owner[a]), b - a, k, rice_encode(local, k), mark))
            return pd.DataFrame(out, columns=["message", "owner", "n", "k", "payload", "mark"])

        for batch in batches:
            held.append(batch["fp"].to_numpy() >> shift)
            rows += len(batch)
            if rows >= MESSAGE_ROWS:
                yield flush()
                held, rows, number = [], 0, number + 1
        if rows:
            yield flush()

    return send


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """One owner's messages: a bitmap for each, set where a fingerprint occurs more than once anywhere."""
    got = [rice_decode(p, n, k) for p, n, k in zip(group["payload"], group["n"], group["k"])]
    marks = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(v)] > 0 for m, v in zip(group["mark"], got)]
    values, counts = np.unique(np.concatenate(got), return_counts=True)
    twice = values[counts > 1]
    twice = np.union1d(twice, np.concatenate([v[m] for v, m in zip(got, marks)]))
    out = [np.packbits(np.isin(v, twice, assume_unique=True)).tobytes() for v in got]
    return pd.DataFrame({"message": group["message"], "owner": group["owner"], "bitmap": out})


def _suspects(bits: int, owners: int):
    span = -(-(1 << bits) // owners)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, n, k, payload, bitmap in batch.itertuples(index=False, name=None):
                mask = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n] > 0
                if mask.any():
                    yield pd.DataFrame({"cut": rice_decode(payload, n, k)[mask] + owner * span})

    return read


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, sha-256 and 63-bit fingerprint of each A-Z-lower-cased text, as a written table."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("sha", StringType()), StructField("fp", LongType())])
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(narrow.mapInArrow(_digest, schema), "digests")


def suspects(digest: DataFrame) -> DataFrame:
    """Rows of ``digests`` whose shortened fingerprint occurs more than once, as a written table."""
    rows = digest.count()
    bits = min(62, max(2, math.ceil(math.log2(rows + 2))) + SPARE_BITS)
    tasks = int(digest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(1, min(tasks, rows // 1000), rows // OWNER_ROWS)
    sent = written(
        digest.select("fp").mapInPandas(
            _messages(bits, owners), "message string, owner long, n long, k long, payload binary, mark binary"
        ),
        "messages",
    )
    replies = sent.groupBy("owner").applyInPandas(_answers, "message string, owner long, bitmap binary")
    back = sent.join(replies, ["message", "owner"]).select("owner", "n", "k", "payload", "bitmap")
    cuts = back.mapInPandas(_suspects(bits, owners), "cut long").distinct()
    short = F.shiftright("fp", 63 - bits)
    return written(digest.withColumn("cut", short).join(cuts, "cut", "left_semi").drop("cut"), "suspects")


def _verified(docs: DataFrame, digest: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts (``sha, keep_id, group_size``, two rows or more) and the suspects."""
    found = suspects(digest)
    ids = written(found.select("id").distinct(), "suspect-ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = small_or_not(ids)
    texts = texts.join(ids, same(texts, ids, ["id"]), "left_semi").select("id", lower_az("text").alias("text"))
    exact = texts.groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = exact.filter("group_size > 1").select(F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    return groups, ids


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts are
    equal to each other.  Of equal texts the largest id stays; a null id is smaller than any other.  Rows that
    repeat both id and text are one document: they count in ``group_size`` and share one answer.  An empty
    table gives an empty result, other columns are not looked at.
    """
    digest = digests(docs, id_col, text_col)
    groups, _ = _verified(docs, digest, id_col, text_col)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return (
        digest.join(groups, "sha", "left")
        .select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one whole row for each text, that of the largest id; all columns stay.

    Rows that share id and text differ in other columns at most; the largest in the order of all columns stays.
    """
    _, ids = _verified(docs, digests(docs, id_col, text_col), id_col, text_col)
    (known,) = unused(docs, "__id")
    ids = ids.withColumnRenamed("id", known)
    match = docs[id_col].eqNullSafe(ids[known])
    alone = docs.join(ids, match, "left_anti")
    shared = docs.join(ids, match, "left_semi")
    row, rank = F.struct(*docs.columns), F.struct(F.col(id_col), F.to_json(F.struct(*docs.columns)))
    best = shared.groupBy(lower_az(text_col).alias("__text")).agg(F.max_by(row, rank).alias("__row"))
    return alone.unionByName(best.select("__row.*"))
