"""Lines that many documents share, dropped everywhere but in one document.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.llm.common import SPACES, lower_az, same, settled, small_or_not, text_of, unused, written

MIN_CHARS = 20
MIN_DOCS = 3
MAX_POSITIONS = 2_000_000  # line positions a broadcast may hold


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with shortened texts, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without spaces at its ends, A-Z lower-cased.  A key of ``min_chars`` code points or
    more that occurs in ``min_docs`` documents or more loses all its lines except in the largest id that has it.

    A null or empty text is one empty line and comes out empty.  Rows with the same id are one document: they
    count once and keep or lose a key together.  A null id is an id smaller than any other.  An empty table gives
    an empty result.  Input columns called like the new ones are replaced.

    Lines are exploded to 128-bit hashes; counting combines before it shuffles, so a line found everywhere is no
    hot key.  The positions to drop come back per row (id and text hash); the texts move only when those
    positions are too many to send to every executor.
    """
    digest = F.xxhash64(text_of(text_col))
    lines = docs.select(
        F.col(id_col).alias("id"), digest.alias("digest"), F.posexplode(F.split(lower_az(text_col), "\n"))
    ).withColumn("key", F.btrim("col", F.lit(SPACES)))
    long = lines.filter(F.char_length("key") >= min_chars)
    found = written(
        long.select("id", "digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "lines",
    )
    shared = (
        found.groupBy("h1", "h2")
        .agg(F.count_distinct(F.struct("id")).alias("n"), F.max(F.struct("id")).alias("last"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "last")
    )
    shared = small_or_not(written(shared, "shared-lines"))
    drops = (
        found.join(shared, ["h1", "h2"])
        .filter(~F.struct("id").eqNullSafe(F.col("last")))
        .groupBy("id", "digest")
        .agg(F.collect_set("pos").alias("drop"))
    )
    drops = written(drops, "dropped-lines")
    key_id, key_digest, drop, parts = unused(docs, "__id", "__digest", "__drop", "__parts")
    drops = drops.toDF(key_id, key_digest, drop)
    if (drops.agg(F.sum(F.size(drop))).first()[0] or 0) <= MAX_POSITIONS:
        drops = F.broadcast(drops)
    match = docs[id_col].eqNullSafe(drops[key_id]) & (digest == drops[key_digest])
    joined = docs.join(drops, match, "left").drop(key_id, key_digest)
    joined = settled(joined, **{parts: F.split(text_of(text_col), "\n")})
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    left = F.transform(F.array_except(every, F.col(drop)), lambda i: F.col(parts)[i])
    text = F.when(F.col(drop).isNull(), text_of(text_col)).otherwise(F.array_join(left, "\n"))
    kept = [c for c in joined.columns if c.lower() not in {"n_lines", "n_dropped", text_col.lower(), drop, parts}]
    n_dropped = F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop))
    return joined.select(
        *kept,
        text.alias(text_col),
        F.size(parts).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )
