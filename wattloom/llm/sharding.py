"""Shards that all look like the whole: sources interleaved in proportion, then cut into runs of equal length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.operators.ranks import with_rank

#: The law that this method keeps: row counts of any two shards differ by one at most.
LAW = "rows"
SHARDS = 24
SEED = 11


def draw(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """The place of a row in the seeded shuffle: a digest of seed and id, so reruns agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def _content(df: DataFrame) -> Column:
    """Tells rows of one id apart; maps have no hash and are left out."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def assign_shards(
    df: DataFrame, shards: int = SHARDS, source_col: str = "source", id_col: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """All columns of ``df`` and ``shard`` (from 0), ``slot`` (place in its shard, gapless from 0).

    Rows of a source are shuffled by ``seed`` and ranked; a row of rank r among n stands at (r + 1/2) / n.  In the
    order of these fractions every stretch holds each source in its share, so equal stretches make shards of equal
    row counts (at most one apart) with the mixture of the whole.  Both rankings are range sorts: a source with
    a third of all rows is spread over tasks like any other.  Only counts by task and by source leave the tasks,
    and the latter stay a table.

    Nulls: rows without a source are a source of their own; a null id draws like the text "null".  Rows of one id
    differ by a hash of their content; rows equal in every column are interchangeable.  Texts are only carried.
    An empty table gives no rows; with fewer rows than shards some shards are empty.  Columns called ``shard`` or
    ``slot`` are replaced, other names may be anything.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    lots = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        draw(id_col, seed).alias("lot"),
        _content(df.select(*[F.col(f"`{c}`") for c in kept])).alias("mark"),
    )
    ranked = with_rank(lots, "source", "lot", "id", "mark", out="rank", name="shuffled").drop("lot", "mark", "id")
    sizes = ranked.groupBy(F.col("source").alias("of")).agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    share = (F.col("rank") - F.col("first") + F.lit(0.5)) / F.col("size")
    placed = ranked.join(sizes, F.col("source").eqNullSafe(F.col("of"))).withColumn("share", share)
    placed = placed.select("row", "source", "rank", "share")
    mixed = with_rank(placed, "share", F.col("source").asc_nulls_last(), "rank", out="at", name="interleaved")
    total = max(mixed.count(), 1)
    cut = mixed.withColumn("shard", F.expr(f"(at * {shards}) DIV {total}"))
    begin = F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")  # the first place of the shard
    return cut.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("at") - begin).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder per shard below ``path``, its rows in the order of their slots, large shards in several files."""
    tasks = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sharded.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
