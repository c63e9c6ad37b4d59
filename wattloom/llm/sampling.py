"""A bounded sample of labelled texts, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k, d, n``: id, text hash and characters of rows that have an id and a text.  Texts stay behind."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(id_col).isNotNull() & text.isNotNull())
    return rows.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("d"), F.char_length(text).alias("n"))


def sample(
    docs: DataFrame, labelled: DataFrame, limit: int, usual: int, id_col: str = "doc_id", text_col: str = "text", total: int | None = None
) -> tuple[list[str], list]:
    """Texts and labels of at most ``limit`` rows and ``limit * usual`` characters for each label.

    ``labelled`` has ``k, d, n`` as above and a label ``y``.  Rows come in the order of a hash of id and text, those
    of at most ``usual`` characters first; longer ones are taken whole while a label has too few of these, and the
    row that would pass the bound on characters gives a stretch of what is left, at a place set by its hash.  With
    ``total`` all labels together get about so many characters at most.  Only keys of about three times as many rows
    as needed come to the driver, and then the texts of the chosen rows, each once.
    """
    spark = docs.sparkSession
    labelled = labelled.withColumn("long", F.col("n") > usual)
    sizes = labelled.groupBy("y", "long").count().collect()  # two rows per label
    if not sizes:
        return [], []
    short = {r["y"]: r["count"] for r in sizes if not r["long"]}
    kinds = StructType([labelled.schema["y"], StructField("long", BooleanType()), StructField("share", DoubleType())])
    wanted = [(r["y"], r["long"], max(0, limit - short.get(r["y"], 0)) if r["long"] else limit, r["count"]) for r in sizes]
    shares = spark.createDataFrame([(y, long, min(1.0, 3 * want / n)) for y, long, want, n in wanted], schema=kinds)
    draw = F.pmod(F.xxhash64(F.lit(1), "k", "d"), F.lit(1 << 40)) / float(1 << 40)
    near = labelled.join(F.broadcast(shares), ["y", "long"]).withColumn("h", draw).filter("h < share")
    room = limit * usual
    if total is not None:
        room = max(1, min(room, total // len({r["y"] for r in sizes})))
    chosen: dict = {}
    for r in sorted(near.select("y", "long", "h", "k", "d", "n").distinct().collect()):
        rows = chosen.setdefault(r["y"], [])
        left = room - sum(keep for *_, keep in rows)
        if len(rows) < limit and left > 0:
            keep = min(r["n"], left)
            rows.append((r["k"], r["d"], r["y"], r["d"] % (r["n"] - keep + 1) + 1, keep))
    picked = [row for group in chosen.values() for row in group]
    if not picked:
        return [], []
    parts = labelled.select("k", "d", "y").schema.add("start", IntegerType()).add("keep", IntegerType())
    table = spark.createDataFrame(picked, schema=parts)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    texts = texts.withColumn("d", F.xxhash64("t")).join(F.broadcast(table), ["k", "d"])
    part = F.first(F.substr("t", F.col("start"), F.col("keep"))).alias("t")
    got = sorted(texts.groupBy("y", "k", "d").agg(part).collect(), key=lambda r: r[:3])
    return [r["t"] for r in got], [r["y"] for r in got]
