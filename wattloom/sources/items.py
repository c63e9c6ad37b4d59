"""The members of one long array inside large JSON files, read by as many tasks as the files have splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattloom.session import written

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_SCAN = "file string, start long, at long, value string, depth array<int>, quoted array<boolean>"


def _scan(text: str, quoted: bool) -> tuple[int, bool]:
    """How much deeper a piece and the brace after it lead, and whether they end inside a string."""
    depth = 0
    for token in _TOKEN.findall(text):
        if token == '"':
            quoted = not quoted
        elif not quoted and len(token) == 1:
            depth += 1 if token in "{[" else -1
    return depth - (not quoted), quoted


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and string state after each piece, counted from the begin of its split, for a begin outside and inside a string."""
    now, depth, quoted = None, [0, 0], [False, True]
    for batch in batches:
        depths, states = [], []
        for file, start, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (file, start) != now:
                now, depth, quoted = (file, start), [0, 0], [False, True]
            for side in (0, 1):
                more, quoted[side] = _scan(text, quoted[side])
                depth[side] += more
            depths.append(list(depth))
            states.append(list(quoted))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(depths, pa.list_(pa.int32())), pa.array(states, pa.list_(pa.bool_()))],
            names=["file", "start", "at", "value", "depth", "quoted"],
        )


def read_items(spark: SparkSession, path: str, name: str, level: int) -> DataFrame:
    """``file, kind, item``: the JSON text of every object in the array called ``name`` of each file at ``path``.

    ``level`` is how many brackets are open inside the array (2 for a member of the top object).  Files are cut at
    closing braces, so Spark splits them by bytes like any text; brackets and strings are counted per split from
    both possible states, and only the sums of each split are put together on the driver.  Pieces of an object that
    lies across splits are joined again.  ``kind`` is the file's own, before or after the array.  Strings may
    hold any characters; spaces and line breaks between members do not matter; an empty array gives no rows.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    pieces = written(text.mapInArrow(_running, _SCAN), "json-pieces")
    last = pieces.groupBy("file", "start").agg(F.max_by(F.struct("depth", "quoted"), "at").alias("end"))
    begin, file, depth, quoted = [], None, 0, False
    for r in sorted(last.collect(), key=lambda r: (r["file"], r["start"])):  # a row per split
        if r["file"] != file:
            file, depth, quoted = r["file"], 0, False
        begin.append((file, r["start"], depth, quoted))
        depth, quoted = depth + r["end"]["depth"][quoted], r["end"]["quoted"][quoted]
    begins = spark.createDataFrame(begin, "file string, start long, base int, inside boolean")
    side = F.col("inside").cast("int")
    known = pieces.join(F.broadcast(begins), ["file", "start"]).withColumn(
        "ends", ~F.get("quoted", side) & (F.col("base") + F.get("depth", side) == level)
    )
    before = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one split's rows
    numbered = known.withColumn("n", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)))
    counts = known.groupBy("file", "start").agg(F.sum(F.col("ends").cast("long")).alias("ends")).collect()  # a row per split
    offsets, file, total = [], None, 0
    for r in sorted(counts, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, total = r["file"], 0
        offsets.append((file, r["start"], total))
        total += r["ends"]
    offsets = spark.createDataFrame(offsets, "file string, start long, first long")
    numbered = numbered.join(F.broadcast(offsets), ["file", "start"]).withColumn("n", F.col("n") + F.col("first"))
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "value")))  # the pieces of one object
    groups = numbered.groupBy("file", "n").agg(parts.alias("parts"), F.max("ends").alias("whole"))
    joined = groups.select("file", "n", "whole", F.array_join("parts.value", "}").alias("text"))
    marker = rf'(?s)^.*?"{name}"\s*:\s*\['
    follows = F.col("text").rlike(r"^\s*,")
    body = F.when(follows, F.regexp_replace("text", r"^\s*,", "")).otherwise(F.regexp_replace("text", marker, ""))
    split = written(joined.withColumn("item", F.concat(F.trim(F.regexp_replace(body, r"^\s+", "")), F.lit("}"))), "json-items")
    head = F.when(F.col("whole") & F.col("text").rlike(marker), F.regexp_extract("text", marker, 0)).otherwise(F.col("text"))
    outside = split.filter(~F.col("whole") | ~follows).select("file", head.alias("text"))
    kind = F.nullif(F.regexp_extract("text", r'"kind"\s*:\s*"([^"]*)"', 1), F.lit(""))
    kinds = outside.groupBy("file").agg(F.max(kind).alias("kind"))  # from the few pieces around the array
    items = split.filter(F.col("whole") & F.col("item").startswith("{") & F.get_json_object("item", "$").isNotNull())
    return items.join(kinds, "file", "left").select("file", "kind", "item")


def write_one_list(members: DataFrame, head: str, tail: str, path: str) -> None:
    """``value`` (the JSON text of a member) of all rows as one list in one file, in any order, between ``head`` and ``tail``.

    One task writes the file and holds a batch at a time; nothing is sorted.  ``members`` should be read from a
    table, since what is computed here is computed by that task.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        comma = ""
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([comma + texts[0], *("," + t for t in texts[1:])])], names=["value"])
                comma = ","
        yield pa.RecordBatch.from_arrays([pa.array([tail])], names=["value"])

    one = members.sparkSession.createDataFrame([(None,)], "value string")  # so that there is a task where there are no rows
    members.select("value").unionByName(one).coalesce(1).mapInArrow(lines, "value string").write.text(path)
