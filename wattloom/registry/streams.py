"""Streaming queries: drained once, then the written result is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.registry.base import EV, query, r, table
from wattloom.registry.models import SCORE_COLUMNS, SCORES_SQL, part_models
from wattloom.registry.specs import COLUMNS_SQL, REQUESTS_SQL, _columns, manifests, s
from wattloom.schemas import accepted
from wattloom.session import scratch_path
from wattloom.sources.objects import as_events, stream_changes
from wattloom.sources.tables import read_requests
from wattloom.streaming.dedup import drop_repeats_stream
from wattloom.streaming.jobs import fresh_events, requests_of_events, score_events, write_requests

SIX_HOURS = 21600


def _drain(df: DataFrame, path: str, checkpoint: str) -> None:
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_ttl_dedup",
    f"""WITH {EV}, w AS (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS p FROM ev)
SELECT event_id, user_id, event_type FROM w WHERE p IS NULL OR t - p > {SIX_HOURS}""",
)
def stream_ttl_dedup(spark, sf):
    """The events table as a stream through keyed state; equals the batch operator."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = drop_repeats_stream(stream, ["user_id", "event_type"], "ts", ["event_id"], ttl=SIX_HOURS)
    path = scratch_path(spark, "stream-dedup")
    _drain(out, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/out").select("event_id", "user_id", "event_type")


@query(
    "stream_ttl_dedup_late",
    f"""WITH {EV}, w AS (SELECT event_id, t, max(t) OVER (PARTITION BY user_id, event_type ORDER BY event_id * 7 % 4, t, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev)
SELECT event_id FROM w WHERE p IS NULL OR t - p > {SIX_HOURS}""",
)
def stream_ttl_dedup_late(spark, sf):
    """Four files, each with events of the whole month: repeats across files, most of them older than the last sighting."""
    path = scratch_path(spark, "stream-late")
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7 % 4).alias("file")
    )
    for n in range(4):
        rows.filter(F.col("file") == n).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = drop_repeats_stream(stream, ["user_id", "event_type"], "ts", ["event_id"], ttl=SIX_HOURS, arrival=["file"])
    _drain(out, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/out").select("event_id")


def _changes(spark, sf: str) -> DataFrame:
    """(type, kind, ts, object): an object change per event; some are deletions."""
    kind = F.when(F.col("event_type") == "error", "DELETED").otherwise("ADDED")
    meta = F.struct(
        F.col("event_type").alias("namespace"),
        F.concat(F.lit("app"), s("user_id")).alias("name"),
        F.lit("7").alias("resourceVersion"),
    )
    body = F.struct(meta.alias("metadata"), F.col("event_id").alias("event_id"))
    return table(spark, sf, "events").select(
        kind.alias("type"),
        F.when(F.col("user_id") % 2 == 0, "Deployment").otherwise("Job").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_json(body).alias("object"),
    )


def _write_changes(changes: DataFrame, path: str) -> None:
    line = F.concat(
        F.lit('{"type":"'), "type", F.lit('","kind":"'), "kind", F.lit('","ts":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit('","object":'), "object", F.lit("}"),
    )
    changes.select(line.alias("value")).write.mode("append").text(path)


@query(
    "snapshot_then_stream",
    f"""WITH {EV}, w AS (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS p FROM ev
  WHERE event_type IN ('click', 'signup', 'view'))
SELECT event_id FROM w WHERE p IS NULL OR t - p > {SIX_HOURS}""",
)
def snapshot_then_stream(spark, sf):
    """The first half of January as a snapshot, the rest as changes: two runs that share one state."""
    path = scratch_path(spark, "changes")
    changes = _changes(spark, sf)
    middle = F.lit("2024-01-16").cast("timestamp")
    spaces = ["click", "error", "signup", "view"]
    early = changes.filter((F.col("ts") < middle) & (F.col("type") != "DELETED"))
    _write_changes(as_events(early, F.col("ts")), f"{path}/in/1-snapshot")
    fresh = fresh_events(stream_changes(spark, f"{path}/in"), ("Deployment", "Job"), spaces, ttl=SIX_HOURS)
    _drain(fresh, f"{path}/out", f"{path}/checkpoint")
    _write_changes(changes.filter(F.col("ts") >= middle), f"{path}/in/2-changes")
    _drain(fresh, f"{path}/out", f"{path}/checkpoint")
    kept = spark.read.schema(fresh.schema).parquet(f"{path}/out")
    return kept.select(F.get_json_object("object", "$.event_id").cast("bigint").alias("event_id"))


def _part_changes(spark, sf: str) -> DataFrame:
    """Every part's manifest, seen twice within the time-to-live."""
    seen = F.explode(F.array(F.lit(0), F.lit(4)))
    rows = manifests(spark, sf).withColumn("late", seen)
    return rows.select(
        F.lit("MODIFIED").alias("type"), F.get_json_object("object", "$.kind").alias("kind"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") + F.col("late")).alias("ts"), "object",
    )


@query("stream_requests", f"WITH {REQUESTS_SQL} SELECT {COLUMNS_SQL} FROM r")
def stream_requests(spark, sf):
    """Changes to requests, repeats dropped, appended as JSON lines and read back."""
    path = scratch_path(spark, "requests")
    _write_changes(_part_changes(spark, sf), f"{path}/in")
    requests = requests_of_events(stream_changes(spark, f"{path}/in"))
    write_requests(requests, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return _columns(accepted(read_requests(spark, f"{path}/out")))


@query("stream_score", f"WITH {SCORES_SQL} SELECT * FROM scores")
def stream_score(spark, sf):
    """Changes scored batch by batch, each part once."""
    path = scratch_path(spark, "scores")
    _write_changes(_part_changes(spark, sf), f"{path}/in")
    encoder, model = part_models(spark, sf)
    requests = requests_of_events(stream_changes(spark, f"{path}/in"))
    score_events(requests, encoder, model, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    scores = spark.read.parquet(f"{path}/out")
    return scores.select(*SCORE_COLUMNS, r("prediction", 4))
