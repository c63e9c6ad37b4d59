"""Change events to requests and to predictions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wattloom.operators import requests as ops
from wattloom.operators.dedup import TTL_SECONDS
from wattloom.plans.encoder import Encoder
from wattloom.plans.model import KnnModel
from wattloom.plans.score import score_requests
from wattloom.schemas import REJECT, accepted, validate
from wattloom.streaming.dedup import KEEP_SECONDS, drop_repeats_stream

log = logging.getLogger(__name__)
STAGE = "requests"  # name of the observed counts: rows, rejected


def fresh_events(
    events: DataFrame,
    kinds: Sequence[str] | None = ops.TEMPLATE_KINDS,
    namespaces: Sequence[str] | None = None,
    ttl: float = TTL_SECONDS,
    keep: float = KEEP_SECONDS,
    exact: bool = True,
) -> DataFrame:
    """Live events of the wanted kinds and namespaces, repeats dropped before any projection."""
    keyed = ops.object_keys(ops.live_events(events))
    keyed = ops.allow(keyed, "key_kind", kinds)
    keyed = ops.allow(keyed, "key_namespace", namespaces)
    return drop_repeats_stream(
        keyed, ops.KEY_COLUMNS, "ts", ("object",), ttl=ttl, keep=keep, exact=exact
    )


def requests_of_events(events: DataFrame, **options) -> DataFrame:
    """Requests of a change stream, with the event's ``ts`` and a ``reject_reason``."""
    fresh = fresh_events(events, **options)
    return validate(
        ops.object_requests(fresh, kind="key_kind", kinds=None, keep=["ts"])
    )


def write_requests(
    requests: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append accepted requests as JSON lines.  All requests and rejected ones are observed as ``requests``."""
    seen = requests.observe(STAGE, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(REJECT).isNotNull()).alias("rejected"))
    writer = (
        accepted(seen)
        .writeStream.format("json")
        .outputMode("append")
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


SPREAD = 1 << 30  # rows are told apart by so many hashes when a failing batch is searched
MOST_FAILING = 100  # failing pieces after which the rest of a failing half is kept aside as it is


def failing_rows(batch: DataFrame, attempt: Callable[[DataFrame], None]) -> Column | None:
    """A condition for the rows of ``batch`` that make ``attempt`` fail, found by halving; null where it succeeds.

    A failing piece is halved by a hash of its rows until one hash is left, so each failing row costs about as
    many attempts as the batch's size has bits.  ``batch`` should be persisted.
    """
    place = F.pmod(F.xxhash64(*[F.to_json(F.struct(*batch.columns))]), F.lit(SPREAD))
    found: list[tuple[int, int]] = []

    def search(low: int, high: int) -> None:
        piece = batch.filter((place >= low) & (place < high))
        ends = piece.agg(F.min(place).alias("a"), F.max(place).alias("b")).first()
        if ends["a"] is None:
            return
        try:
            attempt(piece)
            return
        except Exception as error:
            log.warning("a piece of a batch cannot be scored: %s", str(error)[:200])
        if ends["a"] == ends["b"] or len(found) >= MOST_FAILING:
            found.append((ends["a"], ends["b"]))
            return
        middle = (ends["a"] + ends["b"] + 1) // 2
        search(ends["a"], middle)
        search(middle, ends["b"] + 1)

    search(0, SPREAD)
    bad = None
    for low, high in found:
        here = place.between(low, high)
        bad = here if bad is None else bad | here
    return bad


def score_events(
    requests: DataFrame,
    encoder: Encoder,
    model: KnnModel,
    path: str,
    checkpoint: str,
    once: bool = False,
    tolerate_failures: bool = False,
) -> StreamingQuery:
    """Score each micro-batch into ``path/batch=<id>``; a replayed batch overwrites itself.

    With ``tolerate_failures`` the rows that make scoring fail are found, logged and put into
    ``path-failed/batch=<id>`` as they are (see :func:`read_failed`), and all others are scored.  A batch that cannot
    be written even so goes there whole; only if that fails too does the stream stop.
    """
    aside = f"{path.rstrip('/')}-failed"

    def scores(rows: DataFrame) -> DataFrame:
        return score_requests(rows.filter(rows[REJECT].isNull()), encoder, model, keep=["ts"])

    def put(rows: DataFrame, batch_id: int) -> None:
        scores(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    def score(batch: DataFrame, batch_id: int) -> None:
        if not tolerate_failures:
            put(batch, batch_id)
            return
        batch = batch.persist()  # the state behind it must not be run again
        try:
            put(batch, batch_id)
        except Exception:
            log.exception("batch %s cannot be scored as a whole", batch_id)
            bad = failing_rows(batch, lambda rows: scores(rows).write.format("noop").mode("overwrite").save())
            try:
                put(batch if bad is None else batch.filter(~bad), batch_id)
            except Exception:
                log.exception("batch %s is kept aside whole", batch_id)
                bad = F.lit(True)
            if bad is not None:
                batch.filter(bad).write.mode("overwrite").parquet(f"{aside}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """Requests kept aside by ``score_events``, to be scored again with ``plans.score.score_requests``."""
    return spark.read.parquet(f"{path.rstrip('/')}-failed").drop("batch")
