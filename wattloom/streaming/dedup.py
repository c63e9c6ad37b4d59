"""Time-to-live de-duplication of an unbounded stream, in event time, with a time per key as state."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Generator, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampType

from wattloom.functions.quantities import timestamp_seconds
from wattloom.operators.dedup import TTL_SECONDS

KEEP_SECONDS = 86_400.0
BUCKETS = 1 << 14  # values of state that the keys share
SECONDS, KEY, BUCKET, LATE = "__seconds", "__key", "__bucket", "__late"
METRICS = "repeats"  # name of the observed counts: kept, late


class _Repeats(StatefulProcessor):
    """When each key of a bucket was last seen.  A row passes when that is more than ttl before it.

    Rows are taken by arrival and, where that is equal, by time.  Of each ttl-wide cell of time only the first row
    can pass, so a busy key costs a row per cell and a number per sighting.  A row older than the key's last
    sighting is late: it is counted, moves nothing and never passes.

    Every access to state waits for an answer of Spark's, which takes far longer than a row; so keys share one value
    of state by buckets.  A key keeps its own time of expiry in it.
    """

    def __init__(self, ttl: float, keep: float, arrival: Sequence[str], tie_break: Sequence[str], columns: Sequence[str]):
        self.ttl, self.arrival, self.tie_break, self.columns = ttl, arrival, tie_break, columns
        self.keep = int(1000 * max(keep, ttl))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.named = Row(*self.columns, LATE)
        self.last = handle.getValueState("last", "key array<string>, seen array<double>, written array<long>", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: dict = {}
        at: dict = {}
        for named in rows:
            if not at:  # names are slow to look up in a row, so they are looked up once
                at = {name: i for i, name in enumerate(named.__fields__)}
                seconds, text = at[SECONDS], at[KEY]
                arrival, tie_break = [at[c] for c in self.arrival], [at[c] for c in self.tie_break]
            row = tuple(named)
            t = row[seconds]
            cells = came.setdefault(row[text], {}).setdefault(tuple([row[i] for i in arrival]), {})
            rank = (t, *[(row[i] is not None, row[i]) for i in tie_break])
            cell = cells.get(t // self.ttl)
            if cell is None:
                cells[t // self.ttl] = [rank, row, array("d", (t,))]
                continue
            cell[2].append(t)
            if rank < cell[0]:
                cell[0], cell[1] = rank, row
        out = [at[c] for c in self.columns]
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.last.get()
        known = {k: (seen, written) for k, seen, written in zip(*held) if written + self.keep > now} if held else {}
        moved = False
        for name, arrivals in came.items():
            before = known.get(name, (None,))[0]
            seen = yield from self._passing(arrivals, before, out)
            if before is None or seen > before:
                known[name], moved = (seen, now), True
        if moved:
            self.last.update((list(known), *map(list, zip(*known.values()))))

    def _passing(self, came: dict, seen: float | None, out: Sequence[int]) -> Generator[Row, None, float]:
        """Rows of one key that pass or count late ones, with the values at ``out``; gives back when it was last seen."""
        for _, cells in sorted(came.items()):
            start = seen
            for _, ((first, *_), row, times) in sorted(cells.items()):
                late = 0
                if start is not None:
                    times = sorted(times)
                    late = bisect_left(times, start)
                fresh = seen is None or (not late and first - seen > self.ttl)
                if fresh or late:
                    yield self.named(*[row[i] for i in out], late)
                seen = max(times) if seen is None else max(seen, max(times))
        return seen

    def close(self) -> None:
        pass


def _key_text(events: DataFrame, keys: Sequence[str]) -> Column:
    """A text for each key: equal for equal keys, as grouping takes them, and no others."""
    zero = {f.name: F.lit(0.0) for f in events.schema if f.dataType.typeName() in ("float", "double")}  # -0.0 + 0.0 is 0.0
    fields = [(F.col(k) + zero[k] if k in zero else F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    return F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def mark_repeats_stream(
    events: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie_break: Sequence[str] = (),
    ttl: float = TTL_SECONDS,
    keep: float = KEEP_SECONDS,
    arrival: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows that pass, with ``__late`` 0, and the first of each cell of late rows, with their number.

    ``ts`` is a timestamp; rows without one have no place in time and are left out.  See :func:`drop_repeats_stream`.
    """
    columns = events.columns
    stream = events.withColumn(SECONDS, timestamp_seconds(F.col(ts))).filter(F.col(SECONDS).isNotNull())
    stream = stream.withColumn(KEY, _key_text(events, keys)).withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)))
    plain = events.schema[ts].dataType == TimestampType()  # a number is handed to Python and back much faster
    if plain:
        stream = stream.withColumn(ts, F.unix_micros(ts))
    marked = stream.groupBy(BUCKET).transformWithState(
        _Repeats(float(ttl), float(keep), tuple(arrival), tuple(tie_break), tuple(columns)),
        outputStructType=stream.select(*columns).schema.add(LATE, "long"),
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return marked.withColumn(ts, F.timestamp_micros(ts)) if plain else marked


def drop_repeats_stream(
    events: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie_break: Sequence[str] = (),
    ttl: float = TTL_SECONDS,
    keep: float = KEEP_SECONDS,
    exact: bool = True,
    arrival: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming counterpart of ``operators.dedup.drop_repeats``; ``ts`` is a timestamp.

    One rule for all rows: in the order of ``arrival``, and by time where that is equal, a row passes when its key
    was not seen before or was last seen more than ``ttl`` earlier.  A key's first sighting passes however late it
    is; a row older than its key's last sighting is a late repeat, dropped and counted.  With columns that tell
    when rows arrived (a file's time, an offset), the same rows pass however they are cut into micro-batches;
    without, rows of a micro-batch arrive together.

    State is a time per key.  Keys are dealt by a hash to ``buckets`` values of state, and only those that hold keys
    of the micro-batch are read and written, so a micro-batch asks for at most ``buckets`` values however many keys it
    has, and a single row for one value of live keys / ``buckets`` times.  The number stays the same as long as the
    checkpoint is used.  A key is forgotten ``keep`` seconds of wall-clock time after it was last written, so times
    far ahead or behind forget nothing.
    How many rows were kept and late is observed under the name ``repeats``; see :class:`StreamCounts`.

    ``exact=False`` uses Spark's own de-duplication, which may also drop later repeats.
    """
    if not exact:
        return events.withWatermark(ts, f"{max(1, round(ttl))} seconds").dropDuplicatesWithinWatermark(
            list(keys)
        )
    marked = mark_repeats_stream(events, keys, ts, tie_break, ttl, keep, arrival, buckets)
    late = F.coalesce(F.sum(LATE), F.lit(0)).alias("late")
    counted = marked.observe(METRICS, F.count_if(F.col(LATE) == 0).alias("kept"), late)
    return counted.filter(F.col(LATE) == 0).drop(LATE)


class StreamCounts(StreamingQueryListener):
    """Adds up whatever streams observe: ``spark.streams.addListener(counts)``, then ``counts.total["repeats"]["late"]``."""

    def __init__(self):
        self.total: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for stage, row in event.progress.observedMetrics.items():
            sums = self.total.setdefault(stage, {})
            for name, value in row.asDict().items():
                sums[name] = sums.get(name, 0) + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
