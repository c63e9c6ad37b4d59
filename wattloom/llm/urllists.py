"""Captures judged by the list entries that were active when they were fetched.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.llm.common import small_or_not, unused, written

BUCKET = 30 * 86_400  # seconds; captures and intervals meet by pattern and such a stretch of time


def host_of(url: Column) -> Column:
    """The host, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: its host and parent domains, and its host with each leading part of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.array_remove(F.split(path, "/"), "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    count = F.size(parts)
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    paths = F.transform(steps, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def pattern_of(entry: Column) -> Column:
    """An entry's pattern: host lower-cased, path as it stands, like ``patterns_of``."""
    host = F.regexp_extract(entry, "^[^/]*", 0)
    return F.concat(F.lower(host), F.substr(entry, F.char_length(host) + 1))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``list_name, allow, pattern, start, stop`` from dated entries.

    ``entries``: ``list_name, allow, pattern, added, at`` (seconds).  An entry holds from its time to the next entry
    of its list and pattern; ``added = false`` ends it.  Of entries at the same time a removal wins.  Entries with a
    null pattern or time, or a null ``added``, are ignored.  Case counts in a pattern's path, not in its host.
    """
    known = entries.filter(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("added").isNotNull())
    known = known.groupBy("list_name", "allow", pattern_of(F.col("pattern")).alias("pattern"), "at").agg(F.min("added").alias("added"))
    line = Window.partitionBy("list_name", "allow", "pattern").orderBy("at")
    return (
        known.withColumn("stop", F.lead("at").over(line))
        .filter("added")
        .select("list_name", F.coalesce("allow", F.lit(False)).alias("allow"), "pattern", F.col("at").alias("start"), "stop")
    )


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``list_name`` and ``pattern`` of the entry that decides.

    ``captures`` holds URLs and fetch times in seconds.  Of the entries active at that time the longest pattern
    decides; of equally long ones an allowing entry, then the first list by name.  An interval is repeated only in
    stretches of time from which there are captures of its pattern, so a stray time adds a stretch at most; the as-of
    join is then an equi-join on pattern and stretch with few intervals on one side, and a host with very many
    captures is split by adaptive execution or meets a broadcast.

    A URL that is null or has no host, and a null time, match nothing; nothing matched is not blocked.  Repeated
    rows come out each.  Without entries nothing is blocked, without captures the result is empty.  Columns called
    like the new ones are replaced.
    """
    new = {"host", "blocked", "list_name", "pattern"}
    kept = [c for c in captures.columns if c.lower() not in new]
    u, t, e = unused(captures, "__url", "__time", "__entry")
    seen = captures.select(F.col(url_col).cast("string").alias(u), F.col(time_col).cast("long").alias(t))
    seen = written(seen.filter(F.col(u).isNotNull() & F.col(t).isNotNull()).distinct(), "captures")
    asked = seen.select("*", F.explode(F.array_distinct(patterns_of(F.col(u)))).alias("pattern"))
    asked = asked.withColumn("cell", F.floor(F.col(t) / BUCKET))
    cells = asked.select("pattern", "cell").distinct()
    begin, end = F.floor(F.col("start") / BUCKET), F.floor(F.col("stop") / BUCKET)
    active = intervals(entries).join(cells, "pattern")
    active = active.filter((begin <= F.col("cell")) & (F.col("stop").isNull() | (F.col("cell") <= end)))
    active = small_or_not(written(active, "intervals"))
    met = asked.join(active, ["pattern", "cell"]).filter(
        (F.col("start") <= F.col(t)) & (F.col("stop").isNull() | (F.col(t) < F.col("stop")))
    )
    rank = F.struct(-F.char_length("pattern"), ~F.col("allow"), "list_name", "pattern")
    verdict = met.groupBy(u, t).agg(F.min_by(F.struct("allow", "list_name", "pattern"), rank).alias(e))
    verdict = small_or_not(written(verdict, "verdicts"))
    link = (captures[url_col].cast("string") == verdict[u]) & (captures[time_col].cast("long") == verdict[t])
    return captures.join(verdict, link, "left").select(
        *[captures[c] for c in kept],
        host_of(captures[url_col].cast("string")).alias("host"),
        F.coalesce(~F.col(f"{e}.allow"), F.lit(False)).alias("blocked"),
        F.col(f"{e}.list_name").alias("list_name"),
        F.col(f"{e}.pattern").alias("pattern"),
    )
