"""Mixing sources to target weights by entropy balancing.  Built-in expressions only.

Among all document rates between 0 and ``limit`` that give every source its target of words, the ones closest to
1 in relative entropy are ``min(limit, exp(tilt * size / mean size))`` with one tilt per source.  The dual is
convex and falls apart by source; guarded Newton steps find the tilts for all sources at once.  Each step is one
aggregation over a histogram of sizes, which a source of any number of rows enters with at most one row per size.
Rates become whole copies by a fixed random number per document and one threshold per source, which is set so
that the words taken come as near to the target as whole documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.llm.common import WORD_CLASS, small_or_not, text_of, written
from wattloom.operators.ranks import with_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix per word of the input
LIMIT = 2  # most copies of a document, and most words of a source per word it has
TOLERANCE = 1e-6  # of a target, for the tilts; copies are set to the target itself
BINS = 4096
NEAR = 1e-3  # of a target: a source nearer than this is left as it is
STEP = "struct<up: boolean, most: double, edge: double, only: double>"

# Sums of decimals do not depend on the order of addition, so reruns agree to the last digit.
_EXACT = "decimal(38,6)"


def _exact_sum(c: Column) -> Column:
    return F.sum(c.cast(_EXACT)).cast("double")


def measures(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Source (inside a struct, so that null joins), words and fixed random number of a row."""
    text = text_of(text_col)
    draw = F.xxhash64(F.lit(6), F.col(id_col), F.xxhash64(text))
    return [
        F.struct(F.col(source_col).cast("string").alias("name")).alias("__source"),
        F.regexp_count(text, F.lit(f"{WORD_CLASS}+")).cast("long").alias("__size"),
        (F.pmod(draw, F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("__draw"),
    ]


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Add ``target`` to ``__source, words`` rows: shares by repeating weights, none above ``limit`` times the words."""
    order = F.struct(F.col("__source.name").isNull(), F.col("__source.name"))
    ranked = with_rank(sizes.withColumn("order", order), "order", name="sources").drop("order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("words") * F.lit(float(limit))})
    total = ranked.agg(F.sum("words")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("words"))), F.lit(0)).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count_if(above).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (total * share - row["held"] * limit) / row["open"]
    above = F.col("most") < F.lit(level) * F.col("weight")
    capped = above if row["open"] else F.lit(True)
    target = F.when(capped, F.col("most")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("__source", "words", "documents", target.alias("target"))


def _rate(limit: float) -> Column:
    tilted = F.exp(F.least(F.col("tilt") * F.col("__size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("tilt").isNull(), F.lit(float(limit))).otherwise(F.least(tilted, F.lit(float(limit))))


def tilts(histogram: DataFrame, sources: DataFrame, limit: float = LIMIT, tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``tilt`` to ``sources``: null where a source is taken ``limit`` times whole.

    Newton steps on the dual; a step that leaves the bracket around the root halves it instead.
    """
    whole = F.col("target") >= F.col("words") * F.lit(float(limit)) * (1 - 1e-12)
    now = sources.withColumns(
        {
            "mean": F.greatest(F.col("words") / F.col("documents"), F.lit(1e-9)),
            "tilt": F.when(whole, F.lit(None).cast("double")).otherwise(F.lit(0.0)),
            "low": F.lit(None).cast("double"),
            "high": F.lit(None).cast("double"),
        }
    )
    now = written(now, "tilts")
    while True:
        rate = _rate(limit)
        mass = F.col("__size") * F.col("rows") * rate
        slope = F.when(rate < limit, mass * F.col("__size") / F.col("mean")).otherwise(0.0)
        sums = (
            histogram.join(small_or_not(now), "__source")
            .filter(F.col("tilt").isNotNull())
            .groupBy("__source")
            .agg(_exact_sum(mass).alias("got"), _exact_sum(slope).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        step = F.col("tilt") - off / F.col("slope")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        middle = (
            F.when(F.col("low").isNull(), F.least(2 * F.col("high"), F.col("high") - 1))
            .when(F.col("high").isNull(), F.greatest(2 * F.col("low"), F.col("low") + 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (F.col("slope") > 0) & (F.abs("step") < 1e6)
        inside &= F.coalesce(F.col("step") > F.col("low"), F.lit(True)) & F.coalesce(F.col("step") < F.col("high"), F.lit(True))
        flat = F.coalesce(F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.abs("low"), F.abs("high")), F.lit(False))
        done = F.coalesce((F.abs("off") <= F.col("target") * tolerance) | flat, F.lit(True))
        then = (
            now.join(sums, "__source", "left")
            .withColumns({"off": off, "step": step})
            .withColumns({"low": low, "high": high})
            .withColumns({"middle": middle, "done": done})
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, F.col("step")).otherwise(F.col("middle")))
        )
        then = written(then, "tilts")
        if not then.filter(~F.col("done")).limit(1).count():
            return then.select("__source", "words", "target", "mean", "tilt")
        now = then.select(*now.columns)


def _cut(sized: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """Add ``cut``: a document gets a copy more than its whole ones when its draw less its fraction is below.

    Found by two rounds of counting words by cell of that difference.
    """
    def spread(params: DataFrame) -> DataFrame:
        rate = _rate(limit)
        held = sized.join(small_or_not(params), "__source")
        return held.withColumns({"base": F.floor(rate), "off": F.col("__draw") - (rate - F.floor(rate)), "rate": rate})

    base = spread(sources).groupBy("__source").agg(F.sum(F.col("base") * F.col("__size")).alias("sure"))
    params = sources.join(base, "__source", "left").withColumns(
        {"need": F.col("target") - F.coalesce("sure", F.lit(0)), "from": F.lit(-1.0), "width": F.lit(2.0 / BINS)}
    )
    for last in (False, True):
        params = written(params, "cuts")
        cell = F.floor((F.col("off") - F.col("from")) / F.col("width"))
        mass = (
            spread(params)
            .filter((F.col("rate") < limit) & (F.col("__size") > 0))
            .withColumn("cell", cell)
            .filter((F.col("cell") >= 0) & (F.col("cell") < BINS))
            .groupBy("__source", "cell")
            .agg(F.sum("__size").alias("mass"))
        )
        upto = F.sum("mass").over(Window.partitionBy("__source").orderBy("cell"))
        mass = mass.withColumn("upto", upto).join(params.select("__source", "need"), "__source")
        over = F.col("upto") - F.col("need")
        if last:  # the last edge that does not exceed the need
            under = mass.filter(over <= 0).groupBy("__source").agg(F.max("cell").alias("cell"))
            cut = F.col("from") + F.col("width") * (F.coalesce("cell", F.lit(-1)) + 1)
            params = params.join(under, "__source", "left").withColumn("cut", cut).drop("cell", "from", "width", "need", "sure")
        else:  # the cell in which the need is reached
            under = mass.filter(over <= 0).groupBy("__source").agg(F.max("cell").alias("cell"), F.max("upto").alias("upto"))
            start = F.col("from") + F.col("width") * (F.coalesce("cell", F.lit(-1)) + 1)
            nxt = mass.filter(over > 0).groupBy("__source").agg(F.min("cell").alias("next"))
            start = F.when(F.col("next").isNotNull(), F.col("from") + F.col("width") * F.col("next")).otherwise(start)
            params = params.join(under, "__source", "left").join(nxt, "__source", "left").withColumns(
                {"need": F.col("need") - F.coalesce("upto", F.lit(0)), "from": start, "width": F.col("width") / BINS}
            ).drop("cell", "upto", "next")
    return written(params, "cuts")


def _movable(copies: Column, up: Column, limit: float) -> Column:
    return (F.col("__size") > 0) & F.when(up, copies + 1 <= F.lit(limit)).otherwise(copies > 0)


def _order(copies: Column, up: Column, limit: float) -> Column:
    """Who moves first: up, the one with fewest copies for its rate and draw; down, the one with most."""
    served = F.col("__draw") - _rate(limit) + copies
    return F.when(up, served).otherwise(1 - served)


def _copies(limit: float) -> Column:
    rate = _rate(limit)
    more = (rate < limit) & (F.col("__draw") - (rate - F.floor(rate)) < F.col("cut"))

    def step(copies, s):
        many = (F.col("__mass") <= s["most"]) & (_order(copies, s["up"], limit) < s["edge"])
        hit = F.when(s["only"].isNull(), many).otherwise(F.col("__draw") == s["only"])
        one = F.when(s["up"], F.lit(1)).otherwise(F.lit(-1)).cast("long")
        return copies + F.when(hit & _movable(copies, s["up"], limit), one).otherwise(F.lit(0).cast("long"))

    return F.aggregate("steps", (F.floor(rate) + more.cast("long")).cast("long"), step)


def _massed(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """Add ``__mass``: words of all rows that repeat id and text, which move together."""
    if repeats is None:
        return rows.withColumn("__mass", F.col("__size"))
    joined = rows.join(small_or_not(repeats), ["__source", "__draw"], "left")
    return joined.withColumn("__mass", F.col("__size") * F.coalesce("__rows", F.lit(1))).drop("__rows")


def _edges(free: DataFrame, found: DataFrame, limit: float) -> DataFrame:
    """``__source, edge, took``: how far in their order the small rows can move without exceeding the gap."""
    line = Window.partitionBy("__source").orderBy("cell")
    room = F.abs("gap")

    def summed(cells: DataFrame) -> DataFrame:
        return written(cells.filter("mass > 0").withColumn("upto", F.sum("mass").over(line)), "moves-by-cell")

    def until(cells: DataFrame, left: Column) -> list[Column]:
        return [
            F.max(F.when(F.col("upto") <= left, F.col("upto"))).alias("took"),
            F.min(F.when(F.col("upto") > left, F.col("cell"))).alias("next"),
        ]

    width = 2.0 * limit / BINS
    first = summed(found).groupBy("__source", "gap").agg(*until(found, room))
    first = written(first.withColumn("took", F.coalesce("took", F.lit(0))), "first-edges")
    fine = (
        free.join(small_or_not(first.select("__source", "took", "next")), "__source")
        .filter((F.col("__mass") <= room / 2) & (F.col("cell") == F.col("next")))
        .withColumn("from", width * F.col("next") - limit)
        .withColumn("cell", F.floor((F.col("order") - F.col("from")) / (width / BINS)))
        .groupBy("__source", "cell", "gap", "took", "from")
        .agg(F.sum("__size").alias("mass"))
    )
    fine = summed(fine.withColumnRenamed("took", "before")).groupBy("__source", "before", "from").agg(*until(fine, room - F.col("before")))
    fine = fine.select("__source", F.coalesce("took", F.lit(0)).alias("more"), (F.col("from") + width / BINS * F.col("next")).alias("edge"))
    # without a next cell everything fits
    return first.join(fine, "__source", "left").select(
        "__source", F.coalesce("edge", F.lit(limit + 1.0)).alias("edge"), (F.col("took") + F.coalesce("more", F.lit(0))).alias("took")
    )


def _closed(sized: DataFrame, params: DataFrame, limit: float) -> tuple[DataFrame, DataFrame | None]:
    """Add ``steps``, which close what the cut left open, and give the rows that are drawn together if there are steps.

    A step moves, in their order, documents of at most half of what a source is still off, as many as fit; so either
    the gap halves or all such documents have moved.  Where a single document halves the gap or brings the source
    nearer than that, it moves instead.  Every step makes the gap smaller; a source is done when it is within ``NEAR`` or when no move brings it nearer.
    """
    now = params.withColumns({"steps": F.array().cast(f"array<{STEP}>"), "done": F.lit(False), "was": F.lit(None).cast("double")})
    closed, repeats, width = [], None, 2.0 * limit / BINS
    while True:
        held = _massed(sized, repeats).join(small_or_not(now), "__source").withColumn("copies", _copies(limit))
        got = held.groupBy("__source").agg(F.sum(F.col("__size") * F.col("copies")).alias("got"))
        gaps = now.join(got, "__source", "left").withColumn("gap", F.col("target") - F.coalesce("got", F.lit(0))).drop("got")
        worse = F.coalesce(F.abs("gap") >= F.col("was"), F.lit(False))  # only by rounding at an edge
        kept = F.when(worse, F.slice("steps", F.lit(1), F.size("steps") - 1)).otherwise(F.col("steps"))
        off = F.abs("gap") > F.col("target") * NEAR
        gaps = gaps.withColumns({"open": off & ~F.col("done") & ~worse, "kept": kept})
        gaps = written(gaps.drop("steps").withColumnRenamed("kept", "steps"), "gaps")
        closed.append(gaps.filter(~F.col("open")).drop("open", "gap", "done", "was"))
        still = gaps.filter("open").drop("open")
        if still.isEmpty():
            break
        if repeats is None:
            repeats = sized.join(small_or_not(still.select("__source")), "__source", "left_semi")
            repeats = repeats.groupBy("__source", "__draw").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
            repeats = written(repeats, "drawn-together")
        up, room = F.col("gap") > 0, F.abs("gap")
        free = (
            _massed(sized, repeats)
            .join(small_or_not(still), "__source")
            .withColumn("copies", _copies(limit))
            .filter(_movable(F.col("copies"), up, limit) & (F.col("__mass") < 2 * room))
            .withColumn("order", _order(F.col("copies"), up, limit))
            .select("__source", "__size", "__draw", "__mass", "gap", "order", F.floor((F.col("order") + limit) / width).alias("cell"))
        )
        small = F.when(F.col("__mass") <= room / 2, F.col("__size"))
        best = F.struct(F.abs(room - F.col("__mass")).alias("miss"), "__draw")
        found = free.groupBy("__source", "gap", "cell").agg(F.sum(small).alias("mass"), F.min(best).alias("best"))
        found = written(found, "moves")
        nearest = found.groupBy("__source").agg(F.min("best").alias("best"))
        chosen = still.join(nearest, "__source", "left").join(_edges(free, found, limit), "__source", "left")
        nearer = F.coalesce(F.col("best.miss") < room, F.lit(False))
        fewer = (room - F.col("took") < F.col("best.miss")) & (F.col("best.miss") > room / 2)
        many = F.coalesce((F.col("took") > 0) & fewer, F.lit(False))
        none = F.lit(None).cast("double")
        step = F.when(many, F.struct(up.alias("up"), (room / 2).alias("most"), F.col("edge"), none.alias("only"))).when(
            nearer, F.struct(up.alias("up"), none.alias("most"), none.alias("edge"), F.col("best.__draw").alias("only"))
        )
        steps = F.when(many | nearer, F.concat("steps", F.array(step.cast(STEP)))).otherwise(F.col("steps"))
        now = chosen.withColumns({"steps": steps, "done": ~(many | nearer), "was": F.when(many | nearer, room)})
        now = written(now.drop("gap", "best", "edge", "took"), "mix")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return written(out, "mix"), repeats


def plan_mix(
    sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> tuple[DataFrame, DataFrame | None]:
    """One row per source with its words, target, tilt, cut and steps, from rows of ``measures``; and repeated rows."""
    histogram = written(sized.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("rows")), "histogram")
    sizes = histogram.groupBy("__source").agg(
        F.sum(F.col("__size") * F.col("rows")).alias("words"), F.sum("rows").alias("documents")
    )
    sources = written(targets(written(sizes, "sizes"), weights, share, limit), "targets")
    return _closed(sized, _cut(sized, tilts(histogram, sources, limit), limit), limit)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of its source), ``copies`` and ``taken`` (words).

    Sources in code point order, null last, get the repeating weights; the mix has ``share`` words per word of the
    input, no source and no document more than ``limit`` times its own.  A null text has size 0.  Rows that repeat
    id and text are drawn together; ids may be null.  A source without words has target 0.  An empty table gives
    an empty result.  Input columns called like the new ones are replaced.
    """
    sized = written(docs.select(*measures(docs, id_col, text_col, source_col)), "sizes-by-document")
    params, repeats = plan_mix(sized, weights, share, limit)
    params = small_or_not(params)
    new = {"size", "source_size", "target", "copies", "taken"}
    old = [c for c in docs.columns if c.lower() not in new]
    params = params.toDF(*[c if c.startswith("__") else f"__{c}" for c in params.columns])
    own = [F.col(f"`{c}`").alias(f"__doc_{i}") for i, c in enumerate(old)]  # names that no column of the mix has
    marked = docs.select(*own, *measures(docs, id_col, text_col, source_col))
    return _answer(_massed(marked, repeats).join(params, "__source"), old, limit)


def _answer(joined: DataFrame, old: list[str], limit: float) -> DataFrame:
    plain = joined.withColumnsRenamed({f"__{c}": c for c in ("words", "target", "mean", "tilt", "cut", "steps")})
    return plain.withColumn("__copies", _copies(limit)).select(
        *[F.col(f"__doc_{i}").alias(c) for i, c in enumerate(old)],
        F.col("__size").alias("size"),
        F.col("words").alias("source_size"),
        "target",
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )
