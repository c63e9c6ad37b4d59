"""Benchmark passages found in training documents, by a distributed positional inverted index.

Words of the benchmark are counted over all documents, and every window of an item names its rarest places.  The
index has a posting (document, position, term) for the terms of those places only.  Exact phrases: each posting of
a window's rarest term proposes an alignment of item and document (document position minus item position), one of
the second rarest confirms it, and the words of the aligned documents are laid against all words of the item.
Proximity: places whose alignments differ by no more than the slop propose a match, and the window's words are
looked up in order near it.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.llm.common import lower_az, small_or_not, text_of, unused, written

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: what stands between words
WINDOW = 13
MIN_SHARE = 20  # contaminated: at least one word in so many is hit
NEAR_SHARE = 0.8  # proximity: share of a window's words found in order
SLOP = 3  # proximity: words a place may be off
BLOCK = 64  # document words that travel together when a proximity match is checked
# A document row and an item: the id inside a struct, so that null ids join, and the hash of the text.
KEY = ["row", "digest"]
ITEM = ["item", "item_digest"]


def words(column: str) -> Column:
    return F.array_remove(F.split(lower_az(column), WORD_BREAK), "")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_digest, n, i, term``: every word of every item, as a written table."""
    listed = items.select(
        F.struct(F.col(id_col).alias("item_id")).alias("item"),
        F.xxhash64(text_of(text_col)).alias("item_digest"),
        words(text_col).alias("w"),
    ).distinct()
    return written(
        listed.select(*ITEM, F.size("w").alias("n"), F.posexplode("w").alias("i", "term")), "item-terms"
    )


def _listed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.struct(F.col(id_col).alias("id")).alias("row"),
        F.xxhash64(text_of(text_col)).alias("digest"),
        words(text_col).alias("w"),
    )


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, count``: how often the benchmark's terms stand in all documents; absent terms are left out."""
    vocabulary = small_or_not(written(terms.select("term").distinct(), "vocabulary"))
    every = docs.select(F.explode(words(text_col)).alias("term")).join(vocabulary, "term", "left_semi")
    return written(every.groupBy("term").agg(F.count(F.lit(1)).alias("count")), "term-counts")


def windows(terms: DataFrame, counts: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item, item_digest, n, start, p``: the places (count, i, term) of every window, rarest first."""
    size = F.least("n", F.lit(width))
    starts = F.sequence(F.greatest(F.lit(0), F.col("i") - size + 1), F.least(F.col("i"), F.col("n") - size))
    placed = terms.join(counts, "term", "left").select(
        *ITEM,
        "n",
        F.explode(starts).alias("start"),
        F.struct(F.coalesce("count", F.lit(0)).alias("count"), "i", "term").alias("place"),
    )
    return written(placed.groupBy(*ITEM, "n", "start").agg(F.sort_array(F.collect_list("place")).alias("p")), "windows")


def _pairs(wins: DataFrame) -> DataFrame:
    """The two rarest places of windows whose words all stand somewhere: ``item.., i1, term1, i2, term2``."""
    first, second = F.col("p")[0], F.coalesce(F.get("p", F.lit(1)), F.col("p")[0])
    return (
        wins.filter(first["count"] > 0)
        .select(
            *ITEM, first["i"].alias("i1"), first["term"].alias("term1"), second["i"].alias("i2"), second["term"].alias("term2")
        )
        .distinct()
    )


def _need(share: float) -> Column:
    """Words of a window that have to be found."""
    return F.ceil(F.round(F.size("p") * F.lit(float(share)), 9)).cast("int")


def _anchors(wins: DataFrame, share: float) -> DataFrame:
    """``item.., n, i, term``: of every window so many rarest places that two of them are in any match.

    A match lacks ``size - need`` words at most, so of ``size - need + 2`` places it has two (of one place, one).
    Windows with more words than that which no document has match nowhere and name none.
    """
    chosen = F.slice("p", 1, F.size("p") - _need(share) + 2)
    return (
        wins.filter(F.get("p", F.size("p") - _need(share))["count"] > 0)
        .select(*ITEM, "n", F.explode(chosen).alias("place"))
        .filter("place.count > 0")
        .select(*ITEM, "n", "place.i", "place.term")
        .distinct()
    )


def postings(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, digest, n_words, pos, term`` for the chosen terms, and a posting of the empty term at -1 for every row.

    The empty term carries the number of words of documents that have none of the terms.
    """
    vocabulary = chosen.select("term").union(chosen.sparkSession.range(1).select(F.lit(""))).distinct()
    vocabulary = small_or_not(written(vocabulary, "chosen-terms"))
    every = _listed(docs, id_col, text_col).select(
        *KEY, F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "term")
    )
    found = every.join(vocabulary, "term", "left_semi")
    return written(found.select(*KEY, "n_words", (F.col("pos") - 1).alias("pos"), "term"), "postings")


def _held(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, digest, w``: the words of the documents that have something to check."""
    keys = small_or_not(written(keys.select(*KEY).distinct(), "held-documents"))
    plain = docs.select(
        F.struct(F.col(id_col).alias("id")).alias("row"), F.xxhash64(text_of(text_col)).alias("digest"), F.col(text_col).alias("t")
    )
    return plain.join(keys, KEY, "left_semi").select(*KEY, words("t").alias("w"))


def phrase_matches(
    docs: DataFrame,
    index: DataFrame,
    terms: DataFrame,
    wins: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """Exact occurrences: ``row, digest, item, item_digest, begin, end`` (document positions, end excluded).

    A row is a longest stretch of an item found in a document; it has ``width`` words or more, or is the whole of
    a shorter item.  All occurrences of all windows lie in these rows, and nothing else does.
    """
    rare = small_or_not(written(_pairs(wins), "rarest"))
    proposed = index.join(rare.withColumnRenamed("term1", "term"), "term").select(
        *KEY, *ITEM, (F.col("pos") - F.col("i1")).alias("shift"), "i2", "term2"
    )
    seconds = small_or_not(written(rare.select(F.col("term2").alias("term")).distinct(), "second-terms"))
    seconds = index.join(seconds, "term", "left_semi").select(*KEY, "pos", F.col("term").alias("term2"))
    proposed = proposed.withColumn("pos", F.col("shift") + F.col("i2"))
    confirmed = proposed.join(seconds, [*KEY, "pos", "term2"], "left_semi")
    aligned = written(confirmed.select(*KEY, *ITEM, "shift").distinct(), "alignments")
    inside = _held(docs, aligned, id_col, text_col).select(*KEY, F.posexplode("w").alias("pos", "term"))
    expected = (
        aligned.join(terms, ITEM)
        .withColumn("pos", F.col("shift") + F.col("i"))
        .select(*KEY, *ITEM, "shift", "n", "i", "pos", "term")
    )
    matched = expected.join(inside, [*KEY, "pos", "term"], "left_semi")
    diagonal = [*KEY, *ITEM, "shift"]
    runs = (
        matched.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("i")))
        .groupBy(*diagonal, "run")
        .agg(F.min("pos").alias("begin"), F.count(F.lit(1)).alias("length"), F.first("n").alias("n"))
        .filter(F.col("length") >= F.least("n", F.lit(width)))
    )
    return runs.select(*KEY, *ITEM, "begin", (F.col("begin") + F.col("length")).alias("end"))


def _proposed(index: DataFrame, anchors: DataFrame, width: int, slop: int) -> DataFrame:
    """``row, digest, item, item_digest, n, band, lo, hi``: bands of shifts with two rare places, first and last of them.

    A place at ``d`` (its position minus its place in the item) supports the shifts within ``slop`` of ``d``.  Band
    ``b`` holds the ``2 * slop + 1`` shifts from ``b * (2 * slop + 1) + slop``; what supports them lies in it or the
    band before, so a posting gives two rows, not one for each shift.
    """
    span = 2 * slop + 1
    d = F.col("pos") - F.col("i")
    own = F.floor(d / span)
    bands = F.when(F.pmod(d, F.lit(span)) < 2 * slop, F.array(own - 1, own)).otherwise(F.array(own))
    spread = index.join(anchors, "term").select(*KEY, *ITEM, "n", "i", F.explode(bands).alias("band"))
    ranges = spread.groupBy(*KEY, *ITEM, "n", "band").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return ranges.filter((F.col("lo") < F.col("hi")) | (F.least("n", F.lit(width)) == 1))


def _asked_blocks(first: Column, last: Column) -> Column:
    """Numbers of the blocks of words from position ``first`` to ``last``."""
    return F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / BLOCK), F.floor(F.greatest(last, F.lit(0)) / BLOCK)))


def _hopeful(
    index: DataFrame,
    proposed: DataFrame,
    terms: DataFrame,
    wins: DataFrame,
    vocabulary: DataFrame,
    share: float,
    width: int,
    slop: int,
) -> DataFrame:
    """``row, digest, item, item_digest, n, band, starts``: windows of which enough places stand in the index.

    All places of a window whose terms the index has are looked at.  A match lacks ``size - need`` words at most, so
    it has all but so many of these; words that no document has are lacking, words without postings may be there.
    """
    span = 2 * slop + 1
    size = F.least("n", F.lit(width))
    low = F.col("band") * span
    asked = proposed.withColumn("block", _asked_blocks(low + F.col("lo") - size + 1, low + 4 * slop + F.col("hi") + size - 1))
    asked = asked.select(*KEY, *ITEM, "n", "band", "block")
    posted = index.filter("pos >= 0").select(*KEY, "pos", "term", F.floor(F.col("pos") / BLOCK).alias("block"))
    places = small_or_not(written(terms.join(vocabulary, "term", "left_semi").select(*ITEM, "i", "term"), "places"))
    offset = F.col("pos") - F.col("i") - low
    seen = (
        posted.join(asked, [*KEY, "block"])
        .join(places, [*ITEM, "term"])
        .filter((offset >= 0) & (offset <= 4 * slop))
        .groupBy(*KEY, *ITEM, "n", "band")
        .agg(F.collect_set("i").alias("there"))
    )
    least = (
        wins.withColumn("need", _need(share))
        .select(*ITEM, "start", "need", F.explode("p").alias("place"))
        .select(*ITEM, "start", "need", "place.count", "place.term")
        .join(vocabulary.withColumn("posted", F.lit(True)), "term", "left")
        .groupBy(*ITEM, "start", "need")
        .agg(F.count_if(F.col("posted").isNull() & (F.col("count") > 0)).cast("int").alias("unposted"))
        .select(*ITEM, F.struct("start", (F.col("need") - F.col("unposted")).alias("least")).alias("window"))
    )
    least = small_or_not(written(least.groupBy(*ITEM).agg(F.collect_list("window").alias("least")), "least"))

    def enough(w: Column) -> Column:
        inside = F.filter("there", lambda i: (i >= w["start"]) & (i < w["start"] + size))
        return F.size(inside) >= F.greatest(w["least"], F.lit(1))

    starts = F.transform(F.filter("least", enough), lambda w: w["start"])
    return seen.join(least, ITEM).select(*KEY, *ITEM, "n", "band", starts.alias("starts")).filter(F.size("starts") > 0)


def proximity_matches(
    docs: DataFrame,
    index: DataFrame,
    terms: DataFrame,
    wins: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW,
    slop: int = SLOP,
    share: float = NEAR_SHARE,
    exact: DataFrame | None = None,
) -> DataFrame:
    """``row, digest, item, item_digest``, distinct: documents that hold a window of the item nearly as it stands.

    A window is near at a shift when its words, looked up in order, each at the first place after the one before
    that is at most ``slop`` words from its own place under the shift, are found but for one minus ``share`` of
    them.  Every shift of every window counts; exact occurrences are near too, so the pairs of ``exact`` (the same
    columns, distinct), if given, are in the result without another look.

    Shifts are proposed by postings of rare places: a match has at least two of them within its slop
    (:func:`_anchors`).  Of these, only windows with enough places in the index (:func:`_hopeful`) are laid against
    the words of the document.  Both conditions hold for every match, so none is missed.
    """
    span = 2 * slop + 1
    anchors = written(_anchors(wins, share), "anchors")
    vocabulary = small_or_not(written(anchors.select("term").distinct(), "anchor-terms"))
    proposed = _proposed(index, small_or_not(anchors), width, slop)
    if exact is not None:
        proposed = proposed.join(small_or_not(exact), [*KEY, *ITEM], "left_anti")
    proposed = small_or_not(written(proposed, "proposed"))
    size = F.least("n", F.lit(width))
    low = F.col("band") * span
    hopeful = _hopeful(index, proposed, terms, wins, vocabulary, share, width, slop)
    asked = hopeful.withColumn("block", _asked_blocks(low + F.array_min("starts"), low + 4 * slop + F.array_max("starts") + size))
    asked = written(asked.withColumn("block", F.col("block").cast("int")), "asked")
    held = _held(docs, asked, id_col, text_col).filter(F.size("w") > 0)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / BLOCK)), lambda b: F.slice("w", (b * BLOCK + 1).cast("int"), BLOCK))
    blocks = held.select(*KEY, F.posexplode(cuts).alias("block", "part"))
    region = (
        blocks.join(small_or_not(asked), [*KEY, "block"])
        .groupBy(*KEY, *ITEM, "n", "band")
        .agg(F.sort_array(F.collect_set(F.struct("block", "part"))).alias("blocks"), F.first("starts").alias("starts"))
        .select(
            *KEY, *ITEM, "n", "band", "starts",
            (F.col("blocks")[0]["block"] * BLOCK).alias("base"),
            F.flatten("blocks.part").alias("said"),
        )
    )
    listed = terms.groupBy(*ITEM).agg(F.sort_array(F.collect_list(F.struct("i", "term")))["term"].alias("x"))
    region = region.join(small_or_not(written(listed, "item-words")), ITEM)
    need = F.ceil(F.round(size * F.lit(float(share)), 9))

    def found(s: Column, start: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            # positions in the region, from 0
            begin = F.greatest(acc["last"] + 1, (s + i - slop - F.col("base")).cast("int"), F.lit(0))
            width_left = F.greatest((s + i + slop - F.col("base")).cast("int") - begin + 1, F.lit(0))
            at = F.array_position(F.slice("said", begin + 1, width_left), F.get("x", i)).cast("int")
            return F.struct(
                F.when(at > 0, begin + at - 1).otherwise(acc["last"]).alias("last"),
                (acc["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"),
            )

        zero = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(start, start + size - 1), zero, step)["n"]

    shifts = F.sequence(low + slop, low + 3 * slop)
    holds = F.exists(shifts, lambda s: F.exists("starts", lambda start: found(s, start) >= need))
    near = region.filter(holds).select(*KEY, *ITEM).distinct()
    return near if exact is None else near.union(exact.select(*KEY, *ITEM))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    slop: int | None = None,
    share: float = NEAR_SHARE,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the text hash ``digest`` for every row.

    With a ``slop`` also ``n_near, near_sha256``: items that stand in the document exactly or nearly, as
    :func:`proximity_matches` defines it, counted and named like ``n_items, items_sha256``.  They decide nothing.

    Words are A-Z-lower-cased runs outside the ASCII marks.  A window is ``width`` consecutive words of an item;
    an item of fewer words, but not none, is one window.  A document word inside any occurrence of a window is
    hit; a document is contaminated when a twentieth of its words or more are hit.

    A null or empty text has no words and is never contaminated, nor does such an item ever match.  Rows with the
    same id are judged each by its own text; rows with a null id too.  Repeated items count once; an item with a
    null id hits words but is neither counted nor named.  Without
    documents the result is empty, without items nothing is hit.  Other columns are not looked at.
    """
    terms = item_terms(items, item_id_col, item_text_col)
    wins = windows(terms, term_counts(docs, terms, text_col), width)
    pairs = _pairs(wins)
    chosen = pairs.select(F.col("term1").alias("term")).union(pairs.select("term2"))
    if slop is not None:
        chosen = chosen.union(_anchors(wins, share).select("term"))
    index = postings(docs, chosen, id_col, text_col)
    found = written(phrase_matches(docs, index, terms, wins, id_col, text_col, width), "found")
    spans = F.sort_array(F.collect_set(F.struct("begin", "end")))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc, s):
        fresh = F.greatest(s["end"].cast("long"), acc["end"]) - F.greatest(s["begin"].cast("long"), acc["end"])
        return F.struct(
            F.greatest(s["end"].cast("long"), acc["end"]).alias("end"),
            (acc["total"] + F.greatest(fresh, F.lit(0))).alias("total"),
        )

    names = F.array_join(F.sort_array(F.collect_set(F.col("item.item_id").cast("string"))), ",")
    hits = (
        found.groupBy(*KEY)
        .agg(
            F.aggregate(spans, start, step)["total"].alias("n_hit"),
            F.count_distinct("item.item_id").alias("n_items"),
            F.sha2(names, 256).alias("items"),
        )
    )
    hits = small_or_not(written(hits, "hits"))
    rows = index.filter("pos < 0").select(*KEY, "n_words").join(hits, KEY, "left")
    near = []
    if slop is not None:
        exact = written(found.select(*KEY, *ITEM).distinct(), "exact")
        by_row = proximity_matches(docs, index, terms, wins, id_col, text_col, width, slop, share, exact)
        by_row = by_row.groupBy(*KEY).agg(F.count_distinct("item.item_id").alias("n_near"), F.sha2(names, 256).alias("near"))
        rows = rows.join(small_or_not(written(by_row, "near")), KEY, "left")
        near = [
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.coalesce("near", F.sha2(F.lit(""), 256)).alias("near_sha256"),
        ]
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    n_words = F.col("n_words").cast("long")
    return rows.select(
        F.col("row.id").alias("doc_id"),
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * MIN_SHARE >= n_words)).alias("contaminated"),
        *near,
        "digest",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows; all columns stay.

    A row is judged by its own id and text: repeated rows go or stay together, rows of one id but other texts each by
    their own, rows with a null id too.  Null and empty texts stay.  Columns may have any names; without documents
    the result is empty, without items all stay.
    """
    key_id, key_digest = unused(docs, "__id", "__digest")
    bad = contamination(docs, items, id_col, text_col).filter("contaminated").select("doc_id", "digest").distinct()
    bad = small_or_not(written(bad, "contaminated")).toDF(key_id, key_digest)
    match = docs[id_col].eqNullSafe(bad[key_id]) & (F.xxhash64(text_of(text_col)) == bad[key_digest])
    return docs.join(bad, match, "left_anti")
