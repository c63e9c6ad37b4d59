"""Spelling variants: words one code point apart, found as equal pairs of trie nodes, and the form each one leads to."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattloom.llm.common import LOWER_BYTES, written
from wattloom.operators.ranks import with_rank

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: One in so many words of a document loses a code point, to plant variants; the choice is a checksum of id and word.
DROP_EVERY = 199
#: Words numbered by one task at a time.
SEGMENT = 20_000

_CHUNK = 4 << 20  # bytes of text looked at together, a longer text alone
_LONG = 64  # bytes beyond which a run's checksum is computed on its own


def _crc_table() -> np.ndarray:
    """CRC-32 steps of one byte, from the polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_table()


def _checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run continued from the checksum ``before``; byte j of all runs that have one at a time."""
    order = np.argsort(-size, kind="stable")
    at, left, state = start[order], size[order], before[order] ^ np.uint32(0xFFFFFFFF)
    shorter = np.searchsorted(left[::-1], _LONG, side="right")
    n_long = len(left) - shorter
    for j in range(int(left[n_long]) if shorter else 0):
        n = len(left) - np.searchsorted(left[::-1], j, side="right")
        part = state[n_long:n]
        state[n_long:n] = _STEPS[(part ^ data[at[n_long:n] + j]) & 0xFF] ^ (part >> 8)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:n_long]:
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(before[k]))
    return out


def _runs(texts: bytes, ends: np.ndarray, ids: list, min_length: int, drop_every: int | None) -> pa.Array:
    """Words of the joined texts (UTF-8, text i up to ``ends[i]``), with a code point dropped where the checksum says so."""
    low = texts.translate(LOWER_BYTES)
    data = np.frombuffer(low, np.uint8)
    lead = data == 0xC3  # in UTF-8 the first byte of U+00C0 to U+00FF and of nothing else
    letter = ((data >= 97) & (data <= 122)) | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends[ends <= len(data)]] = True
    begins = letter & (~np.r_[False, letter[:-1]] | edge[:-1])
    stops = letter & (~np.r_[letter[1:], False] | edge[1:])
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    leads = np.r_[0, np.cumsum(lead)]
    points = stop - start - (leads[stop] - leads[start])
    long = points >= min_length
    start, stop, points = start[long], stop[long], points[long]
    bounds = np.empty(2 * len(start) + 2, np.int32)
    bounds[0], bounds[-1] = 0, len(data)
    bounds[1:-1:2], bounds[2:-1:2] = start, stop
    pieces = pa.Array.from_buffers(pa.binary(), 2 * len(start) + 1, [None, pa.py_buffer(bounds), pa.py_buffer(low)])
    every = pieces.take(pa.array(np.arange(len(start)) * 2 + 1))
    if not drop_every or not len(start):
        return every
    doc = np.searchsorted(ends, start, side="right")
    before = np.array([0 if i is None else zlib.crc32(b"%d:" % i) for i in ids], np.uint32)
    known = np.array([i is not None for i in ids], bool)
    sums = _checksums(data, start, stop - start, before[doc])
    hit = (sums % drop_every == 0) & known[doc]
    cut = []
    for k in np.flatnonzero(hit):
        word = low[start[k] : stop[k]].decode()
        at = int(sums[k]) % len(word)
        if len(word) > min_length:
            cut.append((word[:at] + word[at + 1 :]).encode())
    return pa.concat_arrays([every.filter(pa.array(~hit)), pa.array(cut, pa.binary())])


def _counter(min_length: int, drop_every: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
            first = 0
            while first < len(ids):
                last, room = first + 1, _CHUNK - sizes[first]
                while last < len(ids) and sizes[last] <= room:
                    room -= sizes[last]
                    last += 1
                joined = b"".join(t.as_py() or b"" for t in texts[first:last])
                words = _runs(joined, np.cumsum(sizes[first:last]), ids[first:last], min_length, drop_every)
                counts = words.value_counts()
                yield pa.RecordBatch.from_arrays(
                    [counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], ["word", "n"]
                )
                first = last

    return count


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    drop_every: int | None = None,
) -> DataFrame:
    """``word, n``: runs of Latin letters of whole texts (A-Z lower-cased), with at least so many code points and uses.

    With ``drop_every`` a word whose CRC-32 of ``<id>:<word>`` it divides loses the code point at checksum modulo
    length.  Words are counted per few MB of text before anything is shuffled, so a word that every document uses
    costs a row per few MB.  Null texts have no words; words of rows without an id lose nothing; a repeated row
    counts again; an empty table has no words.  Other columns are not read.
    """
    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = taken.mapInArrow(_counter(min_length, drop_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _path_numbers(words: pd.DataFrame) -> pd.DataFrame:
    """Numbers of the trie nodes on each word's path, counted from 1 within this run of sorted words."""
    words = words.sort_values("rank")
    path, last, used, out = [], "", 0, []
    for word in words["key"]:
        same, top = 0, min(len(last), len(word))
        while same < top and last[same] == word[same]:
            same += 1
        fresh = len(word) - same
        path = path[:same] + list(range(used + 1, used + fresh + 1))
        used, last = used + fresh, word
        out.append(path)
    return pd.DataFrame({"segment": words["segment"], "rank": words["rank"], "wid": words["wid"], "key": words["key"], "path": out})


def _shared(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def trie_paths(words: DataFrame, key: Column, segment: int = SEGMENT, name: str = "trie") -> DataFrame:
    """``wid, path``: numbers of the nodes of a trie over ``key`` (distinct, not empty) from the root (0) to each word.

    Sorted words that share a prefix stand together, so each run of ``segment`` of them numbers its nodes alone;
    the first word of a run may share nodes with the word before it, and these numbers are handed on from run to
    run by the driver, which sees the first and last word of each run.
    """
    spark = words.sparkSession
    ranked = with_rank(words.select("wid", key.alias("key")), "key", out="rank", name=f"{name}-words")
    runs = ranked.withColumn("segment", F.expr(f"rank DIV {segment}"))
    kind = "segment long, rank long, wid long, key string, path array<long>"
    numbered = written(runs.groupBy("segment").applyInPandas(_path_numbers, kind), f"{name}-numbers")
    ends = numbered.groupBy("segment").agg(
        F.min_by("key", "rank").alias("first"),
        F.max_by("key", "rank").alias("last"),
        F.max_by("path", "rank").alias("path"),
        F.max(F.array_max("path")).alias("used"),
    )
    handed, last, path, base = [], "", [], 0
    for r in sorted(ends.collect()):  # a row per run
        known = path[: _shared(last, r["first"])]
        handed.append((r["segment"], base, known))
        path = [known[x - 1] if x <= len(known) else base + x for x in r["path"]]
        last, base = r["last"], base + r["used"]
    before = spark.createDataFrame(handed, "segment long, base long, known array<long>")
    whole = F.transform("path", lambda x: F.when(x <= F.size("known"), F.get("known", (x - 1).cast("int"))).otherwise(F.col("base") + x))
    # a row per run: as many as words / segment
    return numbered.join(F.broadcast(before), "segment").select("wid", F.concat(F.array(F.lit(0).cast("long")), whole).alias("path"))


def near_pairs(words: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``a, na, b, nb`` for all words ``a``, ``b`` (given as ``wid, word, n``) that one code point tells apart, both ways.

    A word of length L is the pair (node of its first i letters, node of its last L - i) for every i; with letter i
    skipped it is (node of the first i, node of the last L - i - 1).  Two words with an equal skipped pair differ
    by a replaced letter, a skipped pair equal to a whole one means an inserted letter.  Of equal letters in a row
    only the first is skipped for insertions, so each pair of words is found at one place.  A pair of nodes is
    shared by at most one word for each letter of the alphabet.
    """
    forward = trie_paths(words, F.col("word"), segment, "forward")
    backward = trie_paths(words, F.reverse("word"), segment, "backward").select("wid", F.reverse("path").alias("tail"))
    paths = written(words.join(forward, "wid").join(backward, "wid"), "paths")
    size = F.char_length("word")
    # path[i]: the first i letters; tail[i]: the letters from i on
    skipped = paths.select("wid", "n", "word", "tail", F.posexplode(F.slice("path", F.lit(1), size)).alias("i", "p")).select(
        "wid",
        "n",
        "p",
        F.get("tail", F.col("i") + 1).alias("s"),
        ((F.col("i") == 0) | (F.substring("word", F.col("i"), F.lit(1)) != F.substring("word", F.col("i") + 1, F.lit(1)))).alias("first"),
    )
    whole = paths.select("wid", "n", "tail", F.posexplode("path").alias("i", "p")).select("wid", "n", "p", F.get("tail", "i").alias("s"))
    a = skipped.select(F.col("wid").alias("a"), F.col("n").alias("na"), "p", "s", "first")
    b = skipped.withColumn("gap", F.lit(True)).unionByName(whole.withColumn("gap", F.lit(False)), allowMissingColumns=True)
    b = b.select(F.col("wid").alias("b"), F.col("n").alias("nb"), "p", "s", "gap")
    found = a.join(b, ["p", "s"]).filter(F.when(F.col("gap"), F.col("a") != F.col("b")).otherwise(F.col("first")))
    there = F.struct("a", "na", "b", "nb")
    back = F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))
    # replacements are found from both words, insertions from the longer one
    return found.select(F.explode(F.when(F.col("gap"), F.array(there)).otherwise(F.array(there, back))).alias("x")).select("x.*")


def spelling_variants(counts: DataFrame, ratio: int = RATIO, segment: int = SEGMENT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct, non-empty words and their counts (``word, n``).

    ``form`` is the near word of largest count (ties: the smallest in code-point order) if that count is at least
    ``ratio`` times the word's, else null; ``root`` is where the forms lead, the word itself if it has none.  Counts
    grow by ``ratio`` (over 1) at every step, so forms make no rings and the path is short.  No words, no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be used at least twice as often as its variants")
    words = with_rank(counts.select("word", "n"), "word", out="wid", name="words")  # numbers in code-point order
    words = written(words.select("wid", "word", "n"), "numbered")
    pairs = near_pairs(words, segment)
    best = F.max(F.struct(F.col("nb").alias("n"), (-F.col("b")).alias("order"))).alias("best")
    near = pairs.groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), best)
    known = words.join(near, "wid", "left")
    strong = F.col("best.n") >= ratio * F.col("n")
    step = known.select(
        "wid",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, -F.col("best.order")).alias("form"),
        F.when(strong, F.col("best.n")).alias("form_n"),
    )
    step = written(step, "forms")
    jumps = step.filter("form IS NOT NULL").select("wid", F.col("form").alias("to"))
    while True:  # a round doubles the steps taken
        jumps = written(jumps, "jumps")
        on = jumps.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        ahead = jumps.join(on, "to")
        if not ahead.limit(1).count():
            break
        jumps = jumps.join(on, "to", "left").select("wid", F.coalesce("next", "to").alias("to"))
    named = step.join(jumps, "wid", "left").select("*", F.coalesce("to", "wid").alias("root_id"))
    forms = words.select(F.col("wid").alias("form"), F.col("word").alias("form_word"))
    roots = words.select(F.col("wid").alias("root_id"), F.col("word").alias("root"))
    full = named.join(forms, "form", "left").join(roots, "root_id")
    return full.select("word", F.col("form_word").alias("form"), "root", "n", "n_near", "form_n")
