"""Conversations as training strings with a loss mask, in windows of bounded size.  Built-in expressions only.

A turn is written as ``<|turn|>N:KIND:ROLE<|text|>TEXT<|end|>``: its number, ``+`` for a turn in its own window or
``=`` for one repeated as context, its role and its text.  Strings that control a model are escaped inside roles
and texts, so marks occur only where the template put them, and reading back gives the turns exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"  # fixed values: the template's marks
# Strings that never appear unescaped, and how; the escape sign itself comes first.
ESCAPES = [
    ("&", "&amp;"),
    ("<|", "&lt;|"),
    ("<s>", "&lt;s>"),
    ("</s>", "&lt;/s>"),
    ("<<SYS>>", "&lt;<SYS>>"),
    ("<</SYS>>", "&lt;</SYS>>"),
    ("[INST]", "&#91;INST]"),
    ("[/INST]", "&#91;/INST]"),
]
BUDGET = 512  # tokens after which a new window starts at the next turn
HISTORY = 2  # turns repeated from the window before
HISTORY_TOKENS = 128  # a longer turn is not repeated


def escaped(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescaped(c: Column) -> Column:
    for plain, coded in (("<", "&lt;"), ("[", "&#91;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def turn_tokens(text: Column) -> Column:
    """A size estimate: four code points a token, and four tokens for the marks."""
    return F.floor(F.char_length(text) / 4) + 4


def format_conversations(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """``conv_id, window, formatted, loss`` from rows ``conv_id, turn, role, text``.

    The prefix sum of turn sizes cuts a conversation at turns into windows of about ``budget`` tokens.  Every later
    window starts with the conversation's system turn, if its first turn is one, and with up to ``history`` short
    turns from the end of the window before.  ``loss`` lists the code points (from 0, end excluded) of assistant
    texts, each in its own window only; repeated turns carry no loss.

    Rows are ordered by turn, then role, then text; null turns come first, null roles and texts are empty, and a
    null ``conv_id`` is one conversation.  Repeated rows are turns of their own.  No rows give no windows.  Other
    columns are not looked at.  A conversation's windows are the unit of the output; sizes are summed over sorted
    rows without holding them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("tokens", turn_tokens(F.col("text")))
    before = F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    rows = rows.withColumns({"n": F.row_number().over(ordered) - 1, "raw": F.floor(before / budget)})
    rows = rows.withColumn("window", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("raw")) - 1)
    own = Window.partitionBy("conv_id", "window").orderBy(F.desc("n"))
    rows = rows.withColumn("from_end", F.row_number().over(own))
    head = (F.col("n") == 0) & (F.col("role") == "system")
    repeat = (F.col("from_end") <= history) & (F.col("tokens") <= history_tokens) & ~head
    own_part = F.struct(F.lit(0).alias("step"), F.lit("+").alias("kind"))
    kept = F.array(own_part, F.when(repeat, F.struct(F.lit(1).alias("step"), F.lit("=").alias("kind"))))
    placed = rows.select("*", F.explode(F.array_compact(kept)).alias("as")).select(
        "conv_id", (F.col("window") + F.col("as.step")).alias("window"), "n", "as.kind", "role", "text"
    )
    piece = F.struct("n", "kind", "role", "text")
    grouped = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    grouped = grouped.filter(F.exists("turns", lambda t: t["kind"] == "+"))
    # the system turn reaches later windows within the partition of its conversation: no join, no further shuffle
    first = F.when((F.col("window") == 0) & (F.col("turns")[0]["n"] == 0), F.col("turns")[0])
    first = F.when(first["role"] == "system", F.array(first.withField("kind", F.lit("="))))
    earlier = Window.partitionBy("conv_id").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    grouped = grouped.withColumn("system", F.first(first, ignorenulls=True).over(earlier))
    lead = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.col("system")).otherwise(F.slice("turns", 1, 0))
    written = F.transform(
        F.concat(lead, "turns"),
        lambda t: F.struct(
            F.concat(F.lit(TURN), t["n"], F.lit(":"), t["kind"], F.lit(":"), escaped(t["role"]), F.lit(TEXT)).alias("head"),
            escaped(t["text"]).alias("body"),
            ((t["role"] == "assistant") & (t["kind"] == "+")).alias("target"),
        ),
    )
    whole = grouped.select("conv_id", "window", F.explode(F.array(written)).alias("parts"))
    lengths = F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END))
    whole = whole.select("conv_id", "window", "parts", F.explode(F.array(lengths)).alias("lengths"))
    # begin of each part: positions are added up over rows of the window, so long windows stay linear
    exploded = whole.select("conv_id", "window", F.posexplode(F.arrays_zip("parts", "lengths")).alias("k", "part"))
    upto = Window.partitionBy("conv_id", "window").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.sum("part.lengths").over(upto) - F.col("part.lengths") + F.char_length("part.parts.head")
    exploded = exploded.withColumn("begin", begin)
    string = F.concat("part.parts.head", "part.parts.body", F.lit(END))
    span = F.when(
        F.col("part.parts.target"),
        F.struct(F.col("begin"), (F.col("begin") + F.char_length("part.parts.body")).alias("end")),
    )
    pieces = F.sort_array(F.collect_list(F.struct("k", string.alias("s"))))
    out = exploded.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )
    return out


def _turns(formatted: Column) -> Column:
    """The turns written in a string, in order; those repeated as context have the kind ``=``."""

    def turn(part: Column) -> Column:
        h, said = F.split(F.substring_index(part, TEXT, 1), ":", 3), F.substring_index(part, TEXT, -1)
        said = F.left(said, F.char_length(said) - len(END))
        return F.struct(
            h[0].cast("long").alias("n"), h[1].alias("kind"), unescaped(h[2]).alias("role"), unescaped(said).alias("text")
        )

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>"), lambda part: part != ""), turn)


def _learned(formatted: Column, loss: Column) -> Column:
    """The stretches under the loss mask, unescaped."""
    return F.transform(
        loss,
        lambda s: F.struct(
            s["begin"].alias("begin"),
            unescaped(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"])).alias("text"),
        ),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """``conv_id, n, role, text`` of every turn, each once, from the formatted strings."""
    every = windows.select("conv_id", F.explode(_turns(F.col("formatted"))).alias("t")).filter("t.kind = '+'")
    return every.select("conv_id", "t.n", "t.role", "t.text")


def read_loss(windows: DataFrame) -> DataFrame:
    """``conv_id, window, begin, text`` of every stretch under the loss mask, unescaped."""
    spans = F.explode(_learned(F.col("formatted"), F.col("loss"))).alias("s")
    return windows.select("conv_id", "window", spans).select("conv_id", "window", "s.begin", "s.text")


def digests(windows: DataFrame) -> DataFrame:
    """What a conversation's windows hold, read back from them: one row per conversation, in one aggregation."""
    own = F.filter(_turns(F.col("formatted")), lambda t: t["kind"] == "+")
    read = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("turns"),
            F.transform(_learned(F.col("formatted"), F.col("loss")), lambda s: s["text"]).alias("learned"),
        ).alias("read"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("read")).alias("reads"), F.sum("chars").alias("formatted_chars")
    )
    said, learned = F.flatten("reads.turns"), F.array_join(F.flatten("reads.learned"), "")
    return whole.select(
        "conv_id",
        F.size(said).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
