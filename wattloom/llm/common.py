"""Small helpers the operators share: text expressions, unused names, written tables, size-checked semi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.session import scratch_path

# The six space characters of the contracts, as a character class and as trim characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

# Texts without these take the fast general lower-casing, which then changes A-Z only.
_OTHER_CASED = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"

#: Most rows a side may have to be sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def lower_az(column: str | Column) -> Column:
    """A-Z lower-cased and nothing else; null as empty."""
    c = text_of(column)
    return F.when(c.rlike(_OTHER_CASED), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def unused(df: DataFrame, *bases: str) -> list[str]:
    """A column name for each base that ``df`` does not have, whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use many times, computed once.

    A one-row generator stands between them and what follows; without it the optimizer would
    put their expressions into every use, also inside lambdas.
    """
    names = list(columns)
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    (box,) = unused(df, "__box")
    return df.withColumn(box, F.explode(F.array(packed))).select(
        *[df[c] for c in df.columns], *[F.col(box)[n].alias(n) for n in names]
    )


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``limit`` rows; otherwise joins shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], other: Sequence[str] | None = None):
    """Null-safe equality of ``left``'s keys and ``right``'s."""
    out = F.lit(True)
    for a, b in zip(keys, other or keys):
        out = out & left[a].eqNullSafe(right[b])
    return out
