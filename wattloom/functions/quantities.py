"""Resource quantities, number coercion, and time bounds."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# Memory suffixes and the MiB each stands for; "K" and "Ki" count alike.
MEMORY_SUFFIX_MIB = {
    "k": 1 / 1024, "ki": 1 / 1024,
    "m": 1, "mi": 1,
    "g": 1024, "gi": 1024,
    "t": 1024 * 1024, "ti": 1024 * 1024,
}
_DECIMAL = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_NUMBER = rf"^\s*{_DECIMAL}\s*$"
_CPU = rf"^({_DECIMAL})\s*(m?)$"
_MEMORY = rf"^({_DECIMAL})\s*([kmgt]i?)?$"
_MEMORY_SUFFIX = r"[kmgt]i?$"
_STEP_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def to_double(text: Column) -> Column:
    """Decimal number in a string, or null; words such as ``nan`` and ``1d`` are not numbers."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_int(text: Column) -> Column:
    """Whole part of a number in a string, null when it is no number or does not fit."""
    return to_double(text).try_cast("int")


def _clean(quantity: Column) -> Column:
    return F.lower(F.trim(quantity.cast("string")))


def _matched(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def cpu_millicores(quantity: Column) -> Column:
    """Whole millicores of a processor quantity: ``100m``, or cores such as ``0.5``."""
    q = _clean(quantity)
    unit = F.when(_matched(q, _CPU, 2) == "m", F.lit(1.0)).otherwise(F.lit(1000.0))
    return (_matched(q, _CPU, 1).try_cast("double") * unit).try_cast("bigint")


def cpu_malformed(quantity: Column) -> Column:
    return (quantity.cast("string") != "") & cpu_millicores(quantity).isNull()


def memory_mib(quantity: Column) -> Column:
    """Whole MiB of a memory quantity; without a suffix it counts bytes."""
    q = _clean(quantity)
    factors = {**MEMORY_SUFFIX_MIB, "": 1 / (1024 * 1024)}
    table = F.create_map(*[F.lit(x) for suffix, mib in factors.items() for x in (suffix, float(mib))])
    return (_matched(q, _MEMORY, 1).try_cast("double") * table[_matched(q, _MEMORY, 2)]).try_cast("bigint")


def memory_malformed(quantity: Column) -> Column:
    """True where a known suffix follows something that is no number.

    A bare word or an unknown suffix is a plain null, not an error.
    """
    return _clean(quantity).rlike(_MEMORY_SUFFIX) & memory_mib(quantity).isNull()


def step_seconds(step: str | int | float) -> int:
    """``"60s"``, ``"5m"``, ``"1h"`` or a plain number of seconds."""
    match = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", str(step))
    if not match or int(match.group(1)) == 0:
        raise ValueError(f"not a step: {step!r}")
    return int(match.group(1)) * _STEP_SECONDS[match.group(2) or "s"]


def epoch_seconds(bound: str | int | float | datetime) -> float:
    """A time bound given as epoch seconds or ISO text, as epoch seconds in UTC."""
    if isinstance(bound, (int, float)):
        return float(bound)
    if isinstance(bound, str):
        try:
            return float(bound)
        except ValueError:
            bound = datetime.fromisoformat(bound.strip().replace("Z", "+00:00"))
    if bound.tzinfo is None:
        bound = bound.replace(tzinfo=timezone.utc)
    return bound.timestamp()


def timestamp_seconds(ts: Column) -> Column:
    """Timestamp (with or without zone, session zone UTC) as fractional epoch seconds."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def seconds_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))
