"""Power and energy tables joined, given owners, and rolled up per workload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.functions.names import owner_workload

# Other spellings of the key labels, in order of preference.
LABEL_ALIASES = {
    "namespace": ("container_namespace", "pod_namespace", "kubernetes_namespace", "ns"),
    "pod": ("pod_name", "podname", "pod_uid", "podid"),
}
POD_KEYS = ("namespace", "pod")
STEP_KEYS = ("namespace", "pod", "ts")
WORKLOAD_KEYS = ("namespace", "workload_kind", "workload_name", "pod")


def rename_aliases(df: DataFrame, aliases: dict[str, Sequence[str]] = LABEL_ALIASES) -> DataFrame:
    """Give each key column its usual name, from the first alias present; no row-wise mixing."""
    for target, names in aliases.items():
        found = next((n for n in names if n in df.columns), None)
        if target not in df.columns and found:
            df = df.withColumnRenamed(found, target)
    return df


def drop_incomplete(df: DataFrame, keys: Sequence[str] = POD_KEYS) -> DataFrame:
    return df.dropna(how="any", subset=list(keys))


def has_rows(df: DataFrame | None, check: bool = True) -> bool:
    """Whether a side is there; ``check=False`` takes any given frame as filled, without a job."""
    return df is not None and not (check and df.isEmpty())


def join_power_energy(
    power: DataFrame | None,
    energy: DataFrame | None,
    keys: Sequence[str] = STEP_KEYS,
    power_value: str = "avg_power_w",
    energy_value: str = "energy_step_j",
    check: bool = True,
) -> DataFrame:
    """Power rows with the energy of the same step.

    Where one side is empty (or ``None``) the other gives the keys and the missing measure
    is null; two empty sides are an error.  ``check=False`` trusts the caller to pass
    ``None`` for an empty side, which saves computing each side up to its first row.
    """
    with_power, with_energy = has_rows(power, check), has_rows(energy, check)
    if not with_power and not with_energy:
        raise ValueError("no power and no energy samples in the given range")
    nothing = F.lit(None).cast("double")
    if not with_power:
        return energy.select(*keys, nothing.alias(power_value), energy_value)
    if not with_energy:
        return power.select(*keys, power_value, nothing.alias(energy_value))
    return power.select(*keys, power_value).join(
        energy.select(*keys, energy_value), list(keys), "left"
    )


def choose_owners(
    primary: DataFrame | None, fallback: DataFrame | None, source: str = "auto", check: bool = True
) -> DataFrame:
    """Owner map from the time-stamped primary source, or from the object dump.

    ``source``: ``prom`` insists on the primary, ``k8s`` on the dump, ``auto`` prefers the first.
    """
    if source not in ("prom", "k8s", "auto"):
        raise ValueError(f"unknown owner source {source!r}")
    if source != "k8s" and has_rows(primary, check):
        return rename_aliases(primary).select(*POD_KEYS, "owner_kind", "owner_name", "ts")
    if source == "prom":
        raise ValueError("the primary source holds no owner map")
    if fallback is None:
        raise ValueError("no owner map given")
    return fallback.select(*POD_KEYS, "owner_kind", "owner_name")


def with_owner(
    labels: DataFrame,
    owners: DataFrame,
    pod_keys: Sequence[str] = POD_KEYS,
    ts: str = "ts",
    owner_kind: str = "owner_kind",
    owner_name: str = "owner_name",
) -> DataFrame:
    """Add ``workload_kind`` and ``workload_name`` from the owner map.

    With a time column in the map the join is per step, without one per pod.  Several
    owners of a key repeat its rows.  No side is broadcast by hand: the map grows with the
    cluster, so Spark decides on its measured size and splits skewed pods.
    """
    keys = [*pod_keys, ts] if ts in owners.columns else list(pod_keys)
    joined = labels.join(owners.select(*keys, owner_kind, owner_name), keys, "left")
    kind, name = owner_workload(F.col(owner_kind), F.col(owner_name), F.col(pod_keys[-1]))
    return joined.withColumns({"workload_kind": kind, "workload_name": name}).drop(
        owner_kind, owner_name
    )


def rollup(
    labels: DataFrame,
    by: Sequence[str] = WORKLOAD_KEYS,
    power: str | Column = "avg_power_w",
    energy: str | Column = "energy_step_j",
) -> DataFrame:
    """Mean power and total energy per group; rows without a key are left out, no energy sums to 0."""
    return (
        labels.dropna(how="any", subset=list(by))
        .groupBy(*by)
        .agg(
            F.avg(power).alias("avg_power_w"),
            F.coalesce(F.sum(energy), F.lit(0.0)).alias("total_energy_j"),
        )
    )


def finite(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is a finite number."""
    y = F.col(target).cast("double")
    return df.filter(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
