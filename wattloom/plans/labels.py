"""Label builder: gridded power and energy series, owners, per-step or per-job labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattloom.functions.quantities import epoch_seconds, step_seconds
from wattloom.operators import labels as ops
from wattloom.operators.counters import counter_steps
from wattloom.operators.grid import LOOKBACK_SECONDS, grid_max, grid_sum
from wattloom.sources.days import in_days

WINDOW_COLUMNS = (
    "ts", "namespace", "workload_kind", "workload_name", "pod", "avg_power_w", "energy_step_j"
)
DEFAULT_STEP = "60s"  # fixed value


def pod_series(
    samples: DataFrame,
    start: str | float,
    end: str | float,
    step: str | int = DEFAULT_STEP,
    series: Sequence[str] = ("container",),
    **grid_args,
) -> DataFrame:
    """Container samples as one series per pod: latest sample per step, summed over containers."""
    samples = ops.rename_aliases(samples)
    return grid_sum(
        samples, ops.POD_KEYS, [*ops.POD_KEYS, *series],
        start=epoch_seconds(start), end=epoch_seconds(end), step=step_seconds(step), **grid_args,
    )


def owner_series(
    samples: DataFrame, start: str | float, end: str | float, step: str | int = DEFAULT_STEP, **grid_args
) -> DataFrame:
    """Owner samples as one row per owner tuple and step."""
    by = [*ops.POD_KEYS, "owner_kind", "owner_name"]
    out = grid_max(
        ops.rename_aliases(samples), by, by,
        start=epoch_seconds(start), end=epoch_seconds(end), step=step_seconds(step), **grid_args,
    )
    return out.drop("value")


def build_labels(
    power: DataFrame | None,
    energy: DataFrame | None,
    owners: DataFrame | None = None,
    owner_dump: DataFrame | None = None,
    owner_source: str = "auto",
    mode: str = "window",
    check: bool = True,
) -> DataFrame:
    """Labels per pod and step (``window``) or per pod over the range (``job``).

    ``power`` and ``energy`` are per-pod series (namespace, pod or an alias, ts, value) with
    one row per step, as :func:`pod_series` gives them; energy is a counter.  ``check=False``
    means that an empty input has been replaced by ``None`` already.
    """
    if mode not in ("window", "job"):
        raise ValueError(f"unknown mode {mode!r}")
    if power is not None:
        power = ops.rename_aliases(power).withColumnRenamed("value", "avg_power_w")
    if energy is not None:
        energy = ops.drop_incomplete(ops.rename_aliases(energy))
        # One row per step already, so a pod's group is bounded by the length of the range.
        energy = counter_steps(energy, max_group_rows=None)
    joined = ops.join_power_energy(power, energy, check=check)
    chosen = ops.choose_owners(owners, owner_dump, owner_source, check)
    labelled = ops.with_owner(joined, chosen)
    if mode == "job":
        return ops.rollup(labelled)
    return labelled.select(*WINDOW_COLUMNS)


def labels_from_samples(
    power: DataFrame | None,
    energy: DataFrame | None,
    owners: DataFrame | None,
    owner_dump: DataFrame | None,
    start: str | float,
    end: str | float,
    step: str | int = DEFAULT_STEP,
    owner_source: str = "auto",
    mode: str = "window",
    series: Sequence[str] = ("container",),
    ts: str = "ts",
    lookback: int = LOOKBACK_SECONDS,
    **grid_args,
) -> DataFrame:
    """Labels from raw samples of three metrics.

    Which metrics are there is found out on the raw samples, a filtered scan that stops at
    the first row, and not on the series made from them.  Samples laid out by day (``sources.days``)
    are read from the days of the range and its look-back only.
    """
    first, width = epoch_seconds(start), step_seconds(step)
    last = first + (epoch_seconds(end) - first) // width * width
    grid = dict(start=start, end=end, step=step, ts=ts, lookback=lookback, **grid_args)
    power, energy, owners = (
        in_days(samples, first - lookback, last) if samples is not None else None for samples in (power, energy, owners)
    )

    def present(samples: DataFrame | None, need_keys: bool = False) -> bool:
        if samples is None:
            return False
        named = ops.rename_aliases(samples)
        if need_keys:
            named = ops.drop_incomplete(named)
        at = F.col(ts).cast("double")
        return ops.has_rows(named.filter((at > F.lit(first - lookback)) & (at <= F.lit(last))))

    return build_labels(
        pod_series(power, series=series, **grid) if present(power) else None,
        pod_series(energy, series=series, **grid) if present(energy, need_keys=True) else None,
        owner_series(owners, **grid) if owner_source != "k8s" and present(owners) else None,
        owner_dump,
        owner_source,
        mode,
        # A sample serves some grid point for sure only if it outlives a step.
        check=lookback < width,
    )
