"""Workload names: owner fallback, ReplicaSet and Pod names mapped to their Deployment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Name patterns of generated ReplicaSets and Pods.
REPLICASET_SUFFIX = r"-[a-f0-9]{9,}$"
REPLICASET_NAME = r"^(.+)-[a-f0-9]{9,}$"
REPLICASET_POD_NAME = r"^(.+)-[a-f0-9]{9,}-[a-z0-9]{5}$"


def owner_workload(kind: Column, name: Column, pod: Column) -> tuple[Column, Column]:
    """Owner as (kind, name): ReplicaSets become Deployments, a missing part falls back to the pod."""
    from_replicaset = (kind == "ReplicaSet") & name.isNotNull()
    out_kind = F.when(from_replicaset, F.lit("Deployment")).otherwise(F.coalesce(kind, F.lit("Pod")))
    out_name = F.when(from_replicaset, F.regexp_replace(name, REPLICASET_SUFFIX, "")).otherwise(name)
    return out_kind, F.coalesce(out_name, pod.cast("string"))


def _base(name: Column, *patterns: str) -> Column:
    """First capture of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in patterns])


def canonical_workload(kind: Column, name: Column) -> tuple[Column, Column]:
    """(kind, name) of the workload that a spec row would carry."""
    kind = F.trim(F.coalesce(kind, F.lit("")))
    name = F.trim(F.coalesce(name, F.lit("")))
    pod_base = _base(name, REPLICASET_POD_NAME, REPLICASET_NAME)
    set_base = _base(name, REPLICASET_NAME)
    out_kind = (
        F.when(kind == "ReplicaSet", F.lit("Deployment"))
        .when((kind == "Pod") & pod_base.isNotNull(), F.lit("Deployment"))
        .otherwise(kind)
    )
    out_name = (
        F.when(kind == "ReplicaSet", F.coalesce(set_base, name))
        .when(kind == "Pod", F.coalesce(pod_base, name))
        .otherwise(name)
    )
    return out_kind, out_name


def normalise_keys(df: DataFrame) -> DataFrame:
    """Trim the key columns present and lower-case the namespace; nulls stay null and never join."""
    out = {
        c: F.trim(F.col(c).cast("string"))
        for c in ("namespace", "workload_kind", "workload_name")
        if c in df.columns
    }
    if "namespace" in out:
        out["namespace"] = F.lower(out["namespace"])
    return df.withColumns(out)


def with_canonical(df: DataFrame) -> DataFrame:
    kind, name = canonical_workload(F.col("workload_kind"), F.col("workload_name"))
    return normalise_keys(df).withColumns({"canon_kind": kind, "canon_name": name})
