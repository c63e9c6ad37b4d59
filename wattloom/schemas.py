"""Row schemas as DDL, and validation of request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Field names and types of the request format.
CONTAINER = (
    "struct<name:string,image:string,command:array<string>,args:array<string>,"
    "req_cpu_mcpu:bigint,req_mem_mib:bigint,lim_cpu_mcpu:bigint,lim_mem_mib:bigint>"
)
REQUEST_FIELDS = {
    "schema_version": "string",
    "namespace": "string",
    "workload_kind": "string",
    "workload_name": "string",
    "labels": "map<string,string>",
    "annotations": "map<string,string>",
    "containers": f"array<{CONTAINER}>",
    "init_container_count": "int",
    "sidecar_count": "int",
    "volume_types": "array<string>",
    "node_type": "string",
    "runtime_class": "string",
    "gpu_count": "int",
    "parallelism": "int",
    "completions": "int",
}
REQUEST_DDL = ", ".join(f"{name} {kind}" for name, kind in REQUEST_FIELDS.items())
REQUIRED = ("namespace", "workload_kind", "workload_name", "containers")

REJECT = "reject_reason"


def _defaults() -> dict[str, Column]:
    empty_map = F.create_map().cast("map<string,string>")
    return {
        "schema_version": F.lit("v1"),
        "labels": empty_map,
        "annotations": empty_map,
        "init_container_count": F.lit(0),
        "sidecar_count": F.lit(0),
        "volume_types": F.array().cast("array<string>"),
        "gpu_count": F.lit(0),
    }


def with_defaults(df: DataFrame) -> DataFrame:
    """Add absent request columns, cast the present ones, and fill the defaults."""
    defaults = _defaults()
    columns = {}
    for name, kind in REQUEST_FIELDS.items():
        value = F.col(name) if name in df.columns else F.lit(None)
        value = value.cast(kind)
        columns[name] = F.coalesce(value, defaults[name]) if name in defaults else value
    return df.withColumns(columns)


def validate(df: DataFrame) -> DataFrame:
    """Defaulted requests with a ``reject_reason``: null, or the required fields that are missing.

    A container without a name or image is rejected too.  A reason already set is kept.
    """
    df = with_defaults(df)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    nameless = F.exists("containers", lambda c: c["name"].isNull() | c["image"].isNull())
    reason = F.when(missing != "", F.concat(F.lit("missing field: "), missing)).when(
        nameless, F.lit("container without name or image")
    )
    if REJECT in df.columns:
        reason = F.coalesce(F.col(REJECT), reason)
    return df.withColumn(REJECT, reason)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REJECT).isNull()).drop(REJECT)


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REJECT).isNotNull())
