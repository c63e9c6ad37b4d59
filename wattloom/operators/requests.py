"""Workload objects (JSON text) to request rows, for manifests, object dumps and change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.functions import quantities as q, specs
from wattloom.schemas import REJECT, REQUEST_FIELDS

# Kinds with a pod template, and the kinds of each entry point.
TEMPLATE_KINDS = ("Deployment", "Job", "CronJob")
WATCH_KINDS = ("Deployment", "Job", "CronJob", "Pod")
LIVE_EVENTS = ("ADDED", "MODIFIED")
DEFAULT_NAMESPACE = "default"
DEFAULT_NAME = "noname"

# Only the parts of an object that are read, in manifest spelling and in the spelling of
# client-library dumps.  Quantities are variants, so a number stays apart from a string.
_META = (
    "namespace:string,name:string,resourceVersion:string,resource_version:string,"
    "labels:map<string,string>,annotations:map<string,string>,"
    "ownerReferences:array<struct<kind:string,name:string>>,"
    "owner_references:array<struct<kind:string,name:string>>"
)
_CONTAINER = (
    "struct<name:string,image:string,command:array<string>,args:array<string>,"
    "resources:struct<requests:map<string,variant>,limits:map<string,variant>>>"
)
_POD_SPEC = (
    f"containers:array<{_CONTAINER}>,"
    "initContainers:array<struct<name:string>>,init_containers:array<struct<name:string>>,"
    "volumes:array<map<string,string>>,"
    "nodeSelector:map<string,string>,node_selector:map<string,string>,"
    "runtimeClassName:string,runtime_class_name:string"
)
_TEMPLATE = f"struct<metadata:struct<{_META}>,spec:struct<{_POD_SPEC}>>"
OBJECT_DDL = (
    f"kind string, metadata struct<{_META}>, "
    f"spec struct<template:{_TEMPLATE},"
    f"jobTemplate:struct<spec:struct<template:{_TEMPLATE}>>,"
    f"job_template:struct<spec:struct<template:{_TEMPLATE}>>,"
    f"parallelism:int,completions:int,{_POD_SPEC}>"
)


def either(parent: Column, camel: str, snake: str) -> Column:
    return F.coalesce(parent[camel], parent[snake])


def first_owner(metadata: Column) -> Column:
    """First owner reference, null when there is none."""
    return F.get(either(metadata, "ownerReferences", "owner_references"), 0)


def once(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` plus new columns that are computed once per row.

    A filter on an ordinary computed column is pushed below it and repeats its expression,
    here a whole JSON parse.  A generator of exactly one row is where that stops.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def parse_objects(df: DataFrame, json: str = "object") -> DataFrame:
    """Add the struct ``o`` read from the JSON text; text that is no object gives null."""
    return once(df, df.columns, o=F.from_json(json, OBJECT_DDL))


def live_events(df: DataFrame, kind: str = "type") -> DataFrame:
    """Additions and changes; deletions and the rest are dropped."""
    return df.filter(F.col(kind).isin(*LIVE_EVENTS))


def allow(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows whose column is in the list; no list lets everything pass."""
    return df.filter(F.col(column).isin(*values)) if values else df


# The quantities read from a container, as (request field, side, resource).
_QUANTITIES = (
    ("req_cpu_mcpu", "requests", "cpu"),
    ("req_mem_mib", "requests", "memory"),
    ("lim_cpu_mcpu", "limits", "cpu"),
    ("lim_mem_mib", "limits", "memory"),
)


def _quantity(value: Column) -> Column:
    """A quantity as text; an unquoted 0 or false means "not set", unlike the text "0"."""
    text = F.try_variant_get(value, "$", "string")
    unset = (F.schema_of_variant(value) != "STRING") & text.rlike(r"^(-?0(\.0*)?([eE].*)?|false)$")
    return F.when(~F.coalesce(unset, F.lit(False)), text)


def _with_texts(c: Column) -> Column:
    """A container with its quantities as text, read out of the variants once."""
    return F.struct(
        F.coalesce(c["name"], F.lit("")).alias("name"),
        F.coalesce(c["image"], F.lit("")).alias("image"),
        c["command"].alias("command"),
        c["args"].alias("args"),
        *[_quantity(c["resources"][side][name]).alias(field) for field, side, name in _QUANTITIES],
    )


def _container(c: Column) -> Column:
    parse = {"cpu": q.cpu_millicores, "memory": q.memory_mib}
    return F.struct(
        *[c[name].alias(name) for name in ("name", "image", "command", "args")],
        *[parse[name](c[field]).alias(field) for field, _, name in _QUANTITIES],
    )


def _bad_quantity(c: Column) -> Column:
    check = {"cpu": q.cpu_malformed, "memory": q.memory_malformed}
    first, *rest = [F.coalesce(check[name](c[field]), F.lit(False)) for field, _, name in _QUANTITIES]
    for one in rest:
        first = first | one
    return first


def _limits_text(c: Column) -> Column:
    return F.transform_values(
        c["resources"]["limits"], lambda _, v: F.try_variant_get(v, "$", "string")
    )


def pod_fields(metadata: Column, spec: Column, texts: Column) -> dict[str, Column]:
    """The request columns that come from a pod template or a pod."""
    empty_map = F.create_map().cast("map<string,string>")
    inits = either(spec, "initContainers", "init_containers")
    return {
        "labels": F.coalesce(metadata["labels"], empty_map),
        "annotations": F.coalesce(metadata["annotations"], empty_map),
        "containers": F.transform(texts, _container),
        "init_container_count": F.when(inits.isNull(), F.lit(0)).otherwise(F.size(inits)),
        "sidecar_count": F.lit(0),
        "volume_types": specs.volume_types(spec["volumes"]),
        "node_type": specs.node_type(either(spec, "nodeSelector", "node_selector")),
        "runtime_class": either(spec, "runtimeClassName", "runtime_class_name"),
        "gpu_count": specs.gpu_count(F.transform(spec["containers"], _limits_text)),
    }


def _requests(
    df: DataFrame, kind: Column, allow_pods: bool, keep: Sequence[str]
) -> DataFrame:
    """One projection for all kinds: pick the template by kind, then read it."""
    o_meta, o_spec = F.col("o.metadata"), F.col("o.spec")
    is_pod = (kind == "Pod") if allow_pods else F.lit(False)
    job_template = F.coalesce(o_spec["jobTemplate"], o_spec["job_template"])
    template = F.when(kind == "CronJob", job_template["spec"]["template"]).otherwise(o_spec["template"])
    # A pod carries its own spec; seen as a template it is (its metadata, its spec).
    pod_names = ("containers", "initContainers", "init_containers", "volumes", "nodeSelector",
                 "node_selector", "runtimeClassName", "runtime_class_name")
    as_template = F.struct(
        o_meta.alias("metadata"), F.struct(*[o_spec[n].alias(n) for n in pod_names]).alias("spec")
    )
    step = df.withColumns({"__kind": kind, "__t": F.when(is_pod, as_template).otherwise(template)})
    kind, t = F.col("__kind"), F.col("__t")
    listed = F.coalesce(t["spec"]["containers"], F.array().cast(f"array<{_CONTAINER}>"))
    step = step.withColumn("__texts", F.transform(listed, _with_texts))
    texts = F.col("__texts")
    is_pod = (kind == "Pod") if allow_pods else F.lit(False)
    owner = first_owner(o_meta)
    name = F.coalesce(o_meta["name"], F.lit(DEFAULT_NAME))
    kinds = WATCH_KINDS if allow_pods else TEMPLATE_KINDS
    bad = F.exists(texts, _bad_quantity)
    reason = (
        F.when(F.col("o").isNull(), F.lit("not an object"))
        .when(kind.isNull() | ~kind.isin(*kinds), F.concat(F.lit("unsupported kind: "), F.coalesce(kind, F.lit(""))))
        .when(t.isNull(), F.lit("missing pod template"))
        .when(bad, F.lit("malformed quantity"))
    )
    if REJECT in df.columns:
        reason = F.coalesce(F.col(REJECT), reason)
    is_job = kind == "Job"
    fields = {
        "schema_version": F.lit("v1"),
        "namespace": F.coalesce(o_meta["namespace"], F.lit(DEFAULT_NAMESPACE)),
        "workload_kind": F.when(is_pod, F.coalesce(F.nullif(owner["kind"], F.lit("")), F.lit("Pod"))).otherwise(kind),
        "workload_name": F.when(is_pod, F.coalesce(F.nullif(owner["name"], F.lit("")), name)).otherwise(name),
        **pod_fields(t["metadata"], t["spec"], texts),
        "parallelism": F.when(is_job, o_spec["parallelism"]),
        "completions": F.when(is_job, o_spec["completions"]),
    }
    typed = {n: fields[n].cast(dtype) for n, dtype in REQUEST_FIELDS.items()}
    return once(step, keep, **typed, **{REJECT: reason})


def manifest_requests(df: DataFrame, json: str = "object", keep: Sequence[str] = ()) -> DataFrame:
    """Requests of Deployment, Job and CronJob manifests; other kinds get a ``reject_reason``.

    ``keep`` names input columns to carry along.
    """
    parsed = parse_objects(df, json)
    return _requests(parsed, F.trim(F.col("o.kind")), allow_pods=False, keep=keep)


def object_requests(
    df: DataFrame,
    json: str = "object",
    kind: str | None = "kind",
    kinds: Sequence[str] | None = TEMPLATE_KINDS,
    namespaces: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Requests of live objects (dumps or change events), pods included when asked for.

    The kind comes from the column of that name, else from the object.  A CronJob with an
    empty template is skipped.
    """
    parsed = parse_objects(df, json)
    own = F.col("o.kind")
    parsed = parsed.withColumn("__k", F.coalesce(F.col(kind), own) if kind else own)
    parsed = allow(parsed, "__k", kinds)
    parsed = allow(parsed, "o.metadata.namespace", namespaces)
    jobs = F.coalesce(F.col("o.spec.jobTemplate"), F.col("o.spec.job_template"))["spec"]["template"]
    hollow = jobs.isNull() | (jobs["metadata"].isNull() & jobs["spec"].isNull())
    parsed = parsed.filter(~F.coalesce((F.col("__k") == "CronJob") & hollow, F.lit(False)))
    return _requests(parsed, F.col("__k"), allow_pods=True, keep=keep)


def object_keys(df: DataFrame, json: str = "object", kind: str | None = "kind") -> DataFrame:
    """Add ``key_namespace, key_kind, key_name, key_version``: what tells two sightings apart."""
    meta = F.from_json(
        json,
        "kind string, metadata struct<namespace:string,name:string,resourceVersion:string,resource_version:string>",
    )
    parsed = once(df, df.columns, __m=meta)
    m, own = F.col("__m.metadata"), F.col("__m.kind")
    version = F.nullif(either(m, "resourceVersion", "resource_version"), F.lit(""))
    return parsed.withColumns(
        {
            "key_namespace": m["namespace"],
            "key_kind": F.coalesce(F.col(kind), own) if kind else own,
            "key_name": m["name"],
            "key_version": F.coalesce(version, F.lit("0")),
        }
    ).drop("__m")


KEY_COLUMNS = ("key_namespace", "key_kind", "key_name", "key_version")


def owner_map(df: DataFrame, json: str = "object", namespaces: Sequence[str] | None = None) -> DataFrame:
    """(namespace, pod, owner_kind, owner_name) of pod objects: the first owner, else the pod itself."""
    meta = F.from_json(json, f"metadata struct<{_META}>")["metadata"]
    pods = df.select(meta.alias("m"))
    owner = first_owner(F.col("m"))
    out = pods.select(
        F.col("m.namespace").alias("namespace"),
        F.col("m.name").alias("pod"),
        F.when(owner.isNull(), F.lit("Pod")).otherwise(owner["kind"]).alias("owner_kind"),
        F.when(owner.isNull(), F.col("m.name")).otherwise(owner["name"]).alias("owner_name"),
    )
    return allow(out, "namespace", namespaces)


def first_documents(df: DataFrame, file: str, order: Sequence[str], is_object: Column) -> DataFrame:
    """The first document of each file that is an object."""
    row = F.struct(*df.columns)
    return (
        df.filter(is_object)
        .groupBy(F.col(file).alias("__file"))
        .agg(F.min_by(row, F.struct(*order)).alias("__first"))
        .select("__first.*")
    )
