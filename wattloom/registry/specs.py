"""Quantities, spec expressions, request projections, readers and writers.  Roles: part = workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.functions import quantities as q, specs
from wattloom.functions.vectors import hashed_text, norm
from wattloom.operators.flatten import flat_rows
from wattloom.operators.requests import first_documents, live_events, object_requests, owner_map
from wattloom.plans.score import requests_of_documents
from wattloom.registry.base import query, r, table
from wattloom.schemas import REJECT, accepted, rejected
from wattloom.session import scratch_path, spread, written
from wattloom.sources.manifests import read_documents
from wattloom.sources.items import write_one_list
from wattloom.sources.objects import read_changes, read_dump, read_large_dump
from wattloom.sources.tables import append_requests, read_requests



def s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _branch(on: Column, cases: dict, otherwise=None) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for value, result in cases.items():
        out = F.when(on == value, result if isinstance(result, Column) else F.lit(result)).otherwise(out)
    return out


@query(
    "cpu_quantity",
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000
  WHEN 2 THEN trunc(p_retailprice * 1000)::BIGINT WHEN 3 THEN trunc(p_retailprice)::BIGINT END::BIGINT AS mcpu,
  coalesce(p_size % 6 = 4, false) AS malformed FROM part""",
)
def cpu_quantity(spark, sf):
    part = table(spark, sf, "part")
    text = _branch(
        F.col("p_size") % 6,
        {
            0: F.concat(s("p_size"), F.lit("m")), 1: s("p_size"), 2: s("p_retailprice"),
            3: F.concat(F.lit(" "), s("p_retailprice"), F.lit("M ")), 4: F.concat(s("p_size"), F.lit("n")), 5: "",
        },
    )
    bad = F.coalesce(q.cpu_malformed(text), F.lit(False))
    return part.select("p_partkey", q.cpu_millicores(text).alias("mcpu"), bad.alias("malformed"))


@query(
    "mem_quantity",
    """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN trunc(p_size * 100 / 1024)
  WHEN 3 THEN trunc(p_retailprice * 1048576) WHEN 4 THEN trunc(p_retailprice * 100000 / 1048576)
  WHEN 5 THEN trunc(p_retailprice) END::BIGINT AS mib, p_size % 8 = 7 AS malformed FROM part""",
)
def mem_quantity(spark, sf):
    part = table(spark, sf, "part")
    text = _branch(
        F.col("p_size") % 8,
        {
            0: F.concat(s("p_size"), F.lit("Mi")), 1: F.concat(s("p_size"), F.lit("G")),
            2: F.concat(s(F.col("p_size") * 100), F.lit("ki")), 3: F.concat(s("p_retailprice"), F.lit("Ti")),
            4: s((F.col("p_retailprice") * 100000).cast("bigint")), 5: F.concat(s("p_retailprice"), F.lit("m")),
            6: F.concat(s("p_size"), F.lit("Pi")), 7: F.lit("oneGi"),
        },
    )
    bad = F.coalesce(q.memory_malformed(text), F.lit(False))
    return part.select("p_partkey", q.memory_mib(text).alias("mib"), bad.alias("malformed"))


@query(
    "resource_sum",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_suppkey AS req_cpu_mcpu,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END + l_linenumber AS req_mem_mib FROM lineitem""",
)
def resource_sum(spark, sf):
    """Each line item as a request with two containers; some resources are not set."""
    box = lambda cpu, mem: F.struct(cpu.cast("bigint").alias("req_cpu_mcpu"), mem.cast("bigint").alias("req_mem_mib"))
    unset = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    containers = F.array(box(F.col("l_quantity"), unset), box(F.col("l_suppkey"), F.col("l_linenumber")))
    rows = table(spark, sf, "lineitem").withColumn("containers", containers)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[specs.resource_sum(F.col("containers"), c).alias(c) for c in ("req_cpu_mcpu", "req_mem_mib")],
    )


@query(
    "accelerator_count",
    """SELECT p_partkey, (p_size + CASE WHEN p_size % 2 = 0 THEN 0 ELSE trunc(p_retailprice)::INTEGER END)::INTEGER AS gpus FROM part""",
)
def accelerator_count(spark, sf):
    limits = F.array(
        F.create_map(F.lit("cpu"), F.lit("9"), F.lit("nvidia.com/gpu"), s("p_size")),
        F.create_map(
            F.lit("amd.com/gpu"),
            F.when(F.col("p_size") % 2 == 0, F.lit("several")).otherwise(s("p_retailprice")),
            F.lit("GPU"), F.lit("3"),
        ),
    )
    return table(spark, sf, "part").select("p_partkey", specs.gpu_count(limits).alias("gpus"))


@query(
    "volume_types",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'emptyDir,secret' WHEN 1 THEN 'configMap,other'
  WHEN 2 THEN 'persistentVolumeClaim,projected' ELSE '' END AS types FROM part""",
)
def volume_types(spark, sf):
    volume = lambda kind: F.create_map(F.lit("name"), F.col("p_name"), F.lit(kind), F.lit("{}"))
    none = F.lit(None).cast("array<map<string,string>>")
    volumes = _branch(
        F.col("p_size") % 4,
        {
            0: F.array(volume("emptyDir"), volume("secret")),
            1: F.array(volume("config_map"), volume("csi")),
            2: F.array(volume("persistentVolumeClaim"), volume("projected")),
        },
        none,
    )
    types = F.array_join(specs.volume_types(volumes), ",")
    return table(spark, sf, "part").select("p_partkey", types.alias("types"))


@query(
    "node_type",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS node_type FROM part""",
)
def node_type(spark, sf):
    new, old = (F.lit(label) for label in specs.NODE_TYPE_LABELS)
    selector = _branch(
        F.col("p_size") % 3,
        {0: F.create_map(new, F.col("p_brand"), old, F.col("p_type")), 1: F.create_map(new, F.lit(""), old, F.col("p_type"))},
        F.create_map(F.lit("disk"), F.lit("ssd")),
    )
    return table(spark, sf, "part").select("p_partkey", specs.node_type(selector).alias("node_type"))


# --- one workload per part, as a request row and as a manifest ---

# The same requests in SQL: r holds the projected columns of every part's workload.
REQUESTS_SQL = """r AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS namespace,
  CASE p_size % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'Job' ELSE 'CronJob' END AS workload_kind,
  'part' || p_partkey AS workload_name, p_type AS tier, replace(p_name, ' ', '-') AS app,
  'reg/' || replace(p_name, ' ', '-') || ':' || p_size AS image, p_size,
  p_size * 10 AS req_cpu, p_size AS req_mem, (p_size % 4) * 1000 AS lim_cpu, (p_size % 3 + 1) * 1024 AS lim_mem,
  p_size % 2 = 0 AS two, CASE WHEN p_size % 5 = 0 THEN p_size % 7 ELSE 0 END AS gpu_count,
  p_size % 3 AS init_container_count,
  CASE WHEN p_size % 4 = 1 THEN p_type END AS node_type, CASE WHEN p_size % 10 = 0 THEN 'gvisor' END AS runtime_class,
  CASE WHEN p_size % 3 = 1 THEN p_size % 6 END AS parallelism, CASE WHEN p_size % 3 = 1 THEN p_size END AS completions
  FROM part)"""


def _container(name: Column, extra: dict[str, Column]) -> Column:
    image = F.concat(F.lit("reg/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(":"), s("p_size"))
    return F.struct(name.alias("name"), image.alias("image"), *[v.alias(k) for k, v in extra.items()])


def manifests(spark, sf: str, pods: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(p_partkey, object) and ``keep``: the part's workload as manifest JSON, quantities written in several ways.

    The processor limit is a bare number, 0 for some, which means "not set".
    """
    n = F.col("p_size")
    gpu = F.when(n % 5 == 0, F.create_map(F.lit("nvidia.com/gpu"), s(n % 7)))
    requests = F.create_map(F.lit("cpu"), F.concat(s(n * 10), F.lit("m")), F.lit("memory"), F.concat(s("p_size"), F.lit("Mi")))
    more = F.map_concat(
        F.create_map(F.lit("memory"), F.concat(s(n % 3 + 1), F.lit("Gi"))),
        F.coalesce(gpu, F.create_map().cast("map<string,string>")),
    )
    plain = F.create_map(F.lit("cpu"), n % 4)  # numbers, kept apart from the strings
    main = _container(F.lit("main"), {"args": F.array(F.lit("-n"), s("p_size")), "resources": F.struct(requests.alias("requests"), more.alias("limits"))})
    # to_json cannot mix value types in one map, so the bare number is put in as text
    text = F.regexp_replace(F.to_json(F.struct(main.alias("c"))), r'"limits":\{', F.concat(F.lit('"limits":{"cpu":'), s(plain["cpu"]), F.lit(",")))
    main_text = F.get_json_object(text, "$.c")
    side = F.to_json(_container(F.lit("side"), {"command": F.array(F.lit("run"), F.col("p_type"))}))
    containers = F.concat(F.lit("["), main_text, F.when(n % 2 == 0, F.concat(F.lit(","), side)).otherwise(""), F.lit("]"))
    init = F.to_json(F.array_repeat(F.struct(F.lit("i").alias("name")), n % 3))
    selector = F.when(n % 4 == 1, F.create_map(F.lit(specs.NODE_TYPE_LABELS[0]), F.col("p_type")))
    rest = F.to_json(
        F.struct(
            F.when(n % 10 == 0, F.lit("gvisor")).alias("runtimeClassName"),
            selector.alias("nodeSelector"),
            F.array(F.create_map(F.lit("secret"), F.lit("x"))).alias("volumes"),
        )
    )
    pod_spec = F.concat(
        F.lit('{"containers":'), containers, F.lit(',"initContainers":'), init, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)),
    )
    labels = F.to_json(F.struct(F.struct(F.col("p_type").alias("tier"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("app")).alias("labels")))
    template = F.concat(F.lit('{"metadata":'), labels, F.lit(',"spec":'), pod_spec, F.lit("}"))
    namespace = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    name = F.concat(F.lit("part"), s("p_partkey"))
    part = spread(table(spark, sf, "part"))  # a short row makes a whole manifest
    if pods:
        owners = _branch(n % 3, {0: F.array(F.struct(F.lit("ReplicaSet").alias("kind"), F.concat(name, F.lit("-0123456789")).alias("name")))})
        meta = F.to_json(F.struct(namespace.alias("namespace"), name.alias("name"), owners.alias("owner_references")))
        return part.select("p_partkey", *keep, F.concat(F.lit('{"metadata":'), meta, F.lit(',"spec":'), pod_spec, F.lit("}")).alias("object"))
    meta = F.to_json(F.struct(namespace.alias("namespace"), name.alias("name")))
    kind = _branch(n % 3, {0: "Deployment", 1: "Job"}, "CronJob")
    spec = (
        F.when(n % 3 == 0, F.concat(F.lit('{"template":'), template, F.lit("}")))
        .when(n % 3 == 1, F.concat(F.lit('{"parallelism":'), s(n % 6), F.lit(',"completions":'), s("p_size"), F.lit(',"template":'), template, F.lit("}")))
        .otherwise(F.concat(F.lit('{"jobTemplate":{"spec":{"template":'), template, F.lit("}}}")))
    )
    return part.select(
        "p_partkey", *keep,
        F.concat(F.lit('{"kind":"'), kind, F.lit('","metadata":'), meta, F.lit(',"spec":'), spec, F.lit("}")).alias("object"),
    )


def _documents(spark, sf: str, extra: DataFrame | None = None) -> DataFrame:
    """The manifests written as multi-document text files and read back document by document."""
    path = scratch_path(spark, "manifests")
    docs = manifests(spark, sf).select(F.concat(F.lit("---\n# part\n"), F.col("object")).alias("value"))
    if extra is not None:
        docs = docs.unionByName(extra)
    docs.write.text(path)
    return read_documents(spark, path)


def _columns(requests: DataFrame, *keep: str) -> DataFrame:
    """Requests as scalar columns, for comparison."""
    first, second = F.get("containers", F.lit(0)), F.get("containers", F.lit(1))
    fields = ("image", "req_cpu_mcpu", "req_mem_mib", "lim_cpu_mcpu", "lim_mem_mib")
    return requests.select(
        *keep, "namespace", "workload_kind", "workload_name",
        F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels"),
        F.size("containers").alias("n_containers"),
        *[first[f].alias(f) for f in fields],
        F.array_join(first["args"], " ").alias("args"),
        F.array_join(second["command"], " ").alias("side_command"),
        "init_container_count", "gpu_count", "node_type", "runtime_class",
        F.array_join("volume_types", ",").alias("volumes"), "parallelism", "completions",
    )


COLUMNS_SQL = """namespace, workload_kind, workload_name, 'app=' || app || ',tier=' || tier AS labels,
  CASE WHEN two THEN 2 ELSE 1 END AS n_containers, image, req_cpu::BIGINT AS req_cpu_mcpu, req_mem::BIGINT AS req_mem_mib,
  nullif(lim_cpu, 0)::BIGINT AS lim_cpu_mcpu, lim_mem::BIGINT AS lim_mem_mib, '-n ' || p_size AS args,
  CASE WHEN two THEN 'run ' || tier END AS side_command, init_container_count, gpu_count, node_type, runtime_class,
  'secret' AS volumes, parallelism, completions"""


@query("manifest_requests", f"WITH {REQUESTS_SQL} SELECT {COLUMNS_SQL} FROM r")
def manifest_requests(spark, sf):
    """Manifest files to requests, all three kinds in one pass."""
    return _columns(accepted(requests_of_documents(_documents(spark, sf))))


@query(
    "manifest_rejects",
    """SELECT CASE event_type WHEN 'view' THEN 'invalid manifest' WHEN 'click' THEN 'unsupported kind: Pod'
  WHEN 'error' THEN 'missing pod template' ELSE 'malformed quantity' END AS reason, count(*) AS documents
FROM events WHERE event_type <> 'signup' GROUP BY ALL UNION ALL SELECT 'accepted', count(*) FROM part""",
)
def manifest_rejects(spark, sf):
    """Bad documents among good ones are set aside with a reason; documents that are no objects vanish."""
    bad = _branch(
        F.col("event_type"),
        {
            "view": F.concat(F.lit("---\nkind: [Deployment, "), s("event_id")),
            "click": F.concat(F.lit("---\nkind: Pod\nmetadata: {name: p"), s("event_id"), F.lit("}")),
            "error": F.concat(F.lit("---\nkind: Job\nmetadata: {name: j"), s("event_id"), F.lit("}")),
            "signup": F.concat(F.lit("---\n- "), s("event_id")),
        },
        F.concat(
            F.lit("---\nkind: Deployment\nspec: {template: {spec: {containers: [{name: c, image: x, resources: {requests: {cpu: x"),
            s("event_id"), F.lit("}}}]}}}"),
        ),
    )
    extra = table(spark, sf, "events").select(bad.alias("value"))
    out = requests_of_documents(_documents(spark, sf, extra))
    reason = F.coalesce(F.regexp_replace(REJECT, "^(invalid manifest): .*", "$1"), F.lit("accepted"))
    return out.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


PODS_SQL = f"""WITH {REQUESTS_SQL}, p AS (SELECT * REPLACE (
  CASE WHEN p_size % 3 = 0 THEN 'ReplicaSet' ELSE 'Pod' END AS workload_kind,
  workload_name || CASE WHEN p_size % 3 = 0 THEN '-0123456789' ELSE '' END AS workload_name,
  NULL::INTEGER AS parallelism, NULL::INTEGER AS completions) FROM r),
x AS (SELECT {COLUMNS_SQL} FROM p) SELECT * REPLACE ('' AS labels) FROM x"""


@query("pod_requests", PODS_SQL)
def pod_requests(spark, sf):
    """Pod objects in the spelling of client-library dumps, read as list dumps."""
    return _columns(accepted(object_requests(_dump(spark, sf), kinds=["Pod"])))


def _dump(spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "dump")
    pods = manifests(spark, sf, pods=True)
    text = F.concat(F.lit('{"kind":"PodList","items":['), F.col("object"), F.lit("]}"))
    pods.select(text.alias("value")).write.text(path)
    return read_dump(spark, path)


@query("pod_requests_one_file", PODS_SQL)
def pod_requests_one_file(spark, sf):
    """The same objects as one list in one file, which is cut by bytes."""
    path = scratch_path(spark, "one-dump")
    pods = written(manifests(spark, sf, pods=True).select(F.col("object").alias("value")), "pods")
    write_one_list(pods, '{"kind":"PodList","items":[', "]}", path)
    return _columns(accepted(object_requests(read_large_dump(spark, path), kinds=["Pod"])))


@query(
    "owner_map",
    """SELECT lower(replace(p_brand, '#', '-')) AS namespace, 'part' || p_partkey AS pod,
  CASE WHEN p_size % 3 = 0 THEN 'ReplicaSet' ELSE 'Pod' END AS owner_kind,
  'part' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '-0123456789' ELSE '' END AS owner_name FROM part""",
)
def owners(spark, sf):
    return owner_map(_dump(spark, sf))


def part_events(spark, sf: str) -> DataFrame:
    """Every event as a change of the part's manifest of its user's number."""
    kind = _branch(F.col("event_type"), {"click": "ADDED", "view": "MODIFIED"}, "DELETED")
    ev = table(spark, sf, "events").select("event_id", "user_id", kind.alias("type"), "ts")
    # shuffled: Spark takes the size of manifests for that of the part table, and would send all of them to the driver
    return ev.join(manifests(spark, sf).hint("merge"), F.col("user_id") == F.col("p_partkey"))


@query(
    "change_requests",
    f"""WITH {REQUESTS_SQL}, x AS (SELECT r.*, event_id FROM events JOIN r ON r.p_partkey = user_id
  WHERE event_type IN ('click', 'view') AND workload_kind <> 'CronJob' AND namespace <> 'brand-3')
SELECT event_id, {COLUMNS_SQL} FROM x""",
)
def change_requests(spark, sf):
    """Change events read from JSON lines; kinds and namespaces by list, deletions ignored."""
    path = scratch_path(spark, "changes")
    rows = part_events(spark, sf)
    line = F.concat(
        F.lit('{"type":"'), F.col("type"), F.lit('","ts":"'), s("ts"), F.lit('","object":'),
        F.regexp_replace("object", r'"metadata":\{"namespace"', F.concat(F.lit('"metadata":{"resourceVersion":"'), s("event_id"), F.lit('","namespace"'))),
        F.lit("}"),
    )
    rows.select(line.alias("value")).write.text(path)
    changes = live_events(read_changes(spark, path))
    spaces = [f"brand-{i}" for i in range(1, 26) if i != 3]
    version = F.get_json_object("object", "$.metadata.resourceVersion").cast("bigint")
    requests = object_requests(
        changes.withColumn("event_id", version), kinds=["Deployment", "Job"], namespaces=spaces, keep=["event_id"]
    )
    return _columns(accepted(requests), "event_id")


@query(
    "first_owner",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'Pod' END AS owner_kind,
  CASE WHEN c_acctbal > 0 AND c_nationkey > 4 THEN 'n' || c_nationkey ELSE c_name END AS owner_name FROM customer""",
)
def first_owner(spark, sf):
    """Pod rows take the first owner reference; an absent or empty part falls back to the pod."""
    ref = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))
    kind = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    name = F.when(F.col("c_nationkey") > 4, F.concat(F.lit("n"), s("c_nationkey"))).otherwise("")
    refs = F.when(F.col("c_acctbal") > 0, F.array(ref(kind, name), ref(F.lit("Node"), F.lit("other"))))
    meta = F.struct(F.lit("d").alias("namespace"), F.col("c_name").alias("name"), refs.alias("ownerReferences"))
    pods = table(spark, sf, "customer").select(
        "c_custkey", F.to_json(F.struct(F.lit("Pod").alias("kind"), meta.alias("metadata"), F.struct(F.array().alias("containers")).alias("spec"))).alias("object")
    )
    out = object_requests(pods, kind=None, kinds=None, keep=["c_custkey"])
    return out.select("c_custkey", F.col("workload_kind").alias("owner_kind"), F.col("workload_name").alias("owner_name"))


@query(
    "first_document",
    """SELECT conv_id, min_by("role", turn) AS "role", min(turn) AS turn FROM conversations
WHERE "role" <> 'system' GROUP BY conv_id""",
)
def first_document(spark, sf):
    """Turns as documents of a file: the first that is an object, by position."""
    docs = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return first_documents(docs, "conv_id", ["turn"], F.col("role") != "system")


@query(
    "first_manifest",
    f"""WITH {REQUESTS_SQL}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY p_partkey) = 1)
SELECT {COLUMNS_SQL} FROM f""",
)
def first_manifest(spark, sf):
    """Manifests as the documents of one file per brand: only the first of each file is read."""
    text = F.concat(F.lit("# part\n"), F.col("object"))
    docs = manifests(spark, sf, keep=("p_brand",)).select(F.col("p_brand").alias("file"), F.lit(0).cast("bigint").alias("at"), F.col("p_partkey").alias("n"), text.alias("text"))
    return _columns(accepted(requests_of_documents(docs, first_only=True)))


@query(
    "request_validation",
    """SELECT CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'missing field: namespace, containers'
  WHEN c_mktsegment = 'BUILDING' THEN 'missing field: namespace' WHEN c_acctbal < 0 THEN 'missing field: containers'
  WHEN c_mktsegment = 'MACHINERY' THEN 'container without name or image' ELSE 'accepted' END AS reason,
  count(*) AS requests, sum(CASE WHEN c_nationkey > 9 THEN 0 ELSE c_nationkey END)::BIGINT AS gpus FROM customer GROUP BY ALL""",
)
def request_validation(spark, sf):
    """Requests with missing fields written as JSON lines: rejected with a reason, or defaulted."""
    box = F.struct(F.lit("c").alias("name"), F.when(F.col("c_mktsegment") != "MACHINERY", F.lit("img")).alias("image"))
    line = F.struct(
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("n"), s("c_nationkey"))).alias("namespace"),
        F.lit("Job").alias("workload_kind"), F.col("c_name").alias("workload_name"),
        F.when(F.col("c_acctbal") >= 0, F.array(box)).alias("containers"),
        F.when(F.col("c_nationkey") <= 9, F.col("c_nationkey")).alias("gpu_count"),
    )
    path = scratch_path(spark, "requests")
    table(spark, sf, "customer").select(F.to_json(line).alias("value")).write.text(path)
    out = read_requests(spark, path)
    return out.groupBy(F.coalesce(REJECT, F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("gpu_count").alias("gpus")
    )


@query(
    "ndjson_roundtrip",
    f"""WITH {REQUESTS_SQL} SELECT {COLUMNS_SQL} FROM r
UNION ALL SELECT NULL, NULL, 'rejected', NULL, count(*)::INTEGER, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events""",
)
def ndjson_roundtrip(spark, sf):
    """Requests appended as JSON lines next to damaged and blank lines, then read back."""
    path = scratch_path(spark, "ndjson")
    append_requests(accepted(requests_of_documents(_documents(spark, sf))).drop("file", "at", "n"), path)
    broken = F.explode(F.array(F.concat(F.lit("{broken "), F.col("props")), F.lit("")))
    table(spark, sf, "events").select(broken.alias("value")).write.mode("append").text(path)
    back = read_requests(spark, path)
    good = _columns(accepted(back))
    count = rejected(back).agg(F.count(F.lit(1)).cast("int").alias("n_containers"))
    return good.unionByName(count.withColumn("workload_name", F.lit("rejected")), allowMissingColumns=True)


BUNDLE_SQL = """'workload_kind:' || workload_kind || ' | workload_name:' || workload_name || ' | label:app=' || app || ' | label:tier=' || tier
  || ' | image:' || image || ' | args:-n ' || p_size || CASE WHEN two THEN ' | image:' || image || ' | command:run ' || tier ELSE '' END"""
JSON_SQL = """'{"annotations": {}, "completions": ' || coalesce(completions::VARCHAR, 'null') || ', "containers": [{"args": ["-n", "' || p_size
  || '"], "command": null, "image": "' || image || '", "lim_cpu_mcpu": ' || coalesce(nullif(lim_cpu, 0)::VARCHAR, 'null')
  || ', "lim_mem_mib": ' || lim_mem || ', "name": "main", "req_cpu_mcpu": ' || req_cpu || ', "req_mem_mib": ' || req_mem || '}'
  || CASE WHEN two THEN ', {"args": null, "command": ["run", "' || tier || '"], "image": "' || image
  || '", "lim_cpu_mcpu": null, "lim_mem_mib": null, "name": "side", "req_cpu_mcpu": null, "req_mem_mib": null}' ELSE '' END
  || '], "gpu_count": ' || gpu_count || ', "init_container_count": ' || init_container_count || ', "labels": {"app": "' || app
  || '", "tier": "' || tier || '"}, "namespace": "' || namespace || '", "node_type": ' || coalesce('"' || node_type || '"', 'null')
  || ', "parallelism": ' || coalesce(parallelism::VARCHAR, 'null') || ', "runtime_class": ' || coalesce('"' || runtime_class || '"', 'null')
  || ', "schema_version": "v1", "sidecar_count": 0, "volume_types": ["secret"], "workload_kind": "' || workload_kind
  || '", "workload_name": "' || workload_name || '"}'"""
FLAT_SQL = f"""flat AS (SELECT p_partkey, namespace, workload_kind, workload_name, runtime_class, node_type, gpu_count, init_container_count,
  0 AS sidecar_count, req_cpu::DOUBLE AS req_cpu_mcpu, req_mem::DOUBLE AS req_mem_mib, lim_cpu::DOUBLE AS lim_cpu_mcpu,
  lim_mem::DOUBLE AS lim_mem_mib, {BUNDLE_SQL} AS text_line, substr(sha256({JSON_SQL}), 1, 16) AS spec_hash FROM r)"""


def part_requests(spark, sf: str, *keep: str) -> DataFrame:
    """Requests of every part's workload, straight from the manifest JSON."""
    from wattloom.operators.requests import manifest_requests as project

    return accepted(project(manifests(spark, sf), keep=list(keep)))


@query("flat_rows", f"WITH {REQUESTS_SQL}, {FLAT_SQL} SELECT * FROM flat")
def flat(spark, sf):
    """Flat rows with resource sums, text line and spec hash."""
    rows = flat_rows(part_requests(spark, sf, "p_partkey"), keep=["p_partkey"])
    return rows.withColumnsRenamed({"_text": "text_line", "_spec_hash": "spec_hash"})


@query("text_bundle", f"WITH {REQUESTS_SQL}, {FLAT_SQL} SELECT p_partkey, text_line FROM flat")
def text_bundle(spark, sf):
    return flat(spark, sf).select("p_partkey", "text_line")


@query("spec_hash", f"WITH {REQUESTS_SQL}, {FLAT_SQL} SELECT p_partkey, spec_hash FROM flat")
def spec_hash(spark, sf):
    return flat(spark, sf).select("p_partkey", "spec_hash")


# JSON escapes of one character in SQL, code points beyond the first plane as a surrogate pair.
CHAR_SQL = r"""CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
  WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
  WHEN unicode(c) < 65536 THEN '\u' || lpad(lower(to_hex(unicode(c))), 4, '0')
  ELSE '\u' || lower(to_hex(55296 + (unicode(c) - 65536) // 1024)) || '\u' || lower(to_hex(56320 + (unicode(c) - 65536) % 1024)) END"""


@query(
    "text_hash",
    f"""SELECT doc_id, sha256('"' || array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: {CHAR_SQL}), '') || '"') AS digest
FROM documents""",
)
def text_hash(spark, sf):
    """Whole texts of four languages as JSON strings, hashed: the escaping behind the spec hash."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(specs.json_string(F.col("text")), 256).alias("digest"))


@query(
    "text_embedding",
    """SELECT doc_id, 384 AS dims, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents""",
)
def text_embedding(spark, sf):
    """Hashed text vectors of whole documents; SQL can check only their size and length."""
    out = hashed_text(table(spark, sf, "documents").select("doc_id", "text"), "text", "v")
    return out.select("doc_id", F.size("v").alias("dims"), r(norm(F.col("v")), 6, "length"))
