"""Series, counters, labels, joins and keys.  Roles: user = pod, event type = metric or namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.functions import quantities as q
from wattloom.functions.names import owner_workload, with_canonical
from wattloom.operators import keys, labels as lab
from wattloom.operators.counters import counter_steps
from wattloom.operators.dedup import drop_repeats
from wattloom.operators.grid import grid_max, grid_sum, on_grid
from wattloom.operators.requests import allow, live_events
from wattloom.registry.base import EV, events, grid_sql, query, r, span, table

from wattloom.session import scratch_path, written
from wattloom.sources.items import write_one_list
from wattloom.sources.series import RESPONSE_DDL, flatten_series, read_large_response

STEP_SQL = f"""WITH {EV}, w AS (
  SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev)
SELECT event_id, user_id, round(CASE WHEN p IS NOT NULL THEN greatest(value-p, 0) END, 6) AS energy_step_j FROM w"""


def _steps(spark, sf, **options):
    df = events(spark, sf).select("event_id", "user_id", "t", "value")
    steps = counter_steps(df, ["user_id"], ["t", "event_id"], **options)
    return steps.select("event_id", "user_id", r("energy_step_j"))


@query("counter_step_energy", STEP_SQL)
def counter_step_energy(spark, sf):
    return _steps(spark, sf)


@query("counter_step_energy_split", STEP_SQL)
def counter_step_energy_split(spark, sf):
    """The same with every busy key cut into time segments."""
    return _steps(spark, sf, max_group_rows=25)


@query(
    "counter_step_energy_outlier",
    f"""WITH {EV}, o AS (SELECT event_id, user_id, value,
  CASE WHEN event_id % 77 = 5 THEN NULL WHEN event_id % 100 = 0 OR user_id % 10 = 0 THEN 0 ELSE t END AS t FROM ev),
w AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t NULLS FIRST, event_id) AS p FROM o)
SELECT event_id, user_id, round(CASE WHEN p IS NOT NULL THEN greatest(value-p, 0) END, 6) AS energy_step_j FROM w""",
)
def counter_step_energy_outlier(spark, sf):
    """Times far off, times that are missing and keys whose rows share one time, with every busy key cut."""
    off = F.when(F.col("event_id") % 77 == 5, F.lit(None)).when(
        (F.col("event_id") % 100 == 0) | (F.col("user_id") % 10 == 0), F.lit(0.0)
    )
    df = events(spark, sf).withColumn("t", off.otherwise(F.col("t"))).select("event_id", "user_id", "t", "value")
    steps = counter_steps(df, ["user_id"], ["t", "event_id"], max_group_rows=25)
    return steps.select("event_id", "user_id", r("energy_step_j"))


@query(
    "label_job_rollup",
    f"""WITH {EV}, w AS (
  SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY t, event_id) AS p FROM ev)
SELECT event_type, user_id, round(avg(value), 6) AS avg_power_w,
  round(coalesce(sum(CASE WHEN p IS NOT NULL THEN greatest(value-p, 0) END), 0), 6) AS total_energy_j
FROM w GROUP BY event_type, user_id""",
)
def label_job_rollup(spark, sf):
    by = ["event_type", "user_id"]
    steps = counter_steps(events(spark, sf), by, ["t", "event_id"])
    out = lab.rollup(steps, by, power="value")
    return out.select(*by, r("avg_power_w"), r("total_energy_j"))


@query("grid_last_sample", f"WITH {EV} {grid_sql('ev', 'user_id', 60, 300)}")
def grid_last_sample(spark, sf):
    ev = events(spark, sf)
    lo, hi = span(ev)
    return on_grid(ev, ["user_id"], lo, hi, 60, ts="t", tie_break="event_id").select(
        "user_id", "ts", "value"
    )


@query(
    "grid_sum_by",
    f"""WITH {EV}, g AS ({grid_sql('ev', 'event_type, user_id', 60, 300)})
SELECT event_type, ts, round(sum(value), 4) AS value FROM g GROUP BY event_type, ts""",
)
def grid_sum_by(spark, sf):
    ev = events(spark, sf)
    lo, hi = span(ev)
    out = grid_sum(ev, ["event_type"], ["event_type", "user_id"], start=lo, end=hi, step=60, ts="t", tie_break="event_id")
    return out.select("event_type", "ts", r("value", 4))


@query(
    "grid_max_by",
    f"""WITH {EV}, g AS ({grid_sql('ev', 'event_type, user_id', 60, 300)})
SELECT event_type, ts, max(value) AS value FROM g GROUP BY event_type, ts""",
)
def grid_max_by(spark, sf):
    ev = events(spark, sf)
    lo, hi = span(ev)
    return grid_max(ev, ["event_type"], ["event_type", "user_id"], start=lo, end=hi, step=60, ts="t", tie_break="event_id")


# --- power, energy, owners ---

HOURLY_SQL = f"""{EV},
p AS (SELECT user_id, floor(t/3600)*3600 AS hour, avg(value) AS avg_power_w FROM ev GROUP BY ALL),
e AS (SELECT user_id, floor(t/3600)*3600 AS hour, sum(value) AS energy_step_j FROM ev
  WHERE event_type IN ('click', 'purchase') GROUP BY ALL)"""
HOUR_KEYS = ["user_id", "hour"]


def _hourly(spark, sf):
    ev = events(spark, sf).withColumn("hour", F.floor(F.col("t") / 3600) * F.lit(3600.0))
    power = ev.groupBy(*HOUR_KEYS).agg(F.avg("value").alias("avg_power_w"))
    energy = (
        ev.filter(F.col("event_type").isin("click", "purchase"))
        .groupBy(*HOUR_KEYS)
        .agg(F.sum("value").alias("energy_step_j"))
    )
    return power, energy


def _rounded(df):
    return df.select(*HOUR_KEYS, r("avg_power_w"), r("energy_step_j"))


@query(
    "power_energy_join",
    f"""WITH {HOURLY_SQL} SELECT p.user_id, p.hour, round(avg_power_w, 6) AS avg_power_w,
  round(energy_step_j, 6) AS energy_step_j FROM p LEFT JOIN e USING (user_id, hour)""",
)
def power_energy_join(spark, sf):
    return _rounded(lab.join_power_energy(*_hourly(spark, sf), keys=HOUR_KEYS))


@query(
    "power_missing",
    f"""WITH {HOURLY_SQL} SELECT user_id, hour, CAST(NULL AS DOUBLE) AS avg_power_w,
  round(energy_step_j, 6) AS energy_step_j FROM e""",
)
def power_missing(spark, sf):
    """The power metric has no samples, so the energy side gives the keys."""
    power, energy = _hourly(spark, sf)
    return _rounded(lab.join_power_energy(power.filter(F.col("avg_power_w") < 0), energy, keys=HOUR_KEYS))


OWNER_NAMES_SQL = """own AS (SELECT c_custkey AS pod,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'ReplicaSet' WHEN 'MACHINERY' THEN 'Job' WHEN 'FURNITURE' THEN 'ReplicaSet' END AS k,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'app' || c_custkey || '-' || substr(md5(c_name), 1, 10)
    WHEN 'MACHINERY' THEN 'job' || c_custkey WHEN 'AUTOMOBILE' THEN 'car' || c_custkey END AS n
  FROM customer WHERE c_acctbal > 0)"""
WORKLOAD_SQL = """CASE WHEN k = 'ReplicaSet' AND n IS NOT NULL THEN 'Deployment' ELSE coalesce(k, 'Pod') END AS workload_kind,
  coalesce(CASE WHEN k = 'ReplicaSet' THEN regexp_replace(n, '-[a-f0-9]{9,}$', '') ELSE n END, CAST(pod AS VARCHAR)) AS workload_name"""


def _owners(spark, sf):
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    kind = F.when(segment.isin("BUILDING", "FURNITURE"), F.lit("ReplicaSet")).when(
        segment == "MACHINERY", F.lit("Job")
    )
    name = (
        F.when(segment == "BUILDING", F.concat(F.lit("app"), key, F.lit("-"), F.substring(F.md5("c_name"), 1, 10)))
        .when(segment == "MACHINERY", F.concat(F.lit("job"), key))
        .when(segment == "AUTOMOBILE", F.concat(F.lit("car"), key))
    )
    return (
        table(spark, sf, "customer")
        .filter(F.col("c_acctbal") > 0)
        .select(F.col("c_custkey").alias("pod"), kind.alias("owner_kind"), name.alias("owner_name"))
    )


@query(
    "owner_join_fallback",
    f"""WITH {OWNER_NAMES_SQL}
SELECT o_orderkey, {WORKLOAD_SQL}
FROM (SELECT o_orderkey, o_custkey AS pod FROM orders) LEFT JOIN own USING (pod)""",
)
def owner_join_fallback(spark, sf):
    pods = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("pod"))
    out = lab.with_owner(pods, _owners(spark, sf), pod_keys=["pod"])
    return out.select("o_orderkey", "workload_kind", F.col("workload_name").cast("string"))


@query(
    "owner_join_timed",
    f"""WITH {EV}, d AS (SELECT user_id, floor(t/86400)*86400 AS day, avg(value) AS v FROM ev GROUP BY ALL),
o AS (SELECT DISTINCT user_id, floor(t/86400)*86400 AS day,
  CASE event_type WHEN 'click' THEN 'ReplicaSet' WHEN 'view' THEN 'Job' END AS k,
  event_type || user_id || '-0123456789' AS n FROM ev WHERE event_type IN ('click', 'view', 'error')),
j AS (SELECT d.user_id, CAST(d.user_id AS VARCHAR) AS pod, d.day, v, k, n FROM d LEFT JOIN o ON d.user_id = o.user_id AND d.day = o.day)
SELECT user_id, day, round(v, 6) AS avg_power_w, {WORKLOAD_SQL} FROM j""",
)
def owner_join_timed(spark, sf):
    """Owner map with a time column: several owners of a pod and day repeat its row."""
    ev = events(spark, sf).withColumn("ts", F.floor(F.col("t") / 86400) * F.lit(86400.0))
    kind = F.when(F.col("event_type") == "click", "ReplicaSet").when(F.col("event_type") == "view", "Job")
    owners = (
        ev.filter(F.col("event_type").isin("click", "view", "error"))
        .select(
            "user_id", "ts", kind.alias("owner_kind"),
            F.concat("event_type", F.col("user_id").cast("string"), F.lit("-0123456789")).alias("owner_name"),
        )
        .distinct()
    )
    days = ev.groupBy("user_id", "ts").agg(F.avg("value").alias("v"))
    out = lab.with_owner(days, owners, pod_keys=["user_id"])
    return out.select(
        "user_id", F.col("ts").alias("day"), r("v", 6, "avg_power_w"), "workload_kind",
        F.col("workload_name").cast("string"),
    )


# --- names and keys ---

# Names in all shapes: Pod of a ReplicaSet, ReplicaSet, plain Pod, Deployment, Pod with one suffix.
NAMED_SQL = """named AS (SELECT c_custkey, ' NS-' || c_nationkey || ' ' AS namespace,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ReplicaSet' WHEN 'HOUSEHOLD' THEN 'Deployment' ELSE 'Pod' END AS k,
  'c' || c_custkey || CASE c_mktsegment
    WHEN 'BUILDING' THEN '-' || substr(md5(c_name), 1, 10) || '-' || substr(md5(c_name), 11, 5)
    WHEN 'AUTOMOBILE' THEN '-' || substr(md5(c_name), 1, 9) WHEN 'MACHINERY' THEN '-' || substr(md5(c_name), 1, 5)
    WHEN 'FURNITURE' THEN '-' || substr(md5(c_name), 1, 10) ELSE ' ' END AS n FROM customer),
canon AS (SELECT c_custkey, lower(trim(namespace)) AS namespace, k,
  nullif(regexp_extract(trim(n), '^(.+)-[a-f0-9]{9,}-[a-z0-9]{5}$', 1), '') AS two,
  nullif(regexp_extract(trim(n), '^(.+)-[a-f0-9]{9,}$', 1), '') AS one, trim(n) AS n FROM named),
done AS (SELECT c_custkey, namespace,
  CASE WHEN k = 'ReplicaSet' OR (k = 'Pod' AND coalesce(two, one) IS NOT NULL) THEN 'Deployment' ELSE k END AS canon_kind,
  CASE k WHEN 'ReplicaSet' THEN coalesce(one, n) WHEN 'Pod' THEN coalesce(two, one, n) ELSE n END AS canon_name FROM canon)"""


def _named(spark, sf):
    segment, digest = F.col("c_mktsegment"), F.md5("c_name")
    dash = lambda a, n: F.concat(F.lit("-"), F.substring(digest, a, n))
    kind = F.when(segment == "AUTOMOBILE", "ReplicaSet").when(segment == "HOUSEHOLD", "Deployment").otherwise("Pod")
    suffix = (
        F.when(segment == "BUILDING", F.concat(dash(1, 10), dash(11, 5)))
        .when(segment == "AUTOMOBILE", dash(1, 9))
        .when(segment == "MACHINERY", dash(1, 5))
        .when(segment == "FURNITURE", dash(1, 10))
        .otherwise(" ")
    )
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit(" NS-"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("namespace"),
        kind.alias("workload_kind"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), suffix).alias("workload_name"),
    )


@query("canon_names", f"WITH {NAMED_SQL} SELECT * FROM done")
def canon_names(spark, sf):
    return with_canonical(_named(spark, sf)).select("c_custkey", "namespace", "canon_kind", "canon_name")


ORDER_LABELS_SQL = """lab AS (SELECT o_orderkey, 'ns-' || c_nationkey AS namespace, 'c' || o_custkey AS canon_name
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
# Each customer under its own name and again through its segment mate, so keys have 1 or 2 feature rows.
FEATURES_SQL = """feat AS (SELECT namespace, canon_name, substr(sha256('a' || c_custkey), 1, 16) AS spec FROM done
  UNION ALL SELECT namespace, canon_name, substr(sha256('b' || c_custkey), 1, 16) FROM done WHERE canon_kind = 'Deployment')"""


def _order_labels(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        "o_orderkey",
        F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")).alias("namespace"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("-0123456789-abcde")).alias("workload_name"),
        F.lit("Pod").alias("workload_kind"),
    )


def _spec_features(spark, sf):
    done = with_canonical(_named(spark, sf))
    spec = lambda tag: F.substring(
        F.sha2(F.concat(F.lit(tag), F.col("c_custkey").cast("string")), 256), 1, 16
    ).alias("_spec_hash")
    again = done.filter(F.col("canon_kind") == "Deployment")
    cols = ["namespace", "workload_kind", "workload_name", "canon_name"]
    return done.select(*cols, spec("a")).unionByName(again.select(*cols, spec("b")))


@query(
    "label_feature_join",
    f"""WITH {NAMED_SQL}, {ORDER_LABELS_SQL}, {FEATURES_SQL}
SELECT o_orderkey, namespace, canon_name, spec AS _spec_hash FROM lab JOIN feat USING (namespace, canon_name)""",
)
def label_feature_join(spark, sf):
    joined = keys.join_features(with_canonical(_order_labels(spark, sf)), _spec_features(spark, sf))
    return joined.select("o_orderkey", "namespace", "canon_name", "_spec_hash")


@query(
    "label_feature_join_deduped",
    f"""WITH {NAMED_SQL}, {ORDER_LABELS_SQL}, {FEATURES_SQL}
SELECT o_orderkey, namespace, canon_name, _spec_hash FROM lab
JOIN (SELECT namespace, canon_name, min(spec) AS _spec_hash FROM feat GROUP BY ALL) USING (namespace, canon_name)""",
)
def label_feature_join_deduped(spark, sf):
    joined = keys.join_features(
        with_canonical(_order_labels(spark, sf)), _spec_features(spark, sf), dedupe_features=True
    )
    return joined.select("o_orderkey", "namespace", "canon_name", "_spec_hash")


@query(
    "join_diagnostics",
    f"""WITH {NAMED_SQL}, {ORDER_LABELS_SQL}, {FEATURES_SQL},
l AS (SELECT DISTINCT namespace, canon_name FROM lab), f AS (SELECT DISTINCT namespace, canon_name FROM feat)
SELECT (SELECT count(*) FROM f) AS feature_keys, (SELECT count(*) FROM l) AS label_keys,
  (SELECT count(*) FROM l JOIN f USING (namespace, canon_name)) AS shared_keys""",
)
def join_diagnostics(spark, sf):
    return keys.join_report(with_canonical(_order_labels(spark, sf)), _spec_features(spark, sf))


@query(
    "key_intersection",
    f"""WITH {NAMED_SQL}, {ORDER_LABELS_SQL}, {FEATURES_SQL}
SELECT namespace, canon_name FROM lab INTERSECT SELECT namespace, canon_name FROM feat""",
)
def key_intersection(spark, sf):
    return keys.shared_keys(with_canonical(_order_labels(spark, sf)), _spec_features(spark, sf))


@query(
    "sample_keys",
    """SELECT DISTINCT o_custkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderpriority LIMIT 10""",
)
def sample_keys(spark, sf):
    return keys.sample_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query(
    "key_profile",
    """SELECT "column", "value", count(*) AS "rows" FROM (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS "value" FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY ALL""",
)
def key_profile(spark, sf):
    return keys.profile(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("distinct_keys", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_keys(spark, sf):
    return keys.distinct_keys(table(spark, sf, "part"), ["p_brand", "p_type"])


@query(
    "group_sizes",
    """SELECT user_id, count(*) AS "rows" FROM events GROUP BY user_id""",
)
def group_sizes(spark, sf):
    return keys.group_sizes(table(spark, sf, "events"), "user_id")


@query(
    "finite_targets",
    """WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'nan'::DOUBLE WHEN 'error' THEN NULL
  WHEN 'click' THEN CASE WHEN value < 10 THEN 'inf'::DOUBLE WHEN value < 20 THEN '-inf'::DOUBLE ELSE value END
  ELSE value END AS y FROM events)
SELECT event_id, y FROM x WHERE y IS NOT NULL AND isfinite(y)""",
)
def finite_targets(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    y = (
        F.when(kind == "view", F.lit(float("nan")))
        .when(kind == "error", F.lit(None).cast("double"))
        .when((kind == "click") & (value < 10), F.lit(float("inf")))
        .when((kind == "click") & (value < 20), F.lit(float("-inf")))
        .otherwise(value)
    )
    return lab.finite(table(spark, sf, "events").select("event_id", y.alias("y")), "y")


@query(
    "label_aliases",
    """SELECT event_id, nullif(event_type, 'signup') AS namespace, user_id AS pod, value AS avg_power_w
FROM events WHERE event_type <> 'signup'""",
)
def label_aliases(spark, sf):
    """Series labelled with aliases; a missing label drops the sample."""
    raw = table(spark, sf, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("signup")).alias("container_namespace"),
        F.col("user_id").alias("pod_name"),
        "value",
    )
    named = lab.drop_incomplete(lab.rename_aliases(raw))
    return named.withColumnRenamed("value", "avg_power_w").select("event_id", "namespace", "pod", "avg_power_w")


@query(
    "time_bounds",
    """SELECT event_id, user_id, epoch_us(ts)/1e6 AS t FROM events
WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY user_id, t, event_id""",
)
def time_bounds(spark, sf):
    """One bound as ISO text with an offset, the other as epoch seconds; the scan gets both as filters."""
    lo, hi = q.epoch_seconds("2024-01-05T07:00:00+01:00"), q.epoch_seconds("1705708800")
    bound = lambda s: q.seconds_timestamp(F.lit(s)).cast("timestamp_ntz")
    ev = table(spark, sf, "events").filter((F.col("ts") >= bound(lo)) & (F.col("ts") < bound(hi)))
    out = ev.select("event_id", "user_id", q.timestamp_seconds(F.col("ts")).alias("t"))
    return out.orderBy("user_id", "t", "event_id")


# --- events as changes ---

@query(
    "ttl_dedup",
    f"""WITH {EV}, w AS (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS p FROM ev)
SELECT event_id, user_id, event_type, t FROM w WHERE p IS NULL OR t - p > 21600""",
)
def ttl_dedup(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "event_type", "t")
    return drop_repeats(ev, ["user_id", "event_type"], ts="t", tie_break=["event_id"], ttl=21600)


@query(
    "ttl_dedup_default",
    f"""WITH {EV}, w AS (SELECT *, lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS p FROM ev)
SELECT event_id, event_type, t FROM w WHERE p IS NULL OR t - p > 10""",
)
def ttl_dedup_default(spark, sf):
    """Few, very busy keys: each is a fifth of all rows."""
    ev = events(spark, sf).select("event_id", "event_type", "t")
    return drop_repeats(ev, ["event_type"], ts="t", tie_break=["event_id"])


@query(
    "event_filter",
    """SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""",
)
def event_filter(spark, sf):
    """Order status as kind of change, priority as namespace; the list of kinds lets all pass."""
    status = F.col("o_orderstatus")
    change = F.when(status == "O", "ADDED").when(status == "F", "MODIFIED").otherwise("DELETED")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", change.alias("type"))
    spaces = ["1-URGENT", "2-HIGH", "5-LOW"]
    return allow(allow(live_events(rows), "o_orderpriority", spaces), "type", None).drop("type")


@query(
    "kind_union",
    """SELECT 'Deployment' AS kind, event_id, user_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'view'
UNION ALL SELECT 'Job', event_id, user_id, NULL, props FROM events WHERE event_type IN ('click', 'error')""",
)
def kind_union(spark, sf):
    ev = table(spark, sf, "events")
    first = ev.filter("event_type = 'view'").select(F.lit("Deployment").alias("kind"), "event_id", "user_id", "value")
    second = ev.filter("event_type IN ('click', 'error')").select(F.lit("Job").alias("kind"), "event_id", "user_id", "props")
    return first.unionByName(second, allowMissingColumns=True)


MATRIX_SQL = """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS namespace, CAST(user_id AS VARCHAR) AS pod,
  (epoch_us(ts)//1000000 + off)::DOUBLE AS ts, value * (off + 1) AS value
FROM events, (SELECT unnest([0, 1]) AS off)"""


def _series(spark, sf: str) -> DataFrame:
    """Every event as a series of two samples, values as strings."""
    whole = F.floor(q.timestamp_seconds(F.col("ts")))
    sample = lambda off: F.array(
        (whole + off).cast("string"), (F.col("value") * (off + 1)).cast("string")
    )
    metric = F.create_map(
        F.lit("id"), F.col("event_id").cast("string"),
        F.lit("namespace"), F.col("event_type"), F.lit("pod"), F.col("user_id").cast("string"),
    )
    series = F.struct(metric.alias("metric"), F.array(sample(0), sample(1)).alias("values"))
    return table(spark, sf, "events").select("event_id", series.alias("s"))


@query("matrix_flatten", MATRIX_SQL)
def matrix_flatten(spark, sf):
    """Events as range-query responses (JSON text), then flattened."""
    text = F.to_json(F.struct(F.struct(F.array("s").alias("result")).alias("data")))
    responses = _series(spark, sf).select(F.from_json(text, RESPONSE_DDL).alias("r")).select("r.*")
    return flatten_series(responses, ["id", "namespace", "pod"])


@query("matrix_flatten_one_file", MATRIX_SQL)
def matrix_flatten_one_file(spark, sf):
    """All series in one response in one file, which is cut by bytes."""
    path = scratch_path(spark, "one-response")
    series = written(_series(spark, sf).select(F.to_json("s").alias("value")), "series")
    write_one_list(series, '{"status":"success","data":{"result":[', "]}}", path)
    return flatten_series(read_large_response(spark, path), ["id", "namespace", "pod"])


@query(
    "row_lookup",
    f"WITH {EV} SELECT event_id, user_id, event_type, value FROM ev QUALIFY row_number() OVER (ORDER BY value DESC, event_id) = 1",
)
def row_lookup(spark, sf):
    """One row by key: here the event with the largest value."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return ev.orderBy(F.desc("value"), "event_id").limit(1)


@query(
    "owner_fallback",
    f"WITH {OWNER_NAMES_SQL} SELECT pod, {WORKLOAD_SQL} FROM own",
)
def owner_fallback(spark, sf):
    own = _owners(spark, sf)
    kind, name = owner_workload(F.col("owner_kind"), F.col("owner_name"), F.col("pod").cast("string"))
    return own.select("pod", kind.alias("workload_kind"), name.alias("workload_name"))
