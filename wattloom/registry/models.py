"""Encoder, folds, neighbours, whole label and training jobs, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.functions.vectors import one_hot
from wattloom.operators import knn
from wattloom.operators.flatten import CATEGORIES, META, NUMBERS, flat_rows
from wattloom.operators.folds import with_folds
from wattloom.operators.keys import StageCounts
from wattloom.operators.metrics import fold_metrics, summary
from wattloom.plans.dataset import join_diagnostics, training_rows, write_training_rows
from wattloom.plans.encoder import Encoder
from wattloom.plans.evaluate import cross_validate, score_report
from wattloom.plans.labels import labels_from_samples
from wattloom.plans.model import KnnModel
from wattloom.plans.score import over_horizon, requests_of_documents, score_documents, score_requests
from wattloom.plans.sparse_encoder import SparseEncoder
from wattloom.registry.base import EV, SQL, events, grid_sql, query, r, span, table
from wattloom.registry.specs import FLAT_SQL, REQUESTS_SQL, _documents, part_requests, s
from wattloom.schemas import accepted
from wattloom.session import scratch_path, spread, written
from wattloom.sources.days import read_days, write_by_day
from wattloom.sources.tables import read_table, write_predictions, write_table

# --- encoder over customers and suppliers ---

# One feature row per customer (a Deployment) and per supplier (a Pod of the Deployment of that number).
ROWS_SQL = """f AS (
  SELECT 'ns-' || (c_custkey % 10) AS namespace, 'Deployment' AS workload_kind, 'app' || c_custkey AS workload_name,
    'app' || c_custkey AS canon_name, c_acctbal AS acctbal, c_nationkey AS nation, c_mktsegment AS segment FROM customer
  UNION ALL
  SELECT 'ns-' || (s_suppkey % 10), 'Pod', 'app' || s_suppkey || '-0123456789-abcde', 'app' || s_suppkey, s_acctbal, s_nationkey, NULL FROM supplier),
fit AS (SELECT avg(acctbal) AS m1, stddev_pop(acctbal) AS s1, avg(nation) AS m2, stddev_pop(nation) AS s2 FROM f),
cats AS (SELECT list(c ORDER BY c) AS cs FROM (SELECT DISTINCT coalesce(segment, 'NA') AS c FROM f)),
enc AS (SELECT f.*, substr(sha256(workload_kind || workload_name), 1, 16) AS spec,
  list_concat([(acctbal-m1)/s1, (nation-m2)/s2], list_transform(cs, lambda c: CASE WHEN c = coalesce(segment, 'NA') THEN 1.0 ELSE 0.0 END::DOUBLE))::FLOAT[]::DOUBLE[] AS v
  FROM f, fit, cats)"""
ENCODED = {"numbers": ["acctbal", "nation"], "categories": ["segment"], "use_text": False}


def workload_rows(spark, sf: str) -> DataFrame:
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    part = lambda c, k: F.concat(F.lit(k), s(c))
    a = customers.select(
        part(F.col("c_custkey") % 10, "ns-").alias("namespace"), F.lit("Deployment").alias("workload_kind"),
        part("c_custkey", "app").alias("workload_name"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )
    b = suppliers.select(
        part(F.col("s_suppkey") % 10, "ns-").alias("namespace"), F.lit("Pod").alias("workload_kind"),
        F.concat(part("s_suppkey", "app"), F.lit("-0123456789-abcde")).alias("workload_name"),
        F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"),
    )
    spec = F.substring(F.sha2(F.concat("workload_kind", "workload_name"), 256), 1, 16)
    return a.unionByName(b, allowMissingColumns=True).withColumn("_spec_hash", spec)


def workload_features(spark, sf: str) -> DataFrame:
    rows = workload_rows(spark, sf)
    return Encoder.fit(rows, **ENCODED).transform(rows)


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("features").alias("idx", "x")).select(
        *keys, "idx", r(F.col("x").cast("double"), 4, "x")
    )


LONG_SQL = "unnest(generate_series(0, len(v) - 1))::INTEGER AS idx, round(unnest(v), 4) AS x"


@query(
    "scaler_fit",
    """SELECT 'acctbal' AS feature, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS scale FROM customer
UNION ALL SELECT 'nation', round(avg(c_nationkey), 6), round(stddev_pop(c_nationkey), 6) FROM customer
UNION ALL SELECT 'none', 0.0, 0.0""",
)
def scaler_fit(spark, sf):
    """Means and population deviations; a column that is always null counts as 0."""
    rows = table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("int").alias("none")
    )
    scaler = Encoder.fit(rows, ["acctbal", "nation", "none"], []).scaler
    fitted = spark.createDataFrame([(c, m, d) for c, (m, d) in scaler.items()], "feature string, mean double, scale double")
    return fitted.select("feature", r("mean"), r("scale"))


@query(
    "scaler_transform",
    """WITH f AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part)
SELECT p_partkey, round((p_size-m1)/s1, 4) AS size, round((p_retailprice-m2)/s2, 4) AS price, 0.0::DOUBLE AS flat FROM part, f""",
)
def scaler_transform(spark, sf):
    rows = table(spark, sf, "part").withColumn("flat", F.lit(7))
    columns = ["p_size", "p_retailprice", "flat"]
    out = Encoder.fit(rows, columns, [], use_text=False).transform(rows, keep=["p_partkey"])
    value = lambda i, name: r(F.col("features")[i].cast("double"), 4, name)
    return out.select("p_partkey", value(0, "size"), value(1, "price"), value(2, "flat"))


@query(
    "onehot",
    """SELECT c_custkey, list_position(['AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY', 'NA'], c_mktsegment)::INTEGER AS hot,
  5 AS width, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END::DOUBLE AS total FROM customer""",
)
def onehot(spark, sf):
    """Fitted where one segment is missing (and read as NA), applied where it occurs."""
    rows = table(spark, sf, "customer")
    known = rows.select(F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("seg"))
    categories = Encoder.fit(known, [], ["seg"]).categories["seg"]
    hot = one_hot(F.col("c_mktsegment"), categories)
    return rows.withColumn("v", hot).select(
        "c_custkey",
        F.nullif(F.array_position("v", F.lit(1.0)).cast("int"), F.lit(0)).alias("hot"),
        F.size("v").alias("width"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "onehot_wide",
    """WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders),
c AS (SELECT col, value, row_number() OVER (ORDER BY col, value) AS place FROM (
  SELECT DISTINCT 1 AS col, o_orderpriority AS value FROM orders UNION SELECT DISTINCT 2, CAST(o_orderkey AS VARCHAR) FROM orders)),
f AS (SELECT o_orderkey, 0 AS place, round((o_totalprice - mean) / std, 6) AS value FROM orders, m
  UNION ALL SELECT o_orderkey, c.place, 1.0 FROM orders JOIN c ON c.col = 1 AND c.value = o_orderpriority
  UNION ALL SELECT o_orderkey, c.place, 1.0 FROM orders JOIN c ON c.col = 2 AND c.value = CAST(o_orderkey AS VARCHAR))
SELECT o_orderkey, CAST(place AS BIGINT) AS place, value, (SELECT count(*) + 1 FROM c) AS width FROM f""",
)
def onehot_wide(spark, sf):
    """A category for every order: positions from a joined table, vectors of three numbers however wide."""
    rows = table(spark, sf, "orders")
    encoder = SparseEncoder.fit(rows, ["o_totalprice"], ["o_orderpriority", "o_orderkey"], use_text=False)
    path = scratch_path(spark, "sparse-encoder")
    encoder.save(path)
    vectors = SparseEncoder.load(spark, path).transform(rows, ["o_orderkey"])
    pairs = F.arrays_zip(F.col("features.at").alias("at"), F.col("features.values").alias("value"))
    long = vectors.select("o_orderkey", F.col("features.size").cast("long").alias("width"), F.explode(pairs).alias("p"))
    return long.select("o_orderkey", F.col("p.at").alias("place"), F.round("p.value", 6).alias("value"), "width")


PART_FIT_SQL = f"""{REQUESTS_SQL}, {FLAT_SQL},
pfit AS (SELECT {", ".join(f"avg({c}) AS m_{c}, CASE stddev_pop({c}) WHEN 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in NUMBERS)} FROM flat),
pcats AS (SELECT {", ".join(f"list(DISTINCT coalesce({c}, 'NA') ORDER BY coalesce({c}, 'NA')) AS c_{c}" for c in CATEGORIES)} FROM flat),
penc AS (SELECT flat.*, list_concat(list_concat([{", ".join(f"({c}-m_{c})/s_{c}" for c in NUMBERS)}],
  {", ".join(f"list_transform(c_{c}, lambda c: CASE WHEN c = coalesce({c}, 'NA') THEN 1.0 ELSE 0.0 END::DOUBLE)" + (")" if c == CATEGORIES[0] else "") for c in CATEGORIES)})::FLOAT[]::DOUBLE[] AS v
  FROM flat, pfit, pcats)"""


@query("feature_vector", f"WITH {PART_FIT_SQL} SELECT p_partkey, len(v)::INTEGER AS vec_len, {LONG_SQL} FROM penc")
def feature_vector(spark, sf):
    """Requests of all parts, flattened, fitted and encoded, as (part, position, value)."""
    rows = flat_rows(part_requests(spark, sf, "p_partkey"), keep=["p_partkey"])
    rows = written(rows.select("p_partkey", *NUMBERS, *CATEGORIES), "flat-rows")  # read three times
    encoded = Encoder.fit(rows, use_text=False).transform(rows, keep=["p_partkey"])
    return long_form(encoded, ["p_partkey", "vec_len"])


@query("encoder_pipeline", f"WITH {ROWS_SQL} SELECT workload_kind, workload_name, len(v)::INTEGER AS vec_len, {LONG_SQL} FROM enc")
def encoder_pipeline(spark, sf):
    """Fit, save, load, transform, write, read."""
    rows = workload_rows(spark, sf)
    path = scratch_path(spark, "encoder")
    Encoder.load_or_fit(spark, path, rows, **ENCODED)
    encoder = Encoder.load_or_fit(spark, path, rows.limit(0))  # found: nothing is fitted
    write_table(encoder.transform(rows), f"{path}/features")
    return long_form(read_table(spark, f"{path}/features"), ["workload_kind", "workload_name", "vec_len"])


# --- neighbours ---


def knn_sql(train: str, queries: str, k: int, where: str = "true") -> str:
    """(qid, tid, y, d): k nearest of every query; both sides have id and v, train has y."""
    return f"""SELECT q.id AS qid, t.id AS tid, t.y, round(CASE WHEN q.n * t.n = 0 THEN 1
    ELSE 1 - list_dot_product(q.v, t.v) / (q.n * t.n) END, 9) AS d
  FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM {queries}) q, (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM {train}) t
  WHERE {where} QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY d, t.id) <= {k}"""


EMBEDDINGS_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::DOUBLE AS y FROM embeddings)"
PREDICT_SQL = f"""WITH {EMBEDDINGS_SQL}, nn AS ({knn_sql('e', 'e', 5)})
SELECT qid AS vec_id, round(avg(y), 6) AS prediction FROM nn GROUP BY qid"""


def _embeddings(spark, sf):
    return spread(table(spark, sf, "embeddings")).withColumn("y", F.col("label").cast("double"))


def _predict(spark, sf, limits: knn.Limits) -> DataFrame:
    rows = _embeddings(spark, sf)
    model = KnnModel.fit(rows, "y", features="embedding", id="vec_id", limits=limits)
    return model.predict(rows, "embedding").select("vec_id", r("prediction"))


@query("knn_predict", PREDICT_SQL)
def knn_predict(spark, sf):
    """Every vector against every vector, searched where the queries are."""
    return _predict(spark, sf, knn.Limits())


@query("knn_partitioned", PREDICT_SQL)
def knn_partitioned(spark, sf):
    """The same, taking the way of training tables too large to broadcast."""
    return _predict(spark, sf, knn.Limits(broadcast_bytes=0, block_rows=128, query_rows=500))


@query(
    "knn_approximate",
    "SELECT 2 * count(*) AS queries, 2 * least(5, count(*)) * count(*) AS neighbours, true AS reaches_goal FROM embeddings",
)
def knn_approximate(spark, sf):
    """Vectors and near copies of them, searched in the nearest cells only: as many as the measured recall asks for."""
    rows = _embeddings(spark, sf).select((F.col("vec_id") * 2).alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "y")
    moved = F.transform("v", lambda x, i: x + F.when(i == F.pmod("vec_id", F.size("v")), 0.01).otherwise(0.0))
    both = written(rows.unionByName(rows.withColumn("v", moved).withColumn("vec_id", F.col("vec_id") + 1)), "approximate")
    entries = written(knn.training_entries(both, "v", "vec_id", "y"), "entries")  # read three times
    searcher = knn.Searcher(entries, limits=knn.Limits(0, 128, 500))
    probes = searcher.probes_for(both, 0.9, "v")
    # written, so that what it shuffled goes before the second search begins
    exact = written(searcher.search(both, "v", out="true").select("v", "true"), "exact")
    found = searcher.search(exact, "v", probes=probes)
    hits = F.sum(F.size(F.array_intersect("true.ids", "neighbours.ids")))
    total = F.sum(F.size("neighbours.ids")).cast("long")
    return found.agg(F.count(F.lit(1)).alias("queries"), total.alias("neighbours"), (hits >= 0.88 * F.sum(F.size("true.ids"))).alias("reaches_goal"))


@query(
    "knn_neighbours",
    f"""WITH {EMBEDDINGS_SQL}, nn AS ({knn_sql('e', 'e', 3)})
SELECT qid AS vec_id, row_number() OVER (PARTITION BY qid ORDER BY d, tid)::INTEGER AS "rank", tid AS id, y, round(d, 6) AS distance FROM nn""",
)
def knn_neighbours(spark, sf):
    rows = _embeddings(spark, sf)
    entries = knn.training_entries(rows, "embedding", "vec_id", "y", 3)
    found = knn.neighbour_rows(knn.with_neighbours(rows, entries, 3, "embedding"), ["vec_id"])
    return found.withColumn("distance", F.round(F.round("distance", 9), 6))  # in two steps, as in the SQL


@query(
    "knn_close_vectors",
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::DOUBLE AS y FROM embeddings),
near AS (SELECT id, list_concat([v[1] + 0.0001::FLOAT::DOUBLE], v[2:])::FLOAT[]::DOUBLE[] AS v FROM e),
t AS (SELECT id * 2 + 1 AS id, v, y FROM e UNION ALL SELECT n.id * 2, n.v, -1 FROM near n),
u AS (SELECT id, y, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM t),
q AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)
SELECT q.id AS vec_id, u.id AS id, u.y AS y FROM q, u
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, u.v), u.id) = 1""",
)
def knn_close_vectors(spark, sf):
    """Every vector next to a near copy with a smaller id: the nearest entry is the vector itself."""
    rows = _embeddings(spark, sf)
    moved = F.array_insert(F.slice("v", 2, F.size("v")), 1, (F.col("v")[0].cast("double") + F.lit(0.0001).cast("float").cast("double")).cast("float"))
    own = rows.select((F.col("vec_id") * 2 + 1).alias("id"), F.col("embedding").cast("array<float>").alias("v"), "y")
    copies = own.select((F.col("id") - 1).alias("id"), moved.alias("v"), F.lit(-1.0).alias("y"))
    entries = knn.training_entries(own.unionByName(copies), "v", "id", "y", 1)
    found = knn.neighbour_rows(knn.with_neighbours(rows, entries, 1, "embedding"), ["vec_id"])
    return found.select("vec_id", "id", "y")


@query(
    "row_prediction",
    f"""WITH {EMBEDDINGS_SQL}, one AS (SELECT * FROM e WHERE id = (SELECT max(id) FROM e)), nn AS ({knn_sql('e', 'one', 5)})
SELECT qid AS vec_id, round(avg(y), 6) AS prediction FROM nn GROUP BY qid""",
)
def row_prediction(spark, sf):
    """Spot check: one row looked up by key, and its prediction from all rows."""
    rows = _embeddings(spark, sf)
    newest = rows.orderBy(F.desc("vec_id")).limit(1)
    model = KnnModel.fit(rows, "y", features="embedding", id="vec_id")
    return model.predict(newest, "embedding").select("vec_id", r("prediction"))


@query(
    "batch_score",
    f"""WITH {EMBEDDINGS_SQL}, nn AS ({knn_sql('e', 'e', 5)})
SELECT qid AS vec_id, 'y' AS target, round(avg(y), 4) AS prediction, round(avg(y) * 4, 4) AS energy_over_horizon FROM nn GROUP BY qid""",
)
def batch_score(spark, sf):
    """Model saved and loaded, predictions over a horizon written as JSON records and read back."""
    rows = _embeddings(spark, sf)
    path = scratch_path(spark, "model")
    KnnModel.fit(rows, "y", features="embedding", id="vec_id").save(path)
    model = KnnModel.load(spark, path)
    scored = over_horizon(model.predict(rows, "embedding"), "200s", "60s")
    write_predictions(
        scored.select("vec_id", F.lit(model.target).alias("target"), "prediction", "energy_over_horizon"), f"{path}/scores"
    )
    back = spark.read.schema("vec_id bigint, target string, prediction double, energy_over_horizon double").json(f"{path}/scores")
    return back.select("vec_id", "target", r("prediction", 4), r("energy_over_horizon", 4))


# --- folds and cross-validation ---


def folds_sql(source: str, group: str) -> str:
    """(g, fold): groups by size, then name, each to the lightest of at most five folds."""
    return f"""g AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g) AS rn
  FROM (SELECT {group}::VARCHAR AS g FROM {source}) GROUP BY g),
deal AS (SELECT 0::BIGINT AS rn, list_transform(generate_series(1, least(5, (SELECT count(*) FROM g))), lambda x: 0::BIGINT) AS loads, 0::BIGINT AS fold
  UNION ALL SELECT g.rn, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN n ELSE 0 END),
    list_position(loads, list_min(loads)) - 1 FROM deal JOIN g ON g.rn = deal.rn + 1),
folds AS (SELECT g.g, fold FROM deal JOIN g USING (rn))"""


@query(
    "group_folds",
    f"""WITH RECURSIVE {folds_sql('events', 'user_id')}
SELECT event_id, user_id, fold::INTEGER AS fold FROM events JOIN folds ON g = user_id::VARCHAR""",
)
def group_folds(spark, sf):
    return with_folds(table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query(
    "group_folds_many",
    f"""WITH RECURSIVE {folds_sql('lineitem', 'l_orderkey')}
SELECT fold::INTEGER AS fold, l_orderkey, count(*) AS "rows" FROM lineitem JOIN folds ON g = l_orderkey::VARCHAR GROUP BY 1, 2""",
)
def group_folds_many(spark, sf):
    """As many groups as orders."""
    folded = with_folds(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey")
    return folded.groupBy("fold", "l_orderkey").agg(F.count("*").alias("rows"))


METRICS_SQL = """SELECT fold::INTEGER AS fold, count(*) AS "rows", round(avg(abs(y-p)), 4) AS mae,
  round(1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)), 4) AS r2 FROM scored GROUP BY fold"""


def cv_sql(source: str, group: str) -> str:
    return f"""{folds_sql(source, group)}, x AS (SELECT {source}.*, fold FROM {source} JOIN folds ON g = {group}::VARCHAR),
nn AS ({knn_sql('x', 'x', 5, 'q.fold <> t.fold')}), scored AS (SELECT x.fold, x.y, p FROM x JOIN
  (SELECT qid, avg(y) AS p FROM nn GROUP BY qid) ON qid = x.id)"""


def _metrics(df: DataFrame) -> DataFrame:
    return df.select("fold", "rows", r("mae", 4), r("r2", 4))


@query(
    "cv_metrics",
    f"""WITH RECURSIVE {ROWS_SQL}, y AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders GROUP BY 1),
c AS (SELECT enc.workload_name AS id, v, nation, y FROM enc JOIN y ON workload_name = 'app' || o_custkey), {cv_sql('c', 'nation')} {METRICS_SQL}""",
)
def cv_metrics(spark, sf):
    """Spending of customers from their features, folds by nation."""
    path = scratch_path(spark, "spenders")
    write_table(_spenders(spark, sf), path)  # read several times by the evaluation
    return _metrics(cross_validate(read_table(spark, path), "y", group="nation", id="workload_name"))


@query(
    "cv_metrics_partitioned",
    f"""WITH RECURSIVE {EMBEDDINGS_SQL}, {cv_sql('e', 'y')} {METRICS_SQL}""",
)
def cv_metrics_partitioned(spark, sf):
    """Folds by label over all vectors, searched the way of large training tables."""
    rows = _embeddings(spark, sf)
    limits = knn.Limits(broadcast_bytes=0, block_rows=256, query_rows=1000)
    return _metrics(cross_validate(rows, "y", group="y", features="embedding", id="vec_id", limits=limits))


@query(
    "cv_summary",
    f"""WITH RECURSIVE {EMBEDDINGS_SQL}, {cv_sql('e', 'y')}, m AS (SELECT fold, avg(abs(y-p)) AS mae,
  1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY fold)
SELECT count(*) AS folds, round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std, round(avg(r2), 4) AS r2_mean FROM m""",
)
def cv_summary(spark, sf):
    metrics = cross_validate(_embeddings(spark, sf), "y", group="y", features="embedding", id="vec_id")
    return score_report(metrics).select("folds", *[r(c, 4) for c in ("mae_mean", "mae_std", "r2_mean")])


def _spenders(spark, sf) -> DataFrame:
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("y"))
    name = F.concat(F.lit("app"), s("o_custkey"))
    rows = workload_rows(spark, sf)
    features = Encoder.fit(rows, **ENCODED).transform(rows, keep=["workload_name", "nation"])
    return features.join(spent.select(name.alias("workload_name"), "y"), "workload_name")


@query(
    "fold_metrics",
    """WITH scored AS (SELECT l_linenumber AS fold, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT fold, count(*) AS "rows", round(avg(abs(y-p)), 4) AS mae, round(1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)), 6) AS r2 FROM scored GROUP BY fold""",
)
def metrics_per_fold(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("target"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return fold_metrics(rows).select("fold", "rows", r("mae", 4), r("r2"))


@query(
    "metrics_summary",
    """WITH m AS (SELECT l_linenumber AS fold, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae FROM lineitem GROUP BY 1)
SELECT count(*) AS folds, round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std FROM m""",
)
def metrics_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("target"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return summary(fold_metrics(rows)).select("folds", r("mae_mean", 4), r("mae_std", 4))


# --- labels, training rows, predictions ---

STEP, DAY = 3600, 86400
# Samples by metric: power of two containers, an energy counter of two containers, owners.
SAMPLES_SQL = f"""{EV},
sm AS (SELECT event_id, t, event_type, value, 'NS-' || (user_id % 10) AS namespace, 'app' || user_id AS app, user_id,
  'app' || user_id || '-' || substr(md5(user_id::VARCHAR), 1, 10) AS rs,
  'app' || user_id || '-' || substr(md5(user_id::VARCHAR), 1, 10) || '-' || substr(md5(user_id::VARCHAR), 11, 5) AS pod FROM ev),
sp AS (SELECT * FROM sm WHERE event_type IN ('view', 'purchase')), se AS (SELECT * FROM sm WHERE event_type IN ('click', 'signup')),
so AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'Job' ELSE 'ReplicaSet' END AS k, CASE WHEN user_id % 3 = 0 THEN app ELSE rs END AS n
  FROM sm WHERE event_type = 'error'),
gp AS ({grid_sql('sp', 'namespace, pod, event_type', STEP, DAY)}), ge AS ({grid_sql('se', 'namespace, pod, event_type', STEP, DAY)}),
own AS (SELECT namespace, pod, k, n, ts FROM ({grid_sql('so', 'namespace, pod, k, n', STEP, DAY)})),
own_dump AS (SELECT DISTINCT namespace, pod, k, n FROM so),
pw AS (SELECT namespace, pod, ts, sum(value) AS avg_power_w FROM gp GROUP BY ALL),
et AS (SELECT namespace, pod, ts, sum(value) AS value FROM ge GROUP BY ALL),
es AS (SELECT *, value - lag(value) OVER (PARTITION BY namespace, pod ORDER BY ts) AS rise FROM et),
en AS (SELECT namespace, pod, ts, CASE WHEN rise IS NOT NULL THEN greatest(rise, 0) END AS energy_step_j FROM es),
both_ AS (SELECT namespace, pod, ts, avg_power_w, energy_step_j FROM pw LEFT JOIN en USING (namespace, pod, ts))"""
KIND_SQL = "CASE WHEN k = 'ReplicaSet' THEN 'Deployment' ELSE coalesce(k, 'Pod') END AS workload_kind"
NAME_SQL = "coalesce(regexp_replace(n, '-[a-f0-9]{9,}$', ''), pod) AS workload_name"
JOB_SQL = f"""jobs AS (SELECT namespace, workload_kind, workload_name, pod, avg(avg_power_w) AS avg_power_w, coalesce(sum(energy_step_j), 0) AS total_energy_j
  FROM (SELECT *, {KIND_SQL}, {NAME_SQL} FROM both_ LEFT JOIN own_dump USING (namespace, pod)) GROUP BY ALL)"""


def _samples(spark, sf):
    user = s("user_id")
    digest, app = F.md5(user), F.concat(F.lit("app"), user)
    rs = F.concat(app, F.lit("-"), F.substring(digest, 1, 10))
    job = F.col("user_id") % 3 == 0
    return events(spark, sf).select(
        "event_id", "t", "event_type", "value",
        F.concat(F.lit("NS-"), s(F.col("user_id") % 10)).alias("container_namespace"),
        F.concat(rs, F.lit("-"), F.substring(digest, 11, 5)).alias("pod_name"),
        F.when(job, F.lit("Job")).otherwise(F.lit("ReplicaSet")).alias("owner_kind"),
        F.when(job, app).otherwise(rs).alias("owner_name"),
    )


def _labels(spark, sf, mode: str, timed_owners: bool, by_day: bool = False) -> DataFrame:
    samples = _samples(spark, sf)
    lo, hi = span(samples)
    if by_day:
        path = scratch_path(spark, "samples")
        write_by_day(samples, path, "t", ["container_namespace", "pod_name"])
        samples = read_days(spark, path)
    metric = lambda *kinds: samples.filter(F.col("event_type").isin(*kinds))
    owners = metric("error")
    dump = owners.select(
        F.col("container_namespace").alias("namespace"), F.col("pod_name").alias("pod"), "owner_kind", "owner_name"
    ).distinct()
    return labels_from_samples(
        metric("view", "purchase"), metric("click", "signup"),
        owners if timed_owners else owners.filter(F.col("t") < lo), dump,
        lo, hi, "1h", mode=mode, series=["event_type"], ts="t", lookback=DAY, tie_break="event_id",
    )


@query(
    "label_builder",
    f"""WITH {SAMPLES_SQL} SELECT ts, namespace, {KIND_SQL}, {NAME_SQL}, pod, round(avg_power_w, 4) AS avg_power_w,
  round(energy_step_j, 4) AS energy_step_j FROM both_ LEFT JOIN own USING (namespace, pod, ts)""",
)
def label_builder(spark, sf):
    """Labels per step with owners per step."""
    out = _labels(spark, sf, "window", timed_owners=True)
    return out.withColumns({c: F.round(c, 4) for c in ("avg_power_w", "energy_step_j")})


@query("label_builder_by_day", SQL["label_builder"])
def label_builder_by_day(spark, sf):
    """The same labels from samples laid out by day, and laid out by day themselves."""
    path = scratch_path(spark, "labels")
    write_by_day(_labels(spark, sf, "window", timed_owners=True, by_day=True), path, keys=["namespace", "pod"])
    out = read_days(spark, path).drop("day")
    return out.withColumns({c: F.round(c, 4) for c in ("avg_power_w", "energy_step_j")})


@query(
    "label_builder_job",
    f"""WITH {SAMPLES_SQL}, {JOB_SQL} SELECT * REPLACE (round(avg_power_w, 4) AS avg_power_w, round(total_energy_j, 4) AS total_energy_j) FROM jobs""",
)
def label_builder_job(spark, sf):
    """Labels per pod with owners from the object dump, the time-stamped source being empty."""
    out = _job_labels(spark, sf)
    return out.withColumns({c: F.round(c, 4) for c in ("avg_power_w", "total_energy_j")})


def _job_labels(spark, sf) -> DataFrame:
    return _labels(spark, sf, "job", timed_owners=False)


TRAIN_SQL = f"""{SAMPLES_SQL}, {JOB_SQL}, {ROWS_SQL},
cj AS (SELECT * REPLACE (lower(namespace) AS namespace), CASE workload_kind WHEN 'Pod' THEN 'Deployment' ELSE workload_kind END AS canon_kind,
  CASE workload_kind WHEN 'Pod' THEN regexp_extract(workload_name, '^(.+)-[a-f0-9]{{9,}}-[a-z0-9]{{5}}$', 1) ELSE workload_name END AS canon_name FROM jobs),
tr AS (SELECT cj.*, spec, v FROM cj JOIN enc USING (namespace, canon_name))"""


@query(
    "train_rows",
    f"""WITH {TRAIN_SQL} SELECT namespace, workload_kind, workload_name, pod, canon_kind, canon_name, spec AS _spec_hash,
  round(avg_power_w, 4) AS avg_power_w, round(total_energy_j, 4) AS total_energy_j, len(v)::INTEGER AS vec_len FROM tr""",
)
def train_rows(spark, sf):
    rows = training_rows(_job_labels(spark, sf), workload_features(spark, sf))
    return rows.select(
        "namespace", "workload_kind", "workload_name", "pod", "canon_kind", "canon_name", "_spec_hash",
        r("avg_power_w", 4), r("total_energy_j", 4), F.size("features").alias("vec_len"),
    )


@query(
    "train_diagnostics",
    f"""WITH {TRAIN_SQL}, a AS (SELECT DISTINCT namespace, canon_name FROM enc), b AS (SELECT DISTINCT namespace, canon_name FROM cj)
SELECT (SELECT count(*) FROM a) AS feature_keys, (SELECT count(*) FROM b) AS label_keys,
  (SELECT count(*) FROM a JOIN b USING (namespace, canon_name)) AS shared_keys""",
)
def train_diagnostics(spark, sf):
    return join_diagnostics(_job_labels(spark, sf), workload_features(spark, sf))


@query(
    "workload_prediction",
    f"""WITH {TRAIN_SQL}, tt AS (SELECT concat_ws('|', namespace, workload_kind, workload_name, pod, spec) AS id, v, total_energy_j AS y FROM tr),
qq AS (SELECT spec AS id, v FROM enc), nn AS ({knn_sql('tt', 'qq', 5)})
SELECT namespace, workload_kind, workload_name, spec AS _spec_hash, round(p, 3) AS prediction
FROM enc JOIN (SELECT qid, avg(y) AS p FROM nn GROUP BY qid) ON qid = spec""",
)
def workload_prediction(spark, sf):
    """From samples and specs to predictions: labels, features, join, fit, save, load, predict."""
    path = scratch_path(spark, "pipeline")
    features = workload_features(spark, sf)
    write_table(training_rows(_job_labels(spark, sf), features), f"{path}/train")
    rows = read_table(spark, f"{path}/train")
    KnnModel.fit(rows, "total_energy_j").save(f"{path}/model")
    model = KnnModel.load(spark, f"{path}/model")
    return model.predict(spread(features)).select(*META, r("prediction", 3))


@query(
    "stage_rows",
    f"""WITH {TRAIN_SQL} SELECT 'features' AS stage, count(*) AS "rows" FROM enc UNION ALL SELECT 'labels', count(*) FROM cj
UNION ALL SELECT 'training_rows', count(*) FROM tr UNION ALL SELECT 'scores', count(*) FROM enc""",
)
def stage_rows(spark, sf):
    """Rows of every stage of a run from labels and features to scores, counted while they are written."""
    path, counts = scratch_path(spark, "stages"), StageCounts()
    features = workload_features(spark, sf)
    total = write_training_rows(_job_labels(spark, sf), features, f"{path}/train", counts=counts)
    model = KnnModel.fit(read_table(spark, f"{path}/train"), "total_energy_j")
    write_table(counts.watch(model.predict(spread(features)), "scores"), f"{path}/scores")
    joined = spark.createDataFrame([("training_rows", total)], "stage string, rows bigint")
    return counts.table(spark).unionByName(joined)


# --- scoring of manifests ---

SCORES_SQL = f"""{PART_FIT_SQL}, pt AS (SELECT p_partkey AS id, v, p_retailprice AS y FROM penc JOIN part USING (p_partkey)),
nn AS ({knn_sql('pt', 'pt', 5)}), scores AS (SELECT namespace, workload_kind, workload_name, spec_hash, 'price' AS target, round(p, 4) AS prediction
  FROM penc JOIN (SELECT qid, avg(y) AS p FROM nn GROUP BY qid) ON qid = p_partkey)"""


def part_models(spark, sf: str) -> tuple[Encoder, KnnModel]:
    """Encoder and model of the parts' workloads, the price as target, loaded from their artifacts."""
    path = scratch_path(spark, "part-model")
    rows = flat_rows(part_requests(spark, sf, "p_partkey"), keep=["p_partkey"])
    write_table(rows, f"{path}/rows")
    rows = read_table(spark, f"{path}/rows")
    Encoder.fit(rows, use_text=False).save(spark, f"{path}/encoder")
    encoder = Encoder.load(spark, f"{path}/encoder")
    price = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    train = encoder.transform(rows, keep=["p_partkey"]).join(price, "p_partkey")
    KnnModel.fit(train, "price", id="p_partkey").save(f"{path}/model")
    return encoder, KnnModel.load(spark, f"{path}/model")


SCORE_COLUMNS = ("namespace", "workload_kind", "workload_name", "spec_hash", "target")


@query("score_manifests", f"WITH {SCORES_SQL} SELECT * FROM scores")
def score_manifests(spark, sf):
    """Manifest files scored document by document."""
    out = score_documents(_documents(spark, sf), *part_models(spark, sf))
    return out.select(*SCORE_COLUMNS, r("prediction", 4))


@query("score_requests", f"WITH {SCORES_SQL} SELECT * FROM scores")
def score_request_rows(spark, sf):
    out = score_requests(part_requests(spark, sf), *part_models(spark, sf))
    return out.select(*SCORE_COLUMNS, r("prediction", 4))
