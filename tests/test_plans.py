"""Whole jobs on a small hand-written cluster."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators.flatten import flat_rows
from wattloom.operators.requests import manifest_requests, object_requests
from wattloom.plans.dataset import join_diagnostics, training_rows, write_training_rows
from wattloom.plans.encoder import Encoder
from wattloom.plans.evaluate import cross_validate, score_report
from wattloom.plans.labels import build_labels, labels_from_samples
from wattloom.plans.model import KnnModel
from wattloom.plans.sparse_encoder import SparseEncoder, densified, sparse_dot
from wattloom.plans.score import over_horizon, requests_of_documents, score_documents, score_requests
from wattloom.schemas import accepted
from wattloom.sources.manifests import read_documents
from wattloom.sources.series import flatten_series, read_responses
from wattloom.sources.tables import append_requests, read_requests


def request(ns, kind, name, cpu, **extra):
    box = {"name": "c", "image": f"img/{name}", "req_cpu_mcpu": cpu, "req_mem_mib": 70}
    return {"namespace": ns, "workload_kind": kind, "workload_name": name, "containers": [box], **extra}


REQUESTS = [
    request("kube-system", "Deployment", "coredns", 100, node_type="m5"),
    request("kube-system", "Pod", "coredns-7db6d8ff4d-9cd8j", 100),
    request("kube-system", "Pod", "coredns-7db6d8ff4d-x4x4x", 100),
    request("kube-system", "Pod", "kube-proxy-526w5", 50, runtime_class="gvisor"),
    request("Web", "Deployment", "shop", 500, gpu_count=2),
    request("web", "Job", "report", 900, init_container_count=1),
]


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("requests")
    lines = [json.dumps(r) for r in REQUESTS] + ["", "{broken", json.dumps({"namespace": "x"}), '{"containers": 3}']
    (path / "in.ndjson").write_text("\n".join(lines) + "\n")
    return read_requests(spark, str(path))


@pytest.fixture(scope="module")
def flat(requests):
    return flat_rows(accepted(requests))


def test_reading(requests):
    reasons = sorted(r["reject_reason"] or "" for r in requests.collect())
    assert reasons == [""] * 6 + ["malformed line"] * 2 + ["missing field: workload_kind, workload_name, containers"]


def test_append_and_read_back(spark, requests, tmp_path):
    good = accepted(requests).drop("_corrupt_record")
    append_requests(good, str(tmp_path / "out"))
    append_requests(good, str(tmp_path / "out"))
    assert accepted(read_requests(spark, str(tmp_path / "out"))).count() == 12


def test_encoder(spark, flat, tmp_path):
    encoder = Encoder.fit(flat, use_text=False)
    cpu = np.array([100, 100, 100, 50, 500, 900.0])
    assert encoder.scaler["req_cpu_mcpu"] == pytest.approx((cpu.mean(), cpu.std()))
    assert encoder.categories == {"runtime_class": ["NA", "gvisor"], "node_type": ["NA", "m5"]}
    out = encoder.transform(flat)
    assert out.columns == ["namespace", "workload_kind", "workload_name", "_spec_hash", "vec_len", "features"]
    rows = {r["workload_name"]: r for r in out.collect()}
    assert all(r["vec_len"] == len(r["features"]) == 11 for r in rows.values())
    shop = rows["shop"]["features"]
    assert shop[3] == pytest.approx((500 - cpu.mean()) / cpu.std(), rel=1e-6)
    assert shop[2] == 0.0 and list(shop[7:]) == [1, 0, 1, 0]
    encoder.save(spark, str(tmp_path / "enc"))
    assert Encoder.load(spark, str(tmp_path / "enc")) == encoder
    assert Encoder.load_or_fit(spark, str(tmp_path / "enc"), flat.limit(0)) == encoder
    unseen = flat.withColumn("node_type", F.lit("other"))
    assert all(list(r["features"][9:]) == [0, 0] for r in encoder.transform(unseen).collect())
    with pytest.raises(ValueError):
        Encoder.fit(flat.limit(0))


def test_encoder_with_text(flat):
    encoder = Encoder.fit(flat)
    assert encoder.length == 11 + 384
    vectors = np.array([r["features"] for r in encoder.transform(flat).collect()])
    assert np.linalg.norm(vectors[:, 11:], axis=1) == pytest.approx(np.ones(6), rel=1e-5)
    own = Encoder.fit(flat, text_dim=2, text_model=lambda: lambda texts: [[3.0, 4.0]] * len(texts))
    assert {tuple(r["features"][11:]) for r in own.transform(flat).collect()} == {(np.float32(0.6).item(), np.float32(0.8).item())}


def test_text_model_is_known_by_its_name(spark, flat, tmp_path):
    def made(name, value):
        model = lambda: lambda texts: [[value, 1.0]] * len(texts)
        model.model_name = name
        return model

    path = str(tmp_path / "named")
    Encoder.fit(flat, text_dim=2, text_model=made("one", 1.0)).save(spark, path)
    assert Encoder.load(spark, path, made("one", 1.0)).length == 13
    for other in (made("two", 2.0), None):
        with pytest.raises(ValueError):
            Encoder.load(spark, path, other)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("series")

    def response(metric_of):
        result = [{"metric": m, "values": [[t, str(v)] for t, v in values]} for m, values in metric_of]
        return json.dumps({"status": "success", "data": {"resultType": "matrix", "result": result}})

    pods = {"coredns-7db6d8ff4d-9cd8j": ("kube-system", 1), "shop-0123456789-abcde": ("web", 2), "report-xyz": ("web", 3)}
    label = lambda ns, pod: {"container_namespace": ns, "pod_name": pod}
    power = [(label(ns, p), [(t, n * 10 + t / 60) for t in (0, 60, 120)]) for p, (ns, n) in pods.items()]
    energy = [(label(ns, p), [(0, 10), (60, 10 + n), (120, 5)]) for p, (ns, n) in pods.items()]
    energy.append(({"mode": "idle"}, [(0, 1)]))
    owner = [({"namespace": "web", "pod": "shop-0123456789-abcde", "owner_kind": "ReplicaSet", "owner_name": "shop-0123456789"}, [(0, 1), (60, 1)])]
    out = {}
    for name, data in (("power", power), ("energy", energy), ("owner", owner), ("none", [])):
        (path / f"{name}.json").write_text(response(data))
        labels = ["namespace", "pod", "owner_kind", "owner_name"] if name == "owner" else ["container_namespace", "pod_name"]
        out[name] = flatten_series(read_responses(spark, str(path / f"{name}.json")), labels)
    out["dump"] = spark.createDataFrame(
        [("kube-system", "coredns-7db6d8ff4d-9cd8j", "ReplicaSet", "coredns-7db6d8ff4d"), ("web", "report-xyz", "Job", "report")],
        "namespace string, pod string, owner_kind string, owner_name string")
    return out


def test_labels_window(series):
    got = build_labels(series["power"], series["energy"], series["owner"], series["dump"])
    rows = {(r["pod"], r["ts"]): r for r in got.collect()}
    assert len(rows) == 9
    shop = [rows["shop-0123456789-abcde", t] for t in (0.0, 60.0, 120.0)]
    assert [(r["workload_kind"], r["workload_name"]) for r in shop] == [("Deployment", "shop")] * 2 + [("Pod", "shop-0123456789-abcde")]
    assert [r["energy_step_j"] for r in shop] == [None, 2.0, 0.0] and shop[1]["avg_power_w"] == 21.0


def test_labels_job(series):
    got = build_labels(series["power"], series["energy"], series["none"].withColumns({"owner_kind": F.lit(""), "owner_name": F.lit("")}), series["dump"], mode="job")
    rows = {r["pod"]: r for r in got.collect()}
    assert rows["report-xyz"].asDict() == {"namespace": "web", "workload_kind": "Job", "workload_name": "report", "pod": "report-xyz",
                                           "avg_power_w": pytest.approx(31.0), "total_energy_j": 3.0}
    assert rows["shop-0123456789-abcde"]["workload_kind"] == "Pod"
    only_power = build_labels(series["power"], series["none"], None, series["dump"], "k8s", "job")
    assert {r["total_energy_j"] for r in only_power.collect()} == {0.0}
    with pytest.raises(ValueError):
        build_labels(series["none"], None, None, series["dump"])
    with pytest.raises(ValueError):
        build_labels(series["power"], None, None, series["dump"], "prom")


def test_labels_from_samples(spark):
    ddl = "namespace string, pod string, container string, ts double, value double"
    power = spark.createDataFrame([("n", "p", c, t, v) for c, v in (("a", 1.0), ("b", 2.0)) for t in (3.0, 62.0)], ddl)
    late = spark.createDataFrame([("n", "p", "a", 200.0, 5.0)], ddl)
    nameless = spark.createDataFrame([(None, "p", "a", 10.0, 5.0)], ddl)
    dump = spark.createDataFrame([("n", "p", "Job", "j")], "namespace string, pod string, owner_kind string, owner_name string")
    for energy in (None, late, nameless):
        got = labels_from_samples(power, energy, None, dump, 0, 130).orderBy("ts").collect()
        assert [(r["ts"], r["avg_power_w"], r["energy_step_j"]) for r in got] == [(60.0, 3.0, None), (120.0, 3.0, None)]
    with pytest.raises(ValueError):
        labels_from_samples(late, nameless, None, dump, 0, 130)


def test_training_to_scores(spark, series, flat, requests, tmp_path):
    labels = build_labels(series["power"], series["energy"], None, series["dump"], mode="job")
    encoder = Encoder.fit(flat, use_text=False)
    features = encoder.transform(flat)
    rows = training_rows(labels, features)
    assert rows.groupBy("canon_name").count().orderBy("canon_name").collect() == [("coredns", 3), ("report", 1), ("shop", 1)]
    assert rows.filter("canon_name = 'shop'").first()["namespace"] == "web"
    assert tuple(join_diagnostics(labels, features).first()) == (4, 3, 3)
    assert training_rows(labels, features, dedupe_features=True).count() == 3

    metrics = cross_validate(rows, "total_energy_j", k=2)
    assert score_report(metrics).first()["folds"] == 3 and metrics.agg(F.sum("rows")).first()[0] == 5
    with pytest.raises(ValueError):
        cross_validate(rows.filter("workload_name = 'report'"), "total_energy_j")

    KnnModel.fit(rows, "total_energy_j", k=1).save(str(tmp_path / "model"))
    model = KnnModel.load(spark, str(tmp_path / "model"))
    assert (model.k, model.target) == (1, "total_energy_j")
    scored = over_horizon(score_requests(accepted(requests), encoder, model), "1h", "7m")
    got = {(r["workload_kind"], r["workload_name"]): r for r in scored.collect()}
    assert got["Deployment", "shop"]["prediction"] == 2.0 and got["Job", "report"]["prediction"] == 3.0
    assert got["Job", "report"]["energy_over_horizon"] == 27.0
    with pytest.raises(ValueError):
        KnnModel.fit(rows.withColumn("total_energy_j", F.lit(float("nan"))), "total_energy_j")


def test_sparse_vectors_equal_dense_ones(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1.0, "x", "pod runs pod"), ("b", 2.0, None, None), ("c", 4.0, "y", "other"), ("d", None, "x", "")],
        "id string, n double, kind string, _text string",
    )
    for use_text in (False, True):
        dense = Encoder.fit(rows, ["n"], ["kind", "id"], use_text).transform(rows, ["id"])
        encoder = SparseEncoder.fit(rows, ["n"], ["kind", "id"], use_text)
        encoder.save(str(tmp_path / f"sparse-{use_text}"))
        out = SparseEncoder.load(spark, str(tmp_path / f"sparse-{use_text}")).transform(rows, ["id"])
        got = {r["id"]: r["v"] for r in out.select("id", densified(F.col("features")).alias("v")).collect()}
        want = {r["id"]: r["features"] for r in dense.collect()}
        assert {i: pytest.approx(v) for i, v in want.items()} == got
        for r in out.collect():
            assert r["features"]["at"] == sorted(r["features"]["at"]) and r["vec_len"] == r["features"]["size"] == len(want["a"])
        pairs = out.alias("l").crossJoin(out.alias("r")).select(
            "l.id", F.col("r.id").alias("other"), sparse_dot(F.col("l.features"), F.col("r.features")).alias("dot")
        )
        for r in pairs.collect():
            assert r["dot"] == pytest.approx(sum(x * y for x, y in zip(want[r["id"]], want[r["other"]])), abs=1e-6)
    unseen = SparseEncoder.fit(rows, ["n"], ["kind"], False).transform(rows.withColumn("kind", F.lit("new")), ["id"])
    assert {len(r["features"]["at"]) for r in unseen.collect()} == {1}
    with pytest.raises(ValueError):
        SparseEncoder.fit(rows.filter("false"), ["n"], ["kind"])


def test_no_categories_in_the_plan(spark):
    rows = spark.range(3000).select(F.concat(F.lit("category"), "id").alias("c"), "id")
    out = SparseEncoder.fit(rows, [], ["c"], use_text=False).transform(rows, ["id"])
    assert "category2999" not in out._jdf.queryExecution().toString()
    assert out.select(F.size("features.at").alias("n")).distinct().collect()[0]["n"] == 1


def test_a_kept_model_keeps_its_cells(spark, tmp_path, monkeypatch):
    from wattloom.operators import cells, knn

    rows = spark.range(300).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("features"), F.col("id").cast("double").alias("y"))
    limits = knn.Limits(0, 40, 50)
    KnnModel.fit(rows, "y", id="id", limits=limits).save(str(tmp_path / "model"))
    monkeypatch.setattr(cells.CellIndex, "build", staticmethod(lambda *a: pytest.fail("cut again")))
    model = KnnModel.load(spark, str(tmp_path / "model"), limits)
    one = rows.filter("id = 7")
    assert model.predict(one).first()["prediction"] == pytest.approx(KnnModel.load(spark, str(tmp_path / "model")).predict(one).first()["prediction"])
    assert len(model.predict(rows).collect()) == 300


MANIFESTS = """---
apiVersion: apps/v1
kind: Deployment
metadata:
  name: front
spec:
  template:
    metadata: {labels: {app: front}}
    spec:
      nodeSelector: {beta.kubernetes.io/instance-type: m5}
      volumes: [{name: a, emptyDir: {}}, {name: b, csi: {}}]
      containers:
      - name: web
        image: nginx:1
        resources:
          requests: {cpu: 250m, memory: 1Gi}
          limits: {cpu: 0, memory: "0", nvidia.com/gpu: 2}
--- # a job
kind: Job
metadata: {name: batch, namespace: jobs}
spec:
  parallelism: 3
  completions: 6
  template:
    spec:
      initContainers: [{name: i}]
      containers: [{name: c, image: x, command: [run], args: [--fast, now]}]
---
- not an object
---
kind: Pod
metadata: {name: p}
---
kind: CronJob
metadata: {name: nightly}
spec: {jobTemplate: {spec: {template: {spec: {containers: [{name: c, image: x, resources: {limits: {cpu: "0"}}}]}}}}}
---
kind: CronJob
metadata: {name: hollow}
spec: {}
---
bad: [
"""


def test_manifests(spark, flat, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFESTS)
    docs = read_documents(spark, str(tmp_path / "m.yaml"))
    rows = requests_of_documents(docs).orderBy("at", "n").collect()
    assert [(r["workload_kind"], r["reject_reason"]) for r in rows] == [
        ("Deployment", None), ("Job", None), ("Pod", "unsupported kind: Pod"), ("CronJob", None),
        ("CronJob", "missing pod template"), (None, "invalid manifest: ParserError")]
    front, batch, _, nightly = rows[:4]
    assert (front["namespace"], front["node_type"], front["gpu_count"], front["volume_types"]) == ("default", "m5", 2, ["emptyDir", "other"])
    box = front["containers"][0].asDict()
    assert (box["req_cpu_mcpu"], box["req_mem_mib"], box["lim_cpu_mcpu"], box["lim_mem_mib"]) == (250, 1024, None, 0)
    assert (batch["parallelism"], batch["completions"], batch["init_container_count"]) == (3, 6, 1)
    assert batch["containers"][0]["args"] == ["--fast", "now"] and front["parallelism"] is None
    assert nightly["containers"][0]["lim_cpu_mcpu"] == 0
    first = requests_of_documents(docs, first_only=True).collect()
    assert [r["workload_name"] for r in first] == ["front"]

    encoder = Encoder.fit(flat, use_text=False)
    model = KnnModel.fit(encoder.transform(flat).withColumn("y", F.lit(4.0)), "y", k=2)
    scored = score_documents(docs, encoder, model).orderBy("at", "n").collect()
    assert [r["prediction"] for r in scored] == [4.0, 4.0, None, 4.0, None, None]


def test_objects_in_both_spellings(spark):
    camel = {"metadata": {"name": "p", "namespace": "n", "ownerReferences": [{"kind": "ReplicaSet", "name": "r"}]},
             "spec": {"initContainers": [{}], "runtimeClassName": "kata", "volumes": [{"hostPath": {}}], "containers": []}}
    snake = {"metadata": {"name": "p", "namespace": "n", "owner_references": [{"kind": "ReplicaSet", "name": "r"}]},
             "spec": {"init_containers": [{}], "runtime_class_name": "kata", "containers": [],
                      "volumes": [{"host_path": {}, "ephemeral": None, "secret": None}]}}
    df = spark.createDataFrame([("Pod", json.dumps(d)) for d in (camel, snake)], "kind string, object string")
    a, b = object_requests(df, kinds=["Pod"]).collect()
    assert a == b and (a["workload_kind"], a["workload_name"], a["runtime_class"]) == ("ReplicaSet", "r", "kata")
    assert a["volume_types"] == ["hostPath"] and a["init_container_count"] == 1


def test_object_selection(spark):
    def obj(kind, ns, spec):
        return kind, json.dumps({"metadata": {"name": "x", "namespace": ns}, "spec": spec})

    pod = {"metadata": {}, "spec": {"containers": []}}
    rows = [obj("Deployment", "a", {"template": pod}), obj("Deployment", "b", {"template": pod}), obj("Pod", "a", {"containers": []}),
            obj("CronJob", "a", {"job_template": {"spec": {"template": {}}}}), obj("CronJob", "a", {"job_template": {"spec": {"template": pod}}})]
    df = spark.createDataFrame(rows, "kind string, object string")
    got = object_requests(df, namespaces=["a"]).select("workload_kind", "reject_reason").collect()
    assert sorted(tuple(r) for r in got) == [("CronJob", None), ("Deployment", None)]


def test_text_that_is_no_object(spark):
    df = spark.createDataFrame([("nonsense",), ("[1]",)], "object string")
    assert all(r["reject_reason"] for r in manifest_requests(df).collect())


def test_parse_happens_once(spark, tmp_path):
    df = spark.createDataFrame([("{}",)], "object string")
    df.write.parquet(str(tmp_path / "t"))
    plan = accepted(manifest_requests(spark.read.parquet(str(tmp_path / "t"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_training_rows_report_when_nothing_joins(spark, tmp_path, caplog):
    labels = spark.createDataFrame([("n", "Job", "a", 1.0)], "namespace string, workload_kind string, workload_name string, avg_power_w double")
    features = spark.createDataFrame([("n", "Job", "b", "h", [1.0])], "namespace string, workload_kind string, workload_name string, _spec_hash string, features array<double>")
    assert write_training_rows(labels, features, str(tmp_path / "none")) == 0
    assert "no label has features" in caplog.text and "'shared_keys': 0" in caplog.text and "'a'" in caplog.text
    same = features.withColumn("workload_name", F.lit("a"))
    assert write_training_rows(labels, same, str(tmp_path / "one")) == 1
