"""Quantities, names, text bundle, hash, vectors."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from wattloom.functions import names, quantities as q, specs, vectors
from wattloom.schemas import REQUEST_DDL, validate


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)


def run(df, *exprs):
    rows = df.select("i", *[e.alias(f"e{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in rows]


CPU = {
    "100m": 100, "2": 2000, "0.5": 500, "1.001": 1000, "1.5m": 1, "": None, None: None,
    "0": 0, "abc": None, "100n": None, " 250M ": 250, "1e1": 10000, "nan": None, "1d": None, "-1": -1000,
}
MEMORY = {
    "128Mi": 128, "128M": 128, "128m": 128, "1Gi": 1024, "1G": 1024, "512Ki": 0, "2048K": 2,
    "1Ti": 1048576, "134217728": 128, "1Pi": None, "": None, None: None, "1.5Gi": 1536, "xMi": None,
    "huge": None,
}


def test_cpu(spark):
    df = column(spark, list(CPU))
    assert run(df, q.cpu_millicores(F.col("v"))) == list(CPU.values())
    bad = run(df, q.cpu_malformed(F.col("v")))
    assert [v for v, b in zip(CPU, bad) if b] == ["abc", "100n", "nan", "1d"]


def test_memory(spark):
    df = column(spark, list(MEMORY))
    assert run(df, q.memory_mib(F.col("v"))) == list(MEMORY.values())
    bad = run(df, q.memory_malformed(F.col("v")))
    assert [v for v, b in zip(MEMORY, bad) if b] == ["xMi"]


def test_to_int(spark):
    values = ["1", "1.9", "-2.5", "x", None, "inf", "1e30", " 3 "]
    assert run(column(spark, values), q.to_int(F.col("v"))) == [1, 1, -2, None, None, None, None, 3]


def test_bounds():
    assert q.step_seconds("60s") == 60 and q.step_seconds("5m") == 300 and q.step_seconds(15) == 15
    assert q.step_seconds("2h") == 7200
    with pytest.raises(ValueError):
        q.step_seconds("soon")
    assert q.epoch_seconds("2024-01-01T00:00:00Z") == 1704067200.0
    assert q.epoch_seconds("2024-01-01T01:00:00+01:00") == 1704067200.0
    assert q.epoch_seconds("1704067200") == q.epoch_seconds(1704067200) == 1704067200.0


CANON = [
    ("Deployment", "myapp", "Deployment", "myapp"),
    ("ReplicaSet", "myapp-75b8db778", "Deployment", "myapp"),
    ("ReplicaSet", "myapp", "Deployment", "myapp"),
    ("Pod", "coredns-7db6d8ff4d-9cd8j", "Deployment", "coredns"),
    ("Pod", "ingress-nginx-controller-7b5b8b7785-rcdk5", "Deployment", "ingress-nginx-controller"),
    ("Pod", "local-path-provisioner-988d74bc-dsqxj", "Pod", "local-path-provisioner-988d74bc-dsqxj"),
    ("Pod", "kube-proxy-526w5", "Pod", "kube-proxy-526w5"),
    ("Pod", "app-0123456789", "Deployment", "app"),
    ("Job", "collect-snapshot", "Job", "collect-snapshot"),
    (None, None, "", ""),
    (" Pod ", " a-0123456789 ", "Deployment", "a"),
]


def test_canonical(spark):
    df = spark.createDataFrame([(i, k, n) for i, (k, n, _, _) in enumerate(CANON)], "i int, k string, n string")
    got = run(df, *names.canonical_workload(F.col("k"), F.col("n")))
    assert got == [(k, n) for _, _, k, n in CANON]


def test_owner(spark):
    rows = [(0, None, None, "p"), (1, "ReplicaSet", "a-0123456789", "p"), (2, "ReplicaSet", None, "p"),
            (3, "Job", "j", "p"), (4, None, "x", "p")]
    df = spark.createDataFrame(rows, "i int, k string, n string, p string")
    got = run(df, *names.owner_workload(F.col("k"), F.col("n"), F.col("p")))
    assert got == [("Pod", "p"), ("Deployment", "a"), ("ReplicaSet", "p"), ("Job", "j"), ("Pod", "x")]


REQUEST = {
    "schema_version": "v1", "namespace": "né ▶ \U0001f600", "workload_kind": "Job", "workload_name": "j\"\\\n\t\x01\x7f/",
    "labels": {"b": "2", "a": "1"}, "annotations": {},
    "containers": [
        {"name": "c", "image": "x", "command": None, "args": ["-c", "run"], "req_cpu_mcpu": 100,
         "req_mem_mib": None, "lim_cpu_mcpu": 5, "lim_mem_mib": 7},
        {"name": "d", "image": "", "command": [], "args": None, "req_cpu_mcpu": 1,
         "req_mem_mib": None, "lim_cpu_mcpu": None, "lim_mem_mib": None},
    ],
    "init_container_count": 0, "sidecar_count": 0, "volume_types": ["secret"], "node_type": None,
    "runtime_class": None, "gpu_count": 0, "parallelism": 2, "completions": None,
}


def test_hash_equals_sorted_json(spark):
    df = spark.createDataFrame([json.dumps(REQUEST)], "string").select(
        F.from_json("value", REQUEST_DDL).alias("r")
    )
    row = df.select(specs.canonical_json(F.col("r")).alias("j"), specs.spec_hash(F.col("r")).alias("h")).first()
    want = json.dumps(REQUEST, sort_keys=True)
    assert row["j"] == want
    assert row["h"] == hashlib.sha256(want.encode()).hexdigest()[:16]


def test_text_bundle(spark):
    df = spark.createDataFrame([json.dumps(REQUEST), "{}"], "string").select(
        F.from_json("value", REQUEST_DDL).alias("r")
    )
    fields = [F.col(f"r.{c}") for c in ("workload_kind", "workload_name", "labels", "annotations", "containers")]
    got = [r[0] for r in df.select(specs.text_bundle(*fields)).collect()]
    name = REQUEST["workload_name"]
    assert got == [
        f"workload_kind:Job | workload_name:{name} | label:a=1 | label:b=2 | image:x | args:-c run", "empty"
    ]


def test_resource_sum(spark):
    df = spark.createDataFrame([json.dumps(REQUEST), "{}"], "string").select(
        F.from_json("value", REQUEST_DDL).alias("r")
    )
    got = df.select(*[specs.resource_sum(F.col("r.containers"), c) for c in specs.RESOURCES]).collect()
    assert [tuple(r) for r in got] == [(101.0, 0.0, 5.0, 7.0), (0.0, 0.0, 0.0, 0.0)]


def test_volumes_and_selector(spark):
    doc = {"v": [{"name": "a", "emptyDir": {}}, {"name": "b", "secret": None, "config_map": {"x": 1}},
                 {"name": "c", "csi": {}}], "s": {"node.kubernetes.io/instance-type": "",
                                                  "beta.kubernetes.io/instance-type": "m5"}}
    df = spark.createDataFrame([json.dumps(doc), "{}"], "string").select(
        F.from_json("value", "v array<map<string,string>>, s map<string,string>").alias("r")
    )
    got = df.select(specs.volume_types(F.col("r.v")), specs.node_type(F.col("r.s"))).collect()
    assert [tuple(r) for r in got] == [(["emptyDir", "configMap", "other"], "m5"), ([], None)]


def test_gpu_count(spark):
    doc = [{"nvidia.com/gpu": "2", "cpu": "1"}, {"amd.com/gpu": "1.9", "x-gpu": "many", "GPU": "5"}]
    df = spark.createDataFrame([json.dumps(doc), "[]"], "string").select(
        F.from_json("value", "array<map<string,string>>").alias("r")
    )
    assert [r[0] for r in df.select(specs.gpu_count(F.col("r"))).collect()] == [3, 0]


def test_validation_defaults(spark):
    good = {"namespace": "n", "workload_kind": "Deployment", "workload_name": "w",
            "containers": [{"name": "c", "image": "nginx", "req_cpu_mcpu": 100}]}
    rows = [good, {**good, "containers": None}, {**good, "namespace": None},
            {**good, "containers": [{"image": "x"}]}]
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(
        F.from_json("value", REQUEST_DDL).alias("r")
    ).select("r.*")
    got = validate(df).collect()
    assert [r["reject_reason"] for r in got] == [
        None, "missing field: containers", "missing field: namespace", "container without name or image"]
    first = got[0]
    assert (first["schema_version"], first["labels"], first["volume_types"], first["gpu_count"]) == ("v1", {}, [], 0)


def test_vectors(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 2.0], [2.0, 1.0]), (1, [0.0, 0.0], [1.0, 1.0]), (2, [1.0, 0.0], [-3.0, 0.0])],
        "i int, a array<double>, b array<double>")
    got = run(df, vectors.cosine_distance(F.col("a"), F.col("b")))
    assert got == pytest.approx([0.2, 1.0, 2.0])
    assert run(df, vectors.norm(vectors.normalise(F.col("a")))) == pytest.approx([1.0, 0.0, 1.0])
    cats = column(spark, ["a", "zz", None, "NA"])
    assert run(cats, vectors.one_hot(F.col("v"), ["NA", "a"])) == [[0, 1], [0, 0], [1, 0], [1, 0]]
    assert run(cats, vectors.one_hot(F.col("v"), [])) == [[], [], [], []]
    nums = column(spark, [1.0, 3.0, None], "double")
    assert run(nums, vectors.standardise(F.col("v"), 2.0, 0.0)) == [-1.0, 1.0, -2.0]
    assert run(nums, vectors.standardise(F.col("v"), 2.0, 4.0)) == [-0.25, 0.25, -0.5]


def test_hashed_text(spark):
    df = column(spark, ["a b a", "", None, "Grüße, grüße!"])
    out = vectors.hashed_text(df, "v", "t", 16)
    vecs = [r["t"] for r in out.orderBy("i").collect()]
    assert all(len(v) == 16 for v in vecs)
    assert sorted(v for v in vecs[0] if v) == pytest.approx(sorted([2 / math.sqrt(5), 1 / math.sqrt(5)]))
    assert vecs[1] == vecs[2] == [0.0] * 16
    assert sorted(vecs[3])[-1] == pytest.approx(1.0)


def test_model_text(spark):
    def load():
        return lambda texts: [[len(t), 0.0] for t in texts]

    out = vectors.model_text(column(spark, ["abc", None]), "v", "t", load, 2)
    assert [r["t"] for r in out.orderBy("i").collect()] == [[1.0, 0.0], [1.0, 0.0]]
