"""Small facts of the operators, and the filter compiler against an interpreter of the same algebra."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.functions.filters import compile_filter, matches
from quern.operators import blocks as B
from quern.operators import evidence as E
from quern.operators import folds as O
from quern.operators import graph
from quern.operators import lexical as L
from quern.operators import search as S
from quern.plans import planner as P
from quern.sources import store


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances(spark):
    assert one(spark, V.l2(vec(1, 2, 3), vec(4, 6, 3))) == 5
    assert one(spark, V.dot(vec(1, 2, 3), vec(4, 5, 6))) == 32
    assert one(spark, V.cosine(vec(1, 0), vec(0, 1))) == 0
    assert one(spark, V.cosine(vec(2, 0), vec(5, 0))) == 1
    assert one(spark, V.cosine(vec(0, 0), vec(1, 1))) == 0
    assert one(spark, V.l2(vec(1), vec(1, 2))) == math.inf
    assert one(spark, V.dot(vec(1), vec(1, 2))) == 0


def test_terms_and_sentences(spark):
    assert one(spark, T.terms(F.lit("Hello, World! An Index: 123."))) == ["hello", "world", "an", "index", "123"]
    assert one(spark, T.sentences(F.lit("One. Two?  Three! "))) == ["One", "Two", "Three"]
    assert one(spark, T.content_words(F.lit("The cat is on a mat"))) == ["cat", "mat"]
    assert one(spark, T.memory_words(F.lit("The (Sun) is hot, 42!"))) == ["sun", "hot"]


def test_bm25_ranks_the_document_with_both_terms(spark):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "a lazy dog sleeps, dog"), (3, "quick lazy river")], "doc_id int, text string")
    got = L.bm25(docs, spark.createDataFrame([(1, "lazy dog")], "qid int, query string"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 3]
    assert L.bm25(docs.where("false"), spark.createDataFrame([(1, "x")], "qid int, query string"), 2).count() == 0


def test_batch_topk_equals_topk(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    q = rows.where("vec_id = 7").select(F.lit(7).cast("long").alias("qid"), F.col("embedding").alias("q"))
    batch = [(r.vec_id, round(r.score, 9)) for r in S.batch_topk(rows, q, 9).orderBy("rank").collect()]
    assert batch == [(r.vec_id, round(r.score, 9)) for r in S.topk(rows, q, 9).collect()]


def test_probes():
    assert [S.n_probes(20, p) for p in ("low_latency", "balanced", "high_recall")] == [1, 3, 7]
    assert S.n_probes(1) == 1


def test_folds(spark):
    xs = [10.0, 20.0, 30.0, 5.0]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, s long, x double")
    want = xs[0]
    for x in xs[1:]:
        want = want * 0.9 + x * 0.1
    assert abs(O.ewma(rows, "k", "s", "x", 0.1).first().ewma - want) < 1e-12
    assert [r.value for r in O.percentiles(rows, "x", (0.5, 0.99)).orderBy("p").collect()] == [20.0, 30.0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.05, -0.15, 0.4, -0.3]), min_size=1, max_size=30))
def test_clamped_walk(spark, deltas):
    rows = spark.createDataFrame([("a", i, d) for i, d in enumerate([0.0, *deltas])], "k string, s long, d double")
    got = O.clamped_walk(rows, "k", "s", F.col("d"), start=F.lit(0.5)).first().value
    x = 0.5
    for d in deltas:
        x = min(1.0, max(0.0, x + d))
    assert abs(got - x) < 1e-9


VALUES = st.one_of(st.integers(-3, 3), st.sampled_from(["a", "b", ""]), st.booleans())
LEAF = st.builds(lambda f, op, v: {f: {op: v}}, st.sampled_from(["x", "y", "n.z"]), st.sampled_from(["$eq", "$ne", "$gt", "$lt", "$gte", "$lte"]), VALUES)
IN = st.builds(lambda f, v: {f: {"$in": v}}, st.sampled_from(["x", "n.z"]), st.lists(VALUES, max_size=3))
FILTER = st.recursive(LEAF | IN, lambda f: st.builds(lambda k, fs: {k: fs}, st.sampled_from(["$and", "$or"]), st.lists(f, max_size=3)) | st.builds(lambda x: {"$not": x}, f), max_leaves=5)
RECORDS = [None, 5, [], {}, {"x": 1}, {"x": "a", "y": True}, {"x": 2.5, "y": "b", "n": {"z": 1}}, {"n": {"z": "a"}}, {"x": None}, {"n": 3, "y": False}]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(FILTER)
def test_filters(spark, condition):
    rows = spark.createDataFrame([(i, None if i == 0 else json.dumps(r)) for i, r in enumerate(RECORDS)], "i int, m string")
    got = {r.i for r in rows.where(compile_filter(condition, F.col("m"))).collect()}
    assert got == {i for i, r in enumerate(RECORDS) if matches(condition, r)}


def test_filter_refuses_odd_paths():
    with pytest.raises(ValueError):
        compile_filter({"a'] or 1": {"$eq": 1}}, F.lit("{}"))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-4, 4), min_size=16, max_size=16))
def test_quantization_and_deltas(spark, x):
    v = F.array(*[F.lit(float(a)) for a in x])
    r = spark.range(1).select(B.int8(v).alias("a"), B.int4(v).alias("b"), B.sparse_2_4(v).alias("s"), B.patched(v, B.delta(v, F.transform(v, lambda e: e + 1), 0.5)).alias("p")).first()
    assert all(abs(a - q * r.a.scale) <= r.a.scale / 2 + 1e-9 for a, q in zip(x, r.a.q, strict=True))
    assert all(abs(a - (q - 8) * r.b.scale) <= r.b.scale / 2 + 1e-9 for a, q in zip(x, r.b.q, strict=True))
    assert r.b.packed == [a * 16 + b for a, b in zip(r.b.q[::2], r.b.q[1::2], strict=True)]
    assert all(sum(e != 0 for e in r.s[i : i + 4]) <= 2 for i in range(0, 16, 4))
    assert all(abs(a + 1 - b) < 1e-9 for a, b in zip(x, r.p, strict=True))


def test_dedup(spark):
    refs = spark.createDataFrame([("m", 1, 0, "h", 8), ("m", 2, 0, "h", 8), ("n", 1, 0, "k", 4)], "model string, layer int, chunk_no int, hash string, bytes long")
    r = B.dedup_stats(refs).first()
    assert (r.unique_chunks, r.refs, r.duplicates, r.bytes_saved, r.bytes_avoided) == (2, 3, 1, 8, 8)


def test_levels_stop_at_cycles(spark):
    g = spark.createDataFrame([("a", []), ("b", ["a"]), ("x", ["y"]), ("y", ["x"]), ("w", ["nowhere"])], "id string, dependencies array<string>")
    assert {r.id: r.level for r in graph.levels(g).collect()} == {"a": 0, "b": 1}


def test_verdicts(spark):
    chunks = spark.createDataFrame([(1, "the engine stores vectors in parquet files")], "c long, t string")
    answers = spark.createDataFrame([(1, "The engine stores vectors."), (2, "Bananas grow quickly."), (3, ""), (4, None)], "k int, a string")
    got = {r.k: r.status for r in E.verify(answers, "a", chunks, "c", "t", "k").collect()}
    assert got == {1: "Pass", 2: "Fail", 3: "Fail", 4: "Fail"}


def test_planner(spark):
    assert P.Cost(1, 1, 1, 1).total() == 6.5
    e = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "i int, v double")
    plan = P.aggregate(e, "avg", "v")
    assert plan.result.first().value == 3.0 and "Aggregate" in plan.explain()
    assert P.range_scan(e, "i", 2).result.count() == 2


def test_log_round_trip(spark, tmp_path):
    ops = spark.createDataFrame([(1, "upsert", "a", [1.0], "{}"), (2, "upsert", "b", [2.0], None), (3, "delete", "a", None, None)], store.RECORD)
    store.append_log(ops, str(tmp_path / "log"))
    (tmp_path / "log" / "part-broken.json").write_text('{"seq": 4, "op": \n')
    good, bad = store.read_log(spark, str(tmp_path / "log"))
    assert [r.id for r in store.replay(good).collect()] == ["b"]
    assert bad.count() == 1
    snapshot = store.replay(good)
    store.save(snapshot, str(tmp_path / "snap"))
    assert store.load(spark, str(tmp_path / "snap")).count() == 1
    assert store.status(snapshot, bad, 1) == "CORRUPT" and store.status(snapshot, bad.where("false"), 1) == "READY"
