"""Folds, orders, searches, indexes, tiers and goals against plain versions in memory; the queries that SQL can't express among them."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from quern.functions import text as T
from quern.operators import blocks as B
from quern.operators import clusters as K
from quern.operators import evidence as E
from quern.operators import factor
from quern.operators import folds as O
from quern.operators import graph as G
from quern.operators import hnsw as H
from quern.operators import order
from quern.operators import search as S
from quern.operators import tiers
from quern.plans import defaults, extensions
from quern.registry import all_queries
from quern.sources import store
from quern.streaming import telemetry


def small(spark, name):
    return spark.read.parquet(f"{oracle.SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = small(spark, "embeddings").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)


# ---- folds


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_folds_over_ranges_and_batches(spark, batch):
    """Keys that go over many ranges and batches, a null key, keys of one event."""
    r = random.Random(3)
    events = [(r.choice([None, "a", "a", "a", "b", f"c{i % 40}"]), i, r.uniform(-1, 1)) for i in range(600)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, batch)
    try:
        df = spark.createDataFrame(events, "k string, s long, x double").repartition(5)
        got = {x.k: x.ewma for x in O.ewma(df, "k", "s", "x", 0.3).collect()}
        walk = {x.k: x.value for x in O.clamped_walk(df, "k", "s", F.col("x"), start=F.col("x") + 0.5).collect()}
    finally:
        spark.conf.set(conf, before)
    by = defaultdict(list)
    for k, _, x in events:
        by[k].append(x)
    for k, xs in by.items():
        mean, at = xs[0], xs[0] + 0.5
        for x in xs[1:]:
            mean, at = mean * 0.7 + x * 0.3, min(1.0, max(0.0, at + x))
        assert abs(got[k] - mean) < 1e-9 and abs(walk[k] - at) < 1e-9
    assert set(got) == set(by) and O.ewma(df.where("false"), "k", "s", "x", 0.3).count() == 0


@pytest.mark.parametrize("most", [7, 100, 100_000])
def test_percentiles_by_brackets(spark, monkeypatch, most):
    monkeypatch.setattr(O, "MOST_SORTED", most)
    r = random.Random(most)
    xs = [r.choice([1.0, 2.0, 2.0, r.gauss(0, 5), r.gauss(0, 5)]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    shares = (0.0, 0.01, 0.5, 0.95, 0.999)
    got = {x.p: x.value for x in O.percentiles(df, "x", shares).collect()}
    assert got == {p: sorted(xs)[int(len(xs) * p)] for p in shares}
    assert O.percentiles(df.where("false"), "x", shares).count() == 0


def test_streamed_fold_is_the_fold(spark):
    events = [("a" if i % 3 else "b", i, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(events, "k string, s long, x double")
    state = None
    for low in (0, 20, 40):
        state = telemetry.fold_ewma(df.where(f"s >= {low} and s < {low + 20}"), state, "k", "s", "x")
    want = {r.k: r.ewma for r in O.ewma(df, "k", "s", "x", telemetry.ALPHA).collect()}
    got = {r.k: r for r in state.collect()}
    assert set(got) == set(want) and all(abs(got[k].ewma - v) < 1e-12 for k, v in want.items()) and {k: r.n for k, r in got.items()} == {"a": 40, "b": 20}


# ---- orders


def test_lagged_and_numbered(spark, monkeypatch):
    monkeypatch.setattr(order, "CUTS", 7)
    r = random.Random(1)
    ids = r.sample(range(10_000), 500)
    rows = [(r.choice([None, "a", "b", "b"]), i, f"v{i}") for i in ids]
    df = spark.createDataFrame(rows, "k string, s long, x string").repartition(4)
    got = {x.s: x.p for x in order.lagged(df, "k", "s", "x", "p").collect()}
    want, last = {}, {}
    for k, s, x in sorted(rows, key=lambda t: t[1]):
        want[s] = last.get(k)
        last[k] = x
    assert got == want
    assert {x.s: x.n for x in order.numbered(df, "s", "n").collect()} == {s: i for i, s in enumerate(sorted(ids))}
    assert order.lagged(df.where("false"), "k", "s", "x", "p").count() == 0


# ---- words in common


def test_pairs_by_rare_words(spark):
    r = random.Random(2)
    common = [f"w{i}" for i in range(12)]
    sets = lambda n: [(i, r.sample(common, r.randint(0, 6)) + [f"x{r.randint(0, 60)}" for _ in range(r.randint(0, 4))]) for i in range(n)]
    one, two = sets(60), sets(80)
    a = spark.createDataFrame(one, "a long, aw array<string>").withColumn("aw", F.array_distinct("aw"))
    b = spark.createDataFrame(two, "b long, bw array<string>").withColumn("bw", F.array_distinct("bw"))
    for share in (0.3, 0.4, 1.0):
        got = {(x.a, x.b) for x in E.alike(a, b, share).collect()}
        assert got == {(i, j) for i, v in one for j, w in two if v and w and len(set(v) & set(w)) / min(len(set(v)), len(set(w))) >= share}
    chunks = spark.createDataFrame([(i, " ".join(w)) for i, w in two], "c long, t string")
    rows = spark.createDataFrame([(1, i, v) for i, v in one], "k long, pos int, ws array<string>")
    got = {(x.pos, x.chunk): x.same for x in E.shared(rows, chunks, "c", "t", T.words, F.ceil(F.size("ws") * 0.5), "k").collect()}
    assert got == {(i, j): n for i, v in one for j, w in two if v and (n := sum(x in w for x in v)) >= math.ceil(len(v) / 2)}


# ---- searches


def test_batch_search_in_blocks(spark, vectors, monkeypatch):
    ids, x = vectors
    e = small(spark, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    key = lambda df: sorted((r.qid, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    at_once, stats = key(S.batch_topk(e, q, 4, exclude_self=True)), sorted(map(tuple, S.scan_stats(e, q).select("qid", "n", F.round("low", 9), F.round("mean", 9)).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    assert key(S.batch_topk(e, q, 4, exclude_self=True)) == at_once
    assert sorted(map(tuple, S.scan_stats(e, q).select("qid", "n", F.round("low", 9), F.round("mean", 9)).collect())) == stats
    assert S.batch_topk(e, q.where("false"), 4).count() == 0 and S.batch_topk(e.where("false"), q, 4).count() == 0


def test_assign_in_parts(spark, monkeypatch):
    e = small(spark, "embeddings")
    cents = S.centroids(e).withColumnRenamed("label", "cid")
    key = lambda: sorted(map(tuple, S.assign(e, cents).collect()))
    at_once = key()
    monkeypatch.setattr(S, "MOST_CENTROID_NUMBERS", 200)
    assert key() == at_once


def test_ivf_recall(spark, vectors):
    ids, x = vectors
    label = np.array([r.label for r in small(spark, "embeddings").orderBy("vec_id").collect()])
    names = sorted(set(label))
    cents = np.array([x[label == c].mean(0) for c in names])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    probes = S.n_probes(len(names), "high_recall")
    hits = total = 0
    for i in (i for i, v in enumerate(ids) if v % 50 == 0):
        score = np.round(unit @ unit[i], 9)
        exact = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))[:5]
        near = sorted(range(len(names)), key=lambda c: (round(float(np.linalg.norm(cents[c] - x[i])), 9), names[c]))[:probes]
        probed = sorted((j for j in range(len(ids)) if label[j] in [names[c] for c in near]), key=lambda j: (-score[j], ids[j]))[:5]
        hits, total = hits + len(set(exact) & set(probed)), total + 5
    got = all_queries()["ivf_recall"](spark, oracle.SMALL).first()
    assert abs(got.recall - hits / total) < 1e-6 and got.queries * 5 == total


def test_lsh_finds_near_rows(spark, vectors):
    ids, x = vectors
    got = all_queries()["lsh_topk"](spark, oracle.SMALL).collect()
    d = np.linalg.norm(x - x[ids.index(0)], axis=1)
    assert len(got) == 10 and all(abs(r.distance - d[ids.index(r.vec_id)]) < 1e-5 for r in got)
    assert sum(r.distance <= sorted(d)[9] + 1e-5 for r in got) >= 9


# ---- clusters


def _lloyd(x, cents):
    for _ in range(K.STEPS):
        near = ((x[:, None] - cents[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) for c in range(len(cents))])
        moved = np.linalg.norm(new - cents, axis=1).max()
        cents = new
        if moved <= K.TOLERANCE:
            break
    return cents


def test_kmeans(spark, vectors):
    ids, x = vectors
    e = small(spark, "embeddings")
    points = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    seeds = np.array(K.seeds(points, 10))
    assert len({tuple(s) for s in seeds}) == 10 and all((np.abs(x - s).max(1) < 1e-12).any() for s in seeds)
    got = np.array([r.centroid for r in K.kmeans(e.repartition(3), 10).orderBy("cid").collect()])
    assert np.allclose(got, _lloyd(x, seeds), atol=1e-6)
    sizes = Counter(((x[:, None] - got[None]) ** 2).sum(2).argmin(1).tolist())
    assert {r.cluster: r.n for r in all_queries()["kmeans_clusters"](spark, oracle.SMALL).collect()} == dict(sizes)


def test_kmeans_of_few_points(spark):
    four = [(1, [1.0, 1.0]), (2, [1.2, 0.8]), (3, [10.0, 10.0]), (4, [9.8, 10.2])]
    df = spark.createDataFrame(four, "vec_id long, embedding array<double>")
    got = sorted(r.centroid for r in K.kmeans(df, 2).collect())
    assert np.allclose(got, [[1.1, 0.9], [9.9, 10.1]])
    assert sorted(r.centroid for r in K.kmeans(df, 4).collect()) == sorted(v for _, v in four) and K.kmeans(df.where("false"), 3).count() == 0 and K.kmeans(df, 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert all(r.centroid == [1.0, 2.0] for r in K.kmeans(same, 3).collect())


def test_seeds_are_drawn_by_squared_distance(spark):
    """Two far groups: the second seed lies in the other one nearly always."""
    rows = [(i, [0.0 + i * 1e-3, 0.0]) for i in range(50)] + [(100 + i, [100.0, i * 1e-3]) for i in range(50)]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = K.seeds(points, 2)
    assert (a[0] < 50) != (b[0] < 50)


def test_ivf_index(spark, vectors, tmp_path):
    ids, x = vectors
    e = small(spark, "embeddings").select("vec_id", "embedding")
    index = K.ivf(e, 10)
    assert index.status() == "READY" and index.rows.count() == len(ids)
    K.save_ivf(index, str(tmp_path / "ivf"))
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    found = [(r.vec_id, round(r.distance, 6)) for r in K.ivf_topk(K.load_ivf(spark, str(tmp_path / "ivf")), q, 10).collect()]
    assert found == [(r.vec_id, round(r.distance, 6)) for r in K.ivf_topk(index, q, 10).collect()] and found[0] == (7, 0.0)
    every = [r.vec_id for r in K.ivf_topk(index, q, 10, n_probe=10).collect()]
    d = np.linalg.norm(x - x[ids.index(7)], axis=1)
    assert every == [ids[i] for i in sorted(range(len(ids)), key=lambda i: (round(float(d[i]), 9), ids[i]))[:10]]
    assert K.ivf(e.where("false")).status() == "READY" and K.Ivf(index.centroids.where("false"), index.rows, "vec_id", "embedding").status() == "CORRUPT"


def test_ivf_built_search(spark, vectors):
    ids, x = vectors
    e = small(spark, "embeddings").select("vec_id", "embedding")
    cents = np.array([r.centroid for r in K.kmeans(e, 10).orderBy("cid").collect()])
    near = ((x[:, None] - cents[None]) ** 2).sum(2).argmin(1)
    want = []
    for qid in (0, 7):
        q = x[ids.index(qid)]
        probed = np.linalg.norm(cents - q, axis=1).argsort()[:2]
        d = np.linalg.norm(x - q, axis=1)
        want += [(qid, ids[i]) for i in sorted((i for i in range(len(ids)) if near[i] in probed), key=lambda i: (round(float(d[i]), 9), ids[i]))[:10]]
    assert sorted((r.qid, r.vec_id) for r in all_queries()["ivf_built_search"](spark, oracle.SMALL).collect()) == sorted(want)


# ---- graphs


def test_hnsw_of_a_line(spark):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(4)]) for i in range(20)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [5.1, 5.9, 7.0, 8.1])], "qid long, q array<double>")
    index = H.build(df)
    assert H.topk(index, q, 1).first().vec_id == 5
    only = spark.createDataFrame([(9,), (11,)], "vec_id long")
    assert [r.vec_id for r in H.topk(index, q, 5, allowed=only).orderBy("rank").collect()] == [9, 11]
    assert H.build(df.where("false")).nodes.count() == 0 and H.topk(H.build(df.where("false")), q, 3).count() == 0
    assert H.topk(index, q.where("false"), 3).count() == 0


@pytest.mark.parametrize("part", [5000, 150])
def test_hnsw_recall(spark, vectors, part, monkeypatch):
    monkeypatch.setattr(H, "PART", part)
    ids, x = vectors
    got = defaultdict(list)
    for r in all_queries()["hnsw_topk"](spark, oracle.SMALL).collect():
        got[r.qid].append((r["rank"], r.vec_id, r.distance))
    hits = 0
    for qid, found in got.items():
        d = np.linalg.norm(x - x[ids.index(qid)], axis=1)
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11)) and all(abs(f - d[ids.index(v)]) < 1e-5 for _, v, f in found)
        hits += sum(f <= sorted(d)[9] + 1e-5 for _, _, f in found)
    assert len(got) == sum(v % 50 == 0 for v in ids) and hits / (10 * len(got)) >= 0.95


def test_hnsw_again_is_the_same(spark, tmp_path):
    e = small(spark, "embeddings").select("vec_id", "embedding").where("vec_id < 200")
    key = lambda index: sorted((r.part, r.vec_id, str(r.links), r.entry) for r in index.nodes.collect())
    index = H.build(e)
    H.save(index, str(tmp_path / "hnsw"))
    assert key(index) == key(H.build(e.repartition(4))) == key(H.load(spark, str(tmp_path / "hnsw"))) and H.load(spark, str(tmp_path / "hnsw")).parts == 1


def test_levels_of_graphs(spark):
    """About one node in LINKS goes up a layer."""
    level = [len(r.links) for r in H.build(spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding")), beam=8).nodes.select("links").collect()]
    assert 100 < sum(x > 1 for x in level) < 300 and max(level) >= 3


# ---- tiers


def test_tiers():
    d = tiers.Device(tiers.Limits(hot=100, warm=300, promote=2, idle=10))
    assert d.register("a", 60, "hot", 0) and not d.register("b", 60, "hot", 0) and d.register("b", 60, "warm", 0)
    assert not d.register("big", 400, "warm", 0) and d.register("big", 400, "cold", 0)
    assert d.access("b", 1) and d.where("b") == "warm" and d.access("b", 2) and d.where("b") == "hot"
    assert d.where("a") == "warm" and (d.promotions, d.evictions) == (1, 1) and d.used == {"hot": 60, "warm": 60, "cold": 400}
    d.demote(10)
    assert d.where("a") == "warm"
    d.demote(11)
    assert d.where("a") == "cold" and d.demotions == 1
    assert not d.access("nothing", 12) and d.missing == 1 and d.access("a", 12) and d.where("a") == "cold"
    assert d.fetch_ahead(["x", "a", "y", "z"]) == ["x"] and d.fetches == 1
    full = tiers.Device(tiers.Limits(hot=100, warm=100))
    for layer, tier in (("h", "hot"), ("w", "warm")):
        full.register(layer, 100, tier, 0)
    full.access("w", 1), full.access("w", 2)
    assert full.where("w") == "hot" and full.where("h") == "warm"


def test_tier_state_machine(spark):
    """Against a plain replay, by lists that are searched each time."""
    from quern.queries.streams import tier_events

    got = all_queries()["tier_state_machine"](spark, oracle.SMALL).collect()
    events = defaultdict(list)
    for e in tier_events(spark, oracle.SMALL).collect():
        events[e.device].append(e)
    for device, es in events.items():
        es.sort(key=lambda e: (e.at, e.kind, -1 if e.layer is None else e.layer))
        layers, refused, moves = {}, set(), Counter()
        used = lambda t: sum(v["size"] for v in layers.values() if v["tier"] == t)  # noqa: B023, E731
        room = lambda t, n: t == "cold" or used(t) + n <= {"hot": 200, "warm": 5000}[t]  # noqa: B023, E731
        for clock, e in enumerate(es):
            if e.kind == "register":
                if room(e.tier, e["size"]):
                    layers[e.layer] = {"tier": e.tier, "size": e["size"], "n": 0, "last": e.at, "clock": clock}
                else:
                    refused.add(e.layer)
            elif e.kind == "demote":
                for v in layers.values():
                    if v["tier"] == "warm" and e.at - v["last"] > 3600:
                        v["tier"] = "cold"
                        moves["demotions"] += 1
            elif e.layer in layers:
                v = layers[e.layer]
                moves["hits"] += 1
                v["n"], v["last"], v["clock"] = v["n"] + 1, e.at, clock
                if v["tier"] == "warm" and v["n"] >= 2:
                    v["tier"] = "moving"
                    while not room("hot", v["size"]) and any(o["tier"] == "hot" for o in layers.values()):
                        out = min((o for o in layers.values() if o["tier"] == "hot"), key=lambda o: (o["last"], o["clock"]))
                        out["tier"] = "moving"
                        out["tier"] = "warm" if room("warm", out["size"]) else "cold"
                        moves["evictions"] += 1
                    v["tier"] = "hot"
                    moves["promotions"] += 1
        mine = [r for r in got if r.device == device]
        assert {r.layer: (r.tier, r.accesses) for r in mine if r.layer is not None and not r.refused} == {k: (v["tier"], v["n"]) for k, v in layers.items()}
        assert {r.layer for r in mine if r.refused} == refused
        total = next(r for r in mine if r.layer is None)
        assert (total.hits, total.promotions, total.demotions, total.evictions) == tuple(moves[k] for k in ("hits", "promotions", "demotions", "evictions"))
    assert any(r.layer is None and r.promotions for r in got)


# ---- other queries without SQL


def test_greedy_sharding(spark):
    size = Counter(r.c_nationkey for r in small(spark, "customer").collect())
    budget, device, used, want = sum(size.values()) / 4, 0, 0, {}
    for layer in sorted(size):
        if device < 3 and used + size[layer] > budget:
            device, used = device + 1, 0
        used += size[layer]
        want[layer] = device
    assert {r.layer: r.device for r in all_queries()["greedy_sharding"](spark, oracle.SMALL).collect()} == want


def test_prefetch_matrix(spark):
    by = defaultdict(list)
    for r in small(spark, "events").orderBy("event_id").collect():
        by[r.user_id].append(r.event_type)
    want = {}
    for user, steps in by.items():
        rows = defaultdict(lambda: defaultdict(float))
        for a, b in zip(steps, steps[1:], strict=False):
            rows[a][b] = 0.85 * rows[a][b] + 0.15
            total = sum(rows[a].values())
            for k in rows[a]:
                rows[a][k] /= total
        want |= {(user, a, b): round(p, 6) for a, row in rows.items() for b, p in row.items()}
    assert {(r.user_id, r.source, r.target): r.p for r in all_queries()["prefetch_matrix"](spark, oracle.SMALL).collect()} == pytest.approx(want)


def test_stream_jaccard_gate(spark):
    by = defaultdict(list)
    for r in small(spark, "events").select("user_id", F.col("value").cast("string").alias("v")).orderBy("event_id").collect():
        by[str(r.user_id)].append({int(c) for c in r.v if c.isdigit()})
    got = {r.key: r for r in all_queries()["stream_jaccard_gate"](spark, oracle.SMALL).collect()}
    assert set(got) == set(by)
    for k, steps in by.items():
        seen = [len(a & b) / max(1, len(a | b)) for a, b in zip(steps, steps[1:], strict=False)][-500:]
        mean = sum(seen) / len(seen) if seen else 0.0
        assert got[k].n == len(seen) and abs(got[k]["mean"] - mean) < 1e-6 and got[k].passes == (len(seen) >= 20 and mean >= 0.55)


def test_randomized_svd(spark, vectors):
    ids, x = vectors
    s, right, left = factor.randomized_svd(small(spark, "embeddings"), 8)
    u = np.array([r.factor for r in left.orderBy("vec_id").collect()])
    exact = np.linalg.svd(x, compute_uv=False)
    best = (exact[8:] ** 2).sum()
    assert best <= ((x - u @ right) ** 2).sum() <= 1.5 * best and (s <= exact[:8] + 1e-9).all() and (s >= 0.7 * exact[:8]).all()
    assert np.allclose((u**2).sum(0), s) and np.allclose((right**2).sum(1), s)
    got = all_queries()["randomized_svd"](spark, oracle.SMALL).orderBy("rank").collect()
    assert np.allclose([r.value for r in got], s, atol=1e-6) and abs(got[0].error - ((x - u @ right) ** 2).sum()) < 1e-2
    low = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0, float(i % 3)]) for i in range(30)], "vec_id long, embedding array<double>")
    s, right, left = factor.randomized_svd(low, 3)
    u = np.array([r.factor for r in left.orderBy("vec_id").collect()])
    assert np.allclose(u @ right, [[i, 2 * i, 1, i % 3] for i in range(30)], atol=1e-8)


def test_polynomial_shards_of_any_bytes(spark):
    keys = ["", "a", "Customer#000000001", "ünï😀", "z" * 200]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", B.polynomial_shard(F.col("k"), 13).alias("s")).collect()}
    for k in keys:
        h = 0
        for b in k.encode():
            h = (h * 31 + b) % (1 << 64)
        assert got[k] == h % 13


# ---- goals, plans, stores


def test_goal_hops(spark):
    prompts = spark.createDataFrame([(1, "Compare a and b"), (2, "What is it"), (3, "one; two")], "id long, text string")
    known = {1: ["c1", "c2"], 2: [], 3: []}
    held = spark.createDataFrame(list(known.items()), "id long, contexts array<string>")
    got = {r.id: r for r in G.hops(G.tasks(prompts, "text", "id"), lambda asked: asked.join(held, "id"), "id").collect()}
    assert (got[1].hops, got[1].usefulness, got[1].stopped, got[1].pending) == (1, 0.95, True, "subtask_2") and "c1 | c2" in got[1].merged
    assert (got[2].hops, got[2].usefulness, got[2].stopped, got[2].pending) == (1, 0.1, True, None)
    assert (got[3].hops, got[3].stopped, got[3].merged.count("\n")) == (2, True, 2)
    one = {r.id: r for r in G.hops(G.tasks(prompts, "text", "id"), lambda asked: asked.join(held, "id"), "id", most=1).collect()}
    assert (one[3].hops, one[3].stopped, one[3].pending) == (1, False, "subtask_2")


def test_operations_by_name(spark):
    from quern.plans import planner as P

    e = small(spark, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    rows = e.select("vec_id", "embedding", F.to_json(F.struct("label")).alias("meta"))
    exact = P.plan("ExactSearch", rows, query=q, k=5).result.collect()
    assert exact[0].vec_id == 3 and exact == P.plan("VectorSearch", rows, query=q, k=5).result.collect()
    label = e.where("vec_id = 3").first().label
    got = P.plan("FilteredSearch", rows, query=q, k=500, condition={"label": label}, metadata="meta").result.count()
    assert got == e.where(F.col("label") == label).count()
    assert P.plan("RangeScan", e, column="vec_id", low=3, high=7).result.count() == 5
    assert P.plan("FullScan", e, columns=["vec_id"], limit=4).result.columns == ["vec_id"] and P.plan("FullScan", e).result.count() == e.count()
    assert P.plan("Aggregate", e, op="max", column="vec_id").result.first().value == e.agg(F.max("vec_id")).first()[0]
    with pytest.raises(ValueError):
        P.plan("Nothing", e)


def test_defaults_and_extensions():
    assert defaults.index_parameters() == {"clusters": 10, "n_probe": 2} and defaults.index_parameters("hnsw", m=8)["m"] == 8
    assert Counter(c.kind for c in defaults.CATALOGUE) == {"btree": 3, "hash": 4, "composite": 2, "covering": 2}

    class Plain:
        name = "plain"

        def prompt(self, system, user):
            return F.concat(system, F.lit("\n"), user)

    registry = extensions.Registry()
    with pytest.raises(KeyError):
        registry.get("x")
    registry.put(Plain())
    assert isinstance(registry.get("unknown"), extensions.ModelAdapter) and registry.names() == ["plain"]


def test_store_is_found_and_repaired(spark, tmp_path):
    snap, log, new = (str(tmp_path / x) for x in ("snap", "log", "new"))
    store.save(spark.createDataFrame([("a", [1.0, 2.0], "{}"), ("b", [1.0], None)], "id string, values array<double>, metadata string"), snap)
    rows, status = store.bootstrap(spark, snap, log, 2)
    assert rows.count() == 2 and status == "CORRUPT"
    store.append_log(spark.createDataFrame([(1, "upsert", "c", [3.0, 4.0], "{}"), (2, "delete", "a", None, None)], store.RECORD), log)
    rows, status = store.bootstrap(spark, snap, log, 2)
    assert {r.id for r in rows.collect()} == {"b", "c"} and status == "CORRUPT"
    rows, status = store.repair(spark, snap, log, new, 2)
    assert [r.id for r in rows.collect()] == ["c"] and status == "READY"


def test_audit(spark, tmp_path):
    import hashlib

    for name, data in (("a", b"one"), ("b", b"two"), ("c", b"")):
        (tmp_path / name).write_bytes(data)
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()}
    paths["c"] = paths["a"][:-1] + "c"  # an empty file isn't even listed
    noted = [(paths["a"], hashlib.sha256(b"one").hexdigest()), (paths["b"], hashlib.sha256(b"other").hexdigest()), (paths["c"], hashlib.sha256(b"").hexdigest()), ("file:/nowhere", "0")]
    got = {r.path: r.ok for r in store.audit(spark, str(tmp_path), spark.createDataFrame(noted, "path string, sha256 string")).collect()}
    assert got == {paths["a"]: True, paths["b"]: False, paths["c"]: False, "file:/nowhere": False}
