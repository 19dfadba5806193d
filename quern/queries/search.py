"""Vector search, clusters and merges over the embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters as K
from ..operators import hnsw as H
from ..operators import search as S
from ..registry import query
from ..session import table

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = "list_dot_product(e.embedding::DOUBLE[], q.q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q, q.q)))"


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _query(e, vec_id=0):
    return e.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {_Q} SELECT vec_id, round(list_distance(e.embedding::DOUBLE[], q.q), 6) AS score FROM embeddings e, q ORDER BY round(list_distance(e.embedding::DOUBLE[], q.q), 9), vec_id LIMIT 10")
def exact_topk_l2(spark, d):
    e = _emb(spark, d)
    return _rounded(S.topk(e, _query(e), 10, V.L2))


@query(f"WITH {_Q} SELECT vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.q), 6) AS score FROM embeddings e, q ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.q), 9) DESC, vec_id LIMIT 10")
def exact_topk_dot(spark, d):
    e = _emb(spark, d)
    return _rounded(S.topk(e, _query(e), 10, V.DOT))


@query(f"WITH {_Q} SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, q ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def exact_topk_cosine(spark, d):
    e = _emb(spark, d)
    return _rounded(S.topk(e, _query(e), 10))


@query(f"WITH {_Q} SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, q WHERE e.label = 5 ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def filtered_topk_cosine(spark, d):
    """The flagship: filter, then score, then a bounded heap."""
    e = _emb(spark, d)
    return _rounded(S.topk(e, _query(e), 10, where=F.col("label") == 5))


_ALL_PAIRS = f"""s AS (SELECT x.vec_id AS qid, e.vec_id, {_COS.replace('q.q', 'x.embedding::DOUBLE[]')} AS score FROM embeddings x, embeddings e WHERE x.vec_id % 50 = 0)"""


@query(f"""WITH {_ALL_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20""")
def batch_knn(spark, d):
    e = _emb(spark, d)
    return _rounded(S.batch_topk(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 20)).select("qid", "vec_id", "score", F.col("rank").cast("long"))


@query(f"""WITH {_ALL_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE qid <> vec_id)
SELECT qid AS src, vec_id AS dst, rank FROM r WHERE rank <= 16""")
def knn_graph_edges(spark, d):
    e = _emb(spark, d)
    return S.knn_graph(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 16).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, q WHERE {_COS} >= 0.3 ORDER BY vec_id LIMIT 1")
def semantic_cache_lookup(spark, d):
    """The first inserted row that is near enough, by order of insertion and not the best."""
    e = _emb(spark, d)
    return _rounded(S.first_hit(e, _query(e, 7), 0.3))


_CENTS = """p AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM p GROUP BY label)"""


@query(f"WITH {_CENTS} SELECT label, i - 1 AS pos, round(m / sqrt((SELECT sum(m * m) FROM p p2 WHERE p2.label = p.label)), 6) AS x FROM p")
def mean_pool_normalize(spark, d):
    """The mean vector of each label at unit length, a row for each position."""
    c = S.centroids(_emb(spark, d))
    return c.select("label", F.posexplode(V.normalized(F.col("centroid"))).alias("pos", "x")).select("label", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


@query(f"WITH {_CENTS} SELECT label, i - 1 AS pos, round(m, 6) AS x FROM p")
def ivf_centroid_update(spark, d):
    return S.centroids(_emb(spark, d)).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


@query(f"""WITH {_CENTS}, a AS (SELECT e.vec_id, c.label AS cid, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.centroid), 9), c.label) AS r FROM embeddings e, c)
SELECT vec_id, cid FROM a WHERE r = 1""")
def ivf_assign(spark, d):
    e = _emb(spark, d)
    return S.assign(e, S.centroids(e).withColumnRenamed("label", "cid"))


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT count(*) AS n_buckets, round(greatest(0.0, 1 - stddev_pop(n) / avg(n)), 6) AS health, round(max(n) / avg(n), 6) AS imbalance FROM s""")
def ivf_health(spark, d):
    return S.bucket_health(_emb(spark, d)).select("n_buckets", F.round("health", 6).alias("health"), F.round("imbalance", 6).alias("imbalance"))


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(n / (SELECT avg(n) FROM s), 6) AS ratio FROM s""")
def ivf_imbalance(spark, d):
    """Each bucket's size against the mean size."""
    s = _emb(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return s.join(F.broadcast(s.agg(F.avg("n").alias("m")))).select("label", "n", F.round(F.col("n") / F.col("m"), 6).alias("ratio"))


@query(f"""WITH {_CENTS}, s AS (SELECT c.label, any_value(c.centroid) AS centroid, avg(list_distance(e.embedding::DOUBLE[], c.centroid)) AS s FROM embeddings e JOIN c USING (label) GROUP BY c.label),
r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.centroid, b.centroid)) AS r FROM s a, s b WHERE a.label <> b.label AND list_distance(a.centroid, b.centroid) > 1e-5 GROUP BY a.label)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def ivf_davies_bouldin(spark, d):
    e = _emb(spark, d)
    return S.davies_bouldin(e, S.centroids(e)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("""WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT 50),
m AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.x, b.x)) AS d FROM p a, p b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
v AS (SELECT vec_id, max(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM v""")
def ivf_silhouette(spark, d):
    """A sampled measure by definition: of the 50 lowest ids."""
    return S.silhouette(_emb(spark, d)).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"""WITH {_Q}, {_CENTS}, b AS (SELECT label FROM c, q ORDER BY round(list_distance(c.centroid, q.q), 9), label LIMIT (SELECT greatest(1, round(count(*) * 0.15))::BIGINT FROM c))
SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, q WHERE e.label IN (SELECT label FROM b) ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10""")
def ivf_probe_search(spark, d):
    e = _emb(spark, d)
    return _rounded(S.probe_topk(e, S.centroids(e), _query(e), 10))


@query()
def ivf_recall(spark, d):
    """recall at 5 of probed against exact search, over the stated queries (ids divisible by 50)."""
    e = _emb(spark, d)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    cents = S.centroids(e)
    n = S.n_probes(cents.count(), "high_recall")
    near = q.join(F.broadcast(cents)).select("qid", "q", "label", F.round(V.l2(F.col("q"), F.col("centroid")), 9).alias("d"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "label"))).where(F.col("r") <= n).select("qid", "q", "label")
    scored = e.join(F.broadcast(near), "label").select("qid", "vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("score"))
    probed = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "vec_id"))).where("rank <= 5").select("qid", "vec_id", F.lit(1).alias("hit"))
    exact = S.batch_topk(e, q, 5).select("qid", "vec_id")
    return exact.join(probed, ["qid", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), F.countDistinct("qid").alias("queries"))


@query()
def kmeans_clusters(spark, d):
    """Sizes of ten clusters: seeds by squared distances, then steps until no centroid moves."""
    e = _emb(spark, d)
    return S.assign(e, K.kmeans(e.select("vec_id", "embedding"), 10)).groupBy(F.col("cid").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def lsh_topk(spark, d):
    """Approximate neighbours of the stated query by random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    e = _emb(spark, d).select("vec_id", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=8, seed=42).fit(e)
    q = e.where("vec_id = 0").first().features
    return model.approxNearestNeighbors(e, q, 10, distCol="distance").select("vec_id", F.round("distance", 6).alias("distance"))


# Merges of branches: the branches are the searches of vectors 0 and 1.


def _branches(spark, d, k=20):
    e = _emb(spark, d)
    q = e.where("vec_id IN (0, 1)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return S.batch_topk(e, q, k).select(F.col("qid").alias("branch"), "vec_id", "score", "rank")


_BRANCH = f"""s AS (SELECT x.vec_id AS branch, e.vec_id, {_COS.replace('q.q', 'x.embedding::DOUBLE[]')} AS score FROM embeddings x, embeddings e WHERE x.vec_id IN (0, 1)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 20)"""


@query(f"WITH {_BRANCH} SELECT vec_id, round(max(score), 6) AS score FROM b GROUP BY vec_id")
def merge_union(spark, d):
    return _rounded(_branches(spark, d).groupBy("vec_id").agg(F.max("score").alias("score")))


@query(f"WITH {_BRANCH} SELECT vec_id FROM b GROUP BY vec_id HAVING count(DISTINCT branch) = 2")
def merge_intersection(spark, d):
    return _branches(spark, d).groupBy("vec_id").agg(F.countDistinct("branch").alias("n")).where("n = 2").select("vec_id")


@query(f"WITH {_BRANCH}, m AS (SELECT vec_id, max(score) AS score FROM b GROUP BY vec_id) SELECT vec_id, round(score, 6) AS score FROM m ORDER BY round(m.score, 9) DESC, vec_id LIMIT 10")
def merge_topk(spark, d):
    best = _branches(spark, d).groupBy("vec_id").agg(F.max("score").alias("score"))
    return _rounded(best.orderBy(F.round("score", 9).desc(), "vec_id").limit(10))


@query(f"WITH {_BRANCH}, r AS (SELECT vec_id, rank, branch, row_number() OVER (PARTITION BY vec_id ORDER BY rank, branch) AS k FROM b) SELECT vec_id, row_number() OVER (ORDER BY rank, branch) AS position FROM r WHERE k = 1")
def merge_round_robin(spark, d):
    """Alternates between the branches; a row keeps its first place. The lists are k rows a branch, so one task orders them."""
    first = Window.partitionBy("vec_id").orderBy("rank", "branch")
    b = _branches(spark, d).withColumn("k", F.row_number().over(first)).where("k = 1")
    return b.select("vec_id", F.row_number().over(Window.orderBy("rank", "branch")).cast("long").alias("position"))


@query("SELECT vec_id % 8 AS part, count(*) AS n, min(vec_id) AS low, max(vec_id) AS high FROM embeddings GROUP BY 1")
def hash_split(spark, d):
    return _emb(spark, d).groupBy(F.pmod("vec_id", F.lit(8)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (i / 64.0)::DOUBLE)), 6) AS y FROM embeddings")
def dense_matvec(spark, d):
    """Each embedding times a fixed vector."""
    w = F.array(*[F.lit((i + 1) / 64.0) for i in range(64)])
    return _emb(spark, d).select("vec_id", F.round(V.dot(F.col("embedding"), w), 6).alias("y"))


@query(f"WITH {_ALL_PAIRS} SELECT qid, count(*) AS n, round(min(score), 6) AS low, round(avg(score), 6) AS mean FROM s GROUP BY qid")
def shadow_scan_cosine(spark, d):
    """Cosines of the stated queries with every row, summed up."""
    e = _emb(spark, d)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return S.scan_stats(e, q).select("qid", "n", F.round("low", 6).alias("low"), F.round("mean", 6).alias("mean"))


# Indexes that are built here.


def _index_rows(spark, d):
    return _emb(spark, d).select("vec_id", "embedding")


@query()
def ivf_built_search(spark, d):
    """Of an IVF index built here (10 clusters, 2 probed): the ten nearest of vectors 0 and 7 by L2."""
    e = _index_rows(spark, d)
    index = K.ivf(e, 10)
    found = [K.ivf_topk(index, _query(e, i), 10).select(F.lit(i).cast("long").alias("qid"), "vec_id", F.round("distance", 6).alias("distance")) for i in (0, 7)]
    return found[0].union(found[1])


@query()
def hnsw_topk(spark, d):
    """Of an HNSW index built here: the ten nearest by L2 of the stated queries (ids divisible by 50)."""
    e = _index_rows(spark, d)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return H.topk(H.build(e), q, 10).select("qid", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT count(*) AS nodes, 1.0::DOUBLE AS links_in_place FROM embeddings")
def hnsw_graph(spark, d):
    """Nodes of the built graph, and the share of them whose links are within bounds, to nodes of their own layer and part."""
    g = H.build(_index_rows(spark, d)).nodes
    links = g.select("part", "vec_id", F.posexplode("links").alias("level", "to"))
    there = links.select("part", "level", F.col("vec_id").alias("x")).alias("there")
    bad = links.where(F.size("to") > F.when(F.col("level") == 0, 2 * H.LINKS).otherwise(H.LINKS)).select("part", "vec_id")
    lost = links.select("part", "level", "vec_id", F.explode("to").alias("x")).join(there, ["part", "level", "x"], "left_anti").select("part", "vec_id")
    odd = bad.union(lost).distinct().agg(F.count(F.lit(1)).alias("odd"))
    return g.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(odd)).select("nodes", (1 - F.col("odd") / F.col("nodes")).alias("links_in_place"))


@query("""WITH b AS (SELECT vec_id AS pos, embedding AS v, 'answer ' || vec_id AS completion FROM embeddings WHERE vec_id < 100), c AS (SELECT vec_id AS pos, embedding AS v, 'again ' || vec_id AS completion FROM embeddings WHERE vec_id % 7 = 0 AND vec_id < 50)
SELECT pos, completion FROM (SELECT * FROM b UNION ALL SELECT pos + 1000, v, completion FROM c)""")
def semantic_cache_insert(spark, d):
    """A semantic cache that items are appended to, likeness or not."""
    e = _emb(spark, d)
    one = e.where("vec_id < 100").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"), F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("completion"))
    two = e.where("vec_id % 7 = 0 AND vec_id < 50").select((F.col("vec_id") + 1000).alias("pos"), F.col("embedding").alias("v"), F.concat(F.lit("again "), F.col("vec_id").cast("string")).alias("completion"))
    return S.cache_insert(S.cache_insert(S.cache_clear(two), one), two).select("pos", "completion")
