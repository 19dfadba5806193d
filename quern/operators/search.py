"""Nearest neighbours: exact, filtered, batched, and over buckets; and the checks of an index's shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Share of buckets probed by profile.
PROBE_SHARE = {"low_latency": 0.05, "balanced": 0.15, "high_recall": 0.35}
#: Query vectors of a block: what a task holds of them; rows that are multiplied with them at once.
QUERY_BLOCK, ROWS = 2048, 1024
#: Numbers (of 8 bytes) up to which a block of centroids goes to every task.
MOST_CENTROID_NUMBERS = 4_000_000


def topk(rows: DataFrame, query: DataFrame, k: int, metric: str = V.COSINE, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """id, score of the k rows nearest to a query of one row (column q); where is applied before anything is scored. Ties: by id."""
    if where is not None:
        rows = rows.where(where)
    scored = rows.select(F.col(id_col), F.col(vec_col)).join(F.broadcast(query.select("q").limit(1))).select(id_col, V.metric(metric, F.col(vec_col), F.col("q")).alias("score"))
    return scored.orderBy(V.best_first(metric, F.col("score")), id_col).limit(k)


class _Best:
    """For each query the k rows of largest cosine among those seen; ties to nine digits go to the smaller id."""

    schema = "score double"

    def __init__(self, k: int, exclude_self: bool, qid: np.ndarray):
        self.k, self.exclude_self, self.qid = k, exclude_self, qid
        self.id, self.score = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        if self.exclude_self:
            score = np.where(self.qid[:, None] == ids[None, :], -np.inf, score)
        id_, all_ = np.concatenate([self.id, np.broadcast_to(ids, score.shape)], 1), np.concatenate([self.score, score], 1)
        order = np.lexsort((id_, -np.round(all_, 9)), axis=1)[:, : self.k]
        self.id, self.score = np.take_along_axis(id_, order, 1), np.take_along_axis(all_, order, 1)

    def result(self) -> list[np.ndarray]:
        there = np.isfinite(self.score.ravel())
        return [np.repeat(self.qid, self.id.shape[1])[there], self.id.ravel()[there], self.score.ravel()[there]]


class _Sums:
    """For each query how many rows it has seen, and the sum and least of their cosines."""

    def __init__(self, qid: np.ndarray):
        self.qid, self.n, self.sum, self.low = qid, 0, np.zeros(len(qid)), np.full(len(qid), np.inf)

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        self.n += len(ids)
        self.sum += score.sum(1)
        self.low = np.minimum(self.low, score.min(1))

    def result(self) -> list[np.ndarray]:
        return [self.qid, np.full(len(self.qid), self.n), self.sum, self.low] if self.n else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64) if vectors else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _folded(rows: DataFrame, queries: DataFrame, make, schema: str, id_col: str, vec_col: str) -> DataFrame:
    """What fold objects make(qid) give that are shown, for each block of queries, every row's id and cosines with the block.

    Up to QUERY_BLOCK queries go to every task, and rows stay where they are. More are cut into blocks by a hash, rows into
    as many as keep the cluster at work, and each pair of blocks is a group of one shuffle, in which the queries come first
    and the rows stream by.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def seen(fold, unit, ids, vectors):
        for i in range(0, len(ids), ROWS):
            fold.add(ids[i : i + ROWS], unit @ _unit(vectors[i : i + ROWS]).T)

    def out(fold):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in fold.result()], names=names)

    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    asked = queries.select(F.col("qid").cast("long").alias("id"), F.col("q").cast("array<double>").alias("vec"))
    n = asked.count()
    if n <= QUERY_BLOCK:
        held = asked.toArrow()
        qid, unit = held.column("id").to_numpy(), _unit(held.column("vec").to_pylist())

        def local(batches):
            fold = make(qid)
            for batch in batches:
                if batch.num_rows and len(qid):
                    seen(fold, unit, batch.column("id").to_numpy(), batch.column("vec").to_pylist())
            yield out(fold)

        return slim.mapInArrow(local, schema)
    q_blocks = -(-n // QUERY_BLOCK)
    r_blocks = max(1, -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // q_blocks))

    def blocks(df, kind, own, of, other, k):
        own_block = F.pmod(F.xxhash64(F.lit(kind), "id"), F.lit(of)).cast("int").alias(own)
        return df.select("id", "vec", F.lit(kind).alias("kind"), own_block, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(other))

    both = blocks(asked, 0, "qb", q_blocks, "rb", r_blocks).unionByName(blocks(slim, 1, "rb", r_blocks, "qb", q_blocks))
    grid = both.repartition(min(q_blocks * r_blocks, 20_000), "qb", "rb").sortWithinPartitions("qb", "rb", "kind")

    def paired(batches):
        now, ids, vectors, fold, unit = None, [], [], None, None
        for batch in batches:
            id_, vec = batch.column("id").to_numpy(), batch.column("vec").to_pylist()
            key = np.stack([batch.column(c).to_numpy() for c in ("qb", "rb", "kind")], 1)
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else []
            for a, b in zip(begin, [*begin[1:], len(key)], strict=True):
                if (pair := tuple(key[a][:2])) != now:
                    if fold is not None:
                        yield out(fold)
                    now, ids, vectors, fold = pair, [], [], None
                if key[a][2] == 0:
                    ids.append(id_[a:b])
                    vectors += vec[a:b]
                elif ids:
                    if fold is None:
                        fold, unit, vectors = make(np.concatenate(ids)), _unit(vectors), []
                    seen(fold, unit, id_[a:b], vec[a:b])
        if fold is not None:
            yield out(fold)

    return grid.mapInArrow(paired, schema)


def batch_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """qid, id, score, rank: for each of a set of query vectors (qid, q), of any number, the k rows of largest cosine, ranks from 1.

    A task keeps k rows for each query of its block, so k rows a query and task are shuffled at the end, whatever the
    number of rows.
    """
    kind = dict(rows.dtypes)[id_col]
    local = _folded(rows, queries, lambda qid: _Best(k, exclude_self, qid), f"qid long, {id_col} long, score double", id_col, vec_col)
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), id_col)
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn(id_col, F.col(id_col).cast(kind))


def scan_stats(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """qid, n, low, mean of the cosines of each query (qid, q) with every row."""
    local = _folded(rows, queries, _Sums, "qid long, n long, sum double, low double", id_col, vec_col)
    return local.groupBy("qid").agg(F.sum("n").alias("n"), F.min("low").alias("low"), (F.sum("sum") / F.sum("n")).alias("mean"))


def first_hit(cache: DataFrame, query: DataFrame, threshold: float = 0.92, seq_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The earliest cached row, not the best, whose cosine with the query reaches the threshold: none or one row."""
    scored = cache.join(F.broadcast(query.select("q").limit(1))).select(seq_col, V.cosine(F.col(vec_col), F.col("q")).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(seq_col).limit(1)


def cache_insert(cache: DataFrame, items: DataFrame) -> DataFrame:
    """A semantic cache with items appended (order, vector, completion, as the cache has them); equal ones stay beside each other, the earliest answers."""
    return cache.unionByName(items)


def cache_clear(cache: DataFrame) -> DataFrame:
    """The cache without its items."""
    return cache.where(F.lit(False))


def centroids(rows: DataFrame, cluster: str = "label", vec_col: str = "embedding") -> DataFrame:
    """cluster, centroid: the mean vector of each cluster, by sums of positions that combine before the shuffle."""
    parts = rows.select(cluster, F.posexplode(V.doubles(F.col(vec_col))).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg("x").alias("m"))
    return parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def assign(rows: DataFrame, cents: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cluster: str = "cid") -> DataFrame:
    """id, cluster: the nearest centroid by L2, the lowest of equally near ones.

    Centroids are an array beside each row, whose least is taken in place, without a shuffle; more than
    MOST_CENTROID_NUMBERS numbers of them are cut into several arrays, of whose least the least is taken.
    """
    size = cents.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    parts = max(1, -(-(size.n or 0) * (size.d or 1) // MOST_CENTROID_NUMBERS))
    each = cents.select(F.col(cluster).alias("c"), V.doubles(F.col("centroid")).alias("v"))
    arrays = each.groupBy(F.pmod(F.xxhash64("c"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("c", "v")).alias("cs")).select("cs")
    near = F.array_min(F.transform("cs", lambda c: F.struct(F.round(V.l2(F.col("vec"), c["v"]), 9).alias("d"), c["c"].alias("c"))))
    found = rows.select(F.col(id_col), V.doubles(F.col(vec_col)).alias("vec")).join(F.broadcast(arrays)).select(id_col, near.alias("x"))
    if parts > 1:
        found = found.groupBy(id_col).agg(F.min("x").alias("x"))
    return found.select(id_col, F.col("x.c").alias(cluster))


def n_probes(buckets: int, profile: str = "balanced") -> int:
    return max(1, int(buckets * PROBE_SHARE[profile] + 0.5))


def probe_topk(rows: DataFrame, cents: DataFrame, query: DataFrame, k: int, profile: str = "balanced", cluster: str = "label", metric: str = V.COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """topk over the buckets whose centroids are nearest to the query by L2, as many as the profile says."""
    n = cents.count()
    q = query.select("q").limit(1)
    probed = cents.join(F.broadcast(q)).select(cluster, F.round(V.l2(F.col("centroid"), F.col("q")), 9).alias("d")).orderBy("d", cluster).limit(n_probes(n, profile))
    return topk(rows.join(F.broadcast(probed.select(cluster)), cluster, "left_semi"), query, k, metric, id_col, vec_col)


def bucket_health(rows: DataFrame, cluster: str = "label") -> DataFrame:
    """n_buckets, health (1 less the coefficient of variation of bucket sizes, 0 at least), imbalance (largest over mean)."""
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_buckets"), F.greatest(F.lit(0.0), 1 - F.stddev_pop("n") / F.avg("n")).alias("health"), (F.max("n") / F.avg("n")).alias("imbalance"))


def davies_bouldin(rows: DataFrame, cents: DataFrame, cluster: str = "label", vec_col: str = "embedding") -> DataFrame:
    """index: the mean over clusters of the worst (spread + spread) / distance to another; centroids nearer than 1e-5 are skipped."""
    spread = rows.join(F.broadcast(cents), cluster).groupBy(cluster).agg(F.avg(V.l2(F.col(vec_col), F.col("centroid"))).alias("s")).join(F.broadcast(cents), cluster)
    a, b = (spread.select(*[F.col(c).alias(f"{p}_{c}") for c in (cluster, "s", "centroid")]) for p in ("a", "b"))
    pairs = a.join(F.broadcast(b), F.col(f"a_{cluster}") != F.col(f"b_{cluster}")).withColumn("d", V.l2(F.col("a_centroid"), F.col("b_centroid"))).where("d > 1e-5")
    return pairs.groupBy(f"a_{cluster}").agg(F.max((F.col("a_s") + F.col("b_s")) / F.col("d")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def silhouette(rows: DataFrame, sample: int = 50, cluster: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """silhouette: the mean over the sample (the lowest ids; it is a sampled measure) of how much nearer points are to their own cluster."""
    points = rows.orderBy(id_col).limit(sample).select(F.col(id_col).alias("i"), F.col(cluster).alias("ci"), F.col(vec_col).alias("x"))
    every = points.select(F.col("i").alias("j"), F.col("ci").alias("cj"), F.col("x").alias("y"))
    mean = points.join(F.broadcast(every), F.col("i") != F.col("j")).groupBy("i", "ci", "cj").agg(F.avg(V.l2(F.col("x"), F.col("y"))).alias("d"))
    by_point = mean.groupBy("i", "ci").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return by_point.agg(F.avg(s).alias("silhouette"))


def knn_graph(rows: DataFrame, queries: DataFrame, m: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """src, dst, rank: the m nearest others of each query row."""
    return batch_topk(rows, queries, m, id_col, vec_col, exclude_self=True).select(F.col("qid").alias("src"), F.col(id_col).alias("dst"), "rank")
