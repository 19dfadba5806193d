"""k-means with seeds by squared distances, and the inverted-file index that is built on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .search import assign

#: Seed of the draws, steps at most, and how far a centroid may move in a step that ends the search.
SEED, STEPS, TOLERANCE = 42, 100, 1e-4
#: Clusters and probed clusters of an index unless said otherwise.
CLUSTERS, PROBES = 10, 2


def _drawn(points: DataFrame, each: int, weight=None):
    """A point drawn with a probability in proportion to its weight (alike without one): that of the least exponential variate, made from a hash of its id."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), F.lit(each), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(u) if weight is None else -F.log(u) / weight
    rows = points if weight is None else points.where(weight > 0)
    r = rows.agg(F.min(F.struct(key.alias("k"), F.col("id"), F.col("v"))).alias("m")).first().m
    return None if r is None else list(r.v)


def seeds(points: DataFrame, k: int) -> list[list[float]]:
    """k of points(id, v): the first at random, each further one by its squared distance from those before, at random where all are zero."""
    found = [_drawn(points, 0)]
    for i in range(1, k):
        far = F.array_min(F.array(*[V.l2(F.col("v"), F.array(*[F.lit(x) for x in c])) for c in found[-1:]]))
        points = points.withColumn("d", far if i == 1 else F.least("d", far))
        found.append(_drawn(points, i, F.col("d") * F.col("d")) or _drawn(points, i))
    return found


def _means(points: DataFrame, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and means of the points that are nearest to each centroid; a task adds its rows up, so a sum a task and centroid is shuffled."""
    d = cents.shape[1]

    def run(batches):
        n, total = np.zeros(len(cents), np.int64), np.zeros(cents.shape)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(-1, d)
                for i in range(0, len(x), 4096):
                    part = x[i : i + 4096]
                    near = ((part[:, None, :] - cents[None]) ** 2).sum(2) if len(cents) * d < 4096 else (cents**2).sum(1)[None] - 2 * part @ cents.T
                    c = near.argmin(1)
                    n += np.bincount(c, minlength=len(cents))
                    np.add.at(total, c, part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cents))), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], names=["c", "n", "total"])

    sums = points.select("v").mapInArrow(run, "c long, n long, total array<double>").groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(d)]).alias("total")).collect()
    n, mean = np.zeros(len(cents), np.int64), np.zeros(cents.shape)
    for r in sums:
        n[r.c], mean[r.c] = r.n, np.array(r.total) / max(r.n, 1)
    return n, mean


def kmeans(rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """cid, centroid: k centroids, or the points themselves where there are k at most, none without points or clusters.

    Steps end when no centroid moves by more than TOLERANCE, after STEPS at most; a cluster that lost its points begins anew
    at a random one. Draws depend on ids alone, so that the same rows always give the same centroids.
    """
    spark = rows.sparkSession
    points = rows.select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(vec_col)).alias("v"))
    few = points.orderBy("id").limit(k + 1).collect() if k > 0 else []
    if len(few) <= k:
        return spark.createDataFrame([(i, list(r.v)) for i, r in enumerate(few)], "cid int, centroid array<double>")
    points = points.persist()  # some k and STEPS passes; lost parts are read again
    try:
        cents = np.array(seeds(points, k))
        for step in range(STEPS):
            n, mean = _means(points, cents)
            for c in np.flatnonzero(n == 0):
                mean[c] = _drawn(points, 1000 + step * k + int(c))
            moved = np.sqrt(((mean - cents) ** 2).sum(1)).max() > TOLERANCE or (n == 0).any()
            cents = mean
            if not moved:
                break
    finally:
        points.unpersist()
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cents)], "cid int, centroid array<double>")


@dataclass
class Ivf:
    """An index: centroids (cid, centroid), and the rows (id, vector) with their cid."""

    centroids: DataFrame
    rows: DataFrame
    id_col: str
    vec_col: str

    def status(self) -> str:
        """READY, or CORRUPT where there are rows but no centroids."""
        return "CORRUPT" if self.centroids.isEmpty() and not self.rows.isEmpty() else "READY"


def ivf(rows: DataFrame, clusters: int = CLUSTERS, id_col: str = "vec_id", vec_col: str = "embedding") -> Ivf:
    cents = kmeans(rows, clusters, id_col, vec_col)
    near = assign(rows, cents, id_col, vec_col)
    return Ivf(cents, rows.select(id_col, vec_col).join(near, id_col), id_col, vec_col)


def save_ivf(index: Ivf, path: str) -> None:
    """The index as files, a folder for each cluster, so that a search reads the probed clusters alone."""
    index.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    index.rows.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/rows")


def load_ivf(spark, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> Ivf:
    return Ivf(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/rows"), id_col, vec_col)


def ivf_topk(index: Ivf, query: DataFrame, k: int, n_probe: int = PROBES) -> DataFrame:
    """id, distance: the k nearest by L2 to a query of one row (column q) in the n_probe clusters whose centroids are nearest."""
    q = query.select("q").limit(1)
    near = index.centroids.join(F.broadcast(q)).select("cid", F.round(V.l2(F.col("centroid"), F.col("q")), 9).alias("d")).orderBy("d", "cid").limit(n_probe).collect()
    rows = index.rows.where(F.col("cid").isin([r.cid for r in near]))
    found = rows.join(F.broadcast(q)).select(index.id_col, V.l2(F.col(index.vec_col), F.col("q")).alias("distance"))
    return found.orderBy(F.round("distance", 9), index.id_col).limit(k)
