"""Neighbours and numbers in an order, without one task that has all rows of a key.

The order is cut at approximate quantiles, which are literals of the plan; windows run within the cuts, and what goes over a
cut comes from a row for each cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cuts of an order.
CUTS = 64


def _part(rows: DataFrame, seq: str) -> Column:
    """Which cut of the order of seq a row lies in."""
    q = rows.agg(F.percentile_approx(seq, [(i + 1) / CUTS for i in range(CUTS - 1)], 10_000).alias("q")).first().q or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(q))])
    return F.size(F.filter(bounds, lambda b: b < F.col(seq))) if q else F.lit(0)


def lagged(rows: DataFrame, key: str, seq: str, column: str, name: str) -> DataFrame:
    """rows with name: the column of the row before, in the order of seq (a number, without ties in a key) among those of its key; null for the first."""
    cut = rows.where(F.col(seq).isNotNull()).withColumn("_part", _part(rows, seq))
    inside = cut.withColumn(name, F.lag(F.struct(F.col(column).alias("x"))).over(Window.partitionBy(key, "_part").orderBy(seq)))
    ends = cut.groupBy(key, "_part").agg(F.max_by(F.struct(F.col(column).alias("x")), seq).alias("_last"))
    before = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.lag("_last").over(Window.partitionBy(key).orderBy("_part")).alias("_before"))
    joined = inside.join(before, inside[key].eqNullSafe(before["_key"]) & (inside["_part"] == before["_p"]))
    return joined.withColumn(name, F.coalesce(name, "_before")["x"]).drop("_part", "_key", "_p", "_before")


def numbered(rows: DataFrame, seq: str, name: str) -> DataFrame:
    """rows with name: their places in the order of seq (a number, without ties), from 0 on."""
    cut = rows.withColumn("_part", _part(rows, seq))
    begin, at = [], 0
    for r in cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        begin.append((r["_part"], at))
        at += r.n
    begins = rows.sparkSession.createDataFrame(begin, "_part int, _begin long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(seq)) - 1
    return cut.withColumn(name, place).join(F.broadcast(begins), "_part").withColumn(name, (F.col(name) + F.col("_begin")).cast("long")).drop("_part", "_begin")
