"""BM25 and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf."""
    exploded = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.terms(F.col(text_col))).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, dl: terms of each document that has any."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(T.terms(F.col(text_col))).cast("long").alias("dl")).where("dl > 0")


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """qid, doc_id, score, rank: for each query (qid, query) the k documents of highest BM25 above 0; a repeated query term counts repeatedly.

    Only the query's terms are kept of the documents, within each document, so that nothing but them is shuffled. Query
    terms are a broadcast: they are the stated queries' own words.
    """
    asked = queries.select("qid", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))
    split = docs.select(F.col(id_col).alias("doc_id"), T.terms(F.col(text_col)).alias("terms")).where(F.size("terms") > 0)
    size = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    hits = split.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    tf = hits.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").join(F.broadcast(size))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qn") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")
    return ranked(scored, k, "doc_id", "qid")


def ranked(scored: DataFrame, k: int, id_col: str, *by: str) -> DataFrame:
    """The k best rows of each group with their rank from 1; scores that agree to nine digits tie, then the id decides."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_alpha(query: Column) -> Column:
    """The weight of the vector side: 0.3 for symbols and error codes, 0.8 for questions, else 0.5."""
    symbols = T.contains_any(query, ("{", "}", "::", '"', "'", "(", ")", "ERROR_", "ERR_", "0x"))
    return F.when(symbols, 0.3).when(F.lower(query).rlike("^(how|what|why|explain|describe)"), 0.8).otherwise(0.5)


def fuse(vector: DataFrame, lexical: DataFrame, alpha: float, k: int, id_col: str = "doc_id") -> DataFrame:
    """id, score, rank: weighted reciprocal ranks of two lists (id, rank from 1); a list's weight is alpha, the other's the rest."""
    v = vector.select(id_col, (F.lit(alpha) / (RRF_K + F.col("rank") - 1)).alias("s"))
    w = lexical.select(id_col, (F.lit(1 - alpha) / (RRF_K + F.col("rank") - 1)).alias("s"))
    summed = v.unionByName(w).groupBy(id_col).agg(F.sum("s").alias("score"))
    return summed.orderBy(F.round("score", 12).desc(), id_col).limit(k)


def multi_fuse(lists: DataFrame, k: int, id_col: str) -> DataFrame:
    """id, score: plain reciprocal ranks summed over all lists (list, id, rank from 1)."""
    summed = lists.groupBy(id_col).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank") - 1)).alias("score"))
    return summed.orderBy(F.round("score", 12).desc(), id_col).limit(k)
