"""Lexical and hybrid search over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import lexical as L
from ..operators import search as S
from ..registry import query
from ..session import table

#: The stated queries; their words are frequent, middling and rare ones of the documents.
QUERIES = {1: "licensed under the apache license", 2: "idiot and moron", 3: "the mit license released", 4: "worthless trash"}
DUPLICATE = {1: "the apache apache license the the"}
HYBRID = {1: "how is the apache license"}


def _sql_queries(q):
    return "qs(qid, query) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in q.items()) + ")"


def _queries(spark, q):
    return spark.createDataFrame(list(q.items()), "qid int, query string")


_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25_sql(q, k):
    return rf"""{_sql_queries(q)}, t AS (SELECT doc_id, {_TERMS} AS w FROM documents), d AS (SELECT doc_id, len(w) AS dl FROM t WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({_TERMS.replace('text', 'query')}) AS term FROM qs) GROUP BY ALL), z AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
sc AS (SELECT qid, doc_id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN d USING (doc_id), z GROUP BY qid, doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


def _bm(spark, d, q, k):
    return L.bm25(table(spark, d, "documents"), _queries(spark, q), k)


def _shown(df):
    return df.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(rf"SELECT term, count(*) AS n FROM (SELECT unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, d):
    return table(spark, d, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def bm25_term_stats(spark, d):
    """Documents of each term: each document's terms are made distinct in place, so there is one shuffle, with partial counts."""
    return table(spark, d, "documents").select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(rf"SELECT doc_id, len({_TERMS}) AS dl FROM documents WHERE len({_TERMS}) > 0")
def bm25_doc_stats(spark, d):
    return L.doc_stats(table(spark, d, "documents"))


@query(f"WITH {_bm25_sql({1: QUERIES[1]}, 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return _shown(_bm(spark, d, {1: QUERIES[1]}, 10))


@query(f"WITH {_bm25_sql(DUPLICATE, 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_duplicate_terms(spark, d):
    return _shown(_bm(spark, d, DUPLICATE, 10))


@query(f"WITH {_bm25_sql(QUERIES, 5)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_batch(spark, d):
    """Multi-hop retrieval: the five best documents of each goal, all goals in one pass."""
    return _shown(_bm(spark, d, QUERIES, 5))


@query("""SELECT conv_id, turn, CASE WHEN contains(text, '{') OR contains(text, '}') OR contains(text, '::') OR contains(text, '"') OR contains(text, '''') OR contains(text, '(') OR contains(text, ')') OR contains(text, 'ERROR_') OR contains(text, 'ERR_') OR contains(text, '0x') THEN 0.3::DOUBLE
WHEN starts_with(lower(text), 'how') OR starts_with(lower(text), 'what') OR starts_with(lower(text), 'why') OR starts_with(lower(text), 'explain') OR starts_with(lower(text), 'describe') THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS alpha FROM conversations""")
def hybrid_alpha(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", L.hybrid_alpha(F.col("text")).alias("alpha"))


@query("""SELECT conv_id, turn, NOT (contains(text, '{') OR contains(text, '}') OR contains(text, '::') OR contains(text, '"') OR contains(text, '''') OR contains(text, '(') OR contains(text, ')') OR contains(text, 'ERROR_') OR contains(text, 'ERR_') OR contains(text, '0x')) AS compress FROM conversations""")
def compression_gate(spark, d):
    """Whether the context of a prompt would be compressed: not where the lexical side is trusted."""
    return table(spark, d, "conversations").select("conv_id", "turn", (L.hybrid_alpha(F.col("text")) >= 0.4).alias("compress"))


_VEC = """v AS (SELECT e.vec_id AS doc_id, row_number() OVER (ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q, q.q))), 9) DESC, e.vec_id) AS rank,
list_dot_product(e.embedding::DOUBLE[], q.q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q, q.q))) AS score
FROM embeddings e JOIN documents ON doc_id = vec_id, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 20)"""


def _vector_side(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.lit(1).cast("long").alias("qid"), F.col("embedding").alias("q"))
    there = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return S.batch_topk(there, q, 20).withColumnRenamed("vec_id", "doc_id")


@query(f"""WITH {_bm25_sql(HYBRID, 20)}, {_VEC}, f AS (SELECT doc_id, sum(s) AS score FROM (SELECT doc_id, 0.8 / (60 + rank - 1) AS s FROM v UNION ALL SELECT doc_id, 0.2 / (60 + rank - 1) FROM bm) GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score FROM f ORDER BY round(f.score, 12) DESC, doc_id LIMIT 10""")
def hybrid_rrf(spark, d):
    lexical = _bm(spark, d, HYBRID, 20)
    return L.fuse(_vector_side(spark, d), lexical, 0.8, 10).withColumn("score", F.round("score", 9))


@query(f"WITH {_VEC} SELECT doc_id, round(score, 6) AS score, round(score, 6) AS vector_score FROM v WHERE rank <= 10")
def hybrid_vector_only(spark, d):
    """A query without a lexical hit: the vector list as it is, if the lexical side is empty."""
    lexical = _bm(spark, d, {1: "zzzzqqqq"}, 20).agg(F.count(F.lit(1)).alias("n"))
    v = _vector_side(spark, d).where("rank <= 10")
    return v.join(F.broadcast(lexical)).where("n = 0").select("doc_id", F.round("score", 6).alias("score"), F.round("score", 6).alias("vector_score"))


@query("""WITH s AS (SELECT x.vec_id AS list, e.vec_id, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]))), 9) DESC, e.vec_id) AS rank FROM embeddings x, embeddings e WHERE x.vec_id < 4),
f AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + rank - 1)) AS score FROM s WHERE rank <= 20 GROUP BY vec_id) SELECT vec_id, round(score, 9) AS score FROM f ORDER BY round(f.score, 12) DESC, vec_id LIMIT 10""")
def multi_query_rrf(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id < 4").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    lists = S.batch_topk(e, q, 20).withColumnRenamed("qid", "list")
    return L.multi_fuse(lists, 10, "vec_id").withColumn("score", F.round("score", 9))


@query(f"""WITH {_bm25_sql({1: QUERIES[1]}, 5)} SELECT string_agg('[' || rank || '] (' || bm.doc_id || ', ' || printf('%.3f', score) || ') ' || text, chr(10) ORDER BY rank) AS context FROM bm JOIN documents ON documents.doc_id = bm.doc_id""")
def context_block(spark, d):
    """The best documents as one block of numbered context."""
    best = _bm(spark, d, {1: QUERIES[1]}, 5).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("doc_id").cast("string"), F.lit(", "), F.format_string("%.3f", F.col("score")), F.lit(") "), F.col("text"))
    return best.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])).alias("context"))


@query(rf"""WITH {_bm25_sql({1: QUERIES[1]}, 20)}, o AS (SELECT bm.doc_id, len(list_filter(['licensed','under','the','apache','license'], lambda x: list_contains(t.w, x))) / 5.0::DOUBLE AS overlap FROM bm JOIN t ON t.doc_id = bm.doc_id)
SELECT doc_id, round(overlap, 6) AS overlap FROM o ORDER BY round(o.overlap, 9) DESC, doc_id LIMIT 5""")
def rerank_lexical_overlap(spark, d):
    """The 20 best documents ordered anew by the share of the query's words that they have, five kept."""
    words = F.array(*[F.lit(w) for w in QUERIES[1].split()])
    best = _bm(spark, d, {1: QUERIES[1]}, 20).select("doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    scored = best.select("doc_id", (F.size(F.array_intersect(words, T.terms(F.col("text")))) / F.lit(5.0)).alias("overlap"))
    return scored.orderBy(F.round("overlap", 9).desc(), "doc_id").limit(5).withColumn("overlap", F.round("overlap", 6))


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, n, regexp_replace(line, '^[\s0-9.\-*)]+', '') AS line FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS r FROM c WHERE line <> '')
SELECT conv_id, turn, r AS position, line FROM k WHERE r <= 4""")
def query_expansion_cleanup(spark, d):
    """Generated lines without bullets and numbers, the first four of each answer, which is all that is asked for."""
    t = table(spark, d, "conversations").where("role = 'assistant'")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[\s0-9.\-*)]+", "")), lambda x: x != "")
    return t.select("conv_id", "turn", F.posexplode(F.slice(lines, 1, 4)).alias("p", "line")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("position"), "line")
