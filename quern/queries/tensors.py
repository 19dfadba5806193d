"""Tensor arithmetic over the embeddings, and sequence look-ups over token positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import blocks as B
from ..operators import factor
from ..registry import query
from ..session import table

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))) AS top FROM embeddings)"
_RND = "CASE WHEN {v} >= 0 THEN floor({v} + 0.5) ELSE ceil({v} - 0.5) END::INT"


def _emb(spark, d):
    return table(spark, d, "embeddings")


@query(f"WITH {_E} SELECT vec_id, round(top / 127, 9) AS scale, list_sum(list_transform(x, lambda v: {_RND.format(v='(v / (top / 127))')}))::BIGINT AS total, round(list_max(list_transform(x, lambda v: abs(v - (top / 127) * {_RND.format(v='(v / (top / 127))')}))), 6) AS max_error FROM e")
def int8_quantize(spark, d):
    """Scale, sum of the quantized numbers and largest error of each vector."""
    e = _emb(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("q", B.int8(F.col("x")))
    error = F.zip_with("x", F.col("q.q"), lambda x, q: F.abs(x - q * F.col("q.scale")))
    total = F.aggregate("q.q", F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("vec_id", F.round("q.scale", 9).alias("scale"), total.alias("total"), F.round(F.array_max(error), 6).alias("max_error"))


@query(f"WITH {_E}, q AS (SELECT vec_id, top / 7 AS scale, list_transform(x, lambda v: {_RND.format(v='(v / (top / 7))')} + 8) AS q FROM e) SELECT vec_id, round(scale, 9) AS scale, list_sum(list_transform(range(1, 33), lambda i: i * (q[2 * i - 1] * 16 + q[2 * i])))::BIGINT AS packed FROM q")
def int4_quantize(spark, d):
    """Scale and a weighted checksum of the packed bytes of each vector."""
    e = _emb(spark, d).select("vec_id", B.int4(F.col("embedding")).alias("q"))
    check = F.aggregate(F.transform("q.packed", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("vec_id", F.round("q.scale", 9).alias("scale"), check.alias("packed"))


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, i // 4 ORDER BY abs(x) DESC, i) AS r FROM p)
SELECT vec_id, round(sum(x * (i + 1) / 64.0::DOUBLE), 6) AS y FROM r WHERE r <= 2 GROUP BY vec_id""")
def sparse_2_4_matvec(spark, d):
    """Each vector, two of every four numbers kept, times a fixed vector."""
    w = F.array(*[F.lit((i + 1) / 64.0) for i in range(64)])
    return _emb(spark, d).select("vec_id", F.round(V.dot(B.sparse_2_4(F.col("embedding")), w), 6).alias("y"))


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, i // 16 AS block, sum(CASE WHEN abs(CASE WHEN abs(x) < 0.1 THEN 0 ELSE x END) > 1e-7 THEN 1 << (i % 16)::INT ELSE 0 END)::BIGINT AS mask FROM p GROUP BY ALL""")
def bitmask_pack(spark, d):
    """Bit masks of the vectors with small numbers set to zero."""
    x = F.transform(V.doubles(F.col("embedding")), lambda v: F.when(F.abs(v) < 0.1, 0.0).otherwise(v))
    return _emb(spark, d).select("vec_id", F.posexplode(B.bitmask(x)).alias("block", "mask")).select("vec_id", F.col("block").cast("long"), F.col("mask").cast("long"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: least(255, greatest(0, floor((v::DOUBLE + 1) * 128)))::INT / 128.0::DOUBLE - 1)), 6) AS total FROM embeddings")
def dict_decode(spark, d):
    """Indices decoded by a dictionary of 256 numbers."""
    codes = F.transform(V.doubles(F.col("embedding")), lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 1) * 128))).cast("int"))
    entries = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: i / 128.0 - 1)
    t = _emb(spark, d).select("vec_id", codes.alias("codes")).withColumn("dict", entries)
    return t.select("vec_id", F.round(F.aggregate(F.transform("codes", lambda c: F.element_at(F.col("dict"), c + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT embedding::DOUBLE[] AS x, exp(list_dot_product(embedding::DOUBLE[], q) / 8.0::DOUBLE) AS w FROM embeddings, q),
p AS (SELECT generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v, w FROM s) SELECT pos, round(sum(v * w) / sum(w), 6) AS y FROM p GROUP BY pos""")
def attention_head(spark, d):
    """Softmax of scaled products with the stated query, as weights of the rows."""
    e = _emb(spark, d)
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.join(F.broadcast(q)).select(F.col("embedding").alias("x"), F.exp(V.dot(F.col("embedding"), F.col("q")) / 8.0).alias("w"))
    p = s.select(F.posexplode(V.doubles(F.col("x"))).alias("pos", "v"), "w")
    return p.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("y"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, exp(list_dot_product(embedding::DOUBLE[], q) / 0.7::DOUBLE) AS w FROM embeddings, q),
t AS (SELECT * FROM s ORDER BY round(w, 9) DESC, vec_id LIMIT 40) SELECT vec_id, round(w / sum(w) OVER (), 6) AS p FROM t""")
def softmax_topk_renorm(spark, d):
    """The 40 likeliest of a softmax at temperature .7, made to sum to one."""
    e = _emb(spark, d)
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    top = e.join(F.broadcast(q)).select("vec_id", F.exp(V.dot(F.col("embedding"), F.col("q")) / 0.7).alias("w")).orderBy(F.round("w", 9).desc(), "vec_id").limit(40)
    return top.join(F.broadcast(top.agg(F.sum("w").alias("s")))).select("vec_id", F.round(F.col("w") / F.col("s"), 6).alias("p"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64 + 1e-6), 6) AS y FROM embeddings")
def rms_norm(spark, d):
    x = V.doubles(F.col("embedding"))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return _emb(spark, d).select("vec_id", F.round(total / F.sqrt(V.dot(F.col("embedding"), F.col("embedding")) / 64 + 1e-6), 6).alias("y"))


_TOK = r"t AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS tok FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents))"


@query(rf"""WITH {_TOK}, g AS (SELECT doc_id, pos, tok || ' ' || lead(tok) OVER w || ' ' || lead(tok, 2) OVER w AS tri, max(pos) OVER (PARTITION BY doc_id) - 2 AS last FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
z AS (SELECT doc_id, tri FROM g WHERE pos = last) SELECT g.doc_id, min(g.pos) AS pos FROM g JOIN z ON g.doc_id = z.doc_id AND g.tri = z.tri WHERE g.pos < g.last GROUP BY g.doc_id""")
def trigram_draft(spark, d):
    """Where each document's last three terms stood first before, if they did; within the document's row, without a shuffle."""
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    t = table(spark, d, "documents").select("doc_id", norm.alias("norm"))
    last = F.regexp_extract("norm", r" ([^ ]+ [^ ]+ [^ ]+) $", 1)
    t = t.select("doc_id", "norm", F.instr(F.col("norm"), F.concat(F.lit(" "), last, F.lit(" "))).alias("at"), F.length(last).alias("k"))
    before = F.substring(F.col("norm"), F.lit(1), F.col("at"))
    found = t.where((F.col("k") > 0) & (F.col("at") + F.col("k") + 1 < F.length("norm")))
    return found.select("doc_id", (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).cast("long").alias("pos"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, unnest(range(16, len(w) + 1, 16)) AS n, w FROM w WHERE len(w) >= 16),
h AS (SELECT doc_id, n, sha256(array_to_string(w[1:n], ' ')) AS h FROM p), f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h) SELECT h.doc_id, max(n) AS prefix FROM h JOIN f USING (h) WHERE f.first < h.doc_id GROUP BY h.doc_id""")
def longest_prefix(spark, d):
    """The longest prefix, in multiples of 16 terms, that an earlier document has cached: a join on prefix hashes."""
    w = table(spark, d, "documents").select("doc_id", T.terms(F.col("text")).alias("w")).where(F.size("w") >= 16)
    # A block's hash holds its place, so that the running xor of the blocks' hashes tells a whole prefix; two of them, of 64 bits.
    blocks = w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 16).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * 16 + 1, F.lit(16)), " "))).alias("i", "block"))
    run = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    h = blocks.select("doc_id", ((F.col("i") + 1) * 16).alias("n"), *[F.expr(f"bit_xor(xxhash64({s}, i, block))").over(run).alias(f"h{s}") for s in (1, 2)])
    first = h.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return h.join(first, ["n", "h1", "h2"]).where("first < doc_id").groupBy("doc_id").agg(F.max("n").cast("long").alias("prefix"))


@query("""WITH w AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE) AS v FROM embeddings), g AS (SELECT vec_id, i, v[i] AS x, row_number() OVER (PARTITION BY vec_id, (i - 1) // 4 ORDER BY abs(v[i]) DESC, i) AS r FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM w))
SELECT vec_id, round(sum(CASE WHEN r <= 2 THEN x * (i / 64.0)::DOUBLE ELSE 0 END), 6) AS y FROM g GROUP BY vec_id""")
def packed_2_4_matvec(spark, d):
    """The packed form of a 2:4 sparse tensor times a fixed vector."""
    w = F.array(*[F.lit((i + 1) / 64.0) for i in range(64)])
    return _emb(spark, d).select("vec_id", F.round(B.packed_dot(B.packed_2_4(F.col("embedding")), w), 6).alias("y"))


@query(r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, n, least(n, 4) AS sinks, least(greatest(n - 4, 0), 252) AS recent, greatest(n - 256, 0) AS evicted FROM w""")
def sink_eviction(spark, d):
    """Of a window of 256 terms the first four stay, with the latest."""
    n = F.col("n")
    t = table(spark, d, "documents").select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n"))
    return t.select("doc_id", "n", F.least(n, F.lit(4)).alias("sinks"), F.least(F.greatest(n - 4, F.lit(0)), F.lit(252)).alias("recent"), F.greatest(n - 256, F.lit(0)).alias("evicted"))


@query(r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT *, list_filter(range(1, least(length(text), length(b)) + 1), lambda i: substr(text, i, 1) <> substr(b, i, 1)) AS odd FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(odd) = 0 THEN least(length(text), length(b)) ELSE odd[1] - 1 END AS valid FROM q""")
def branch_replay(spark, d):
    """How far a turn repeats the one before it: the characters up to the first that differs."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("b")).where("b IS NOT NULL")
    n = F.least(F.length("text"), F.length("b"))
    same = F.zip_with(F.split(F.substring(F.col("text"), F.lit(1), n), ""), F.split(F.substring(F.col("b"), F.lit(1), n), ""), lambda x, y: x == y)
    first = F.array_position(same, False)
    return p.select("conv_id", "turn", F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("long").alias("valid"))


@query()
def randomized_svd(spark, d):
    """Leading singular values of the embeddings, by a randomised factorisation, and how far the factors' product is from them."""
    e = _emb(spark, d)
    s, right, left = factor.randomized_svd(e, 8)
    cells = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in right.T])
    off = F.zip_with(F.col("embedding").cast("array<double>"), F.transform(cells, lambda r: V.dot(F.col("factor"), r)), lambda a, b: (a - b) * (a - b))
    error = e.select("vec_id", "embedding").join(left, "vec_id").select(F.aggregate(off, F.lit(0.0), lambda a, x: a + x).alias("e")).agg(F.round(F.sum("e"), 4).alias("error"))
    values = spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(s)], "rank int, value double")
    return values.join(F.broadcast(error))
