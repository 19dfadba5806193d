"""Storage reports: chunks, deduplication, manifests, partitions, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators.order import lagged
from ..registry import query
from ..session import table

_C = "c AS (SELECT source AS model, doc_id AS layer, i AS chunk_no, substr(text, i * 256 + 1, 256) AS piece FROM (SELECT *, unnest(range(0, (length(text) + 255) // 256)) AS i FROM documents)), r AS (SELECT model, layer, chunk_no, sha256(piece) AS hash, strlen(piece) AS bytes FROM c)"


def _refs(spark, d):
    return B.chunks(table(spark, d, "documents"))


@query(f"WITH {_C} SELECT * FROM r")
def chunk_hashes(spark, d):
    return _refs(spark, d).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(f"WITH {_C}, h AS (SELECT hash, count(*) AS n, max(bytes) AS b FROM r GROUP BY hash) SELECT count(*) AS unique_chunks, sum(n) AS refs, count(*) FILTER (WHERE n > 1) AS duplicates, coalesce(sum(b) FILTER (WHERE n > 1), 0) AS bytes_saved, coalesce(sum((n - 1) * b), 0) AS bytes_avoided FROM h")
def dedup_stats(spark, d):
    return B.dedup_stats(_refs(spark, d))


@query(f"WITH {_C}, f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY layer, chunk_no) = 1 AS first FROM r) SELECT model, sum(bytes) FILTER (WHERE first) AS stored, coalesce(sum(bytes) FILTER (WHERE NOT first), 0) AS saved FROM f GROUP BY model")
def dedup_first_seen(spark, d):
    """Bytes that each model stores, and those another chunk had stored before."""
    r = _refs(spark, d)
    first = r.groupBy("hash").agg(F.min(F.struct("layer", "chunk_no", "model", "bytes")).alias("f"))
    stored = first.groupBy(F.col("f.model").alias("model")).agg(F.sum("f.bytes").alias("stored"))
    every = r.groupBy("model").agg(F.sum("bytes").alias("total"))
    return every.join(stored, "model", "left").select("model", "stored", (F.col("total") - F.coalesce("stored", F.lit(0))).alias("saved"))


@query(f"WITH {_C}, h AS (SELECT hash, count(*) AS n, min(model) AS model FROM r GROUP BY hash) SELECT model, count(*) AS exclusive FROM h WHERE n = 1 GROUP BY model")
def dedup_exclusive(spark, d):
    return _refs(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("model")).where("n = 1").groupBy("model").agg(F.count(F.lit(1)).alias("exclusive"))


@query(f"WITH {_C}, a AS (SELECT DISTINCT hash FROM r WHERE model NOT IN ('src1', 'src2')) SELECT count(DISTINCT hash) AS dropped, coalesce(sum(bytes), 0) AS bytes FROM (SELECT DISTINCT hash, bytes FROM r WHERE hash NOT IN (SELECT hash FROM a))")
def dedup_gc(spark, d):
    """Chunks that no active model refers to, counted anew from the references."""
    by = _refs(spark, d).groupBy("hash").agg(F.max("bytes").alias("bytes"), F.count_if(~F.col("model").isin("src1", "src2")).alias("active"))
    return by.where("active = 0").agg(F.count(F.lit(1)).alias("dropped"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


_L = "l AS (SELECT l_partkey % 8 AS model, l_linenumber AS layer, sum(l_quantity)::BIGINT AS bytes, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, CASE WHEN layer <= 2 THEN 'critical' WHEN layer <= 5 THEN 'important' ELSE 'redundant' END AS tier FROM l)"


def _layers(spark, d):
    l = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 8).alias("model"), F.col("l_linenumber").alias("layer")).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return l.withColumn("tier", F.when(F.col("layer") <= 2, "critical").when(F.col("layer") <= 5, "important").otherwise("redundant"))


@query(f"WITH {_L} SELECT model, count(*) AS layers, sum(bytes) AS bytes, round(avg(bytes * 1.0::DOUBLE / n), 6) AS mean_ratio, round(min(bytes * 1.0::DOUBLE / n), 6) AS least_ratio, round(max(bytes * 1.0::DOUBLE / n), 6) AS most_ratio, count(*) FILTER (WHERE tier = 'critical') AS critical FROM t GROUP BY model")
def manifest_stats(spark, d):
    ratio = F.col("bytes") / F.col("n")
    return _layers(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("layers"), F.sum("bytes").alias("bytes"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.min(ratio), 6).alias("least_ratio"), F.round(F.max(ratio), 6).alias("most_ratio"), F.count_if(F.col("tier") == "critical").alias("critical"))


@query(f"WITH {_L} SELECT model, sum(bytes) FILTER (WHERE tier = 'critical') AS critical, sum(bytes) FILTER (WHERE tier = 'important') AS important, sum(bytes) FILTER (WHERE tier <> 'redundant') AS dram FROM t GROUP BY model")
def tier_sizes(spark, d):
    size = lambda c: F.sum(F.when(c, F.col("bytes")))
    return _layers(spark, d).groupBy("model").agg(size(F.col("tier") == "critical").alias("critical"), size(F.col("tier") == "important").alias("important"), size(F.col("tier") != "redundant").alias("dram"))


@query(f"WITH {_L} SELECT tier, count(*) AS layers, round(sum(bytes) * 1.0::DOUBLE / (SELECT sum(bytes) FROM t), 6) AS share FROM t GROUP BY tier")
def tier_utilisation(spark, d):
    t = _layers(spark, d)
    return t.groupBy("tier").agg(F.count(F.lit(1)).alias("layers"), F.sum("bytes").alias("b")).join(F.broadcast(t.agg(F.sum("bytes").alias("all")))).select("tier", "layers", F.round(F.col("b") / F.col("all"), 6).alias("share"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS t, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b, label FROM embeddings), n AS (SELECT label, len(list_filter(range(1, 65), lambda i: abs(t[i] - b[i]) > 0.05)) AS nnz FROM p WHERE b IS NOT NULL)
SELECT label, count(*) AS tensors, sum(nnz) AS nnz, count(*) * 256 AS full_bytes, sum(least(nnz * 8, 256)) AS delta_bytes FROM n GROUP BY label""")
def savings_report(spark, d):
    """What deltas between neighbours of a label would save."""
    e = _pairs(spark, d)
    n = e.select("label", F.size(B.delta(F.col("b"), F.col("t"), 0.05)).cast("long").alias("nnz"))
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("tensors"), F.sum("nnz").alias("nnz"), (F.count(F.lit(1)) * 256).alias("full_bytes"), F.sum(F.least(F.col("nnz") * 8, F.lit(256))).alias("delta_bytes"))


def _pairs(spark, d):
    """Each tensor and the one before it of its label."""
    e = lagged(table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("t")), "label", "vec_id", "t", "b")
    return e.where("b IS NOT NULL").select("label", "vec_id", "t", "b")


_P = "p AS (SELECT vec_id, embedding::DOUBLE[] AS t, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"


@query(f"WITH {_P} SELECT vec_id, len(list_filter(range(1, 65), lambda i: abs(t[i] - b[i]) > 0.05)) AS nnz, round(list_max(list_transform(range(1, 65), lambda i: CASE WHEN abs(t[i] - b[i]) > 0.05 THEN 0 ELSE abs(t[i] - b[i]) END)), 6) AS max_error FROM p WHERE b IS NOT NULL")
def delta_stats(spark, d):
    """Changed positions of each tensor against the one before, and the largest error of leaving out the rest."""
    e = _pairs(spark, d).withColumn("x", B.delta(F.col("b"), F.col("t"), 0.05))
    rest = F.zip_with(F.col("b").cast("array<double>"), F.col("t").cast("array<double>"), lambda a, b: F.when(F.abs(b - a) > 0.05, 0.0).otherwise(F.abs(b - a)))
    return e.select("vec_id", F.size("x").cast("long").alias("nnz"), F.round(F.array_max(rest), 6).alias("max_error"))


@query(f"WITH {_P} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * CASE WHEN abs(t[i] - b[i]) > 0.05 THEN t[i] ELSE b[i] END)), 6) AS checksum FROM p WHERE b IS NOT NULL")
def delta_reconstruct(spark, d):
    """The tensors put together again, by a weighted checksum of each."""
    e = _pairs(spark, d).withColumn("y", B.patched(F.col("b"), B.delta(F.col("b"), F.col("t"), 0.05)))
    weighted = F.aggregate(F.transform("y", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(weighted, 6).alias("checksum"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def btree_range(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice").between(100000, 150000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'p')")
def btree_prefix(spark, d):
    return table(spark, d, "part").where(F.col("p_name").startswith("p")).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT s_suppkey * 32 FROM supplier)")
def composite_prefix(spark, d):
    """By the first part of a key of two, as a value and not as a prefix of its text (32 isn't 320); a batch of them."""
    keys = table(spark, d, "supplier").select((F.col("s_suppkey") * 32).alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(keys, "l_orderkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT s_suppkey * 7 FROM supplier)")
def hash_lookup(spark, d):
    """A batch of keys, some of which aren't there."""
    keys = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(keys, "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 100 AND 2000")
def covering_lookup(spark, d):
    """Answered from three columns of the scan."""
    return table(spark, d, "orders").where("o_orderkey BETWEEN 100 AND 2000").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT 'l_orderkey' AS key, count(DISTINCT l_orderkey) AS entries FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem")
def index_report(spark, d):
    l = table(spark, d, "lineitem")
    parts = [l.agg(F.countDistinct(k).alias("entries")).select(F.lit(k).alias("key"), "entries") for k in ("l_orderkey", "l_partkey", "l_suppkey")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT CASE WHEN value <= 20 THEN 'low' WHEN value <= 80 THEN 'mid' ELSE 'high' END AS part, count(*) AS n FROM events GROUP BY 1")
def range_partition(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.when(v <= 20, "low").when(v <= 80, "mid").otherwise("high").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(part, 'rest') AS part, count(*) AS n FROM events LEFT JOIN (VALUES ('click', 'ui'), ('view', 'ui'), ('purchase', 'money')) t(k, part) ON k = event_type GROUP BY 1")
def list_partition(spark, d):
    lists = spark.createDataFrame([("click", "ui"), ("view", "ui"), ("purchase", "money")], "event_type string, part string")
    return table(spark, d, "events").join(F.broadcast(lists), "event_type", "left").groupBy(F.coalesce("part", F.lit("rest")).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT abs(user_id) % 8 AS part, count(*) AS n FROM events GROUP BY 1")
def hash_partition(spark, d):
    return table(spark, d, "events").groupBy((F.abs("user_id") % 8).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS part, count(*) AS n FROM events GROUP BY 1")
def time_partition(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS part, count(*) AS records, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY 1")
def partition_totals(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("o_totalprice"), 2).alias("size"))


@query("SELECT o_orderkey, c_name AS customer_name, n_name AS nation_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def denormalize(spark, d):
    """Fields of related rows copied into each record."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer_name"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation_name"))
    return table(spark, d, "orders").join(c, "o_custkey", "left").join(F.broadcast(n), "c_nationkey", "left").select("o_orderkey", "customer_name", "nation_name")


@query("SELECT p_partkey % 4 AS device, count(*) AS n, max(p_retailprice) AS largest FROM part GROUP BY 1")
def device_totals(spark, d):
    return table(spark, d, "part").groupBy((F.col("p_partkey") % 4).alias("device")).agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("largest"))


@query("""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: unicode(substr(c_name, i, 1))::HUGEINT)), lambda h, b: (h * 31 + b) % 18446744073709551616::HUGEINT) AS h FROM customer)
SELECT (h % 12)::BIGINT AS shard, count(*) AS n, min(c_custkey) AS least FROM h GROUP BY 1""")
def shard_hash(spark, d):
    """Customers by the shard that the polynomial hash of their name gives."""
    c = table(spark, d, "customer").select("c_custkey", B.polynomial_shard(F.col("c_name"), 12).alias("shard"))
    return c.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"))


@query(f"""WITH {_C}, b AS (SELECT hash, arg_min(layer, layer * 1000000 + chunk_no) AS block_layer, min(layer * 1000000 + chunk_no) % 1000000 AS block_chunk FROM r WHERE layer % 3 <> 0 GROUP BY hash)
SELECT layer, chunk_no, r.hash, block_layer, block_chunk::BIGINT AS block_chunk FROM r LEFT JOIN b USING (hash) WHERE model = 'src3'""")
def layer_index(spark, d):
    """Where each chunk of a model's layers lies in the block store (which holds the chunks of two layers in three); null where it isn't there."""
    r = _refs(spark, d).withColumn("chunk_no", F.col("chunk_no").cast("long"))
    return B.layer_index(r.where("model = 'src3'"), r.where("layer % 3 <> 0")).select("layer", "chunk_no", "hash", F.col("location.layer").alias("block_layer"), F.col("location.chunk_no").alias("block_chunk"))


@query(f"WITH {_C}, m AS (SELECT layer, chunk_no, CASE WHEN layer % 10 = 0 THEN sha256('other') ELSE hash END AS noted FROM r) SELECT r.layer, count(*) AS chunks, count(*) FILTER (WHERE noted <> hash) AS mismatches FROM r JOIN m USING (layer, chunk_no) GROUP BY r.layer HAVING count(*) FILTER (WHERE noted <> hash) > 0")
def manifest_mismatches(spark, d):
    """Layers with chunks whose checksum isn't the one that the manifest has; every tenth layer's entries are wrong here."""
    r = _refs(spark, d).select("layer", "chunk_no", "hash")
    noted = r.select("layer", "chunk_no", F.when(F.col("layer") % 10 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("hash")).alias("noted"))
    both = r.join(noted, ["layer", "chunk_no"]).groupBy("layer").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("noted") != F.col("hash")).alias("mismatches"))
    return both.where("mismatches > 0")
