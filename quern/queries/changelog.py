"""Change logs, catalogues, sessions and relational upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as O
from ..registry import query
from ..session import table


def _ev(spark, d):
    return table(spark, d, "events")


@query("""SELECT user_id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def changelog_latest_wins(spark, d):
    """The rows that stand after the log: the last change of each key, unless it deletes."""
    log = _ev(spark, d).select("user_id", "event_id", "event_type", "value")
    return O.latest(log, ["user_id"], "event_id").where("event_type <> 'error'").select("user_id", F.col("event_id").alias("seq"), "value")


@query("""SELECT count(*) AS deleted FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'error'""")
def changelog_deleted_count(spark, d):
    return O.latest(_ev(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id").where("event_type = 'error'").agg(F.count(F.lit(1)).alias("deleted"))


@query("SELECT count(*) AS ops, count(*) FILTER (WHERE event_type = 'error') AS deletes, count(DISTINCT user_id) AS keys FROM events")
def wal_replay_count(spark, d):
    return _ev(spark, d).agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("event_type") == "error").alias("deletes"), F.countDistinct("user_id").alias("keys"))


@query("""WITH d AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 5 = 0),
u AS (SELECT vec_id, label, 0 AS v FROM embeddings UNION ALL SELECT *, 1 FROM d) SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC) AS r FROM u) WHERE r = 1""")
def vector_upsert(spark, d):
    """A delta laid over the base, by key."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    delta = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")).union(e.where("vec_id % 5 = 0").select(F.col("vec_id") + 1000000, "label"))
    both = e.withColumn("v", F.lit(0)).union(delta.withColumn("v", F.lit(1)))
    return O.latest(both, ["vec_id"], "v").select("vec_id", "label")


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) AS deleted, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS kept")
def vector_delete(spark, d):
    """Rows deleted by a list of ids, and those that stay."""
    e, gone = table(spark, d, "embeddings").select("vec_id"), table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("gone")).distinct()
    return e.join(gone, "vec_id", "left").agg(F.count("gone").alias("deleted"), F.count_if(F.col("gone").isNull()).alias("kept"))


@query("SELECT label, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 WHEN count(*) < 10 THEN 2 ELSE floor(sqrt(count(*)))::BIGINT END AS clusters FROM embeddings GROUP BY label")
def collection_info(spark, d):
    """Collections with their sizes, and the clusters that an automatic index would get."""
    n = F.col("n")
    by = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return by.select("label", "n", F.when(n < 2, 0).when(n < 10, 2).otherwise(F.floor(F.sqrt(n))).cast("long").alias("clusters"))


@query("SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000")
def ring_prune(spark, d):
    e = _ev(spark, d).select("event_id", "user_id")
    return e.join(F.broadcast(e.agg(F.max("event_id").alias("m")))).where("event_id > m - 1000").select("event_id", "user_id")


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50")
def recent_traces(spark, d):
    return _ev(spark, d).select("event_id", "event_type", "value").orderBy(F.col("event_id").desc()).limit(50)


@query("""WITH r AS (SELECT r_regionkey FROM region WHERE r_regionkey <> 2), n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT * FROM r)), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n))
SELECT 'region' AS t, count(*) AS n FROM r UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)""")
def fk_cascade_delete(spark, d):
    """What stays in each table after a region goes with all that hangs on it."""
    gone = table(spark, d, "region").where("r_regionkey = 2")
    region = table(spark, d, "region").join(F.broadcast(gone.select("r_regionkey")), "r_regionkey", "left_anti")
    nation = table(spark, d, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customer = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t, df in (("region", region), ("nation", nation), ("customer", customer), ("orders", orders))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT n_name, count(*) AS customers, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def fk_chain(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.countDistinct("o_orderkey").alias("orders"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def unique_violations(spark, d):
    """Keys that a unique index would refuse."""
    return table(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphan_indices(spark, d):
    """Index entries without their row."""
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("""WITH u AS (SELECT event_type, user_id, event_id, value FROM events) SELECT event_type, user_id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM u GROUP BY ALL""")
def upsert_on_conflict(spark, d):
    """The latest row of each composite key."""
    r = O.latest(_ev(spark, d).select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id")
    return r.select("event_type", "user_id", F.col("event_id").alias("seq"), "value")


@query("""SELECT c_custkey, coalesce(u.seg, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT c_custkey AS k, 'UPDATED' AS seg FROM customer WHERE c_acctbal < 0) u ON k = c_custkey WHERE c_custkey % 11 <> 0
UNION ALL SELECT c_custkey + 10000000, c_mktsegment FROM customer WHERE c_custkey % 13 = 0""")
def crud_apply(spark, d):
    """Inserts, updates and deletes of keyed rows, as joins."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    updates = c.where("c_acctbal < 0").select("c_custkey", F.lit("UPDATED").alias("new"))
    deletes = c.where("c_custkey % 11 = 0").select("c_custkey")
    kept = c.join(updates, "c_custkey", "left").join(deletes, "c_custkey", "left_anti").select("c_custkey", F.coalesce("new", "segment").alias("segment"))
    return kept.union(c.where("c_custkey % 13 = 0").select(F.col("c_custkey") + 10000000, "segment"))


@query("SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def session_export(spark, d):
    """Each session with its turns in order."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    s = table(spark, d, "conversations").withColumn("line", line).groupBy("conv_id").agg(O.ordered("turn", "line").alias("t"), F.count(F.lit(1)).alias("n"))
    return s.select("conv_id", F.transform("t", lambda x: x["line"]).alias("turns"), "n")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def session_latest(spark, d):
    return O.latest(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "text")


@query("SELECT hash, any_value(n) AS n, min(doc_id) AS first FROM (SELECT sha256(text) AS hash, length(text) AS n, doc_id FROM documents) GROUP BY hash")
def block_store_put(spark, d):
    """Blocks put if absent: one of each hash, with its first owner."""
    return table(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("n"), "doc_id").groupBy("hash").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"))


@query("""SELECT source AS model, 'chunk:' || lpad(i::VARCHAR, 6, '0') AS key, count(*) AS n FROM (SELECT source, unnest(range(0, (length(text) + 255) // 256)) AS i FROM documents) GROUP BY ALL""")
def virtual_view_keys(spark, d):
    """Padded keys of every model's chunks, counted."""
    i = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 256) - 1)).alias("i")
    t = table(spark, d, "documents").where(F.length("text") > 0).select(F.col("source").alias("model"), i)
    return t.groupBy("model", F.format_string("chunk:%06d", F.col("i").cast("long")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS model, list(DISTINCT lang ORDER BY lang) AS layers, count(*) AS n FROM documents GROUP BY source")
def layer_listing(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("model")).agg(F.array_sort(F.collect_set("lang")).alias("layers"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE sha256(text) <> sha256(trim(text))")
def shard_hash_mismatch(spark, d):
    """Shards whose checksum differs from the manifest's; here the manifest is that of trimmed texts."""
    return table(spark, d, "documents").where(F.sha2("text", 256) != F.sha2(F.trim("text"), 256)).select("doc_id")
