"""Planner rules and decisions, over prompts (user turns) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as O
from ..plans import planner as P
from ..registry import query
from ..session import table


def _prompts(spark, d):
    return table(spark, d, "conversations").where("role = 'user'")


_COST = "(CASE WHEN turn % 4 = 0 THEN 0.5::DOUBLE ELSE strlen(text) * 0.15::DOUBLE END + 600)"


@query(f"SELECT conv_id, turn, round({_COST}, 6) AS exact, round({_COST} / 2.4::DOUBLE, 6) AS speculative, round({_COST} * 1.15::DOUBLE, 6) AS sparse, 0.5::DOUBLE AS cached FROM conversations WHERE role = 'user'")
def path_cost(spark, d):
    view, size = F.col("turn") % 4 == 0, F.octet_length("text")
    cost = {a: P.path_cost(p, size, 50, 1.0, 0.7, view) for a, p in (("exact", "ExactDecode"), ("speculative", "SpeculativeDecode"), ("sparse", "SparseDecode"), ("cached", "CachedAnswer"))}
    return _prompts(spark, d).select("conv_id", "turn", *[F.round(c, 6).alias(a) for a, c in cost.items()])


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'CachedAnswer' WHEN turn % 4 = 0 THEN 'ExactDecode'
WHEN (conv_id % 10) / 10.0 >= 0.6 AND NOT (conv_id % 2 = 0 AND 1.15 < 1 / (1 + 2 * ((conv_id % 10) / 10.0))) THEN 'SpeculativeDecode' WHEN conv_id % 2 = 0 THEN 'SparseDecode' ELSE 'ExactDecode' END AS decision FROM conversations WHERE role = 'user'""")
def planner_decision(spark, d):
    c = F.col("conv_id")
    rate = (c % 10) / F.lit(10.0)
    made = P.decide("sparse", F.octet_length("text"), c % 5 == 0, F.col("turn") % 4 == 0, rate, c % 2 == 0, F.lit(0.5), F.lit(0.5))
    return _prompts(spark, d).select("conv_id", "turn", made.alias("decision"))


@query("""WITH l AS (SELECT l_linenumber - 1 AS layer, l_partkey, count(*) AS n, max(l_orderkey) AS last FROM lineitem GROUP BY ALL), m AS (SELECT max(l_orderkey) AS now FROM lineitem)
SELECT layer, l_partkey, CASE WHEN layer <= 1 OR layer >= 5 THEN 'Critical' WHEN last > 0 AND now - last >= 3600 THEN 'Redundant' WHEN n >= 2 AND now - last <= 300 THEN 'Critical' ELSE 'Important' END AS tier FROM l, m""")
def tier_preference(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("layer"), "l_partkey", "l_orderkey")
    now = l.agg(F.max("l_orderkey").alias("now"))
    use = l.groupBy("layer", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last")).join(F.broadcast(now))
    return use.select("layer", "l_partkey", P.tier_preference(F.col("layer"), F.lit(7), F.col("n"), F.col("last"), F.col("now")).alias("tier"))


@query(r"""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'compare') OR contains(lower(text), 'why') OR contains(lower(text), 'explain') OR contains(lower(text), 'analyze') OR contains(lower(text), 'difference') OR contains(lower(text), 'how do i') OR contains(lower(text), 'what is the relation')
OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 18 OR turn >= 8 THEN 'DeepPath' ELSE 'FastPath' END AS profile FROM conversations WHERE role = 'user'""")
def route_profile(spark, d):
    return _prompts(spark, d).select("conv_id", "turn", P.route_profile(F.col("text"), F.col("turn"), F.lit(150.0)).alias("profile"))


@query(r"""SELECT conv_id, turn, round(0.5::DOUBLE + CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 15 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(text, 'code') OR contains(text, 'rust') OR contains(text, 'compile') OR contains(text, 'error') OR contains(text, 'implement') OR contains(text, 'database') THEN 0.2::DOUBLE ELSE 0 END, 6) AS complexity FROM conversations WHERE role = 'user'""")
def query_complexity(spark, d):
    return _prompts(spark, d).select("conv_id", "turn", F.round(P.complexity(F.col("text")), 6).alias("complexity"))


@query("""SELECT op, target, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'embedding' WHEN 2 THEN 'sampling' WHEN 3 THEN 'gemv' WHEN 4 THEN 'gemm' ELSE 'other' END AS op, l_partkey * 200 AS size,
CASE WHEN l_linenumber <= 2 OR l_linenumber = 3 AND l_partkey * 200 < 131072 OR l_linenumber = 4 AND l_partkey * 200 < 262144 THEN 'Cpu' ELSE 'Gpu' END AS target FROM lineitem) GROUP BY ALL""")
def op_route(spark, d):
    n = F.col("l_linenumber")
    op = F.when(n == 1, "embedding").when(n == 2, "sampling").when(n == 3, "gemv").when(n == 4, "gemm").otherwise("other")
    l = table(spark, d, "lineitem").select(op.alias("op"), (F.col("l_partkey") * 200).alias("size"))
    return l.groupBy("op", P.op_route(F.col("size"), F.col("op")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE fits) AS fits, count(*) FILTER (WHERE NOT fits) AS misses FROM (SELECT p_size * (p_partkey % 64 + 1) * 64 * (p_partkey % 64 + 1) * 64 * 6 * (CASE p_partkey % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1 ELSE 4 END) < 4000000000 AND (p_partkey % 64 + 1) * 64 * (p_partkey % 64 + 1) * 64 * (CASE p_partkey % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1 ELSE 4 END) < 134217728 AS fits FROM part)")
def backend_fit(spark, d):
    k = F.col("p_partkey")
    hidden, size = (k % 64 + 1) * 64, F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 1.0).otherwise(4.0)
    fits = P.backend_fits(F.col("p_size"), hidden, size, 4_000_000_000, 134_217_728)
    return table(spark, d, "part").select(fits.alias("f")).agg(F.count_if("f").alias("fits"), F.count_if(~F.col("f")).alias("misses"))


@query("""SELECT event_type, CASE WHEN m > 50 THEN greatest(10 - 2, 1) WHEN m < 50 * 0.7::DOUBLE THEN least(10 + 2, 32) ELSE 10 END AS nprobe, CASE WHEN m > 50 THEN greatest(5 - 1, 1) WHEN m < 50 * 0.7::DOUBLE THEN least(5 + 1, 20) ELSE 5 END AS top_k FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)""")
def adaptive_parameters(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return m.select("event_type", P.adapted(F.lit(10), 2, 1, 32, F.col("m"), 50.0).alias("nprobe"), P.adapted(F.lit(5), 1, 1, 20, F.col("m"), 50.0).alias("top_k"))


@query("SELECT p_partkey, round(p_size + 2 * (p_retailprice / 100) + 0.5::DOUBLE * (p_partkey % 10) + 3 * (p_partkey % 3), 6) AS cost FROM part")
def optimizer_costs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(P.total_cost(F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_partkey") % 10, F.col("p_partkey") % 3), 6).alias("cost"))


@query("SELECT low, high, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN 0.2::DOUBLE WHEN low IS NOT NULL OR high IS NOT NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS selectivity FROM (VALUES (1, 2), (1, NULL), (NULL, 2), (NULL, NULL)) t(low, high)")
def range_selectivity(spark, d):
    t = spark.createDataFrame([(1, 2), (1, None), (None, 2), (None, None)], "low int, high int")
    return t.select("low", "high", P.range_selectivity(F.col("low"), F.col("high")).alias("selectivity"))


@query("SELECT event_type, count(*) AS n, greatest(1, least(floor(count(*) / 500.0)::BIGINT, 8)) AS workers FROM events GROUP BY event_type")
def optimal_workers(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", "n", P.optimal_workers(F.col("n"), 500, 8).alias("workers"))


@query("SELECT 'avg' AS op, round(avg(value), 6) AS value FROM events UNION ALL SELECT 'sum', round(sum(value), 4) FROM events UNION ALL SELECT 'count', count(value) FROM events UNION ALL SELECT 'min', min(value) FROM events UNION ALL SELECT 'max', max(value) FROM events")
def aggregate_op(spark, d):
    e = table(spark, d, "events")
    parts = [P.aggregate(e, op, "value").result.select(F.lit(op).alias("op"), F.round("value", 4 if op == "sum" else 6).cast("double").alias("value")) for op in ("avg", "sum", "count", "min", "max")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT i AS layer, round(0.95::DOUBLE - 0.25::DOUBLE * i / 24, 6) AS threshold FROM range(0, 24) t(i)")
def early_exit_thresholds(spark, d):
    return spark.range(24).select(F.col("id").alias("layer"), F.round(0.95 - 0.25 * F.col("id") / 24, 6).alias("threshold"))


@query("SELECT conv_id, turn, strlen(text) // 4 + 256 <= 2048 AS fits FROM conversations WHERE role = 'user'")
def request_bound(spark, d):
    return _prompts(spark, d).select("conv_id", "turn", (F.floor(F.octet_length("text") / 4) + 256 <= 2048).alias("fits"))


@query("SELECT role, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END >= 2 AS may_write, count(*) AS n FROM conversations GROUP BY role")
def role_check(spark, d):
    """Roles in order: reading, writing, administering."""
    rank = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    return table(spark, d, "conversations").groupBy("role", (rank >= 2).alias("may_write")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey % 3 AS model, max(l_linenumber) + 1 AS layers, min('model.layers.' || lpad(l_linenumber::VARCHAR, 3, '0') || '.weight') AS first FROM lineitem GROUP BY 1")
def layer_names(spark, d):
    """Layer numbers parsed from names, and the count of layers they give."""
    name = F.format_string("model.layers.%03d.weight", F.col("l_linenumber"))
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") % 3).alias("model"), name.alias("name"))
    number = F.expr("try_cast(split(name, '[.]')[2] AS int)")
    return l.groupBy("model").agg((F.max(number) + 1).alias("layers"), F.min("name").alias("first"))


@query("SELECT user_id, max(ts) AS refreshed, date_diff('second', max(ts), (SELECT max(ts) FROM events)) >= 3600 OR bool_or(event_type = 'error') AS stale FROM events GROUP BY user_id")
def view_staleness(spark, d):
    """Materialized views, here one a user: stale if an hour old, or marked by a change."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    v = e.groupBy("user_id").agg(F.max("ts").alias("refreshed"), F.bool_or(F.col("event_type") == "error").alias("marked")).join(F.broadcast(now))
    return v.select("user_id", "refreshed", ((F.timestamp_diff("SECOND", "refreshed", "now") >= 3600) | F.col("marked")).alias("stale"))


@query("SELECT user_id, max(event_id) AS last, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id")
def answer_cache(spark, d):
    """The answer kept for each key, and how often it was asked for."""
    e = table(spark, d, "events").where("event_type <> 'view'").select("user_id", "event_id")
    return O.latest(e, ["user_id"], "event_id").select("user_id", F.col("event_id").alias("last")).join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
