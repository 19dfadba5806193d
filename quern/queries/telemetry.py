"""Planner and latency telemetry over the events: decision = event_type, latency = value, order = event_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds as O
from ..operators.order import numbered
from ..registry import query
from ..session import table

#: Usual latencies, in ms, of the routes that the multipliers refer to.
BASELINES = {"click": 615.0, "purchase": 256.0, "view": 707.0, "signup": 0.5}


def _ev(spark, d):
    return table(spark, d, "events")


@query("""WITH w AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM w)
SELECT p, value FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(p) WHERE i = floor(n * p)""")
def latency_percentiles(spark, d):
    """p50, p95, p99 of the ring of the latest 1,000 latencies, which is the window's definition."""
    return O.percentiles(_ev(spark, d).orderBy(F.col("event_id").desc()).limit(1000), "value", (0.5, 0.95, 0.99))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT p, value FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(p) WHERE i = floor(n * p)""")
def latency_percentiles_all(spark, d):
    """The same places over all events."""
    return O.percentiles(_ev(spark, d), "value", (0.5, 0.95, 0.99))


@query("SELECT event_type AS route, round(list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS ewma FROM events GROUP BY event_type")
def route_ewma(spark, d):
    return O.ewma(_ev(spark, d), "event_type", "event_id", "value", 0.1).select(F.col("event_type").alias("route"), F.round("ewma", 6).alias("ewma"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE), 6) AS ewma FROM events GROUP BY user_id")
def edge_latency_ema(spark, d):
    return O.ewma(_ev(spark, d), "user_id", "event_id", "value", 0.3).select("user_id", F.round("ewma", 6).alias("ewma"))





@query("""WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT user_id, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x0 FROM e WHERE r = 1),
f AS (SELECT user_id, list(CASE WHEN ok THEN 0.05::DOUBLE ELSE -0.15::DOUBLE END ORDER BY event_id) FILTER (WHERE r > 1) AS v FROM e GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(x0, coalesce(v, [])), lambda a, x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, a + x))), 6) AS confidence FROM s JOIN f USING (user_id)""")
def route_confidence(spark, d):
    """Confidence of a route: 1 or 0 after the first outcome, then up by .05 or down by .15, within 0 and 1."""
    e = _ev(spark, d)
    ok = F.col("event_type") != "error"
    walk = O.clamped_walk(e, "user_id", "event_id", F.when(ok, 0.05).otherwise(-0.15), start=F.when(ok, 1.0).otherwise(0.0))
    return walk.select("user_id", F.round("value", 6).alias("confidence"))


@query("""WITH e AS (SELECT user_id, list_prepend(0.5::DOUBLE, list(CASE WHEN event_type = 'view' THEN 0.25::DOUBLE ELSE -0.02::DOUBLE END ORDER BY event_id)) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, a + x))), 6) AS confidence FROM e""")
def paging_confidence(spark, d):
    """Confidence of a page: up by .25 on a use, down by .02 otherwise, from .5."""
    e = _ev(spark, d).select("user_id", "event_id", "event_type")
    begun = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("event_type")).union(e)
    walk = O.clamped_walk(begun, "user_id", "event_id", F.when(F.col("event_type") == "view", 0.25).otherwise(-0.02), start=F.lit(0.5))
    return walk.select("user_id", F.round("value", 6).alias("confidence"))


@query("SELECT event_type AS route, count(*) FILTER (WHERE value >= 50) AS successes, count(*) AS n FROM events GROUP BY event_type")
def route_success(spark, d):
    return _ev(spark, d).groupBy(F.col("event_type").alias("route")).agg(F.count_if(F.col("value") >= 50).alias("successes"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r.route, coalesce(round(s.m, 6), 0.5) AS confidence FROM (VALUES ('view'), ('click'), ('nothing')) r(route) LEFT JOIN (SELECT event_type, count(*) FILTER (WHERE value >= 50) * 1.0::DOUBLE / count(*) AS m FROM events GROUP BY 1) s ON s.event_type = r.route""")
def route_confidence_lookup(spark, d):
    """The confidence of asked routes, a half where nothing is known."""
    asked = spark.createDataFrame([("view",), ("click",), ("nothing",)], "route string")
    known = _ev(spark, d).groupBy("event_type").agg((F.count_if(F.col("value") >= 50) / F.count(F.lit(1))).alias("m"))
    return asked.join(known, asked.route == known.event_type, "left").select("route", F.coalesce(F.round("m", 6), F.lit(0.5)).alias("confidence"))


@query("SELECT coalesce(round(avg(ok), 6), 0.7) AS accept_rate FROM (SELECT CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END AS ok FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 100)")
def accept_rate_history(spark, d):
    """Mean acceptance of the last 100 speculative traces, .7 without any."""
    last = _ev(spark, d).where("event_type = 'purchase'").orderBy(F.col("event_id").desc()).limit(100)
    return last.agg(F.coalesce(F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 6), F.lit(0.7)).alias("accept_rate"))


@query("""WITH l AS (SELECT value / 100 AS sim FROM events ORDER BY event_id DESC LIMIT 100), s AS (SELECT count(*) AS n, avg(CASE WHEN sim < 0.999 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM l)
SELECT n, CASE WHEN n >= 20 AND share > 0.05 THEN round(share, 6) END AS failing FROM s""")
def shadow_gate(spark, d):
    """Of the last 100 shadow scans the share below .999, if there are 20 and it is over a twentieth."""
    last = _ev(spark, d).select("event_id", (F.col("value") / 100).alias("sim")).orderBy(F.col("event_id").desc()).limit(100)
    s = last.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("sim") < 0.999, 1.0).otherwise(0.0)).alias("share"))
    return s.select("n", F.when((F.col("n") >= 20) & (F.col("share") > 0.05), F.round("share", 6)).alias("failing"))


@query("""WITH e AS (SELECT event_type, list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.9::DOUBLE + x * 0.1::DOUBLE) AS m FROM events GROUP BY event_type)
SELECT event_type AS route, round(least(10.0::DOUBLE, greatest(0.1::DOUBLE, m / b)), 6) AS multiplier FROM e JOIN (VALUES ('click', 615.0::DOUBLE), ('purchase', 256.0::DOUBLE), ('view', 707.0::DOUBLE), ('signup', 0.5::DOUBLE)) t(route, b) ON route = event_type""")
def cost_multipliers(spark, d):
    base = spark.createDataFrame(list(BASELINES.items()), "event_type string, b double")
    e = O.ewma(_ev(spark, d), "event_type", "event_id", "value", 0.1).join(F.broadcast(base), "event_type")
    return e.select(F.col("event_type").alias("route"), F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.col("ewma") / F.col("b"))), 6).alias("multiplier"))


@query("SELECT coalesce(round(avg(value + value * 0.5::DOUBLE + json_extract_string(props, '$.k')::DOUBLE), 6), 0) AS avg_total_ms FROM events")
def avg_total_latency(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return _ev(spark, d).agg(F.coalesce(F.round(F.avg(F.col("value") + F.col("value") * 0.5 + k), 6), F.lit(0.0)).alias("avg_total_ms"))


@query("SELECT event_type AS scope, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def profiler_stats(spark, d):
    return _ev(spark, d).groupBy(F.col("event_type").alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, list_sort(list(DISTINCT user_id)) AS s FROM events GROUP BY 1), p AS (SELECT h, s, lag(s) OVER (ORDER BY h) AS b FROM h),
j AS (SELECT h, len(list_intersect(s, b)) * 1.0::DOUBLE / len(list_distinct(list_concat(s, b))) AS j FROM p WHERE b IS NOT NULL ORDER BY h DESC LIMIT 500)
SELECT count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(j), 6) END AS mean, coalesce(count(*) >= 20 AND avg(j) >= 0.55, false) AS passes FROM j""")
def jaccard_gate(spark, d):
    """Mean likeness of the user sets of one hour and the next, over the last 500; passes from 20 samples and .55.

    Sets are compared as rows (hour, user): a user's next hour is looked up by a join, so no hour's set stands in one array,
    and only the short table of hours is ordered.
    """
    seen = _ev(spark, d).select(F.date_trunc("hour", "ts").alias("h"), "user_id").distinct()
    hours = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    near = hours.select("h", "n", F.lag("h").over(Window.orderBy("h")).alias("b"), F.lag("n").over(Window.orderBy("h")).alias("bn")).where("b IS NOT NULL")
    both = seen.join(F.broadcast(near.select("h", "b")), "h").join(seen.withColumnRenamed("h", "b"), ["b", "user_id"]).groupBy("h").agg(F.count(F.lit(1)).alias("same"))
    j = near.join(both, "h", "left").withColumn("same", F.coalesce("same", F.lit(0))).withColumn("j", F.col("same") / (F.col("n") + F.col("bn") - F.col("same")))
    last = j.orderBy(F.col("h").desc()).limit(500)
    s = last.agg(F.count(F.lit(1)).alias("n"), F.avg("j").alias("m"))
    return s.select("n", F.when(F.col("n") >= 20, F.round("m", 6)).alias("mean"), F.coalesce((F.col("n") >= 20) & (F.col("m") >= 0.55), F.lit(False)).alias("passes"))


@query("SELECT n_name AS region, round(avg(c_acctbal), 6) AS latency FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY avg(c_acctbal), n_name LIMIT 1")
def best_region(spark, d):
    """The region of least mean latency."""
    j = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_name").alias("region")).agg(F.avg("c_acctbal").alias("m")).agg(F.min(F.struct("m", "region")).alias("x")).select("x.region", F.round("x.m", 6).alias("latency"))


@query("SELECT s_suppkey AS node, s_acctbal AS vram FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def best_node(spark, d):
    """The healthy node, none of the control group, with the most memory."""
    s = table(spark, d, "supplier").where("s_acctbal > 0 AND s_nationkey <> 0")
    return s.agg(F.max(F.struct(F.col("s_acctbal").alias("vram"), (-F.col("s_suppkey")).alias("n"))).alias("x")).select((-F.col("x.n")).alias("node"), F.col("x.vram").alias("vram"))


@query("SELECT count(*) AS total, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE event_type = 'view') * 1.0::DOUBLE / count(*), 6) END AS hit_rate FROM events")
def cache_hit_rate(spark, d):
    return _ev(spark, d).agg(F.count(F.lit(1)).alias("total"), F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.round(F.try_divide(F.count_if(F.col("event_type") == "view"), F.count(F.lit(1))), 6)).alias("hit_rate"))


@query("""SELECT (SELECT count(DISTINCT label) FROM embeddings) AS collections, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS cache_items, (SELECT count(*) FROM (SELECT label FROM embeddings GROUP BY label HAVING count(*) < 40)) AS degraded""")
def global_counts(spark, d):
    by = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "conversations").agg(F.count(F.lit(1)).alias("cache_items"))
    return by.agg(F.count(F.lit(1)).alias("collections"), F.sum("n").alias("vectors"), F.count_if(F.col("n") < 40).alias("degraded")).join(F.broadcast(c))


# Victims of eviction among users as pages: last use, uses, arrival.

_PAGES = "p AS (SELECT user_id, max(event_id) AS last, count(*) AS uses, min(event_id) AS first, max(ts) AS last_ts FROM events GROUP BY user_id)"


def _pages(spark, d):
    return _ev(spark, d).groupBy("user_id").agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("uses"), F.min("event_id").alias("first"), F.max("ts").alias("last_ts"))


def _victims(name, sql_order, order):
    @query(f"WITH {_PAGES} SELECT user_id, row_number() OVER (ORDER BY {sql_order}, user_id) AS victim FROM p ORDER BY 2 LIMIT 10", name=name)
    def build(spark, d):
        first = _pages(spark, d).orderBy(*order, "user_id").limit(10)
        return first.select("user_id", F.row_number().over(Window.orderBy(*order, "user_id")).cast("long").alias("victim"))

    return build


cache_victims_lru = _victims("cache_victims_lru", "last", ["last"])
cache_victims_lfu = _victims("cache_victims_lfu", "uses, last", ["uses", "last"])
cache_victims_fifo = _victims("cache_victims_fifo", "first", ["first"])


@query(f"WITH {_PAGES}, m AS (SELECT max(ts) AS now FROM events) SELECT user_id FROM p, m WHERE date_diff('second', last_ts, now) >= 3600")
def cache_victims_ttl(spark, d):
    """Users idle for an hour at the end of the events."""
    now = _ev(spark, d).agg(F.max("ts").alias("now"))
    return _pages(spark, d).join(F.broadcast(now)).where(F.timestamp_diff("SECOND", "last_ts", "now") >= 3600).select("user_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
k AS (SELECT user_id, max(CASE WHEN r = 2 THEN event_id END) AS second FROM r WHERE r <= 2 GROUP BY user_id)
SELECT user_id, coalesce(second, 0) AS second FROM k WHERE user_id % 7 <> 0 ORDER BY coalesce(second, 0), user_id LIMIT 10""")
def buffer_victim_lru2(spark, d):
    """The first ten victims by second latest use; pinned pages (ids divisible by 7) stay."""
    e = _ev(spark, d).where("user_id % 7 <> 0")
    second = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))).where("r <= 2").groupBy("user_id").agg(F.max(F.when(F.col("r") == 2, F.col("event_id"))).alias("s"))
    return second.select("user_id", F.coalesce("s", F.lit(0)).alias("second")).orderBy("second", "user_id").limit(10)


@query("""WITH r AS (SELECT user_id, avg(value) AS confidence, max(event_id) AS last_step FROM events GROUP BY user_id) SELECT user_id, row_number() OVER (ORDER BY round(confidence, 9), last_step, user_id) AS victim FROM r ORDER BY 2 LIMIT 10""")
def confidence_victims(spark, d):
    r = _ev(spark, d).groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("c"), F.max("event_id").alias("last"))
    w = Window.orderBy("c", "last", "user_id")
    return r.orderBy("c", "last", "user_id").limit(10).select("user_id", F.row_number().over(w).cast("long").alias("victim"))


@query("WITH r AS (SELECT conv_id, min(turn) AS t, row_number() OVER (ORDER BY conv_id) AS r, count(*) OVER () AS n FROM conversations GROUP BY conv_id) SELECT conv_id FROM r WHERE r <= n - 50")
def oldest_evicted(spark, d):
    """The oldest entries beyond 50."""
    c = table(spark, d, "conversations").select("conv_id").distinct()
    newest = c.orderBy(F.col("conv_id").desc()).limit(50)
    return c.join(F.broadcast(newest), "conv_id", "left_anti")


@query("SELECT event_id, s_suppkey AS replica FROM events JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier WHERE s_acctbal > 0) s ON event_id % n = i")
def round_robin_replica(spark, d):
    """Requests in order over the ready replicas."""
    ready = numbered(table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"), "s_suppkey", "i")
    n = ready.count()
    e = _ev(spark, d).select("event_id", F.pmod("event_id", F.lit(max(n, 1))).cast("long").alias("i"))
    return e.join(ready, "i").select("event_id", F.col("s_suppkey").alias("replica"))


_AGE = "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE date_diff('second', ts, now) {test} 86400"


def _ttl(name, sql, keep):
    @query(_AGE.format(test=sql), name=name)
    def build(spark, d):
        e = _ev(spark, d).select("event_id", "ts")
        now = e.agg(F.max("ts").alias("now"))
        return e.join(F.broadcast(now)).where(keep(F.timestamp_diff("SECOND", "ts", "now"))).select("event_id")

    return build


ttl_alive_memory = _ttl("ttl_alive_memory", "<", lambda age: age < 86400)
ttl_alive_edge = _ttl("ttl_alive_edge", "<=", lambda age: age <= 86400)
ttl_alive_answer = _ttl("ttl_alive_answer", "<=", lambda age: ~(age > 86400))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY ts, event_id")
def log_tail(spark, d):
    """Entries after a time, in order."""
    e = _ev(spark, d).select("event_id", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("m")))).where(F.col("ts") > F.col("m") - F.expr("INTERVAL 1 DAY")).select("event_id", "ts").orderBy("ts", "event_id")
