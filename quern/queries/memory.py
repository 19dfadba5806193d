"""Memories, evidence, goals and sessions.

Memories are the documents: tier by language (en semantic, fr episodic, others working), confidence by the quality label,
idle seconds by id. New facts and chunks are the benchmark's texts, answers the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import folds as O
from ..operators import graph as G
from ..operators.order import lagged
from ..registry import query
from ..session import table

_M = """m AS (SELECT d.doc_id AS id, d.text AS content, CASE d.lang WHEN 'en' THEN 'Semantic' WHEN 'fr' THEN 'Episodic' ELSE 'Working' END AS tier, 0.6::DOUBLE + 0.3::DOUBLE * coalesce(l.quality, 0) AS confidence,
(d.doc_id % 60)::DOUBLE AS idle, d.doc_id % 9 AS usage, d.doc_id % 17 = 0 AS retracted, d.source AS provenance FROM documents d LEFT JOIN labels l USING (doc_id))"""
_RATE = "CASE tier WHEN 'Working' THEN 0.05::DOUBLE WHEN 'Episodic' THEN 0.005::DOUBLE ELSE 0.0005::DOUBLE END"
_WS = r"list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^\P{{L}}+', ''), '\P{{L}}+$', '')), lambda x: x <> '' AND x NOT IN ('the','and','a','of','to','in','is','that','it','for','on','with','as')))"
PROMPT = "Worthless idiot in the loser trash"


def memories(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", F.col("source").alias("provenance"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    tier = F.when(F.col("lang") == "en", "Semantic").when(F.col("lang") == "fr", "Episodic").otherwise("Working")
    rows = docs.join(labels, "id", "left")
    return rows.select("id", "content", tier.alias("tier"), (F.lit(0.6) + F.lit(0.3) * F.coalesce("quality", F.lit(0))).alias("confidence"), (F.col("id") % 60).cast("double").alias("idle"), (F.col("id") % 9).alias("usage"), (F.col("id") % 17 == 0).alias("retracted"), "provenance")


def decayed():
    rate = F.when(F.col("tier") == "Working", 0.05).when(F.col("tier") == "Episodic", 0.005).otherwise(0.0005)
    return F.greatest(F.lit(0.0), F.col("confidence") * F.exp(-rate * F.col("idle")))


@query(f"WITH {_M} SELECT id, round(greatest(0, confidence * exp(-{_RATE} * idle)), 6) AS confidence FROM m")
def memory_decay(spark, d):
    return memories(spark, d).select("id", F.round(decayed(), 6).alias("confidence"))


@query(f"WITH {_M} SELECT count(*) FILTER (WHERE confidence * exp(-{_RATE} * idle) < 0.5) AS pruned, count(*) FILTER (WHERE confidence * exp(-{_RATE} * idle) >= 0.5) AS kept FROM m")
def memory_prune(spark, d):
    return memories(spark, d).select((decayed() < 0.5).alias("p")).agg(F.count_if("p").alias("pruned"), F.count_if(~F.col("p")).alias("kept"))


@query(f"WITH {_M} SELECT id, CASE WHEN up THEN 'Semantic' ELSE tier END AS tier, CASE WHEN up THEN 1.0::DOUBLE ELSE round(confidence, 6) END AS confidence FROM (SELECT *, tier = 'Episodic' AND usage >= 5 AND confidence > 0.85 AS up FROM m)")
def memory_promote(spark, d):
    up = (F.col("tier") == "Episodic") & (F.col("usage") >= 5) & (F.col("confidence") > 0.85)
    return memories(spark, d).select("id", F.when(up, "Semantic").otherwise(F.col("tier")).alias("tier"), F.when(up, 1.0).otherwise(F.round("confidence", 6)).alias("confidence"))


@query(f"""WITH {_M}, s AS (SELECT id, len(list_filter(['worthless','idiot','loser','trash'], lambda w: contains(lower(content), w))) / 4.0::DOUBLE * confidence * exp(-{_RATE} * idle) AS score FROM m WHERE NOT retracted)
SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.15 ORDER BY round(s.score, 9) DESC, id LIMIT 2""")
def memory_inject(spark, d):
    """The two memories worth putting before a prompt: share of its words that they contain, times decayed confidence."""
    ws = T.memory_words(F.lit(PROMPT))
    low = F.lower("content")
    share = F.size(F.filter(ws, lambda w: F.contains(low, w))) / F.size(ws)
    s = memories(spark, d).where("NOT retracted").select("id", (share * decayed()).alias("score")).where("score >= 0.15")
    return s.orderBy(F.round("score", 9).desc(), "id").limit(2).withColumn("score", F.round("score", 6))


#: Negations and pairs of opposites.
NEGATIONS = ("not", "no", "never", "cannot", "isn't", "aren't", "won't", "don't", "doesn't", "false", "incorrect")
ANTONYMS = (("true", "false"), ("enable", "disable"), ("enabled", "disabled"), ("hot", "cold"), ("warm", "cold"), ("high", "low"), ("active", "inactive"), ("allow", "deny"), ("allowed", "denied"), ("success", "failure"), ("successful", "failed"))


def _opposed_sql():
    neg = lambda c: "(" + " OR ".join(f"contains({c}, '{n.replace(chr(39), chr(39) * 2)}')" for n in NEGATIONS) + ")"
    pairs = " OR ".join(f"((contains(f, '{a}') OR contains(c, '{a}')) AND (contains(f, '{b}') OR contains(c, '{b}')) AND contains(f, '{a}') <> contains(c, '{a}'))" for a, b in ANTONYMS)
    return f"({neg('f')} <> {neg('c')} OR {pairs})"


@query(f"""WITH {_M}, s AS (SELECT id, lower(content) AS c, {_WS.format(c='content')} AS w FROM m WHERE NOT retracted AND tier = 'Semantic' AND confidence >= 0.8),
f AS (SELECT item_id, lower(text) AS f, {_WS.format(c='text')} AS v FROM benchmark)
SELECT item_id, id FROM f, s WHERE len(v) > 0 AND len(w) > 0 AND len(list_intersect(v, w)) * 1.0::DOUBLE / least(len(v), len(w)) >= 0.4 AND {_opposed_sql()}""")
def memory_contradiction(spark, d):
    """Facts against semantic memories with much the same words, one of them negated or with an opposite."""
    mem = memories(spark, d).where("NOT retracted AND tier = 'Semantic' AND confidence >= 0.8").select("id", F.lower("content").alias("c"), F.array_distinct(T.memory_words(F.col("content"))).alias("w"))
    facts = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("f"), F.array_distinct(T.memory_words(F.col("text"))).alias("v"))
    near = E.alike(facts.select(F.col("item_id").alias("a"), F.col("v").alias("aw")), mem.select(F.col("id").alias("b"), F.col("w").alias("bw")), 0.4).select(F.col("a").alias("item_id"), F.col("b").alias("id"))
    near = near.join(facts.select("item_id", "f"), "item_id").join(mem.select("id", "c"), "id")
    f, c = F.col("f"), F.col("c")
    opposed = T.contains_any(f, NEGATIONS) != T.contains_any(c, NEGATIONS)
    for a, b in ANTONYMS:
        opposed = opposed | ((F.contains(f, F.lit(a)) | F.contains(c, F.lit(a))) & (F.contains(f, F.lit(b)) | F.contains(c, F.lit(b))) & (F.contains(f, F.lit(a)) != F.contains(c, F.lit(a))))
    return near.where(opposed).select("item_id", "id")


@query("""WITH e AS (SELECT user_id, list_prepend(0.8::DOUBLE, list(CASE WHEN event_type = 'error' THEN -0.05::DOUBLE ELSE 0.15::DOUBLE END ORDER BY event_id)) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, a + x))), 6) AS confidence FROM e""")
def memory_reinforce_fold(spark, d):
    """Confidence from .8, reinforced and weakened in order, within 0 and 1."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    begun = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("event_type")).union(e)
    return O.clamped_walk(begun, "user_id", "event_id", F.when(F.col("event_type") == "error", -0.05).otherwise(0.15), start=F.lit(0.8)).select("user_id", F.round("value", 6).alias("confidence"))


@query("SELECT user_id AS id, 1 + count(*) AS usage, max(ts) AS last_accessed FROM events GROUP BY user_id")
def memory_touch(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg((1 + F.count(F.lit(1))).alias("usage"), F.max("ts").alias("last_accessed"))


@query(f"WITH {_M} SELECT id, CASE WHEN l.doc_id IS NOT NULL THEN 0.0::DOUBLE ELSE round(confidence, 6) END AS confidence, retracted OR l.doc_id IS NOT NULL AS retracted, CASE WHEN l.doc_id IS NOT NULL THEN 'toxic' END AS reason FROM m LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = id")
def memory_retract(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("reason"))
    r = memories(spark, d).join(gone, "id", "left")
    return r.select("id", F.when(F.col("reason").isNotNull(), 0.0).otherwise(F.round("confidence", 6)).alias("confidence"), (F.col("retracted") | F.col("reason").isNotNull()).alias("retracted"), "reason")


@query("SELECT 'mem_ep_' || conv_id AS id, 'Session ' || conv_id || ': User queried: ''' || arg_min(text, turn) || '''. Assistant replied: ''' || arg_max(text, turn) || '''.' AS content FROM conversations GROUP BY conv_id")
def episodic_distill(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("z"))
    return s.select(F.concat(F.lit("mem_ep_"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("Session "), F.col("conv_id").cast("string"), F.lit(": User queried: '"), "a", F.lit("'. Assistant replied: '"), "z", F.lit("'.")).alias("content"))


@query("""WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'user')
SELECT conv_id, 1000000 + 13000 * i + o AS timestamp_ms, t AS event_type FROM u, (VALUES (0, 'ChatTurn'), (500, 'KvCheckpoint'), (2500, 'GoalHop'), (3000, 'EpisodicMemory')) e(o, t)""")
def session_timeline(spark, d):
    """Four events for each of a session's exchanges, at fixed offsets."""
    from pyspark.sql import Window

    u = table(spark, d, "conversations").where("role = 'user'").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("i"))
    events = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(t).alias("t")) for o, t in ((0, "ChatTurn"), (500, "KvCheckpoint"), (2500, "GoalHop"), (3000, "EpisodicMemory"))])
    return u.select("conv_id", "i", F.explode(events).alias("e")).select("conv_id", (F.lit(1000000) + 13000 * F.col("i") + F.col("e.o")).alias("timestamp_ms"), F.col("e.t").alias("event_type"))


_SENT = r"list_filter(list_transform(regexp_split_to_array({c}, '[.?!]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_ANS = rf"a AS (SELECT conv_id, turn, unnest({_SENT.format(c='text')}) AS sentence, generate_subscripts({_SENT.format(c='text')}, 1) - 1 AS pos FROM conversations WHERE role = 'assistant')"
_SPACE = r"list_distinct(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"


@query(rf"""WITH {_ANS}, s AS (SELECT *, {_SPACE.format(c='sentence')} AS v FROM a), b AS (SELECT item_id, {_SPACE.format(c='text')} AS w FROM benchmark),
g AS (SELECT conv_id, turn, pos, list(item_id ORDER BY item_id) AS chunks, max(len(list_intersect(v, w)) * 1.0::DOUBLE / len(v)) AS score FROM s, b WHERE len(list_intersect(v, w)) * 1.0::DOUBLE / len(v) > 0.3 GROUP BY ALL)
SELECT s.conv_id, s.turn, s.pos, coalesce(chunks, []) AS chunks, round(coalesce(score, 0), 6) AS score FROM s LEFT JOIN g USING (conv_id, turn, pos)""")
def evidence_map(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'")
    r = E.evidence(answers, "text", table(spark, d, "benchmark"), "item_id", "text", "conv_id", "turn")
    return r.select("conv_id", "turn", F.col("pos").cast("long"), "chunks", F.round("score", 6).alias("score"))


_CW = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) > 1 AND x NOT IN ('the','a','an','and','or','but','is','are','was','were','to','of','in','on','at','for','with','by','about','as'))"


@query(rf"""WITH {_ANS}, s AS (SELECT *, {_CW.format(c='sentence')} AS v FROM a), b AS (SELECT item_id, {_CW.format(c='text')} AS w FROM benchmark),
g AS (SELECT conv_id, turn, pos, max(len(list_filter(v, lambda x: list_contains(w, x))) * 1.0::DOUBLE / len(v)) AS r FROM s, b WHERE len(v) > 0 GROUP BY ALL),
c AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (WHERE r >= 0.3) AS supported FROM s LEFT JOIN g USING (conv_id, turn, pos) GROUP BY ALL),
e AS (SELECT t.conv_id, t.turn, coalesce(supported, 0) AS supported, coalesce(claims, 0) AS claims FROM conversations t LEFT JOIN c USING (conv_id, turn) WHERE role = 'assistant')
SELECT *, round(supported * 1.0::DOUBLE / greatest(claims, 1), 6) AS score, CASE WHEN supported * 1.0 / greatest(claims, 1) >= 0.8 THEN 'Pass' WHEN supported * 1.0 / greatest(claims, 1) >= 0.5 THEN 'Flag' ELSE 'Fail' END AS status FROM e""")
def verify_claims(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'")
    r = E.verify(answers, "text", table(spark, d, "benchmark"), "item_id", "text", "conv_id", "turn")
    return r.withColumn("score", F.round("score", 6))


@query(rf"""WITH {_ANS}, c AS (SELECT conv_id, string_agg(lower(text), ' ') AS ctx FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
s AS (SELECT a.conv_id, turn, pos, list_filter(list_transform(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^\P{{L}}+', ''), '\P{{L}}+$', '')), lambda x: strlen(x) > 3) AS w, ctx FROM a JOIN c USING (conv_id) WHERE len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) >= 3),
f AS (SELECT conv_id, turn, pos, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: contains(ctx, lower(x)))) * 1.0::DOUBLE / len(w) END AS confidence FROM s)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS citation_index, round(confidence, 6) AS confidence FROM f WHERE confidence >= 0.5""")
def grounded_citations(spark, d):
    """Sentences of answers half of whose longer words stand in the session's other turns."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations")
    ctx = t.where("role <> 'assistant'").groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("ctx"))
    rows = E.sentence_rows(t.where("role = 'assistant'"), "text", T.words, "conv_id", "turn").where(F.size("ws") >= 3).join(ctx, "conv_id")
    w = F.filter(F.transform("ws", lambda x: F.regexp_replace(F.regexp_replace(x, r"^\P{L}+", ""), r"\P{L}+$", "")), lambda x: F.octet_length(x) > 3)
    rows = rows.withColumn("w", w).withColumn("c", F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.filter("w", lambda x: F.contains(F.col("ctx"), F.lower(x)))) / F.nullif(F.size("w"), F.lit(0))))
    return rows.where("c >= 0.5").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")).cast("long").alias("citation_index"), F.round("c", 6).alias("confidence"))


@query("""SELECT conv_id, turn, unnest(CASE WHEN contains(lower(text), 'compare') OR contains(lower(text), 'difference') OR contains(lower(text), 'first') OR contains(lower(text), 'then') OR contains(text, ';') THEN ['subtask_1', 'subtask_2'] ELSE ['subtask_main'] END) AS task,
CASE WHEN contains(lower(text), 'compare') OR contains(lower(text), 'difference') THEN 'comparative' WHEN contains(lower(text), 'first') OR contains(lower(text), 'then') OR contains(text, ';') THEN 'multi_part' ELSE 'single' END AS kind FROM conversations WHERE role = 'user'""")
def goal_decompose(spark, d):
    low = F.lower("text")
    kind = F.when(T.contains_any(low, ("compare", "difference")), "comparative").when(T.contains_any(low, ("first", "then")) | F.contains(F.col("text"), F.lit(";")), "multi_part").otherwise("single")
    t = table(spark, d, "conversations").where("role = 'user'").withColumn("kind", kind)
    tasks = F.when(F.col("kind") == "single", F.array(F.lit("subtask_main"))).otherwise(F.array(F.lit("subtask_1"), F.lit("subtask_2")))
    return t.select("conv_id", "turn", F.explode(tasks).alias("task"), "kind")


GOALS = [("a", []), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("e", ["d"]), ("x", ["y"]), ("y", ["x"]), ("z", ["x", "a"])]


def goals(spark):
    return spark.createDataFrame(GOALS, "id string, dependencies array<string>")


@query("""WITH RECURSIVE g(id, dep) AS (VALUES ('a', NULL), ('b', 'a'), ('c', 'a'), ('d', 'b'), ('d', 'c'), ('e', 'd')), l AS (SELECT id, 0 AS level FROM g WHERE dep IS NULL UNION ALL SELECT g.id, l.level + 1 FROM g JOIN l ON g.dep = l.id)
SELECT id, max(level)::BIGINT AS level FROM l GROUP BY id""")
def goal_levels(spark, d):
    """The round in which each goal runs: after all it depends on, in ten rounds at most; goals in or behind a cycle never run."""
    from ..operators.graph import levels

    return levels(goals(spark))


@query("""SELECT task_from AS source, task_to AS target, 'dependency' AS type, count(*) AS n FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b, role AS task_to, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS task_from FROM conversations) WHERE b IS NOT NULL GROUP BY ALL""")
def goal_dependency_edges(spark, d):
    """Edges from each step to the next, counted by kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select(F.lag("role").over(w).alias("source"), F.col("role").alias("target"))
    return t.where("source IS NOT NULL").groupBy("source", "target", F.lit("dependency").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_M} SELECT 'memory' AS type, id::VARCHAR AS id, tier, round(confidence, 6) AS confidence FROM m UNION ALL SELECT DISTINCT 'session', 'session_' || provenance, NULL, NULL::DOUBLE FROM m")
def memory_graph_nodes(spark, d):
    m = memories(spark, d)
    a = m.select(F.lit("memory").alias("type"), F.col("id").cast("string").alias("id"), "tier", F.round("confidence", 6).alias("confidence"))
    b = m.select("provenance").distinct().select(F.lit("session").alias("type"), F.concat(F.lit("session_"), "provenance").alias("id"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("double").alias("confidence"))
    return a.union(b)


@query(f"WITH {_M} SELECT id AS source, 'session_' || provenance AS target, 'session' AS type FROM m UNION ALL SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY provenance ORDER BY id)::VARCHAR AS target, 'session_link' FROM m) WHERE target IS NOT NULL")
def memory_graph_edges(spark, d):
    """Memory to session, and each memory to the next of its session: the links of all pairs follow from these, without their square."""
    m = memories(spark, d).select("id", "provenance")
    a = m.select(F.col("id").alias("source"), F.concat(F.lit("session_"), "provenance").alias("target"), F.lit("session").alias("type"))
    b = lagged(m, "provenance", "id", "id", "before").where("before IS NOT NULL").select(F.col("before").alias("source"), F.col("id").cast("string").alias("target"), F.lit("session_link").alias("type"))
    return a.union(b)


_GOALS = """t AS (SELECT conv_id, turn, text, contains(lower(text), 'compare') OR contains(lower(text), 'difference') AS cmp, contains(lower(text), 'first') OR contains(lower(text), 'then') OR contains(text, ';') AS many FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, turn, text, unnest(CASE WHEN cmp OR many THEN ['subtask_1', 'subtask_2'] ELSE ['subtask_main'] END) AS task, unnest(CASE WHEN cmp OR many THEN [1, 2] ELSE [1] END) AS seq FROM t)"""


@query(f"""WITH {_GOALS}, p AS (SELECT conv_id, turn, 'prompt_' || conv_id || '_' || turn AS pid, task, seq FROM g)
SELECT pid AS source, pid || '_' || task AS target, 'decomposition' AS type FROM p UNION ALL SELECT pid || '_subtask_1', pid || '_subtask_2', 'dependency' FROM p WHERE seq = 2""")
def prompt_graph_edges(spark, d):
    """A prompt's node to each of its goals, and each goal to the next."""
    p = G.tasks(table(spark, d, "conversations").where("role = 'user'"), "text", "conv_id", "turn").withColumn("pid", F.concat_ws("_", F.lit("prompt"), "conv_id", "turn"))
    a = p.select(F.col("pid").alias("source"), F.concat_ws("_", "pid", "task").alias("target"), F.lit("decomposition").alias("type"))
    b = p.where("seq = 2").select(F.concat(F.col("pid"), F.lit("_subtask_1")).alias("source"), F.concat_ws("_", "pid", "task").alias("target"), F.lit("dependency").alias("type"))
    return a.union(b)


@query(f"WITH {_GOALS} SELECT 'prompt_' || conv_id || '_' || turn AS id, 'prompt' AS type, NULL AS status FROM (SELECT DISTINCT conv_id, turn FROM g) UNION ALL SELECT 'prompt_' || conv_id || '_' || turn || '_' || task, 'goal', 'Pending' FROM g")
def prompt_graph_nodes(spark, d):
    p = G.tasks(table(spark, d, "conversations").where("role = 'user'"), "text", "conv_id", "turn").withColumn("pid", F.concat_ws("_", F.lit("prompt"), "conv_id", "turn"))
    a = p.where("seq = 1").select(F.col("pid").alias("id"), F.lit("prompt").alias("type"), F.lit(None).cast("string").alias("status"))
    return a.union(p.select(F.concat_ws("_", "pid", "task").alias("id"), F.lit("goal").alias("type"), F.col("status")))


@query(f"""WITH {_GOALS}, c AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS ctx FROM conversations WHERE role = 'assistant' AND turn % 4 = 1 GROUP BY conv_id),
n AS (SELECT conv_id, turn, max(seq) AS tasks FROM g GROUP BY ALL),
h AS (SELECT n.conv_id, n.turn, tasks, CASE WHEN ctx IS NULL THEN least(tasks, 3) ELSE 1 END AS hops, ctx FROM n LEFT JOIN c USING (conv_id))
SELECT conv_id, turn, hops::BIGINT AS hops, CASE WHEN ctx IS NULL THEN 0.1::DOUBLE ELSE 0.95::DOUBLE END AS usefulness, ctx IS NOT NULL OR hops = tasks AS stopped, CASE WHEN hops < tasks THEN 'subtask_2' END AS pending,
CASE WHEN ctx IS NOT NULL THEN '[Step Output for: ' || CASE WHEN tasks = 2 THEN 'subtask_1' ELSE 'subtask_main' END || '] Resolved using contexts: ' || ctx || chr(10)
WHEN tasks = 2 THEN 'No direct evidence found for: subtask_1' || chr(10) || 'No direct evidence found for: subtask_2' || chr(10) ELSE 'No direct evidence found for: subtask_main' || chr(10) END AS merged FROM h""")
def goal_hops(spark, d):
    """Goals of a session's prompts, worked off in hops that ask the session's answers for contexts: hops until it stops, the last one's usefulness, the first goal still pending, and the results put together."""
    t = table(spark, d, "conversations")
    contexts = t.where("role = 'assistant' AND turn % 4 = 1").groupBy("conv_id").agg(F.transform(O.ordered("turn", "text"), lambda x: x["text"]).alias("contexts"))
    tasks = G.tasks(t.where("role = 'user'"), "text", "conv_id", "turn")

    def retrieve(asked):
        return asked.join(contexts, "conv_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))

    return G.hops(tasks, retrieve, "conv_id", "turn")


@query("SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations WHERE turn % 3 <> 0 GROUP BY conv_id")
def first_pending_task(spark, d):
    """Of each session's steps the first that is pending (two in three are)."""
    return G.first_pending(table(spark, d, "conversations").withColumn("status", F.when(F.col("turn") % 3 == 0, "Completed").otherwise("Pending")), "turn", "role", "conv_id").select("conv_id", "turn", "role")


@query(r"""WITH c AS (SELECT conv_id, string_agg(turn || chr(1) || text, chr(1) ORDER BY turn) AS ctx FROM conversations WHERE role <> 'user' GROUP BY conv_id)
SELECT t.conv_id, t.turn, sha256(t.text || chr(1) || 'model-1' || coalesce(chr(1) || c.ctx, '')) AS hash FROM conversations t LEFT JOIN c USING (conv_id) WHERE t.role = 'user'""")
def context_hash(spark, d):
    """The key of an answer: a hash of its prompt, the model's version and the contexts, each with its id, in order."""
    t = table(spark, d, "conversations")
    chunks = t.where("role <> 'user'").groupBy("conv_id").agg(O.ordered("turn", "text").alias("chunks"))
    asked = t.where("role = 'user'").join(chunks, "conv_id", "left")
    return asked.select("conv_id", "turn", T.context_hash(F.col("text"), F.lit("model-1"), F.transform("chunks", lambda c: F.struct(c["turn"].cast("string").alias("id"), c["text"].alias("text")))).alias("hash"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, avg(n_chars) AS size FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size > 2500, n DESC, lang) AS r FROM c WHERE lang <> 'en')
SELECT source, lang AS model, n FROM r WHERE r = 1""")
def model_for_task(spark, d):
    """Of the models that fit each task the first: those whose mean size is within bounds before others, then the one used most, then by name."""
    c = table(spark, d, "documents").where("lang <> 'en'").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("size"))
    best = c.groupBy("source").agg(F.min(F.struct((F.col("size") > 2500).alias("a"), (-F.col("n")).alias("b"), F.col("lang").alias("c"))).alias("x"))
    return best.select("source", F.col("x.c").alias("model"), (-F.col("x.b")).alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'under')")
def substring_filter(spark, d):
    """Contexts in which every value occurs, whatever its case."""
    low = F.lower("text")
    return table(spark, d, "documents").where(F.forall(F.array(F.lit("license"), F.lit("UNDER")), lambda v: F.contains(low, F.lower(v)))).select("doc_id")
