"""Goal graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rounds after which execution stops.
ROUNDS = 10
#: Hops of a goal graph at most; the usefulness of a hop with contexts and of one without, and that beyond which it ends early.
HOPS, USEFUL, USELESS, ENOUGH = 3, 0.95, 0.1, 0.9


def levels(goals: DataFrame) -> DataFrame:
    """id, level of goals(id, dependencies): the longest way down to a goal without dependencies.

    Every goal's dependencies are walked in one recursive query, ROUNDS deep at most; who gets that deep is in or behind a
    cycle, or beyond the last round, and never runs, nor does a goal that needs one that doesn't exist.
    """
    spark = goals.sparkSession
    goals.createOrReplaceTempView("_goals")
    goals.select("id", F.explode("dependencies").alias("dep")).createOrReplaceTempView("_needs")
    walked = spark.sql(f"""WITH RECURSIVE walk(id, at, n) AS (
        SELECT id, id, 0 FROM _goals UNION ALL SELECT w.id, d.dep, n + 1 FROM walk w JOIN _needs d ON w.at = d.id WHERE n < {ROUNDS}
    ) SELECT w.id, max(n) AS level, count_if(g.id IS NULL) AS missing FROM walk w LEFT JOIN _goals g ON w.at = g.id GROUP BY w.id""")
    return walked.where((F.col("level") < ROUNDS) & (F.col("missing") == 0)).select("id", F.col("level").cast("long").alias("level"))


def tasks(prompts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """keys, seq (from 1), task, status: two subtasks for prompts that compare or have several parts, else one."""
    low = F.lower(text_col)
    many = T.contains_any(low, ("compare", "difference", "first", "then")) | F.contains(F.col(text_col), F.lit(";"))
    names = F.when(many, F.array(F.lit("subtask_1"), F.lit("subtask_2"))).otherwise(F.array(F.lit("subtask_main")))
    return prompts.select(*keys, F.posexplode(names).alias("p", "task")).select(*keys, (F.col("p") + 1).cast("long").alias("seq"), "task", F.lit("Pending").alias("status"))


def first_pending(steps: DataFrame, seq: str, value: str, *keys: str) -> DataFrame:
    """keys, seq, value of the first step in order whose status is Pending; none where none is."""
    first = steps.where("status = 'Pending'").groupBy(*keys).agg(F.min(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))).alias("f"))
    return first.select(*keys, F.col("f.s").alias(seq), F.col("f.v").alias(value))


def hops(steps: DataFrame, retrieve: Callable[[DataFrame], DataFrame], *keys: str, most: int = HOPS) -> DataFrame:
    """keys, hops, usefulness, stopped, pending, merged of graphs of steps(keys, seq, task, status).

    A hop takes the first pending step of each graph that still runs and asks retrieve(keys, seq, task) for its contexts; the
    step is done with what they say, or without evidence. A graph stops when all its steps are done, or early, when the
    first of them was very useful; after most hops (HOPS at most) it goes no further, stopped or not. usefulness: of the
    last hop; pending: the first step that is still to be done; merged: the results in order, a line each.
    """
    done = None
    left = steps
    for _ in range(min(most, HOPS)):
        now = first_pending(left, "seq", "task", *keys)
        asked = retrieve(now).select(*keys, "seq", "task", "contexts")
        none = F.size("contexts") == 0
        result = F.when(none, F.concat(F.lit("No direct evidence found for: "), "task")).otherwise(F.concat(F.lit("[Step Output for: "), "task", F.lit("] Resolved using contexts: "), F.array_join("contexts", " | ")))
        hop = asked.select(*keys, "seq", result.alias("result"), F.when(none, USELESS).otherwise(USEFUL).alias("useful"))
        done = hop if done is None else done.unionByName(hop)
        # Graphs whose first step was very useful stop; of the others the step done goes.
        stop = done.where((F.col("seq") == 1) & (F.col("useful") > ENOUGH)).select(*keys)
        left = left.join(hop.select(*keys, "seq"), [*keys, "seq"], "left_anti").join(stop, list(keys), "left_anti")
    all_ = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("hops"), F.max(F.struct("seq", "useful"))["useful"].alias("usefulness"), F.max(F.when((F.col("seq") == 1) & (F.col("useful") > ENOUGH), True).otherwise(False)).alias("early"), F.array_sort(F.collect_list(F.struct("seq", "result"))).alias("r"))
    open_ = first_pending(steps.join(done.select(*keys, "seq"), [*keys, "seq"], "left_anti"), "seq", "task", *keys).select(*keys, F.col("task").alias("pending"))
    merged = F.concat(F.array_join(F.transform("r", lambda x: x["result"]), "\n"), F.lit("\n"))
    return all_.join(open_, list(keys), "left").select(*keys, "hops", "usefulness", (F.col("early") | F.col("pending").isNull()).alias("stopped"), "pending", merged.alias("merged"))
