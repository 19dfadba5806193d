"""Ordered folds over event sequences, and small telemetry rules.

A fold's steps are functions that compose to one of the same form. Events are dealt to ranges of (key, order), each range folds
its part of a key to a few numbers, and the parts of a key follow one another; so a key with most of the events is worked
on by many tasks, and no task gathers its events.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows up to which a bracket of values is put in order at once.
MOST_SORTED = 100_000


def ordered(seq: str, *values: str) -> Column:
    """An aggregate: the values as an array in the order of seq."""
    return F.array_sort(F.collect_list(F.struct(seq, *values)))


Steps = list[np.ndarray]


def _reduced(group: np.ndarray, steps: Steps, n: int, unit: list[float], compose: Callable) -> Steps:
    """For each of n groups the composition of its steps, which stand one after another; unit where it has none."""
    place = np.arange(len(group)) - np.searchsorted(group, group)
    while len(group) and place.max() > 0:
        even = place % 2 == 0
        at = np.flatnonzero(even)
        paired = np.r_[even[1:] == 0, False][at] if len(group) > 1 else np.zeros(len(at), bool)
        paired &= np.r_[group[1:] == group[:-1], False][at]
        merged = compose([s[at[paired]] for s in steps], [s[at[paired] + 1] for s in steps])
        steps = [s[at] for s in steps]
        for s, m in zip(steps, merged, strict=True):
            s[paired] = m
        group, place = group[at], place[at] // 2
    out = [np.full(n, u) for u in unit]
    for o, s in zip(out, steps, strict=True):
        o[group] = s
    return out


def fold(events: DataFrame, key: str, seq: str, steps: list[Column], start: Column, unit: list[float], compose: Callable[[Steps, Steps], Steps], walk: Callable[[Column, list[Column]], Column]) -> DataFrame:
    """key, value: what a key's start becomes by its steps in the order of seq.

    start is a column of a key's first event, whose own step is left out; steps are the numbers of an event's step, compose()
    makes those of one step after another, walk() is a step's value as an expression, and unit the step that does nothing.
    A null key is a key like others.
    """
    names = [f"f{i}" for i in range(len(steps))]
    rows = events.select(F.col(key).alias("k"), F.col(seq).alias("s"), start.cast("double").alias("x0"), *[c.cast("double").alias(n) for c, n in zip(steps, names, strict=True)])
    rows = rows.repartitionByRange("k", "s").sortWithinPartitions("k", "s")
    kinds = to_arrow_schema(rows.select("k", "s").schema)
    rests = [f"r{i}" for i in range(len(steps))]
    form = pa.schema([kinds.field("k"), kinds.field("s"), *[pa.field(n, pa.float64()) for n in ("x0", *names, *rests)]])

    def run(batches):
        held = None  # the last key's part: key, order, start, its first step, the rest
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("k").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            group = np.cumsum(np.r_[True, code[1:] != code[:-1]]) - 1
            first = np.zeros(len(code), bool)
            first[begin] = True
            each = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
            rest = _reduced(group[~first], [x[~first] for x in each], len(begin), unit, compose)
            parts = [[batch.column("k")[int(i)].as_py(), batch.column("s")[int(i)].as_py(), batch.column("x0")[int(i)].as_py(), [float(x[i]) for x in each], [float(r[g]) for r in rest]] for g, i in enumerate(begin)]
            if held is not None and held[0] == parts[0][0]:
                follows = compose([np.array([v]) for v in parts[0][3]], [np.array([v]) for v in parts[0][4]])
                held[4] = [float(v[0]) for v in compose([np.array([v]) for v in held[4]], follows)]
                parts[0] = held
            elif held is not None:
                parts.insert(0, held)
            held = parts.pop()
            if parts:
                yield _batch(parts, form)
        if held is not None:
            yield _batch([held], form)

    sql = ", ".join(f"{n} {t}" for n, t in [*rows.select("k", "s").dtypes, *[(n, "double") for n in ("x0", *names, *rests)]])
    parts = rows.mapInArrow(run, sql).groupBy("k").agg(ordered("s", "x0", *names, *rests).alias("v"))

    def follow(x: Column, p: Column) -> Column:
        came = F.when(x.isNull(), p["x0"]).otherwise(walk(x, [p[n] for n in names]))
        return walk(came, [p[n] for n in rests])

    return parts.select(F.col("k").alias(key), F.aggregate("v", F.lit(None).cast("double"), follow).alias("value"))


def _batch(parts: list, form: pa.Schema) -> pa.RecordBatch:
    columns = [[p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]]
    columns += [[p[i][j] for p in parts] for i in (3, 4) for j in range(len(parts[0][3]))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form, strict=True)], schema=form)


def ewma(events: DataFrame, key: str, seq: str, value: str, alpha: float) -> DataFrame:
    """key, ewma: the exponential moving average of each key's values in order, begun with the first value. A step x -> x s + t is affine, and so is one after another."""
    rows = events.where(F.col(value).isNotNull())
    steps = [F.lit(1 - alpha), F.lit(alpha) * F.col(value)]
    made = fold(rows, key, seq, steps, F.col(value), [1.0, 0.0], lambda f, g: [f[0] * g[0], f[1] * g[0] + g[1]], lambda x, f: x * f[0] + f[1])
    return made.withColumnRenamed("value", "ewma")


def clamped_walk(events: DataFrame, key: str, seq: str, delta: Column, low: float = 0.0, high: float = 1.0, start: Column | None = None) -> DataFrame:
    """key, value: a walk by delta in order, held within low and high after each step, from start (a column of the first event, whose delta doesn't count). A step min(max(x + a, l), h) after another is one too."""
    def compose(f, g):
        return [f[0] + g[0], np.clip(f[1] + g[0], g[1], g[2]), np.clip(f[2] + g[0], g[1], g[2])]

    def walk(x, f):
        return F.least(F.greatest(x + f[0], f[1]), f[2])

    return fold(events, key, seq, [delta, F.lit(low), F.lit(high)], start if start is not None else F.lit(0.0), [0.0, -1e300, 1e300], compose, walk)


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key: a maximum of structs, which combines before the shuffle, not a window over a key's rows."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("_seq"), *others)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """p, value: the element at place floor(n p) (from 0) of the sorted values; none without values.

    Approximate quantiles give a bracket about each place, exact counts tell the place within it, and brackets shrink until
    they hold MOST_SORTED rows at most (or one value): only those are sorted.
    """
    v = rows.select(F.col(value).alias("v")).where("v IS NOT NULL")
    n = v.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "p double, value double").select("p", F.col("value").cast(dict(rows.dtypes)[value]).alias("value"))
    found = [_place(v, min(int(n * p), n - 1), n).select(F.lit(float(p)).alias("p"), F.col("v").alias("value")) for p in shares]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _place(v: DataFrame, place: int, n: int) -> DataFrame:
    """The row of v(v), of n rows, that stands at a place in order."""
    below, inside, size = 0, v, n
    while size > MOST_SORTED:
        near = (place - below + 0.5) / size
        low, high = inside.agg(F.percentile_approx("v", [max(0.0, near - 0.002), min(1.0, near + 0.002)], 5000).alias("q")).first().q
        c = inside.agg(F.count_if(F.col("v") < low).alias("a"), F.count_if((F.col("v") >= low) & (F.col("v") <= high)).alias("b")).first()
        if below + c.a <= place < below + c.a + c.b:
            below, size, inside = below + c.a, c.b, inside.where((F.col("v") >= low) & (F.col("v") <= high))
        elif place < below + c.a:
            size, inside = c.a, inside.where(F.col("v") < low)
        else:
            below, size, inside = below + c.a + c.b, size - c.a - c.b, inside.where(F.col("v") > high)
        if low == high and below <= place < below + size:
            return inside.limit(1)
    return inside.orderBy("v").offset(place - below).limit(1)
