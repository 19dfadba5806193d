"""Pairs within buckets, whatever the buckets' sizes.

Rows with a bucket's key are brought together by one shuffle. A sample of the rows, one in SAMPLED, tells which buckets are
large before that: their rows are dealt to blocks of about BLOCK rows by a hash, and every pair of blocks is a group of
its own in that same shuffle. A bucket of up to BLOCK rows is worked on as it streams by. A larger one that the sample
didn't tell is set aside, cut into blocks and dealt out in a second shuffle. So no task holds more than two blocks of a
bucket or so, and every pair is still looked at exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import MOST_SENT, cut

#: Rows of a block. Buckets beyond it are dealt out in pairs of blocks.
BLOCK = 4096
#: One row in so many is in the sample; rows of a bucket in the sample from which it is dealt out at once.
SAMPLED, LEAST_SEEN = 64, 96


def sampled(rows: DataFrame, column: str) -> DataFrame:
    """One row in SAMPLED, by a hash of a column; large_buckets() takes what is made from these as buckets' rows are from all."""
    return rows.where(F.pmod(F.xxhash64(F.lit(11), column), F.lit(SAMPLED)) == 0)


def runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that agree in keys, from batches sorted by them; a run beyond BLOCK rows comes in several tables, all but the last of BLOCK rows at least. The flag says that a run ends with this table; a run whose tables all have BLOCK rows ends without it."""
    held: list[pa.Table] = []
    last = None

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change), t.num_rows]
        first = tuple(c[0] for c in cols)
        for n, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            now = first if n == 0 else tuple(c[a] for c in cols)
            if now != last and held:
                yield last, True, pa.concat_tables(held)
                held = []
            last = now
            held.append(t.slice(a, b - a))
            if sum(x.num_rows for x in held) >= BLOCK:
                yield last, False, pa.concat_tables(held)
                held = []
    if held:
        yield last, True, pa.concat_tables(held)


def large_buckets(sample: DataFrame, key: str) -> DataFrame | None:
    """key, _parts: the buckets that a sample tells to be large, the largest MOST_SENT of them, and into how many blocks they go; None without any. Others are large only once they are met."""
    seen = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEN)
    large = cut(seen.orderBy(F.col("n").desc(), key).limit(MOST_SENT).select(key, F.ceil(F.col("n") * F.lit(SAMPLED) / F.lit(BLOCK)).cast("long").alias("_parts")))
    return None if large.isEmpty() else large


def _in_blocks(rows: DataFrame, key: str, large: DataFrame | None) -> DataFrame:
    """rows with _i, _j, _block: -1, -1, 0, or in large buckets a copy for each pair of blocks that the row's block is in."""
    if large is None:
        return rows.select(F.lit(-1).cast("long").alias("_i"), F.lit(-1).cast("long").alias("_j"), F.lit(0).cast("long").alias("_block"), *rows.columns)
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("_block", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), F.lit(0)).cast("long"))
    dealt = dealt.withColumn("_other", F.explode(F.when(F.col("_parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return dealt.select(low.alias("_i"), F.when(F.col("_other") < 0, -1).otherwise(high).cast("long").alias("_j"), "_block", *rows.columns)


def bucket_pairs(rows: DataFrame, key: str, within: Callable[[pa.Table], dict], across: Callable[[pa.Table, pa.Table], dict], made: str, large: DataFrame | None = None, many: Callable[[pa.Table], dict] | None = None) -> DataFrame:
    """What within() makes of every bucket, or of a block of a large one, and across() of every two blocks of one.

    rows: a column of longs that names the bucket, and others; no row twice. made: the columns of the result, "a long, b
    long"; within and across return them as a dict of lists or arrays. many: what within() makes of several buckets, one
    after another, at once; small buckets go to it together where it is given. large: what large_buckets() gives; the
    result depends on neither. Buckets of one row make nothing. An empty
    table is fine; rows with a null key must be left out by the caller.
    """
    names = rows.columns
    made_names = [x.split()[0] for x in made.split(",")]
    row_schema = to_arrow_schema(rows.schema)
    made_schema = pa.schema([(n, pa.int64()) for n in made_names])
    flat = pa.schema([("_block", pa.int64()), *[(f"_m_{n}", pa.int64()) for n in made_names], *[(f"_r_{f.name}", f.type) for f in row_schema]])
    flat_sql = ", ".join(["_block long", *[f"_m_{n} long" for n in made_names], *[f"_r_{n} {t}" for n, t in rows.dtypes]])

    def put(count, **columns):
        return pa.Table.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in flat], schema=flat).combine_chunks().to_batches()

    def of_blocks(k, held):
        """What a block, or two, make; k: key and numbers of the blocks."""
        t = pa.concat_tables(held)
        block, plain = t.column("_block").to_numpy(), t.select(names)
        if k[1] == k[2]:
            return within(plain) if t.num_rows > 1 else None
        one, two = plain.filter(pa.array(block == k[1])), plain.filter(pa.array(block == k[2]))
        return across(one, two) if one.num_rows and two.num_rows else None

    def first(batches):
        def made_of(found):
            if found is not None and (n := len(found[made_names[0]])):
                yield from put(n, **{f"_m_{x}": pa.array(found[x], pa.int64()) for x in made_names})

        # A group ends where the key changes or the rows end: a run of exactly BLOCK rows has no table that says so.
        held, aside, now = [], 0, None
        small, n_small = [], 0
        for k, done, t in runs(batches, [key, "_i", "_j"]):
            if k != now:
                if held:
                    yield from made_of(of_blocks(now, held))
                held, aside, now = [], 0, k
            if n_small >= BLOCK:
                yield from made_of(many(pa.concat_tables(small)))
                small, n_small = [], 0
            if k[1] >= 0:
                held.append(t)
            elif done and not aside and t.num_rows <= BLOCK:
                if t.num_rows > 1 and many is not None:
                    small.append(t.select(names))
                    n_small += t.num_rows
                elif t.num_rows > 1:
                    yield from made_of(within(t.select(names)))
            else:
                block = (aside + np.arange(t.num_rows)) // BLOCK
                aside += t.num_rows
                yield from put(t.num_rows, _block=pa.array(block, pa.int64()), **{f"_r_{f.name}": t.column(f.name).cast(f.type) for f in row_schema})
        if held:
            yield from made_of(of_blocks(now, held))
        if small:
            yield from made_of(many(pa.concat_tables(small)))

    def second(batches):
        def made_of(found):
            if found is not None and len(found[made_names[0]]):
                yield from pa.Table.from_arrays([pa.array(found[n], pa.int64()) for n in made_names], schema=made_schema).to_batches()

        held, now = [], None
        for k, _, t in runs(batches, [key, "_i", "_j"]):
            if k != now and held:
                yield from made_of(of_blocks(now, held))
                held = []
            now = k
            held.append(t)
        if held:
            yield from made_of(of_blocks(now, held))

    def grouped(df):
        return df.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")

    one = cut(grouped(_in_blocks(rows, key, large)).mapInArrow(first, flat_sql))
    few = one.where("_block is null").select(*[F.col(f"_m_{n}").alias(n) for n in made_names])
    late = one.where("_block is not null").select("_block", *[F.col(f"_r_{n}").alias(n) for n in names])
    last = late.groupBy(key).agg(F.max("_block").alias("_last"))
    pairs = late.join(last, key).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    pairs = pairs.select(F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block", *names)
    return few.union(grouped(pairs).mapInArrow(second, made))


def chains(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between rows a and b connect: in each component the nodes in order, each with the next, so that none has many."""
    root = np.arange(len(node))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            break
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    order = np.lexsort((node, root))
    same = root[order[1:]] == root[order[:-1]]
    return node[order[:-1][same]], node[order[1:][same]]
