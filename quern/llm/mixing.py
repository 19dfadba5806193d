"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Every document belongs to one of BLOCKS blocks of its source, by a hash of its id and text. A source's target, in words,
fixes its quota of blocks: whole passes over its blocks and a part of one more, blocks in an order permuted anew for each
pass, the last block cut at the target. The quotas are split among the output shards by a binary tree: at each node half
of the blocks still there go to the left, how many from each source being one multivariate hypergeometric draw, so that
every shard gets its share of the mix and the quotas are kept exactly. A leaf of the tree is a shard's part of a source: a
run of its permuted blocks, disjoint from all others. What lies in a leaf is taken, and nothing else; rows are shuffled
within their shard by a hash.

Sources may be as many as documents. They are numbered in order, and the tree is drawn twice: among groups of GROUP sources,
of which the driver holds the quotas, and then among a group's sources, in a task for each group. That is the same
distribution as one draw among all sources.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_SENT, cut

#: Weights that sources take in turn; words of the mix for each word of the input; most words of a source, as a multiple of its size.
WEIGHTS, GROWTH, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words of a slice of a shard.
SLICE_WORDS = 4_000_000
#: Blocks of a source; output shards (a power of two); seed; sources of a group.
BLOCKS, SHARDS, SEED, GROUP = 4096, 16, 97, 4096
#: Rows of the table of blocks up to which it is sent to every task, beside documents that stay where they are.
MOST_BLOCKS = 40 * MOST_SENT


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, growth: float = GROWTH, most: float = MOST) -> list[float]:
    """Words to take from each source: shares of growth times all sizes by weight, none above most times its size.

    A target above its limit stops there, and the excess is shared among the others by weight, until none is above.
    """
    n = len(sizes)
    limit = np.array([most * s for s in sizes])
    w = np.array([weights[i % len(weights)] for i in range(n)])
    out, open_ = np.zeros(n), np.ones(n, bool)
    left = min(growth * float(sum(sizes)), float(limit.sum()))
    while open_.any():
        out[open_] = left * w[open_] / w[open_].sum()
        above = open_ & (out > limit)
        if not above.any():
            break
        out[above] = limit[above]
        left = left - float(limit[above].sum())
        open_ &= ~above
    return out.tolist()


def _targeted(sources: DataFrame) -> DataFrame:
    """sources(sid, size) with target: targets() by a few aggregations, for any number of sources."""
    rows = sources.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))).withColumn("limit", F.lit(MOST) * F.col("size"))
    total = rows.agg(F.sum("size").alias("s"), F.sum("limit").alias("l")).first()
    words = min(GROWTH * float(total.s or 0), float(total.l or 0))
    left, weight = words, None
    while True:  # those above their limit at the last shares stay there
        full = F.lit(False) if weight is None else F.lit(left) * F.col("w") / F.lit(weight) > F.col("limit")
        now = rows.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not now.w:
            return rows.withColumn("target", F.col("limit"))
        if (words - now.full, now.w) == (left, weight):
            return rows.withColumn("target", F.when(full, F.col("limit")).otherwise(F.lit(left) * F.col("w") / F.lit(weight)))
        left, weight = words - now.full, now.w


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of drawn are good: numpy's draw, and beyond its range one by ratio of uniforms, for totals of any size."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if good and drawn else 0
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low

    def log_ways(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))

    mean, share = drawn * good / total, good / total
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = log_ways((drawn + 1) * (good + 1) // (total + 2))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_ways(k) - top:
            return k


def halves(total: int, shards: int) -> list[int]:
    """A total dealt to the leaves of the tree, half of what is there to the left at each node."""
    return [total] if shards == 1 else halves((total + 1) // 2, shards // 2) + halves(total // 2, shards // 2)


def tree(quotas: np.ndarray, leaves: list[int], seed: list[int]) -> np.ndarray:
    """Quotas dealt to leaves of the given sizes, whose sum is theirs: a row for each leaf, whose sums over leaves are the quotas."""
    if len(leaves) == 1:
        return quotas[None, :]
    half = len(leaves) // 2
    rng = np.random.default_rng([*seed, len(leaves)])
    # Draws one after another, each given those before, are a multivariate hypergeometric one.
    left, want, rest = np.zeros_like(quotas), sum(leaves[:half]), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        if want and q:
            left[i] = hypergeometric(rng, q, rest - q, want)
        want -= int(left[i])
        rest -= q
    return np.concatenate([tree(left, leaves[:half], [*seed, 1]), tree(quotas - left, leaves[half:], [*seed, 2])])


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of drawn blocks by source, dealt to shards: a row for each shard. First among groups of sources, then in each group."""
    groups = [quotas[i : i + GROUP] for i in range(0, len(quotas), GROUP)]
    totals = np.array([g.sum() for g in groups], np.int64)
    each = tree(totals, halves(int(totals.sum()), shards), [seed, 0])
    return np.concatenate([tree(g, each[:, i].tolist(), [seed, 1, i]) for i, g in enumerate(groups)] or [np.zeros((shards, 0), np.int64)], axis=1)


def _leaves(quotas: DataFrame) -> DataFrame:
    """sid, ends: split() of quotas(sid, quota), the running sums over shards for each source."""
    grouped = quotas.withColumn("grp", F.floor(F.col("sid") / GROUP).cast("long"))
    sums = grouped.groupBy("grp").agg(F.sum("quota").alias("q")).orderBy("grp").collect()
    each = tree(np.array([r.q for r in sums], np.int64), halves(sum(r.q for r in sums), SHARDS), [SEED, 0])
    of = quotas.sparkSession.createDataFrame([(r.grp, each[:, i].tolist()) for i, r in enumerate(sums)], "grp long, leaves array<long>")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("sid")
        dealt = tree(f["quota"].to_numpy(np.int64), f["leaves"].iloc[0].tolist(), [SEED, 1, int(key[0])])
        return pd.DataFrame({"sid": f["sid"], "ends": list(np.cumsum(dealt, axis=0).T)})

    return grouped.join(of, "grp").groupBy("grp").applyInPandas(run, "sid long, ends array<long>")


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) with sid, from 0 on in order of code point, null last: places in ranges of sources, and the ranges' beginnings."""
    key = F.struct(F.col("source").isNull().alias("none"), "source")
    parts = cut(sizes.repartitionByRange(key).withColumn("part", F.spark_partition_id()).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(key)).cast("long")))
    begin, at = [], 0
    for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        begin.append((r.part, at))
        at += r.n
    begins = sizes.sparkSession.createDataFrame(begin, "part int, begin long")
    return parts.join(F.broadcast(begins), "part").select("source", "size", (F.col("begin") + F.col("place") - 1).alias("sid"))


def _order(block: Column, each: int) -> list[Column]:
    return [F.xxhash64(F.lit(SEED + each), block), block]


def _hash(doc: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 10), doc)


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, doc (a hash of id and text), source, size, block of each row of docs, and more."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(F.lit(SEED), id_, text).alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), *more)
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc"), F.lit(BLOCKS)).cast("int"))


def _plan(slim: DataFrame) -> DataFrame:
    """source, block, source_size, target, words, and for both passes k: room{k}, words that are taken of the block, and shard{k}, the leaf that it lies in; only blocks in a leaf have room."""
    blocks = cut(slim.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sources = cut(_targeted(_numbered(blocks.groupBy("source").agg(F.sum("words").alias("size")))).select("source", "sid", F.col("size").alias("source_size"), "target", F.round("target").cast("long").alias("goal")))
    both = blocks.join(sources, blocks["source"].eqNullSafe(sources["source"])).drop(blocks["source"])
    for k in (1, 2):
        run = Window.partitionBy("sid").orderBy(*_order(F.col("block"), k))
        goal = F.col("goal") if k == 1 else F.col("goal") - F.col("source_size")
        before = F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
        both = both.withColumn(f"rank{k}", F.row_number().over(run)).withColumn(f"room{k}", F.greatest(F.lit(0), F.least("words", goal - before)))
    both = cut(both)
    last = [F.max(F.when(F.col(f"room{k}") > 0, F.col(f"rank{k}")).otherwise(0)).cast("long").alias(f"n{k}") for k in (1, 2)]
    quotas = cut(both.groupBy("sid").agg(*last))
    leaves = _leaves(quotas.select("sid", (F.col("n1") + F.col("n2")).alias("quota")))
    both = both.join(leaves.join(quotas, "sid"), "sid")
    for k, place, end in ((1, F.col("rank1") - 1, F.col("n1")), (2, F.col("n1") + F.col("rank2") - 1, F.col("n1") + F.col("n2"))):
        both = both.withColumn(f"shard{k}", F.when(place < end, _leaf(place)))
    drawn = [F.when(F.col(f"shard{k}").isNotNull(), F.col(f"room{k}")).otherwise(0).cast("long").alias(f"room{k}") for k in (1, 2)]
    return cut(both.select("source", "block", "source_size", "target", "words", *drawn, "shard1", "shard2"))


def _leaf(place: Column) -> Column:
    """The leaf that a source's place lies in, by the running sums in ends."""
    return F.size(F.filter("ends", lambda e: e <= place))


def _of_blocks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their block's columns of plan; the rows stay where they are while plan is small."""
    p = plan.withColumnsRenamed({"source": "p_source", "block": "p_block"})
    same = rows["source"].eqNullSafe(p["p_source"]) & (rows["block"] == p["p_block"])
    return rows.join(F.broadcast(p) if plan.count() <= MOST_BLOCKS else p, same).drop("p_source", "p_block")


_CUT = "room1 > 0 AND room1 < words OR room2 > 0 AND room2 < words"


def _in_cuts(rows: DataFrame, whole: bool) -> DataFrame:
    """Rows of cut blocks with first and second: words taken in either pass, in an order for each, until the block's room is full."""
    for k, name in ((1, "first"), (2, "second")):
        run = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(SEED + 10 + k), "doc"), "doc", "doc_id", "size")
        left = F.col(f"room{k}") - (F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        near = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0) if whole else left
        rows = rows.withColumn(name, F.when(left >= F.col("size"), F.col("size")).when(left <= 0, 0).otherwise(near).cast("long"))
    return rows


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken, first, second, shard1, shard2: one row for each row of docs.

    size: words of the text, 0 where it is null or empty. first and second: words taken in the first and second pass over
    the source, each from 0 to size; taken: their sum. At most one block of a source is cut in a pass, and in it one
    document, whose first words are taken so that the source meets its target. shard1 and shard2: the output shards of the
    two passes, null where nothing is taken. Sources are ordered by code point, null last, and take WEIGHTS in turn. Rows
    alike in id and text are in one block; each is drawn in its own right. Rows without an id are like others. Only the
    three columns are read, whatever others are called. An empty table gives an empty table.
    """
    slim = cut(_slim(docs, id_col, text_col, source_col))
    dealt = _of_blocks(slim, _plan(slim))
    columns = ["doc_id", "size", "source", "source_size", "target", "first", "second", "shard1", "shard2"]
    plain = dealt.where(f"NOT ({_CUT})")
    for k, name in ((1, "first"), (2, "second")):
        plain = plain.withColumn(name, F.when(F.col(f"room{k}") > 0, F.col("size")).otherwise(0).cast("long"))
    out = plain.select(columns).union(_in_cuts(dealt.where(_CUT), False).select(columns))
    shards = [F.when(F.col(n) > 0, F.col(f"shard{k}")).alias(f"shard{k}") for k, n in ((1, "first"), (2, "second"))]
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"), "first", "second", *shards)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, whole, a row once for each pass that takes it, by shards and shuffled within them.

    Whether a row is taken follows from its block, and in a cut block from its place in an order by hash; so rows are
    only shuffled as they are written to their shards. A document that the target would cut is taken or left as a whole,
    whichever is nearer; rows alike in id and text share what happens to them. A shard is cut at random into slices of
    about SLICE_WORDS, each sorted by a hash and in one partition, so that no task holds a shard. The result has the columns
    of docs, which may have any names. Documents without words are never taken. An empty table gives an empty table.
    """
    slim = cut(_slim(docs, id_col, text_col, source_col))
    plan = _plan(slim)
    # Of cut blocks: the last place in the order, by the hash of a document, up to which documents are taken.
    few = _in_cuts(_of_blocks(slim, plan.where(_CUT)), True)
    order = [F.struct(F.xxhash64(F.lit(SEED + 10 + k), "doc").alias("h"), F.col("doc").alias("d")) for k in (1, 2)]
    ends = few.groupBy("source", "block").agg(*[F.max(F.when(F.col(n) > 0, o)).alias(f"end{k}") for (k, n), o in zip(((1, "first"), (2, "second")), order, strict=True)])
    ends = ends.withColumnsRenamed({"source": "e_source", "block": "e_block"})
    plan = cut(plan.join(ends, plan["source"].eqNullSafe(ends["e_source"]) & (plan["block"] == ends["e_block"]), "left").drop("e_source", "e_block"))
    words = plan.agg(F.sum(F.col("room1") + F.col("room2"))).first()[0] or 0
    slices = max(1, -(-int(words) // (SHARDS * SLICE_WORDS)))

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _of_blocks(_slim(docs, id_col, text_col, source_col, whole).where("size > 0"), plan.where("room1 > 0 OR room2 > 0"))
    taken = [(F.col(f"room{k}") > 0) & ((F.col(f"room{k}") == F.col("words")) | F.coalesce(o <= F.col(f"end{k}"), F.lit(False))) for k, o in zip((1, 2), order, strict=True)]
    copies = F.array_compact(F.array(*[F.when(t, F.struct(F.col(f"shard{k}").alias("shard"), F.lit(k).alias("pass"))) for k, t in zip((1, 2), taken, strict=True)]))
    rows = rows.select("row", "doc", F.explode(copies).alias("copy"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(F.lit(SEED + 21), "doc", "copy.pass"), F.lit(slices)))
    shuffled = rows.repartition(SHARDS * slices, F.col("copy.shard"), "slice").sortWithinPartitions(F.col("copy.shard"), "slice", F.xxhash64(F.lit(SEED + 20), "doc", "copy.pass"), "doc")
    return shuffled.select("row.*")
