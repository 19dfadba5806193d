"""Embedding near-duplicates by lattice hashing.

Random projections take a unit vector to blocks of 8 numbers, each decoded to the nearest point of the E8 lattice; the points
of all blocks are the vector's home cell in a table. Its PROBES nearest neighbouring cells (a step of one or more blocks to
one of the 240 points around) are probed too. Vectors that meet, one at home, the other at home or probing, are compared by
cosine in double precision.

Cells grow in number with the vectors, so that unlike vectors seldom share one: for n vectors they have log2 n + SPARE bits,
which a block gives some 16.4 of, less where its projection is scaled down. How surely a pair at the least cosine meets in
a table follows from blocks and scale alone, whatever the vectors' length; there are as many tables as take that to RECALL.

Cells are posted without vectors. Only postings that meet another fetch theirs.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_pairs, chains, large_buckets, sampled
from .common import cut, small_batches
from .components import components

#: Least cosine of a link, and the probability with which a pair of that cosine meets; neighbouring cells probed; neighbours of a block's point that are looked at; seed.
COSINE, RECALL, PROBES, NEAR, SEED = 0.95, 0.99, 4, 6, 31
#: Bits of cells beyond those that number the vectors; bits that a block's point has at scale 1 (the entropy of 8 normal numbers, a cell having volume 1).
SPARE, BLOCK_BITS = 5.0, 8 * math.log2(math.sqrt(2 * math.pi * math.e))
#: Rows of a block that are compared with the other's at once; rows of a bucket up to which it is compared together with others.
ROWS, SMALL = 256, 64


@cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    half = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(1) % 2)
    i = np.abs(e[odd]).argmax(1)
    r[odd, i] += np.where(e[odd, i] >= 0, 1, -1)
    return r


def nearest_points(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points to rows of 8 numbers: integers with an even sum, or those moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    """A long for each cell (rows of numbers that are halves of whole ones); cells that share one by chance are only compared in vain."""
    out = np.full(points.shape[:-1], (salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    whole = np.rint(2 * points).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(points.shape[-1]):
            out = (out ^ whole[..., i]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _cells_of(p: np.ndarray, salt: int) -> np.ndarray:
    """For projections (n, blocks, 8): the cells (n, 1 + PROBES), home first."""
    n, blocks, _ = p.shape
    home = nearest_points(p.reshape(-1, 8)).reshape(p.shape)
    cost = np.zeros((n, blocks, NEAR + 1))  # of staying, then of going to one of the nearest neighbours: what the squared distance grows by
    step = np.zeros((n, blocks, NEAR + 1, 8))
    for k in range(blocks):
        all_ = 2 - 2 * ((p[:, k] - home[:, k]) @ _roots().T)
        at = np.sort(np.argpartition(all_, NEAR, axis=1)[:, :NEAR], axis=1)
        cost[:, k, 1:] = np.take_along_axis(all_, at, 1)
        step[:, k, 1:] = _roots()[at]
    ways = np.array(list(product(range(NEAR + 1), repeat=blocks))[1:] if blocks < 4 else [[j if i == k else 0 for i in range(blocks)] for k in range(blocks) for j in range(1, NEAR + 1)])
    total = sum(cost[:, k, ways[:, k]] for k in range(blocks))
    best = ways[np.argsort(total, axis=1, kind="stable")[:, :PROBES]]  # n, PROBES, blocks
    probed = np.stack([home[:, None, k] + np.take_along_axis(step[:, k], best[:, :, k, None], 1) for k in range(blocks)], 2)
    return _hashed(np.concatenate([home[:, None], probed], 1).reshape(n, 1 + PROBES, -1), salt)


def meeting(blocks: int, scale: float, cosine: float = COSINE, pairs: int = 4000) -> float:
    """The probability that a pair of unit vectors of that cosine meets in a table: their projections are normal numbers with that correlation."""
    rng = np.random.default_rng(SEED)
    x = rng.normal(size=(pairs, blocks, 8))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.normal(size=x.shape)
    a, b = _cells_of(scale * x, 0), _cells_of(scale * y, 0)
    return float(((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)).mean())


def layout(n: int) -> tuple[int, float, int]:
    """Blocks, scale and tables for n vectors."""
    bits = math.log2(max(n, 2)) + SPARE
    blocks = max(1, math.ceil(bits / BLOCK_BITS))
    scale = 2 ** ((bits / blocks - BLOCK_BITS) / 8)
    return blocks, scale, math.ceil(math.log(1 - RECALL) / math.log(1 - meeting(blocks, scale)))


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length one. Sums run over the columns one by one, so that a row's result doesn't depend on the rows beside it."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    square = np.zeros(len(x))
    for j in range(x.shape[1]):
        square += x[:, j] * x[:, j]
    return x / np.sqrt(square)[:, None]


def cells(u: np.ndarray, form: tuple[int, float, int]) -> np.ndarray:
    """For unit vectors (n, d): the cells (n, tables, 1 + PROBES) of each, home first; the same for a row whatever stands beside it."""
    blocks, scale, tables = form
    d = u.shape[1]
    out = np.empty((len(u), tables, 1 + PROBES), np.int64)
    for t in range(tables):
        way = np.random.default_rng([SEED, t, d]).normal(size=(d, 8 * blocks)) * scale
        p = np.zeros((len(u), 8 * blocks))
        for j in range(d):
            p += u[:, j, None] * way[j]
        out[:, t] = _cells_of(p.reshape(len(u), blocks, 8), 1000 * d + t)
    return out


def _vectors(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


class _Rows:
    """Rows of a bucket: vectors of length one, nodes, ids, copies, whether at home."""

    def __init__(self, t: pa.Table):
        self.unit = unit(_vectors(t.column("vec")))
        self.node, self.id, self.copies = (t.column(c).to_numpy() for c in ("node", "id", "copies"))
        self.home = t.column("home").to_numpy() == 1
        self.keys = t.column("key").to_numpy()
        self.key = int(self.keys[0])


def _compare_many(x: _Rows, form: tuple[int, float, int]) -> dict:
    """_compare() within each of several buckets, one after another, at once: rows are taken with the next, the next but one and so on of their bucket."""
    begin = np.flatnonzero(np.r_[True, x.keys[1:] != x.keys[:-1]])
    last = np.repeat(np.r_[begin[1:], len(x.keys)], np.diff(np.r_[begin, len(x.keys)])) - 1  # of each row's bucket
    found, i, off = [], np.arange(len(x.keys)), 0
    while len(i := i[last[i] > i + off]):
        off += 1
        j = i + off
        near = (x.home[i] | x.home[j]) & (x.node[i] != x.node[j])
        a, b = i[near], j[near]
        close = np.einsum("nd,nd->n", x.unit[a], x.unit[b]) >= COSINE
        found.append((a[close], b[close]))
    a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    if not len(a):
        return {"kind": [], "a": [], "b": []}
    rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    of = cells(x.unit[rows], form)
    first = _first_meeting(of[where[: len(a)]], of[where[len(a) :]], x.keys[a])
    fa, fb = a[first], b[first]
    every, at = np.unique(np.concatenate([x.id[a], x.id[b]]), return_inverse=True)
    p, q = chains(every, at[: len(a)], at[len(a) :])
    return _summed([x.node[fa], x.node[fb]], [x.copies[fb], x.copies[fa]], [p], [q])


def _by_length(t: pa.Table) -> dict[int, pa.Table]:
    """The rows by the length of their vectors; but for chance there is one."""
    size = pc.list_value_length(t.column("vec")).to_numpy()
    return {int(n): t if (size == n).all() else t.filter(pa.array(size == n)) for n in np.unique(size)}


def _joined(found: list[dict]) -> dict:
    return {k: np.concatenate([np.asarray(f[k], np.int64) for f in found] or [np.zeros(0, np.int64)]) for k in ("kind", "a", "b")}


def _first_meeting(x: np.ndarray, y: np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """Of pairs of rows with cells x and y, those that meet first in the cell that key says, for all or each: in the first table, and there in the smaller of the two cells that they may share."""
    key = np.broadcast_to(key, len(x))
    first, open_ = np.zeros(len(x), bool), np.arange(len(x))
    for t in range(x.shape[1]):  # most pairs meet in the first tables, and need no look at the others
        cx, cy = x[open_, t], y[open_, t]
        hx, hy = cx[:, 0], cy[:, 0]
        in_x, in_y = (cy == hx[:, None]).any(1), (cx == hy[:, None]).any(1)
        where = np.where(in_x & in_y, np.minimum(hx, hy), np.where(in_x, hx, hy))
        met = in_x | in_y
        first[open_[met & (where == key[open_])]] = True
        open_ = open_[~met]
        if not len(open_):
            break
    return first


def _compare(x: _Rows, y: _Rows, same: bool, form: tuple[int, float, int]) -> dict:
    """kind 1: a node and how many rows it links to by pairs that meet here first; kind 0: edges between ids."""
    node, weight, low, high = [], [], [], []
    of_x = of_y = None
    for i in range(0, len(x.node), ROWS):
        near = x.unit[i : i + ROWS] @ y.unit.T >= COSINE
        near &= (x.home[i : i + ROWS, None] | y.home[None, :]) & (x.node[i : i + ROWS, None] != y.node[None, :])
        if same:
            near &= np.arange(i, min(i + ROWS, len(x.node)))[:, None] < np.arange(len(y.node))[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            continue
        a += i
        if of_x is None:
            of_x = cells(x.unit, form)
            of_y = of_x if same else cells(y.unit, form)
        first = _first_meeting(of_x[a], of_y[b], x.key)
        fa, fb = a[first], b[first]
        for at, w in ((x.node[fa], y.copies[fb]), (y.node[fb], x.copies[fa])):
            each, where = np.unique(at, return_inverse=True)
            node.append(each)
            weight.append(np.bincount(where, weights=w, minlength=len(each)).astype(np.int64))
        every, where = np.unique(np.concatenate([x.id[a], y.id[b]]), return_inverse=True)
        p, q = chains(every, where[: len(a)], where[len(a) :])
        low.append(p)
        high.append(q)
    return _summed(node, weight, low, high)


def _summed(node: list, weight: list, low: list, high: list) -> dict:
    """The rows of kind 1 and 0 from nodes with numbers of links, and ends of edges."""
    if not node:
        return {"kind": [], "a": [], "b": []}
    each, where = np.unique(np.concatenate(node), return_inverse=True)
    sums = np.bincount(where, weights=np.concatenate(weight), minlength=len(each)).astype(np.int64)
    every, where = np.unique(np.concatenate(low + high), return_inverse=True)
    p, q = chains(every, *np.split(where, 2))
    return {"kind": np.r_[np.ones(len(each), np.int64), np.zeros(len(p), np.int64)], "a": np.r_[each, p], "b": np.r_[sums, q]}


def _useful(batches):
    """Of postings in order of key, those at home first, the ones whose key has one at home and another; postings of large buckets all."""
    last, ok, held = None, False, None  # the key before, whether it has one at home, its only posting so far

    for batch in batches:
        if not batch.num_rows:
            continue
        key, tag, large = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tag", "large"))
        if held is not None:
            key, tag, large = np.r_[held[0], key], np.r_[held[1], tag], np.r_[held[2], large]
            held, last = None, None
        start = np.r_[key[0] != last if last is not None else True, key[1:] != key[:-1]]
        group = np.cumsum(start) - 1 + (not start[0])  # group 0 is the one that goes on from before, if any
        begins = np.flatnonzero(start)
        home = np.r_[ok, (tag[begins] & 1) == 1] if not start[0] else (tag[begins] & 1) == 1
        size = np.bincount(group, minlength=len(home))
        many = size > 1
        if not start[0]:
            many[0] = True
        keep = (home & many)[group] | large
        last, ok = key[-1], bool(home[-1])
        if size[-1] == 1 and start[-1] and not large[-1]:
            held = key[-1:], tag[-1:], large[-1:]
            keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(tag[keep])], names=["key", "tag"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    Equal vectors are compared as one. n_links: rows, itself not counted, that are equal to it or were found to have a
    cosine of COSINE at least with it; component_id: the smallest id that links reach, an id reaching all rows that carry
    it; kept: whether that is its own. A vector that is null, empty, zero or has a null or non-finite component links with
    nothing, nor do vectors of different lengths. A row with a null id links with nothing and has null for component_id
    and kept. Only the two columns are read. An empty table gives an empty one.
    """
    small_batches(vectors)
    vec, id_ = F.col(f"`{vec_col}`"), F.col(f"`{id_col}`").cast("long")
    sound = id_.isNotNull() & F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    # Equal vectors are known by 128 bits of hash; the vectors themselves are shuffled once.
    hashed = [F.when(sound, F.xxhash64(F.lit(s), vec)).alias(f"h{s}") for s in (1, 2)]
    slim = cut(vectors.select(id_.alias("id"), *hashed))
    rows = vectors.where(sound).select(id_.alias("id"), vec.alias("vec"), *hashed)
    distinct = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()))
    form = layout(distinct.count())

    def post(batches):
        for batch in batches:
            all_, nodes = batch.column("vec").to_pylist(), batch.column("node").to_numpy()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(all_):
                by_size.setdefault(len(v), []).append(i)
            for at in by_size.values():
                c = cells(unit(np.array([all_[i] for i in at], np.float64)), form)
                tag = np.broadcast_to(2 * nodes[at][:, None, None] + (np.arange(1 + PROBES) == 0), c.shape)
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(tag.ravel())], names=["key", "tag"])

    def posted(of):
        return of.select("vec", "node").mapInArrow(post, "key long, tag long")

    large = large_buckets(posted(sampled(distinct, "node")), "key")
    tagged = posted(distinct)
    if large is None:
        dealt = tagged.withColumn("large", F.lit(False)).repartition("key")
    else:  # a large bucket's postings all meet; they are only passed on, from many tasks
        dealt = tagged.join(F.broadcast(large), "key", "left").select("key", "tag", F.col("_parts").isNotNull().alias("large")).repartition("key", F.when(F.col("large"), F.col("tag")))
    useful = cut(dealt.sortWithinPartitions("key", F.col("tag").bitwiseAND(F.lit(1)).desc()).mapInArrow(_useful, "key long, tag long"))
    met = useful.select("key", F.shiftright("tag", 1).alias("node"), F.col("tag").bitwiseAND(F.lit(1)).alias("home"))
    fetched = met.join(distinct.select("node", "id", "copies", "vec"), "node").select("key", "node", "id", "copies", "home", "vec")

    def within(t: pa.Table) -> dict:
        rows_ = [_Rows(x) for x in _by_length(t).values()]
        return _joined([_compare(x, x, True, form) for x in rows_])

    def across(s: pa.Table, t: pa.Table) -> dict:
        one, two = _by_length(s), _by_length(t)
        return _joined([_compare(_Rows(one[n]), _Rows(two[n]), False, form) for n in one if n in two])

    def many(t: pa.Table) -> dict:
        out = []
        for part in _by_length(t).values():
            x = _Rows(part)
            size = np.unique(x.keys, return_inverse=True, return_counts=True)
            few = size[2][size[1]] <= SMALL
            if few.any():
                out.append(_compare_many(x if few.all() else _Rows(part.filter(pa.array(few))), form))
            for key in size[0][size[2] > SMALL]:
                one = _Rows(part.filter(pa.array(x.keys == key)))
                out.append(_compare(one, one, True, form))
        return _joined(out)

    made = cut(bucket_pairs(fetched, "key", within, across, "kind long, a long, b long", large, many))
    links = made.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    # An id that different vectors carry holds them together.
    several = slim.where("h1 is not null").groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("id")
    carried = cut(slim.join(several, "id", "left_semi").select(F.col("id").alias("carrier"), "h1", "h2").distinct().join(distinct.select("h1", "h2", "id"), ["h1", "h2"]).select("carrier", "id"))
    held = carried.join(carried.groupBy("carrier").agg(F.min("id").alias("least")), "carrier").select(F.col("least").alias("a"), F.col("id").alias("b"))
    label = components(made.where("kind = 0").select("a", "b").union(held)).select(F.col("node").alias("id"), "label")
    of_vec = distinct.select("h1", "h2", "id", "copies", "node").join(links, "node", "left").join(label, "id", "left")
    of_vec = of_vec.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component"))
    alone = slim.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = slim.where("h1 is not null").join(of_vec, ["h1", "h2"]).select("id", F.col("n_links").cast("long").alias("n_links"), "component").union(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
