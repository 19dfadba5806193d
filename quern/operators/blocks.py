"""Chunks, deduplication, deltas, quantization and sparse blocks, as columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

CHUNK = 256


def chunks(docs: DataFrame, model: str = "source", layer: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """model, layer, chunk_no, hash, bytes: the whole text in pieces of size characters."""
    i = F.explode(F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)).alias("chunk_no")
    rows = docs.where(F.length(text) > 0).select(F.col(model).alias("model"), F.col(layer).alias("layer"), text, i)
    piece = F.substring(F.col(text), F.col("chunk_no") * size + 1, F.lit(size))
    return rows.select("model", "layer", "chunk_no", F.sha2(piece, 256).alias("hash"), F.octet_length(piece).cast("long").alias("bytes"))


def dedup_stats(refs: DataFrame) -> DataFrame:
    """unique chunks, refs, duplicated chunks, bytes_saved (a duplicated chunk once), bytes_avoided (for each reference beyond the first)."""
    by = refs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("b"))
    return by.agg(F.count(F.lit(1)).alias("unique_chunks"), F.sum("n").alias("refs"), F.count_if(F.col("n") > 1).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("b"))), F.lit(0)).alias("bytes_saved"), F.coalesce(F.sum((F.col("n") - 1) * F.col("b")), F.lit(0)).alias("bytes_avoided"))


def int8(v: Column) -> Column:
    """struct(scale, q): symmetric, by the largest magnitude over 127; all zeros keep a scale of 1."""
    top = F.array_max(F.transform(V.doubles(v), lambda x: F.abs(x)))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(V.doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale).cast("int")))).alias("q"))


def int4(v: Column) -> Column:
    """struct(scale, q, packed): largest magnitude over 7, moved by 8 into 0 to 15, two to a byte, the first in the high half."""
    top = F.array_max(F.transform(V.doubles(v), lambda x: F.abs(x)))
    scale = F.when(top > 0, top / 7).otherwise(1.0)
    q = F.transform(V.doubles(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(15), F.round(x / scale).cast("int") + 8)))
    high, low = F.filter(q, lambda x, i: i % 2 == 0), F.filter(q, lambda x, i: i % 2 == 1)
    packed = F.zip_with(high, low, lambda a, b: a * 16 + b)
    return F.struct(scale.alias("scale"), q.alias("q"), packed.alias("packed"))


def sparse_2_4(v: Column) -> Column:
    """The vector with the two of least magnitude of every four set to zero; of equal ones the earlier stays."""
    x = V.doubles(v)

    def rank(i: Column) -> Column:
        base = i - i % 4
        mine = F.abs(F.element_at(x, i + 1))
        ahead = [F.when(((base + j) < F.size(x)) & ((base + j) != i), ((F.abs(F.try_element_at(x, base + j + 1)) > mine) | ((F.abs(F.try_element_at(x, base + j + 1)) == mine) & ((base + j) < i))).cast("int")).otherwise(0) for j in range(4)]
        return ahead[0] + ahead[1] + ahead[2] + ahead[3]

    return F.transform(x, lambda e, i: F.when(rank(i) < 2, e).otherwise(0.0))


def bitmask(v: Column, block: int = 16) -> Column:
    """For each block of 16 numbers the bits of those beyond 1e-7."""
    x = V.doubles(v)
    starts = F.sequence(F.lit(0), F.size(x) - block, F.lit(block))
    one = lambda s, i: F.when(F.abs(F.element_at(x, s + i + 1)) > 1e-7, 1 << i).otherwise(0)

    def mask(s: Column) -> Column:
        out = one(s, 0)
        for i in range(1, block):
            out = out + one(s, i)
        return out

    return F.transform(starts, mask)


def delta(base: Column, target: Column, epsilon: float) -> Column:
    """array of (i, d): where the target differs from its base by more than epsilon."""
    d = F.zip_with(V.doubles(base), V.doubles(target), lambda a, b: b - a)
    indexed = F.transform(d, lambda x, i: F.struct(i.alias("i"), x.alias("d")))
    return F.filter(indexed, lambda s: F.abs(s["d"]) > epsilon)


def patched(base: Column, changes: Column) -> Column:
    """base with the changes added."""
    m = F.map_from_entries(changes)
    return F.transform(V.doubles(base), lambda x, i: x + F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def polynomial_shard(key: Column, shards: int) -> Column:
    """The shard of a key: h <- 31 h + b over its bytes, modulo 2^64, then modulo the number of shards. h is held in two halves, as no long may overflow."""
    data = key.cast("binary")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    half = F.lit((1 << 32) - 1)
    zero = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        low = h["lo"] * 31 + b
        return F.struct((h["hi"] * 31 + F.shiftright(low, 32)).bitwiseAND(half).alias("hi"), low.bitwiseAND(half).alias("lo"))

    shard = lambda h: F.pmod(F.pmod(h["hi"], F.lit(shards)) * ((1 << 32) % shards) + h["lo"], F.lit(shards))
    return F.when(F.octet_length(key) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(codes, zero, step, shard))


def layer_index(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """refs(model, layer, chunk_no, hash, bytes) with location: of the stored chunks with that hash the first, by layer and number; null where none is."""
    blocks = stored.groupBy("hash").agg(F.min(F.struct("layer", "chunk_no")).alias("location"))
    return refs.join(blocks, "hash", "left")


def packed_2_4(v: Column) -> Column:
    """A 2:4 sparse array in packed form: of each four numbers the two that stay, with their places there."""
    fours = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 4).cast("int") - 1), lambda i: F.slice(v, i * 4 + 1, F.lit(4)))
    def pick(four):
        order = F.array_sort(F.transform(four, lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("i"), x.alias("x"))))
        return F.array_sort(F.transform(F.slice(order, 1, 2), lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))
    return F.when(F.size(v) > 0, F.flatten(F.transform(fours, lambda four, g: F.transform(pick(four), lambda s: F.struct((4 * g + s["i"]).cast("int").alias("at"), s["x"].cast("double").alias("x")))))).otherwise(F.array().cast("array<struct<at:int,x:double>>"))


def packed_dot(packed: Column, v: Column) -> Column:
    """The product of a packed sparse array and a dense one: half the products of the whole."""
    return F.aggregate(packed, F.lit(0.0), lambda a, s: a + s["x"] * F.element_at(v, s["at"] + 1))
