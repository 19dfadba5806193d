"""SimHash near-duplicates: an inverted index of positional bytes with count filtering.

Two 64-bit fingerprints that differ in at most DISTANCE = 4 bits differ in at most 4 of their 8 bytes, so at least 4 bytes
agree at their positions. Posting lists of single bytes would hold a 256th of all documents each, and the pairs to tally
would grow with the square of the corpus. The index therefore posts three positional bytes at a time: POSTINGS are 20 triples
of positions such that any 4 positions hold one of them (the least number that does, after Turan), so that every pair
with the guaranteed minimum of matches meets in a posting list. Within a list the shared positional bytes of each pair
are tallied, pairs below the minimum go, and the rest are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_pairs, chains, large_buckets, sampled
from .common import cut, id_text, map_batches, texts, with_keys
from .components import components

#: Differing bits up to which fingerprints link, words of a shingle, and the seed of its hash.
DISTANCE, WORDS, SEED = 4, 4, 42
#: Bytes that agree at least between linked fingerprints.
MATCHES = 8 - DISTANCE


def _postings() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions such that any 4 positions hold one: the triples within each of three parts, and two of a part with one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in parts for t in combinations(p, 3)]
    for i, p in enumerate(parts):
        out += [(*pair, x) for pair in combinations(p, 2) for x in parts[(i + 1) % 3]]
    return out


POSTINGS = _postings()
assert len(POSTINGS) == 20 and all(any(set(t) <= set(four) for t in POSTINGS) for four in combinations(range(8), 4))

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    """The fingerprint of a text, unsigned. No words: 0; fewer than WORDS: of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    at = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
    starts, ends = at[: len(words) - WORDS + 1].tolist(), (at[WORDS:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # the bits of a very long text don't all stand in memory at once
        ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long): one row for each row; a null text is an empty one, with fingerprint zero. An empty table gives an empty one."""
    return _prints(docs, id_col, text_col).drop("mark")


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text, by which rows that repeat an id are told apart), fp."""
    def run(batch):
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "fp": np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)}

    return map_batches(id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), "text"), run, "doc_id long, mark long, fp long")


def _mark(text: Column) -> Column:
    return F.xxhash64(F.lit(3), text)


def shared_bytes(diff: np.ndarray) -> np.ndarray:
    """How many of its 8 bytes are zero, for each difference of two fingerprints."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((diff & low) + low) | diff | low))


def _links(x: np.ndarray, y: np.ndarray, same: bool):
    """Index pairs of x and y (i < j where they are the same list) that share MATCHES positional bytes, by the tally, and then differ in at most DISTANCE bits."""
    ia, ib = [], []
    for i in range(0, len(x), 512):
        diff = x[i : i + 512, None] ^ y[None, :]
        enough = shared_bytes(diff) >= MATCHES
        if same:
            enough &= np.arange(i, min(i + 512, len(x)))[:, None] < np.arange(len(y))[None, :]
        p, q = np.nonzero(enough)
        near = np.bitwise_count(diff[p, q]) <= DISTANCE
        ia.append(p[near] + i)
        ib.append(q[near])
    return np.concatenate(ia or [np.zeros(0, int)]), np.concatenate(ib or [np.zeros(0, int)])


def _edges(fp: np.ndarray, links) -> dict:
    a, b = chains(fp, *links)
    return {"a": a, "b": b}


def _within(t: pa.Table) -> dict:
    fp = t.column("fp").to_numpy()
    return _edges(fp, _links(fp.view(np.uint64), fp.view(np.uint64), True))


def _across(s: pa.Table, t: pa.Table) -> dict:
    x, y = s.column("fp").to_numpy(), t.column("fp").to_numpy()
    a, b = _links(x.view(np.uint64), y.view(np.uint64), False)
    return _edges(np.concatenate([x, y]), (a, b + len(x)))


def _keys(fp: Column) -> Column:
    """The posting keys of a fingerprint: the number of the triple, then its bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    return F.array(*[F.lit(n << 24).cast("long").bitwiseOR(F.shiftleft(byte[i], 16)).bitwiseOR(F.shiftleft(byte[j], 8)).bitwiseOR(byte[k]) for n, (i, j, k) in enumerate(POSTINGS)])


def _components(prints: DataFrame) -> DataFrame:
    """fp, part, component_id of each fingerprint of prints(doc_id, mark, fp): part is the least fingerprint of its component, component_id the least doc_id there, null ids aside."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))

    def posted(rows):
        return rows.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))

    label = components(bucket_pairs(posted(distinct), "key", _within, _across, "a long, b long", large_buckets(posted(sampled(distinct, "fp")), "key")))
    linked = cut(distinct.join(label.select(F.col("node").alias("fp"), F.col("label").alias("part")), "fp"))
    least = cut(linked.groupBy("part").agg(F.min("least_id").alias("component_id")))
    of_linked = with_keys(linked.select("fp", "part"), least, ["part"], least.count()).select("fp", "part", "component_id")
    every = distinct.join(of_linked, "fp", "left")
    # Cut, so that the join of all rows with it stands alone, and may split a fingerprint that very many share.
    return cut(every.select("fp", F.coalesce("part", "fp").alias("part"), F.when(F.col("part").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs.

    Fingerprints, not documents, are compared: copies share one, so that a fingerprint is looked at once however many
    copies it has. component_id is the smallest doc_id among the documents reachable by links; rows with a null doc_id take
    part, but give no id, so a component of such rows alone has a null one. Repeated rows each get a row. Null and empty
    texts have fingerprint zero and link with each other. Only the two columns are read. An empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    return prints.join(_components(prints), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, as it is, for each component: the one with the smallest id, of several with that id the one whose text hashes lowest.

    A row without an id takes part and stands for its component where no row has an id. Rows with the same id and text count
    as one, of which the first by its columns stays; rows with the same id and different texts are told apart. Columns
    may have any names. An empty table gives an empty table.
    """
    prints = cut(_prints(docs, id_col, text_col))
    of = prints.join(_components(prints).select("fp", "part"), "fp")
    first = of.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    times = prints.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    stay = cut(times.join(first, times["doc_id"].eqNullSafe(first["doc_id"]) & (times["mark"] == first["mark"]), "left_semi").select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "n"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i0"), _mark(F.col(f"`{text_col}`")).alias("m0"), whole)
    rows = rows.join(stay, F.col("i0").eqNullSafe(F.col("i")) & (F.col("m0") == F.col("m")))
    out = rows.where("n = 1").select("row")
    if not stay.where("n > 1").isEmpty():
        out = out.union(rows.where("n > 1").groupBy("i0", "m0").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select("row.*")
