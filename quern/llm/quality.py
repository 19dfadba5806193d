"""Quality rules: plain counts, and robust multivariate outliers within each language and source.

Each document becomes a vector of transformed statistics. For each language and source the minimum covariance determinant
estimate of centre and scatter is sought: random elemental subsets give starts, concentration steps improve them (the
three quarters of the group's documents that lie nearest give the next centre and scatter), and of the starts the one whose
scatter has the least determinant is taken to the end. A step is two aggregations over all documents (counts of distances
by narrow bins, then sums of the vectors and of their products), so a group may hold a third of the corpus. Small groups
lean on the estimate of their language, and a language on that of all documents, by weights that change smoothly with their
sizes. A document whose Mahalanobis distance is beyond what clean documents reach is rejected.

Counts that nearly all documents have none of (symbols, repeats, duplicate lines) have no scatter among the nearest
documents. Their variance is held to what chance alone gives counts of such documents' sizes; to every variance a
hundredth of the one over all documents is added, so that statistics which go together exactly still have an inverse.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, texts, with_keys

#: The statistics in order; of the counts that are mostly zero, how many come at once at least (a repeat has two windows of five words).
STATISTICS = ("word_length", "symbols", "capitals", "marks", "repeats", "duplicates")
AT_ONCE = {"symbols": 1, "repeats": 10, "duplicates": 1}
#: Share of a group that a concentration step keeps; distinct vectors of a group from which starts are drawn; elemental subsets; starts kept.
SHARE, SAMPLE, SUBSETS, STARTS = 0.75, 300, 24, 3
#: Concentration steps of all starts, then of the best; documents for which a group's parent counts; share of the scatter of all that is added, and variance added.
STEPS, LAST_STEPS, PRIOR, LEAST_SHARE, LEAST_VARIANCE = 2, 3, 200.0, 0.01, 1e-6
#: What is added to a variance before a matrix is inverted within the search; bins of a doubling of the distance.
RIDGE, BINS = 1e-5, 32
#: Share of normal vectors that lie within the distance that is still kept.
KEPT_SHARE = 0.99999
#: A document fails the base rules with fewer words than this, or a larger percentage of repeated ones.
LEAST_WORDS, MOST_REPEATED = 10, 20

_D = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]


def _chi2(x: float, d: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, d) < p else (low, mid)
    return low


#: Beyond this squared distance a document is rejected; what the scatter of the nearest SHARE is multiplied by.
CUTOFF = chi2_quantile(KEPT_SHARE, _D)
CONSISTENCY = SHARE / _chi2(chi2_quantile(SHARE, _D), _D + 2)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 5 words found twice or more, the first included."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, 5):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    windows = [tuple(words[i : i + 5]) for i in at]  # hashes only point to them
    count = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if count[w] > 1:
            covered[i] += 1
            covered[i + 5] -= 1
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word; lines are what stands between line feeds."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(text: str) -> tuple[tuple, list[float], list[float]]:
    """The counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the transformed statistics, and the variance that chance gives those of mostly zero counts."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    space = int(n[9:14].sum() + n[32])
    chars = len(text) - space
    symbols = int(n[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    dup, lines = duplicate_lines(text)
    repeated = repeated_words(words)
    capitals, small, marks = int(n[65:91].sum()), int(n[97:123].sum()), int(n[[33, 44, 46, 58, 59, 63]].sum())
    of = {"symbols": (symbols, chars + 50), "repeats": (repeated, len(words) + 10), "duplicates": (dup, lines + 3)}
    x = {
        "word_length": math.log((chars + 200) / (len(words) + 40)),
        "capitals": math.sqrt((capitals + 1) / (capitals + small + 60)),
        "marks": math.sqrt((marks + 1) / (chars + 50)),
    } | {k: math.sqrt(c / all_) for k, (c, all_) in of.items()}
    # The square root of a rate of Poisson counts has about the variance 1 / (4 n), whatever the rate.
    chance = {k: AT_ONCE[k] / (4 * all_) for k, (_, all_) in of.items()}
    return (len(words), chars, symbols, dup, repeated), [x[k] for k in STATISTICS], [chance.get(k, 0.0) for k in STATISTICS]


# ---- estimates: small matrices by numpy, sums over documents by Spark


def _distance(c: Column, p: Column) -> Column:
    """The squared distance of the statistics x from centre c by the matrix p (row by row)."""
    d = [F.col("x")[i] - c[i] for i in range(_D)]
    terms = [d[i] * d[j] * p[i * _D + j] * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(0.0)) + 1e-9) * BINS).cast("int")


def _matrix(ss: list[float], n: float, c: np.ndarray) -> np.ndarray:
    m = np.zeros((_D, _D))
    for (i, j), v in zip(_PAIRS, ss, strict=True):
        m[i, j] = m[j, i] = v / n - c[i] * c[j]
    return m


def _inverse(m: np.ndarray) -> list[float]:
    return np.linalg.inv(m + RIDGE * np.eye(_D)).ravel().tolist()


def concentrate(x: np.ndarray, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step in memory: centre, scatter and log determinant of the SHARE of x that lies nearest to c by m."""
    d = x - c
    d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(m + RIDGE * np.eye(_D)), d)
    near = x[np.argsort(d2, kind="stable")[: max(1, math.ceil(SHARE * len(x)))]]
    c = near.mean(0)
    m = (near - c).T @ (near - c) / len(near)
    return c, m, float(np.linalg.slogdet(m + RIDGE * np.eye(_D))[1])


def starts(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The STARTS best of SUBSETS random elemental subsets of x, each after two steps; (centre, scatter)."""
    x = x[np.lexsort(x.T)]
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(SUBSETS):
        few = x[rng.choice(len(x), min(len(x), _D + 1), replace=False)]
        c, m = few.mean(0), np.cov(few.T, bias=True) if len(few) > 1 else np.zeros((_D, _D))
        for _ in range(2):
            c, m, least = concentrate(x, c, m)
        found.append((least, c, m))
    found.sort(key=lambda f: f[0])
    return [(c, m) for _, c, m in found[:STARTS]]


def _starts(vectors: DataFrame, sizes: DataFrame, n_groups: int) -> DataFrame:
    """g, s, c, p: the starts of each group, from some SAMPLE of its distinct vectors, by a hash of the vector; all documents count in the steps."""
    share = F.lit(float(SAMPLE)) / F.col("n")
    drawn = with_keys(vectors, sizes, ["g"], n_groups).where((F.pmod(F.xxhash64("x"), F.lit(1 << 30)) / float(1 << 30)) < share)
    few = drawn.select("g", "x").distinct()

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found = starts(np.stack(f["x"].to_numpy()), zlib.crc32(key[0].encode()))
        return pd.DataFrame([(key[0], s, c.tolist(), _inverse(m)) for s, (c, m) in enumerate(found)], columns=["g", "s", "c", "p"])

    return few.groupBy("g").applyInPandas(run, "g string, s int, c array<double>, p array<double>")


def _step(vectors: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """g, s, n, c, m, noise, det, p after a concentration step of params(g, s, c, p), which has n groups."""
    packed = params.groupBy("g").agg(F.collect_list(F.struct("s", "c", "p")).alias("ways"))
    ways = with_keys(vectors, packed, ["g"], n).select("g", "x", "v", F.explode("ways").alias("w"))
    near = ways.select("g", F.col("w.s").alias("s"), "x", "v", _bin(_distance(F.col("w.c"), F.col("w.p"))).alias("bin"))
    counts = near.groupBy("g", "s", "bin").agg(F.count(F.lit(1)).alias("k"))
    by = Window.partitionBy("g", "s")
    upto = counts.select("g", "s", "bin", F.sum("k").over(by.orderBy("bin")).alias("upto"), F.sum("k").over(by).alias("all"))
    edge = cut(upto.where(F.col("upto") >= SHARE * F.col("all")).groupBy("g", "s").agg(F.min("bin").alias("edge")))
    edges = edge.groupBy("g").agg(F.collect_list(F.struct("s", "edge")).alias("edges"))
    both = packed.join(edges, "g").select("g", F.transform("ways", lambda w: F.struct(w["s"].alias("s"), w["c"].alias("c"), w["p"].alias("p"), F.filter("edges", lambda e: e["s"] == w["s"])[0]["edge"].alias("edge"))).alias("ways"))
    inside = with_keys(vectors, both, ["g"], n).select("g", "x", "v", F.explode("ways").alias("w")).where(_bin(_distance(F.col("w.c"), F.col("w.p"))) <= F.col("w.edge"))
    x, v = [F.col("x")[i] for i in range(_D)], [F.col("v")[i] for i in range(_D)]
    sums = inside.groupBy("g", F.col("w.s").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in x]).alias("sx"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("ss"), F.array(*[F.sum(a) for a in v]).alias("sv"))

    def solve(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                c = np.array(r.sx) / r.n
                m = _matrix(r.ss, r.n, c)
                rows.append((r.g, r.s, r.n, c.tolist(), m.ravel().tolist(), (np.array(r.sv) / r.n).tolist(), float(np.linalg.slogdet(m + RIDGE * np.eye(_D))[1]), _inverse(m)))
            yield pd.DataFrame(rows, columns=["g", "s", "n", "c", "m", "noise", "det", "p"])

    return cut(sums.mapInPandas(solve, "g string, s int, n long, c array<double>, m array<double>, noise array<double>, det double, p array<double>"))


def estimates(vectors: DataFrame) -> DataFrame:
    """g, size, c, m, noise: of each group g of vectors(g, x, v) the minimum covariance determinant centre and scatter (row by row, not yet made consistent), and the mean of v over the nearest documents."""
    sizes = cut(vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    n = sizes.count()
    params = cut(_starts(vectors, sizes, n))
    for _ in range(STEPS):
        params = _step(vectors, params, n)
    best = params.groupBy("g").agg(F.min(F.struct("det", "s", "c", "p")).alias("b")).select("g", "b.s", "b.c", "b.p")
    for _ in range(LAST_STEPS):
        best = _step(vectors, best, n)
    return best.join(sizes.withColumnRenamed("n", "size"), "g").select("g", "size", "c", "m", "noise")


def combined(own: tuple, parent: tuple, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of a group of that size, which leans on its parent's as on PRIOR documents."""
    w = size / (size + PRIOR)
    return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1]


def precision(m: np.ndarray, all_: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The inverse of a scatter to whose variances a small share of those of all documents is added, so that it has one, and which are at least noise."""
    m = m + np.diag(LEAST_SHARE * np.diag(all_) + LEAST_VARIANCE)
    return np.linalg.inv(m + np.diag(np.maximum(0.0, noise - np.diag(m))))


def _final(levels: DataFrame, est: DataFrame) -> DataFrame:
    """both, c, p for each language and source: its estimate, leaning on its language's, leaning on that of all."""
    def part(name):
        return est.select(F.col("g").alias(name), F.struct("size", "c", "m", "noise").alias(f"e_{name}"))

    every = levels.withColumn("top", F.lit("*")).join(part("both"), "both").join(part("lang"), "lang").join(F.broadcast(part("top").where("top = '*'")), "top")

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                (_, c0, m0, v0), (n1, c1, m1, _), (n2, c2, m2, _) = ((e["size"], np.array(e["c"]), CONSISTENCY * np.array(e["m"]).reshape(_D, _D), np.array(e["noise"])) for e in (r.e_top, r.e_lang, r.e_both))
                c, m = combined((c2, m2), combined((c1, m1), (c0, m0), n1), n2)
                rows.append((r.both, c.tolist(), precision(m, m0, v0).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["both", "c", "p"])

    return every.mapInPandas(run, "both string, c array<double>, p array<double>")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept: one row for each row.

    A null or empty text has no words, so it fails. Null languages and sources are groups like others. distance is the
    squared Mahalanobis distance; kept is false where the base rules fail, else whether distance is at most CUTOFF. Rows
    with repeated or null ids are judged like others; rows alike in text, language and source alike. Only these four
    columns are read, whatever others are called. An empty table gives an empty table.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.to_json(F.struct(docs[lang_col].alias("l"))).alias("lang"), F.to_json(F.struct(docs[lang_col].alias("l"), docs[source_col].alias("s"))).alias("both"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch):
        stats = [statistics(t) for t in texts(batch)]
        out = {n: [s[0][i] for s in stats] for i, n in enumerate(counts)}
        return out | {n: batch.column(n) for n in ("doc_id", "lang", "both")} | {"x": [s[1] for s in stats], "v": [s[2] for s in stats]}

    table = cut(map_batches(rows, run, "doc_id long, lang string, both string, " + ", ".join(f"{n} long" for n in counts) + ", x array<double>, v array<double>"))
    levels = cut(table.select("lang", "both").distinct())
    # Every document counts in its group, in its language and among all.
    vectors = table.select(F.explode(F.array(F.lit("*"), F.concat(F.lit("l"), "lang"), F.concat(F.lit("s"), "both"))).alias("g"), "x", "v")
    named = levels.select(F.concat(F.lit("l"), "lang").alias("lang"), F.concat(F.lit("s"), "both").alias("both"))
    final = cut(_final(named, estimates(vectors)).select(F.expr("substring(both, 2)").alias("both"), "c", "p"))
    scored = with_keys(table, final, ["both"], final.count()).withColumn("distance", _distance(F.col("c"), F.col("p")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.select("doc_id", *counts, failed.alias("base_failed"), "distance", (~failed & (F.col("distance") <= CUTOFF)).alias("kept"))
