"""Toxicity by a factorization machine over hashed terms.

Beside a weight for each term, every term has a vector of FACTORS numbers, and each pair of terms in a text adds the
product of its vectors: an insult beside a mention of a group can so weigh more than the two apart. The machine is fitted
here, on a bounded sample of the labelled documents; scoring reads every document.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_text, map_batches, small_batches, texts

#: Hash buckets of terms (a power of two), buckets that the machine keeps (those that tell most about the label), numbers of a term's vector.
BUCKETS, TERMS, FACTORS = 1 << 20, 1024, 8
#: Labelled documents that are learned from, at most: those whose ids hash lowest. The fit alone is bounded so.
TRAIN_ROWS = 20_000
#: Documents of the sample in which a term must occur, passes over the sample, rows of a step, step size, steps at least.
LEAST_DOCS, EPOCHS, STEP_ROWS, RATE, LEAST_STEPS = 5, 15, 256, 0.02, 800
#: What is chosen by a split of the sample, the first where they tie: documents for each term kept (a small sample keeps few terms), and the vectors' shrinkage.
ROWS_A_TERM, SHRINK = (24, 8, 72), (1e-3, 1e-5)
#: Every so manieth document of the sample is set aside for that choice.
SET_ASIDE = 5
#: Scores from this one on count as toxic.
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> np.ndarray:
    """The hash buckets of a text's distinct words, lower-cased."""
    crc = zlib.crc32
    words = set(_WORD.findall(text.lower()))
    return np.unique(np.fromiter((crc(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words), np.int32, len(words)))


@dataclass
class Machine:
    """slot[bucket]: the row of weight and vectors, or -1; bias, weight, vectors of the machine."""

    slot: np.ndarray
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def odds(self, found: np.ndarray) -> float:
        """The log odds of a document with these buckets."""
        rows = self.slot[found]
        rows = rows[rows >= 0]
        v = self.vectors[rows]
        return float(self.bias + self.weight[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.odds(terms(text)), -30, 30))))


def fit(found: list[np.ndarray], label: np.ndarray, rows_a_term: int = ROWS_A_TERM[0], shrink: float = SHRINK[0]) -> Machine:
    """The machine for documents' buckets and labels 0 or 1. With one label only, or none, every score is the labels' smoothed mean."""
    slot = np.full(BUCKETS, -1, np.int16)
    n, toxic = len(label), float(label.sum())
    base = (toxic + 0.5) / (n + 5.0)
    bias = float(np.log(base / (1 - base)))
    if not 0 < toxic < n:
        return Machine(slot, bias, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    one, all_ = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for x, y in zip(found, label, strict=True):
        all_[x] += 1
        if y:
            one[x] += 1
    often = np.flatnonzero(all_ >= LEAST_DOCS)
    one, all_ = one[often].astype(np.float64), all_[often].astype(np.float64)
    expected = all_ * toxic / n
    gain = (one - expected) ** 2 / np.maximum(expected * (1 - toxic / n) * (1 - all_ / (n + 1)), 1e-9)
    best = np.argsort(-gain, kind="stable")[: min(TERMS, max(16, n // rows_a_term))]
    kept = np.sort(often[best[gain[best] > 0]])
    slot[kept] = np.arange(len(kept))
    rows = [(r := slot[x])[r >= 0] for x in found]
    rng = np.random.default_rng(7)
    k = len(kept)
    params = [np.array([bias], np.float32), np.zeros(k, np.float32), rng.normal(0, 0.01, (k, FACTORS)).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * STEP_ROWS // n))):
        order = rng.permutation(n)
        for i in range(0, n, STEP_ROWS):
            part = order[i : i + STEP_ROWS]
            x = np.zeros((len(part), k), np.float32)
            for j, d in enumerate(part):
                x[j, rows[d]] = 1
            b, w, v = params
            s = x @ v
            z = b[0] + x @ w + 0.5 * ((s**2).sum(1) - (x @ (v**2)).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - label[part]).astype(np.float32) / len(part)
            xg = x * g[:, None]
            grads = [np.array([g.sum()], np.float32), x.T @ g + SHRINK[-1] * w, x.T @ (g[:, None] * s) - xg.sum(0)[:, None] * v + shrink * v]
            step += 1
            for p, d, m, u in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                u += 0.001 * (d * d - u)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return Machine(slot, float(params[0][0]), params[1], params[2])


def tuned(found: list[np.ndarray], label: np.ndarray) -> Machine:
    """fit() with what of ROWS_A_TERM and SHRINK, fitted to the others, gives the documents set aside the least log loss; then fitted to all."""
    aside = np.arange(len(label)) % SET_ASIDE == 0
    others = [x for x, a in zip(found, aside, strict=True) if not a]
    if min(label[aside].sum(), (1 - label[aside]).sum(), label[~aside].sum(), (1 - label[~aside]).sum()) < 1:
        return fit(found, label)

    def loss(way):
        machine = fit(others, label[~aside], *way)
        z = np.array([machine.odds(x) for x, a in zip(found, aside, strict=True) if a])
        return float(np.logaddexp(0, np.where(label[aside] > 0, -z, z)).mean())

    return fit(found, label, *min(product(ROWS_A_TERM, SHRINK), key=loss))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from: crc32 of its id as text leaves 1 when divided by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """The machine fitted to at most TRAIN_ROWS labelled documents that are not held out.

    Null ids and labels are left out; of an id's labels the largest counts, of its texts the one whose terms hash lowest.
    Empty tables, of documents or labels, give a machine whose score is the same for every text.
    """
    ids = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    ids = ids.groupBy(ids[id_col].cast("long").alias("doc_id")).agg(F.max(ids[label_col].cast("int")).alias("label"))
    rows = id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text")
    ids = ids.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def run(batch):
        found = [terms(t) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "mark": [zlib.crc32(x.tobytes()) for x in found], "found": found}

    sample = map_batches(rows.join(F.broadcast(ids), "doc_id"), run, "doc_id long, label int, mark long, found array<int>")
    sample = sample.groupBy("doc_id", "mark").agg(F.first("label").alias("label"), F.first("found").alias("found")).toArrow().combine_chunks()
    id_, mark, label = (sample.column(c).to_numpy() for c in ("doc_id", "mark", "label"))
    lists = sample.column("found").combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.lexsort((mark, id_))
    order = order[np.unique(id_[order], return_index=True)[1]]
    return tuned([values[at[i] : at[i + 1]] for i in order], label[order].astype(np.float32))


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row, repeated ids and null ones like others.

    A null text is an empty one; its score is that of no terms. Only the two columns are read. An empty table gives an
    empty table.
    """
    def run(batch):
        return {"doc_id": batch.column("doc_id"), "score": [machine.score(t) for t in texts(batch)]}

    out = map_batches(id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text scores below THRESHOLD: null and empty texts as one without terms, repeated rows alike. Columns may have any names."""
    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: machine.score(t or ""))

    return small_batches(docs).where(score(F.col(f"`{text_col}`")) < THRESHOLD)
