"""Randomised factorisation of a table of vectors: two passes over the rows, small matrices on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions beyond the rank that are tried, and the seed of the trial.
BEYOND, SEED = 5, 42


def _summed(rows: DataFrame, vec_col: str, make) -> np.ndarray:
    """The sum over rows of what make gives for a matrix of some of them; a task adds its own up."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").to_pylist(), np.float64)
                part = make(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "i long, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((1 + max((r.i for r in cells), default=-1), 1 + max((r.j for r in cells), default=-1)))
    for r in cells:
        out[r.i, r.j] = r.x
    return out


def randomized_svd(rows: DataFrame, rank: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Singular values, the right factor (rank x width), and the left factor as (id, factor): left times right is near the rows, the root of each singular value in both."""
    first = rows.select(F.size(vec_col).alias("d")).first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0)), rows.select(id_col, F.array().cast("array<double>").alias("factor"))
    trial = np.random.default_rng(SEED).normal(size=(first.d, min(first.d, rank + BEYOND)))
    # Y = A trial has the Gram matrix G; Q = Y G^(-1/2) has orthonormal columns.
    gram = _summed(rows, vec_col, lambda x: (x @ trial).T @ (x @ trial))
    values, ways = np.linalg.eigh(gram)
    good = values > values.max() * 1e-12
    to_q = trial @ (ways[:, good] / np.sqrt(values[good]))
    small = _summed(rows, vec_col, lambda x: (x @ to_q).T @ x)
    u, s, vt = np.linalg.svd(small, full_matrices=False)
    u, s, vt = u[:, :rank], s[:rank], vt[:rank]
    left = to_q @ u * np.sqrt(s)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x @ left) if batch.num_rows else [], pa.list_(pa.float64()))], names=["id", "factor"])

    factor = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, factor array<double>")
    return s, np.sqrt(s)[:, None] * vt, factor.withColumnRenamed("id", id_col)
