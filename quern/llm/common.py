"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: a batch of whole documents stays small even where documents are long.
BATCH_ROWS, BATCH_BYTES = 400, 32 << 20
#: Rows of a small table up to which it is sent to every task.
MOST_SENT = 20_000
#: Parts into which the rows of a key are dealt where a table of keys is too large to be sent.
SALTS = 16
_UNITS = {"": 0, "K": 10, "M": 20, "G": 30}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, the one in spark.checkpoint.dir.

    Only in a session of one machine that has none (tests) a folder of our own is made; on a cluster that is an error,
    since executors don't share local folders.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return df.checkpoint()


def small_batches(df: DataFrame) -> DataFrame:
    """df. Arrow batches of its session are held to BATCH_ROWS rows and BATCH_BYTES bytes from now on; smaller settings stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)([KMG]?)B?", conf.get(key).strip().upper())
        if not now or not 0 < int(now[1]) << _UNITS[now[2]] <= most:
            conf.set(key, str(most))
    return df


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow for a function from one pyarrow RecordBatch to a dict of columns (lists or arrays); schema: its columns in order."""
    small_batches(df)
    names = [field.split()[0] for field in _fields(schema)]
    types = [_arrow(field.split(None, 1)[1]) for field in _fields(schema)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x, t) for n, t in zip(names, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    return [x.strip() for x in schema.split(",")]


def _arrow(kind: str):
    simple = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.list_(simple[kind[6:-1]]) if kind.startswith("array<") else simple[kind]


def texts(batch, name: str = "text") -> list[str]:
    """The texts of a batch, a null as the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, as doc_id and text, whatever other columns there are."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_keys(rows: DataFrame, keyed: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, that has n rows: sent to every task up to MOST_SENT, else by a join in which a key's rows are dealt out."""
    if n <= MOST_SENT:
        return rows.join(F.broadcast(keyed), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    dealt = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(dealt, [*on, "_salt"], how).drop("_salt")
