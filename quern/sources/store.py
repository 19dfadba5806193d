"""Snapshots as Parquet, change logs as JSON lines, and the collection that both give."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import latest

#: A vector record as it stands in a change log.
RECORD = "seq bigint, op string, id string, values array<double>, metadata string"


def save(df: DataFrame, path: str) -> None:
    """A snapshot; the commit protocol makes it visible as a whole or not at all."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_log(ops: DataFrame, path: str) -> None:
    """Appends operations (seq, op, id, values, metadata) as JSON lines."""
    ops.select("seq", "op", "id", "values", "metadata").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The operations, and the lines that are none."""
    read = F.from_json("value", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", read.alias("r"))
    broken = F.col("r._bad").isNotNull() | F.col("r.seq").isNull()
    return raw.where(~broken).select("r.*").drop("_bad"), raw.where(broken).select(F.col("value").alias("_bad"))


def replay(ops: DataFrame) -> DataFrame:
    """id, values, metadata that stand after the log: the last operation of each id, unless it deletes."""
    return latest(ops, ["id"], "seq").where("op <> 'delete'").select("id", "values", "metadata")


def current(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """A snapshot (id, values, metadata) with the log laid over it."""
    base = snapshot.select(F.lit(-1).cast("long").alias("seq"), F.lit("upsert").alias("op"), "id", "values", "metadata")
    return replay(base.unionByName(ops))


def status(snapshot: DataFrame, bad_lines: DataFrame, dimension: int) -> str:
    """READY, or CORRUPT where the log has broken lines or a vector has another dimension."""
    if not bad_lines.isEmpty() or not snapshot.where(F.size("values") != dimension).isEmpty():
        return "CORRUPT"
    return "READY"


def bootstrap(spark: SparkSession, snapshot_path: str, log_path: str, dimension: int) -> tuple[DataFrame, str]:
    """A collection as it is found: the snapshot with the log laid over it, and its status. Without a log the snapshot stands."""
    snapshot = load(spark, snapshot_path)
    try:
        ops, bad = read_log(spark, log_path)
    except AnalysisException:  # no log
        return snapshot, status(snapshot, snapshot.select(F.lit("").alias("_bad")).where("false"), dimension)
    return current(snapshot, ops), status(snapshot, bad, dimension)


def repair(spark: SparkSession, snapshot_path: str, log_path: str, new_path: str, dimension: int) -> tuple[DataFrame, str]:
    """What can be read of a collection, written to new_path as a snapshot without a log: whole operations and vectors of the right length. It is READY then."""
    rows, _ = bootstrap(spark, snapshot_path, log_path, dimension)
    save(rows.where((F.size("values") == dimension) | F.col("values").isNull()), new_path)
    whole = load(spark, new_path)
    return whole, status(whole, whole.select(F.lit("").alias("_bad")).where("false"), dimension)


def audit(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """path, ok of the files below a folder whose SHA-256 is (path, sha256) in the manifest; an empty or changed file isn't ok, a missing one neither."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("got"), "length")
    return manifest.join(found, "path", "left").select("path", F.coalesce((F.col("got") == F.col("sha256")) & (F.col("length") > 0), F.lit(False)).alias("ok"))
