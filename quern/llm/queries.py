"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many layers were cut, of every document."""
    from .secrets import secrets

    return secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_cut")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and the shards that its first and second copy go to."""
    from .mixing import draws

    return draws(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard1", "shard2")


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding."""
    from .lattice import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base phrases' counts and places, base_labels, labels and score of every document."""
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents")).drop("detections")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text is an empty one."""
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score of every document under the public 32k pieces."""
    import public_tokenizers

    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a machine fitted to the labels that are not held out."""
    from .toxicity import learn, scores

    docs = table(spark, sf_dir, "documents")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_lattice, op4_licenses, op5_byte_bpe, op6_simhash, op7_token_counts, op8_quality, op9_personal_data, op10_toxicity)}

#: SQL for the queries that SQL can express.
SQL: dict[str, str] = {}
