"""Metadata filters over the events' JSON and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..registry import query
from ..session import table

_K = "json_extract(props, '$.k')::DOUBLE"


def _filtered(spark, d, condition):
    return table(spark, d, "events").where(compile_filter(condition, F.col("props"))).select("event_id")


def _docs(spark, d):
    t = table(spark, d, "documents")
    meta = F.to_json(F.struct("lang", F.struct("source", "n_chars").alias("origin"), F.when(F.col("doc_id") % 2 == 0, F.col("lang") == "en").alias("english")))
    return t.select("doc_id", meta.alias("meta"))


def _on_docs(spark, d, condition):
    return _docs(spark, d).where(compile_filter(condition, F.col("meta"))).select("doc_id")


@query(f"SELECT event_id FROM events WHERE {_K} = 7")
def json_filter_eq(spark, d):
    return _filtered(spark, d, {"k": {"$eq": 7}})


@query("SELECT doc_id FROM documents WHERE doc_id % 2 <> 0 OR lang <> 'en'")
def json_filter_ne_missing(spark, d):
    """A missing field is unequal to anything: odd documents have none."""
    return _on_docs(spark, d, {"english": {"$ne": True}})


@query(f"SELECT event_id FROM events WHERE {_K} >= 20 AND {_K} < 60")
def json_filter_range(spark, d):
    return _filtered(spark, d, {"k": {"$gte": 20, "$lt": 60}})


@query(f"SELECT event_id FROM events WHERE {_K} IN (1, 2, 3)")
def json_filter_in(spark, d):
    return _filtered(spark, d, {"k": {"$in": [1, 2, 3, "4"]}})


@query(f"SELECT event_id FROM events WHERE ({_K} > 10 AND {_K} <= 30) OR NOT ({_K} < 90)")
def json_filter_and_or_not(spark, d):
    return _filtered(spark, d, {"$or": [{"$and": [{"k": {"$gt": 10}}, {"k": {"$lte": 30}}]}, {"$not": {"k": {"$lt": 90}}}]})


@query("SELECT doc_id FROM documents WHERE source = 'src3' OR n_chars > 5000")
def json_nested_path(spark, d):
    return _on_docs(spark, d, {"$or": [{"origin.source": {"$eq": "src3"}}, {"origin.n_chars": {"$gt": 5000}}]})


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND lang = 'en'")
def json_filter_boolean(spark, d):
    return _on_docs(spark, d, {"english": True})


@query("SELECT doc_id FROM documents WHERE lang > 'en' AND source <> 'src1'")
def json_filter_strings(spark, d):
    return _on_docs(spark, d, {"lang": {"$gt": "en"}, "origin.source": {"$ne": "src1"}})


@query("SELECT doc_id FROM documents WHERE source = 'src2' OR doc_id % 2 = 0 AND lang = 'en'")
def json_filter_mixed_types(spark, d):
    """Numbers and strings are neither equal nor ordered; what else the filter asks for counts."""
    return _on_docs(spark, d, {"$or": [{"origin.n_chars": {"$gt": "0"}}, {"lang": {"$lt": 5}}, {"english": {"$in": [1, "true", True]}}, {"origin.source": "src2"}]})


@query("SELECT doc_id, CASE WHEN length(trim(text)) > 0 THEN text ELSE source END AS shown FROM documents")
def display_text(spark, d):
    """The text to show: the first of the fields that holds any."""
    meta = F.to_json(F.struct("text", F.col("source").alias("content")))
    shown = F.coalesce(F.when(F.length(F.trim(F.get_json_object("m", "$.text"))) > 0, F.get_json_object("m", "$.text")), F.nullif(F.get_json_object("m", "$.content"), F.lit("")), F.col("m"))
    return table(spark, d, "documents").select("doc_id", meta.alias("m")).select("doc_id", shown.alias("shown"))
