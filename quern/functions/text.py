"""Text functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count, of the verifier and of the memory.
CLAIM_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in", "on", "at", "for", "with", "by", "about", "as")
MEMORY_STOP_WORDS = ("the", "and", "a", "of", "to", "in", "is", "that", "it", "for", "on", "with", "as")


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def terms(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts between full stops, question and exclamation marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[.?!]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def content_words(text: Column) -> Column:
    """Terms of more than one byte that are no stop words."""
    return F.filter(terms(text), lambda w: (F.octet_length(w) > 1) & ~w.isin(*CLAIM_STOP_WORDS))


def memory_words(text: Column) -> Column:
    """Lower-case words without what is no letter at their ends, stop words left out."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(F.regexp_replace(w, r"^\P{L}+", ""), r"\P{L}+$", ""))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(*MEMORY_STOP_WORDS))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return F.exists(_strings(*needles), lambda n: F.contains(text, n))


def context_hash(prompt: Column, model: Column, chunks: Column) -> Column:
    """SHA-256 of a prompt, a model's version and chunks (array of id, text) in order, with U+0001 between them; null chunks are none."""
    parts = F.flatten(F.transform(F.coalesce(chunks, F.array().cast("array<struct<id:string,text:string>>")), lambda c: F.array(c["id"], c["text"])))
    return F.sha2(F.array_join(F.concat(F.array(prompt, model), parts), "\x01"), 256)
