"""License scans by ordered signature rules, in DataFrame operations alone.

A text is reduced to its lower-cased words with one space between. The rules, some hundreds written by hand in license_rules,
are regular expressions on that: notices, choices of licenses, identifiers, names with versions, grants by a name, bare
names, and places that speak of licenses without giving one. A rule is tried only where its keyword occurs, and a text only
where any may. Rules are ordered by priority; a detection that lies within another of the same or a better priority is
suppressed, so that "apache license version 2 0" leaves nothing of "apache license", nor "not licensed under the mit
license" anything at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_text
from .license_rules import KINDS

#: The phrases that always count, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Kinds of rules from the best priority on, with how sure a detection of the kind is.
SURE = {k: sure for k, (_, sure) in KINDS.items()}
#: Short words that many keywords hold; a text needs one of them, or one of the keywords without any, to be looked at.
STEMS = ("licen", "copyright", "gpl", "public domain", "creative", "cc by", "cc0", "redistribut", "permission", "software", "rights reserved", "mpl", "bsd", "epl", "cddl")


def rules() -> list[tuple[str, int, str, str]]:
    """(keyword, priority, labels, regex) in order."""
    out = []
    for priority, (lines, _) in enumerate(KINDS.values()):
        for line in filter(None, lines.split("\n")):
            labels, keyword, regex = (x.strip() for x in f" {line}".split(" | ", 2))
            out.append((keyword, priority, labels, regex))
    return out


def gate() -> list[str]:
    """Words of which any text that a rule with a label can match holds one: each such rule's keyword holds one of them."""
    keywords = sorted({k for k, _, labels, _ in rules() if labels}, key=len)
    used = [s for s in STEMS if any(s in k for k in keywords)]
    rest: list[str] = []
    for k in keywords:
        if not any(s in k for s in used + rest):
            rest.append(k)
    return used + rest


def _places(norm: Column, pattern: Column) -> Column:
    """(start, end) in characters of every match of the whole-word pattern in norm, leftmost and without overlap."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, whole, F.lit(0))
    before = F.transform(F.split(norm, whole, F.lit(-1)), F.length)
    sizes = F.transform(found, F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    pairs = F.arrays_zip(F.slice(before, 1, F.size(found)).alias("gap"), sizes.alias("len"))
    step = F.aggregate(pairs, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("a"), (s["at"] + x["gap"] + x["len"]).alias("b")))).alias("out")))
    return step["out"]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections: one row for each row of docs.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all beyond ASCII. n_base counts the places of the BASE
    phrases, first_word and last_word are the smallest and largest words at which one starts (null without any).
    detections: array of (labels, priority, first word, number of words) that the rules leave after suppression, by place.
    base_labels and labels: distinct labels, sorted, joined by commas; labels has the rules' too. score: 1 less the product
    of what each detected label leaves in doubt, 0 without labels. A null text is an empty one: no words, no labels. Rows
    that repeat an id, or have none, are scanned like others. Only the two columns are read. An empty table gives an empty
    table.
    """
    rows = id_text(docs, id_col, text_col)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    rows = rows.select("doc_id", norm.alias("norm")).withColumn("norm", F.when(F.col("norm") == "  ", " ").otherwise(F.col("norm")))

    def spaces(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    phrase = "(?<= )(" + "|".join(BASE) + ")(?= )"
    has_phrase = reduce(lambda a, b: a | b, [F.contains(F.col("norm"), F.lit(f" {p} ")) for p in BASE])
    rows = rows.withColumn("pieces", F.when(has_phrase, F.split("norm", phrase, -1)))
    n_words = (spaces(F.col("norm")) - 1).cast("long")
    last = F.element_at("pieces", -1)
    base = {
        "n_words": n_words,
        "n_base": F.coalesce(F.size("pieces") - 1, F.lit(0)).cast("long"),
        "first_word": F.when(F.col("pieces").isNotNull(), spaces(F.element_at("pieces", 1)) - 1).cast("long"),
        # The words of the last phrase: those after it and its own.
        "last_word": F.when(F.col("pieces").isNotNull(), n_words - (spaces(last) - 1) - F.size(F.split(F.element_at(F.regexp_extract_all("norm", F.lit(phrase), F.lit(1)), -1), " "))).cast("long"),
        "base_found": F.array_compact(F.array(*[F.when(F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()])),
    }
    may = reduce(lambda a, b: a | b, [F.contains(F.col("norm"), F.lit(w)) for w in gate()])
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(label).alias("l"), F.lit(r).alias("r")) for k, p, label, r in rules()])
    tried = F.filter(table, lambda r: F.contains(F.col("norm"), r["k"]))
    found = F.flatten(F.transform(tried, lambda r: F.transform(_places(F.col("norm"), r["r"]), lambda m: F.struct(m["a"].alias("a"), (-m["b"]).alias("z"), r["p"].alias("p"), r["l"].alias("l")))))
    rows = rows.withColumns(base).withColumn("found", F.when(may, F.array_sort(found)))
    # One pass in order of start, longest first: how far the detections of each priority have reached so far.
    ranks = range(len(SURE))
    start = F.struct(F.array(*[F.lit(-1) for _ in ranks]).alias("far"), F.array().cast("array<struct<a:int,z:int,p:int,l:string>>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        inside = F.array_max(F.slice(s["far"], 1, d["p"] + 1)) >= -d["z"]
        far = F.transform(s["far"], lambda x, i: F.when((i == d["p"]), F.greatest(x, -d["z"])).otherwise(x))
        return F.struct(F.when(inside, s["far"]).otherwise(far).alias("far"), F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(d))).alias("out"))

    kept = F.filter(F.aggregate("found", start, step)["out"], lambda d: d["l"] != "")
    rows = rows.withColumn("kept", F.coalesce(kept, F.array().cast("array<struct<a:int,z:int,p:int,l:string>>")))
    rows = rows.withColumn("each", F.flatten(F.transform("kept", lambda d: F.transform(F.split(d["l"], " "), lambda l: F.struct(l.alias("l"), d["p"].alias("p"))))))
    sure = F.array(*[F.lit(x) for x in SURE.values()])
    best = F.transform(F.array_distinct(F.concat(F.transform("each", lambda d: d["l"]), "base_found")), lambda l: F.struct(l.alias("l"), F.coalesce(F.array_min(F.transform(F.filter("each", lambda d: d["l"] == l), lambda d: d["p"])), F.lit(len(SURE) - 1)).alias("p")))
    doubt = F.aggregate(best, F.lit(1.0), lambda x, b: x * (1 - F.element_at(sure, b["p"] + 1)))
    words_before = lambda a: (spaces(F.substring(F.col("norm"), F.lit(1), a)) - 1)
    detections = F.transform("kept", lambda d: F.struct(d["l"].alias("label"), d["p"].alias("priority"), words_before(d["a"]).cast("long").alias("first_word"), F.size(F.split(F.substring(F.col("norm"), d["a"] + 1, -d["z"] - d["a"]), " ")).cast("long").alias("words")))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base_found")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_found", F.transform("each", lambda d: d["l"])))), ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"), detections.alias("detections"),
    )
