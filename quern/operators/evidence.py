"""Evidence and claims: sentences against chunks, by tokens they share, never every sentence with every chunk.

Only pairs that share enough matter. A set whose commonest tokens together fall short of what must be shared is looked up by
its other tokens alone, the rare ones, so that the words which all texts have bring no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def sentence_rows(answers: DataFrame, text_col: str, words, *keys: str) -> DataFrame:
    """keys, pos, sentence, ws (its words)."""
    rows = answers.select(*keys, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence"))
    return rows.withColumn("ws", words(F.col("sentence")))


def posted(sets: DataFrame, words: str, *keys: str) -> DataFrame:
    """keys, w: a row for each distinct word of a set."""
    return sets.select(*keys, F.explode(F.array_distinct(words)).alias("w"))


def rare(sets: DataFrame, words: str, need: Column, among: DataFrame, *keys: str) -> DataFrame:
    """keys, w: of each set of words those by which any set of among(w, ...) can be found that shares words of weight need at least.

    A word weighs as often as it stands in the set. The words are taken from the rarest among the others on; what is left
    out weighs less than need. Words that no other set has are left out too, as they can't be shared.
    """
    often = among.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    each = sets.select(*keys, need.alias("need"), F.explode(words).alias("w")).groupBy(*keys, "need", "w").agg(F.count(F.lit(1)).alias("m"))
    ranked = each.join(often, "w").groupBy(*keys, "need").agg(F.array_sort(F.collect_list(F.struct(F.col("df"), F.col("w"), F.col("m")))).alias("v"))
    # From the commonest on: how many can be left out while their weight stays below need.
    left = F.aggregate(F.reverse("v"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["sum"] + x["m"]).alias("sum"), F.when(a["go"] & (a["sum"] + x["m"] < F.col("need")), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & (a["sum"] + x["m"] < F.col("need"))).alias("go")))
    return ranked.select(*keys, F.explode(F.slice("v", F.lit(1), F.size("v") - left["n"])).alias("x")).select(*keys, F.col("x.w").alias("w"))


def shared(sentences: DataFrame, chunks: DataFrame, chunk_id: str, chunk_text: str, words, need: Column, *keys: str) -> DataFrame:
    """keys, pos, chunk, same: how many of a sentence's words (as often as they stand in ws) each chunk has, where that is need at least."""
    sets = chunks.select(F.col(chunk_id).alias("chunk"), F.array_distinct(words(F.col(chunk_text))).alias("cw"))
    of_chunks = posted(sets, "cw", "chunk")
    some = sentences.select(*keys, "pos", "ws").where(F.size("ws") > 0)
    pairs = rare(some, "ws", need, of_chunks, *keys, "pos").join(of_chunks, "w").select(*keys, "pos", "chunk").distinct()
    both = pairs.join(some, [*keys, "pos"]).join(sets, "chunk")
    return both.withColumn("same", F.size(F.filter("ws", lambda w: F.array_contains("cw", w))).cast("long")).where(F.col("same") >= need).select(*keys, "pos", "chunk", "same")


def evidence(answers: DataFrame, text_col: str, chunks: DataFrame, chunk_id: str, chunk_text: str, *keys: str) -> DataFrame:
    """keys, pos, chunks (supporting, sorted), score: chunks with over .3 of a sentence's distinct words, and the best share; 0 without any."""
    def words(c: Column) -> Column:
        return F.array_distinct(T.words(c))

    rows = sentence_rows(answers, text_col, words, *keys)
    need = F.floor(F.size("ws") * F.lit(3) / F.lit(10)) + 1  # over three tenths
    near = shared(rows, chunks, chunk_id, chunk_text, words, need, *keys).join(rows.select(*keys, "pos", F.size("ws").alias("n")), [*keys, "pos"])
    good = near.withColumn("s", F.col("same") / F.col("n")).where("s > 0.3").groupBy(*keys, "pos").agg(F.array_sort(F.collect_set("chunk")).alias("chunks"), F.max("s").alias("score"))
    return rows.select(*keys, "pos").join(good, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("chunks", F.array().cast("array<bigint>")).alias("chunks"), F.coalesce("score", F.lit(0.0)).alias("score"))


def verify(answers: DataFrame, text_col: str, chunks: DataFrame, chunk_id: str, chunk_text: str, *keys: str, least: float = 0.3, strict: bool = False) -> DataFrame:
    """keys, supported, claims, score, status. A claim is a sentence; one without content words counts as a claim, though never as supported."""
    rows = sentence_rows(answers, text_col, T.content_words, *keys)
    need = F.greatest(F.lit(1), F.ceil(F.size("ws") * F.lit(least) - 1e-9))
    best = shared(rows, chunks, chunk_id, chunk_text, T.content_words, need, *keys).groupBy(*keys, "pos").agg(F.max("same").alias("same"))
    claims = rows.join(best, [*keys, "pos"], "left").groupBy(*keys).agg(F.count_if(F.coalesce(F.col("same") / F.nullif(F.size("ws"), F.lit(0)), F.lit(0.0)) >= least).alias("supported"), F.count(F.lit(1)).alias("claims"))
    every = answers.select(*keys).join(claims, list(keys), "left").select(*keys, F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("claims", F.lit(0)).alias("claims"))
    score = F.col("supported") / F.greatest("claims", F.lit(1))
    status = F.when(score >= 0.8, "Pass").when((score >= 0.5) & F.lit(not strict), "Flag").otherwise("Fail")
    return every.select(*keys, "supported", "claims", score.alias("score"), status.alias("status"))


def alike(one: DataFrame, two: DataFrame, share: float) -> DataFrame:
    """a, b: sets of words one(a, aw) and two(b, bw), without repeats, that share at least that share of the smaller one's words; empty sets are like none."""
    one, two = one.where(F.size("aw") > 0), two.where(F.size("bw") > 0)
    need = lambda c: F.ceil(F.size(c) * F.lit(share) - 1e-9)
    of_one, of_two = posted(one.withColumn("na", F.size("aw")), "aw", "a", "na"), posted(two.withColumn("nb", F.size("bw")), "bw", "b", "nb")
    # A pair is found from its smaller set, by rare words of that; need depends on it alone.
    from_one = rare(one.withColumn("na", F.size("aw")), "aw", need("aw"), of_two, "a", "na").join(of_two, "w").where("na <= nb").select("a", "b")
    from_two = rare(two.withColumn("nb", F.size("bw")), "bw", need("bw"), of_one, "b", "nb").join(of_one, "w").where("nb < na").select("a", "b")
    both = from_one.union(from_two).distinct().join(one, "a").join(two, "b")
    return both.where(F.size(F.array_intersect("aw", "bw")) / F.least(F.size("aw"), F.size("bw")) >= share).select("a", "b")
