"""The pipeline, stage by stage, against plain versions of its decisions."""

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
import oracle
from quern.llm import bpe, mixing, secrets, simhash, toxicity


def test_pipeline(spark):
    docs = spark.read.parquet(f"{oracle.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{oracle.SMALL}/labels.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, oracle.SMALL)
        if name != "tokens":
            assert now.columns == docs.columns
        now = now.cache()
        kept[name] = [r.asDict() for r in now.collect()]

    machine = toxicity.learn(docs, labels)
    before = [r.asDict() for r in docs.collect()]
    want = [r for r in before if machine.score(r["text"] or "") < toxicity.THRESHOLD]
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, kept["toxicity"])) == sorted(map(key, want))

    prints = {r["doc_id"]: simhash.fingerprint(r["text"] or "") for r in want}
    ids, seen, stay = sorted(prints), set(), []
    for i in ids:  # the smallest id of each group, and all it reaches
        if i not in seen:
            stay.append(i)
            work = [i]
            while work:
                a = work.pop()
                seen.add(a)
                work += [b for b in ids if b not in seen and (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE]
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == stay

    masked = {r["doc_id"]: r["text"] and secrets.redacted(r["text"]) for r in kept["near_duplicates"]}
    assert {r["doc_id"]: r["text"] for r in kept["secrets"]} == masked and len(kept["secrets"]) == len(masked)

    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert max(times.values()) <= 2 and all(r["text"] == masked[r["doc_id"]] for r in kept["mixing"])
    size = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in kept["secrets"]}
    sources = sorted({s for s, _ in size.values()})
    total = [sum(n for s, n in size.values() if s == x) for x in sources]
    for x, target in zip(sources, mixing.targets(total), strict=True):
        got = sum(times[i] * n for i, (s, n) in size.items() if s == x)
        assert abs(got - target) <= max(n for s, n in size.values() if s == x)

    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted(map(key, kept["tokens"])) == sorted(map(key, kept["mixing"]))
    assert all(r["token_ids"] == tik.encode_ordinary(r["text"] or "") for r in kept["tokens"])


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, an id with two texts, rows without ids, copies among them, and columns named like those used inside."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12 + i % 5))
    rows = [(i, text(i), "en", "ab"[i % 2], i) for i in range(40)]
    rows += [(1, text(100), "en", "a", 1000), (1, text(1), "fr", "a", 1001), (None, text(2), "en", "a", 1002), (None, text(200), None, None, 1003), (None, text(200), None, None, 1004), (50, None, "en", "b", 1005), (51, "", None, None, 1006), (52, f"{text(52)} password=hunter2secret", "en", None, 1007)]
    clash = ["_id", "_c", "_slice", "_stays", "row", "doc", "copy", "shard1", "block", "fp", "part", "mark", "score", "i0", "m0", "m"]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("kept").alias(c) for c in clash])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "token_ids"]
    got = [r.asDict() for r in out.collect()]
    times = Counter(r["n_chars"] for r in got)
    machine = toxicity.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    clean = {r[4] for r in rows if machine.score(r[1] or "") < toxicity.THRESHOLD}
    gone = {1002, 1005, 1006, 1001} | ({1004} if 1003 in times else {1003})  # copies and texts without words, and one of the rows that are alike
    assert set(times) <= clean - (gone - {1001}) and max(times.values()) <= 2
    assert len({1, 1001} & set(times)) <= 1 and all(r["_slice"] == r["row"] == "kept" for r in got)
    assert all("hunter2" not in r["text"] for r in got)
    # Few documents, of which the heavier source is taken twice.
    size = {r[4]: (r[3], len((r[1] or "").split())) for r in rows}
    held = {s: sum(size[n][1] * k for n, k in times.items() if size[n][0] == s) for s in ("a", "b")}
    assert held["a"] > held["b"] > 0
    key = lambda df: sorted(str(sorted(r.asDict().items(), key=str)) for r in df.collect())
    assert key(out) == key(corpus_pipeline.run(spark, str(tmp_path)))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{oracle.SMALL}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "token_ids"
