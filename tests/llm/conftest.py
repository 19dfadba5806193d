import pytest

ODD = "ſecret=abcdefgh é password: hunter2hunter2 ünï"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names clash with those used inside."""
    rows = [
        (1, "plain words of a text that says nothing much at all really", "en", "a"),
        (1, "plain words of a text that says nothing much at all really", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "some text without an id, idiot, call (415) 555-0199 now", "de", "b"),
        (4, " \n\t ", "en", None),
        (5, ODD + " under the Apache License, Version 2.0. token = \"0123456789abcdef0123456789abcdef\" x", "fr", "b"),
        (6, "long " * 40000 + "mit license a.b@c.example.org", "en", "b"),
        (7, "x" * 50000, "es", "c"),
        (8, "don't stop, we'll 's 've  go\r\n\n now  ", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["fp", "key", "score", "label", "block", "n", "size", "found", "norm", "kept", "word", "sid", "labels", "g", "x", "c", "p", "base", "ids"]
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def small_docs(spark):
    import oracle

    return spark.read.parquet(f"{oracle.SMALL}/documents.parquet")
