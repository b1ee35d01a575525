import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and further columns named like the operators' own."""
    rows = [
        (1, "Same text here, of some words", "en", "a", 1), (2, "SAME text here, of some words", None, "a", None), (3, None, "en", None, None), (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 3), (6, LONG, "en", "a", len(LONG)), (7, LONG.upper(), "en", "a", len(LONG)), (1, "Same text here, of some words", "en", "a", 1),
        (None, "same text here, of some words", "en", "a", 1), (None, None, None, None, None), (8, "ÄÖ ünï \u0000 words \U0001F600 \\ \" end", "de", "c", 9), (9, "one", "en", "c", 3),
    ]
    names = ("keep_id", "kept", "row", "b", "edge", "size", "rank", "fp", "node", "n_words", "host", "score", "target", "copies", "bucket", "batch", "key", "start", "norm", "component_id", "n_tokens", "rid", "taken", "id", "a.b", "place", "lines")
    df = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def prose(spark):
    """300 documents with exact copies, near copies and a shared passage."""
    import random

    r = random.Random(4)
    words = [f"{a}{b}" for a in ("ta", "ko", "ri", "mul", "sen", "vo") for b in ("n", "lis", "mer", "dor", "pe", "tu", "gan", "hes")]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.randint(5, 260))]
        text = " ".join(w)
        if i % 10 == 3 and rows:
            text = rows[r.randrange(len(rows))][1]
        elif i % 10 == 5 and rows:
            w = rows[r.randrange(len(rows))][1].split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif i % 10 == 7:
            text = f"{text}\n{passage}\n{text[:40]}"
        rows.append((i * 3, text, "en", f"s{i % 5}" if i % 3 else "s0", len(text)))
    return spark.createDataFrame(rows, DOC)
