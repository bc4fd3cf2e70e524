import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns with clashing names."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta,", "epsilon.", "zeta", "eta\n", "théta", "iota", "kappa"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long_ = text(60_000)
    base = text(200)
    rows = [
        (1, base, "en", "s1"), (1, base, "en", "s1"), (2, base, "en", "s2"), (3, None, "en", "s1"), (4, "", None, None), (5, "   \n\t ", "fr", "s3"),
        (6, long_, "en", "s1"), (7, base + " more", None, "s1"), (8, "42 !!", "en", None), (None, text(50), "fr", "s2"), (9, "one", "fr", "s2"),
        (10, "x<|endoftext|>y  two  spaces ", "en", "s3"), (11, "\x1c\x85 ÉTÉ ΑΣ. ½ don't", "fr", "s3"), (12, text(300), "en", "s1"), (12, text(300), "fr", "s4"),
    ] + [(20 + i, text(rnd.randrange(1, 400)), rnd.choice(["en", "fr"]), rnd.choice(["s1", "s2", "s3"])) for i in range(40)]
    rows = [(*r, i, float(i), "x", True) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, score double, rejected string, is_toxic boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
