import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, repeated ids, and other columns' names."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "δέλτα", "été", "x1", "token=abcdef99", "#tag", "AKIA" + "Z" * 16, "0123456789abcdef01234567"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 10),
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 10),
        (1, "another text under the same id, with words enough to pass every rule there is", "en", "a", 10),
        (None, "no id but words, many words, enough of them to be kept by all of the rules", None, None, None),
        (2, None, "en", "b", 0),
        (3, "", None, "b", 0),
        (4, " \n\t ", "de", None, None),
        (5, long, "en", "a", len(long)),
        (6, long, "en", "b", len(long)),
        (7, "short", "en", "b", 5),
        (8, "line\nline\nline\n\n\nline two", "en", "b", 5),
        (9, "日本語の文章 <|endoftext|> and 🙂 emoji <|", "ja", "b", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clashes = "token_ids spans kept n_words n_hit p site score node key words text_hash class_id windows item_ids _key _host _blob _text h rep body blob host path".split()
    return df.selectExpr("*", *[f"'clash' as {c}" for c in clashes])
