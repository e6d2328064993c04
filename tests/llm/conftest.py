import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000
HARD = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, LONG, "en"), (5, "one two three four five six seven eight nine ten eleven", "en"),
    (6, "one two three four five six seven eight nine ten eleven", "en"), (7, "one two three four five six seven eight nine ten twelve", "xx-long"), (None, "no id here at all", "en"),
    (8, "a" * 5000, "de"), (9, "été élève naïf 漢字 😀 <|endoftext|> it's", "fr"), (9, "été élève naïf 漢字 😀 <|endoftext|> it's", "fr"), (10, " 　odd space\x1cx", "es"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Null ids, texts and languages, empty and long texts, ties, repeated rows, and
    extra columns whose names the operators use themselves."""
    rows = [(i, t, lang, "src", len(t or ""), 7, "x", "y") for i, t, lang in HARD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp string, shard string"
    return spark.createDataFrame(rows, schema).repartition(3, "doc_id", "text")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
