import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, n_words int, kept int, key string, h long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, wide white space; extra columns with clashing names."""
    long = " ".join(f"wort{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten " * 3, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "a"),
        (4, " \n\t ", "en", None),
        (5, long, "de", "b"),
        (6, long + " end", "de", "b"),
        (7, "same words here and there", "en", "a"),
        (8, "same  words here\nand there", "en", "b"),
        (8, "same  words here\nand there", "en", "b"),
        (9, "café  naïve x  ß Ǩ J̌ 漢字 <|endoftext|> it's 12,5", "fr", "c"),
        (None, "no id but some words in the text", "en", "c"),
        (None, "another text without an id", "en", None),
        (10, "### $$$ %%% &&& ||| <<< >>> ***", "en", "c"),
        (11, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>\n<|endoftext|>", "en", "c"),
    ]
    return [(*r, None, "x", 3, 7, 1, "k", 5) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
