import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_table(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def docs(docs_table):
    return [r.asDict() for r in docs_table.collect()]


#: Nulls in any column, empty and blank texts, ties, repeated rows and a long
#: text; extra columns whose names clash with the operators' own.
LONG = " ".join(f"word{i % 97} and{i % 89}" for i in range(20_000))
LINE = "A line that stands in several documents of this table, word for word."
ODD = [
    (1, "", "en", "a"), (2, None, None, None), (3, " \n\t\n", "en", "a"), (4, LINE, "en", "a"),
    (5, LINE + "\nanother line here\n" + LINE, "fr", "b"), (5, LINE + "\nanother line here\n" + LINE, "fr", "b"),
    (None, LINE.upper() + "\nthe null document", "en", "c"), (7, LONG, "en", None), (8, LONG + "\n" + LINE, "en", "a"),
    (9, "é" * 9 + "\n" + "é" * 10 + "\n<|endoftext|> été 日本語 ½ £$%", "fr", "b"), (10, "é" * 9 + "\n" + "é" * 10, "fr", "b"),
    (11, "one two three", "en", "a"), (12, "One two THREE", "en", "a"), (13, "x" * 3000, None, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, i, "h", 0, 0) for i, r in enumerate(ODD)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_lines long, key string, component long, "
        "shard int")


@pytest.fixture(scope="session")
def odd_docs():
    return [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in ODD]


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
