import pytest

SF = "/root/testdata/sf0.001"

LONG = "alpha beta gamma delta epsilon " * 6000


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows and a null id."""
    return [(1, None, "s"), (2, "", None), (3, " \n\t ", "s"), (4, LONG, "t"), (5, LONG, "t"), (6, "one two", "s"),
            (6, "one two", "s"), (7, "One  TWO", None), (None, "one two three four five", "s"), (None, None, None),
            (8, "é ☃ \U0001f600 zero\x00byte", "s")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    rows = [(*r, "x", 1, True) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string, size long, kept boolean")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
