import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, _id string, _cut string, hash string, label string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use inside."""
    return lambda *rows: spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def pairs():
    """A table's rows as a sorted list of tuples."""
    return lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
