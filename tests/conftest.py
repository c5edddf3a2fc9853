import pytest

from postweave.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column function over a list of strings."""

    def run(fn, values):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(values)), "i INT, c STRING")
        out = rows.select("i", fn(F.col("c")).alias("out")).collect()
        return [row["out"] for row in sorted(out, key=lambda r: r["i"])]

    return run
