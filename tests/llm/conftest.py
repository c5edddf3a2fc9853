import pytest

from tests.llm.helpers import made_up, table


@pytest.fixture(scope="session")
def texts():
    return made_up(160)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return table(spark, texts).repartition(4, "doc_id").cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


