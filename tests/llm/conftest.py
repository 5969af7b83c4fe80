import pytest


@pytest.fixture(scope="session", autouse=True)
def cleaned(spark):
    yield
    from ashlar.llm.common import clean

    clean(spark)
