import pytest

from tallystar.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one expression over one row of named values."""

    def evaluate(column, schema="v string", value=("",)):
        return spark.createDataFrame([tuple(value)], schema).select(column).first()[0]

    return evaluate
