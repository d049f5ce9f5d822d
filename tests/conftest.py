import pytest
from pyspark.sql import SparkSession

from lictor.session import tune


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("lictor-tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def table(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture
def rows():
    """Rows of a DataFrame as dicts, ordered by the given columns."""
    return lambda df, *by: [r.asDict(recursive=True) for r in df.orderBy(*by).collect()]
