import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


@pytest.fixture(scope="session")
def documents(spark):
    """Maker of a documents table with an extra column."""

    def make(rows):
        full = [(i, t, *rest, *("en", "s")[len(rest):]) for i, t, *rest in rows]
        return spark.createDataFrame([(*r[:4], 0, "x") for r in full], "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
