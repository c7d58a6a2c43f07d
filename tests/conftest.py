import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def db(spark, tmp_path):
    from veldt.database import Database

    with Database.create(spark, str(tmp_path / "db"), timezone="America/New_York") as handle:
        yield handle


@pytest.fixture
def run(db):
    """Run statements one after the other."""

    def go(*statements: str) -> None:
        for s in statements:
            db.exec(s)

    return go
