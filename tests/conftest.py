import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one_column(spark):
    """A frame of (id, value) from a list of values."""

    def build(values, kind="string", name="value"):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, f"id int, {name} {kind}").repartition(3)

    return build


@pytest.fixture
def by_id():
    """The values of a column in the order of ``id``."""

    def read(df, name):
        return [row[name] for row in sorted(df.collect(), key=lambda row: row.id)]

    return read
