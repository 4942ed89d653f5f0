import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("mapengine-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Applies a Column function to single values: ``column(fn, *values) -> list``."""

    def apply(fn, *values):
        from pyspark.sql import functions as F

        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        width = len(rows[0]) - 1
        names = [f"c{i}" for i in range(width)]
        schema = "i INT, " + ", ".join(f"{n} STRING" for n in names)
        df = spark.createDataFrame(rows, schema)
        return [r[0] for r in df.orderBy("i").select(fn(*[F.col(n) for n in names])).collect()]

    return apply
