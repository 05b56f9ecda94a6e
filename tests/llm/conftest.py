import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture()
def tables(spark, tmp_path):
    """Write small tables as a folder of Parquet files; missing columns become null."""

    def write(**rows):
        for name, (schema, values) in rows.items():
            spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
