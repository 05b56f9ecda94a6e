import os

from pyspark.sql import functions as F

from tokenloom.session import materialize


def shuffle_files(folder):
    return [name for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_") and name.endswith(".data")]


def test_shuffles_of_a_stored_table_are_removed(spark):
    folder = str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = set(shuffle_files(folder))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(setting, None)
    counted = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    for _ in range(2):  # the same frame may be stored again, and be read afterwards
        assert materialize(counted, "counted").count() == 700
    assert spark.conf.get(setting, None) == held
    assert len(counted.collect()) == 700
    stored = set(shuffle_files(folder)) - before
    materialize(counted, "counted")
    assert set(shuffle_files(folder)) - before <= stored
