import pytest

from gradeloom.session import scratch_dir, spread, stage


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class Fake:
    def __init__(self, value, master):
        self.conf = Conf(value)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_the_named_folder_is_used(spark):
    assert scratch_dir(Fake("s3a://shared/checkpoints/", "yarn")) == "s3a://shared/checkpoints"


def test_a_cluster_has_to_name_a_folder():
    with pytest.raises(RuntimeError):
        scratch_dir(Fake(None, "yarn"))


def test_one_machine_gets_one_folder():
    fake = Fake(None, "local[2]")
    assert scratch_dir(fake) == scratch_dir(fake)


def test_stage_freezes_values(spark):
    from pyspark.sql import functions as F

    df = stage(spark.range(100).withColumn("r", F.rand()))
    assert df.collect() == df.collect()


def test_spread_leaves_large_scans_alone(spark):
    many = spark.range(100, numPartitions=64)
    assert spread(many, "id") is many
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() > 1


def test_spread_cuts_scans_whose_rows_lie_in_few_tasks(spark, tmp_path):
    """A file of one row group is read by many tasks, and one of them gets the rows."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "one.parquet")
    spark.range(200000).select("id", F.rand(1).alias("x")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores
        rows = spread(scan, "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert rows * cores <= 2 * 200000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_worker_functions_need_no_package(tmp_path):
    """A worker that has never heard of the package can run the facts function."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from gradeloom.operators import code_facts

    path = tmp_path / "function.pkl"
    path.write_bytes(cloudpickle.dumps(code_facts._facts))
    program = f"import pickle; print(pickle.load(open({str(path)!r}, 'rb'))('x = 1', ())['has_logic'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert found.stdout.strip() == "True", found.stderr
