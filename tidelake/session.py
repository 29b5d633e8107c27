"""Session settings and the scratch tables that cut long lineages."""

from __future__ import annotations

import atexit
import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


class Scratch:
    """Parquet tables in the folder that driver and executors share.

    The folder is `spark.checkpoint.dir` of the session; only where that is unset in a
    local session a folder under /tmp takes its place.  On a cluster, where executors do
    not share /tmp, it must be set.  A written table survives
    lost executors, as any task can read it again.  Tables go when `drop` is called
    or, at the latest, when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[[^-]*\])?", master):
                raise ValueError(f"spark.checkpoint.dir is unset; master {master!r} needs a folder that all executors share")
            base = "file:///tmp/tidelake-scratch"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` now; returns a DataFrame that reads what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def release(scratch: Scratch) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to."""
    gc.collect()
    scratch.spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone, and with it the need to tidy up
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
