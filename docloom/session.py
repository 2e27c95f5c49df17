"""Session defaults, table loading and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_dir(master: str) -> str:
    """A new folder on this machine, for sessions that run on it alone; elsewhere an error."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-docloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or an own one in a local session where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path:
        path = there.get() if there.isDefined() else own_dir(spark.sparkContext.master)
    if there.isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read several times, computed once, kept if executors are lost.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: whether a command's shuffle files go when it ends; else they stay until the driver happens to collect its garbage
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bucketed(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """``df`` as a table of ``n`` buckets of ``key`` in the shared folder, sorted within files by ``order``.

    What groups or joins by the key, alone or among others, needs no shuffle.  What was shuffled for it goes when it
    is written, the table when the application ends.
    """
    spark = df.sparkSession
    name = f"docloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    writer = df.write.bucketBy(n, key)
    kept = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        (writer.sortBy(*order) if order else writer).option("path", path).saveAsTable(name)
    finally:
        spark.conf.unset(CLEAN_UP) if kept is None else spark.conf.set(CLEAN_UP, kept)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(name)
