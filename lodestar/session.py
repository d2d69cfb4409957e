"""Session settings that the plans rely on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for correct results on this Spark version.

    Spark 4.1 takes the union of two co-partitioned inputs as partitioned like them,
    but adaptive execution may coalesce the inputs differently; aggregations over
    the union then miss rows of a key. Without that shortcut the union is shuffled.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer partitions than there are: a small file
    with one row group is one task. Larger inputs are not shuffled."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings for the time of the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: a query's shuffle files go when it ends, not when the driver collects its garbage
SHUFFLES_REMOVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local
    master, whose executors are threads of the driver, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables in the shared folder that cut lineage, and their removal.

    ``cut`` writes a frame and returns a scan of what was written, so a lost executor costs a
    re-read. ``drop`` removes tables that nothing reads any more, ``close`` all but those named.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        name = f"{name}-{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/lodestar-index/{name}"
        with settings(self.spark, SHUFFLES_REMOVED):
            df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Tables by the name they were cut under."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for key in [k for k in self.paths if k.rpartition("-")[0] in names]:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key))
            path.getFileSystem(conf).delete(path, True)

    def close(self, *keep: str) -> None:
        self.drop(*{k.rpartition("-")[0] for k in self.paths} - set(keep))


_written: dict[str, Scratch] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: made once, read by whoever needs it, there until
    ``release``."""
    spark = df.sparkSession
    return _written.setdefault(spark.sparkContext.applicationId, Scratch(spark)).cut(df, name)


def release(spark: SparkSession) -> None:
    """Remove every table that ``written`` made in this application. Frames that read them
    must have been written or shown before."""
    if held := _written.pop(spark.sparkContext.applicationId, None):
        held.close()
