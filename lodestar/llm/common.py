"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000
CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local master, whose executors are threads of the driver, gets a folder of
    its own when none is named.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set(CHECKPOINT_KEY, found)
    return found


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for correct results and bounded worker memory.

    Spark 4.1 takes the union of two co-partitioned inputs as partitioned like them,
    but adaptive execution may coalesce the inputs differently, so aggregations over
    the union can miss rows of a key: that shortcut is turned off. Arrow batches are
    kept small because a row can be a whole document.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries run inside remove their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``cut`` materialises a frame and returns a scan of the written files, so a
    lost executor only costs a re-read. ``drop`` removes tables that nothing reads
    any more; ``close`` removes every table but those named. A frame that an
    operator returns may still read some: its caller closes the scratch once the
    frame is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.paths: dict[str, str] = {}

    def cut(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """``files``: into so many at most, where the caller knows how small the table is."""
        if files:
            df = df.repartition(files)  # not coalesce: one task would hold the sorters of all the partitions it takes
        if name in self.paths:
            name = f"{name}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        path = f"{shared_dir(self.spark)}/lodestar/{name}-{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

    def close(self, *keep: str) -> None:
        self.drop(*[x for x in self.paths if x not in keep])


def by_value(module_name: str) -> None:
    """Ship a helper module inside the pickled task, so executors need no copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def files_for(spark: SparkSession, rows: int, a_file: int = 20_000) -> int:
    return max(1, min(shuffle_width(spark), -(-rows // a_file)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


BITMAP_BITS = 1 << 23  # 131,072 words of 64 bits: the bound of every bitmap broadcast
BITMAP_FILES = 2


def bitmap(keys: DataFrame, name: str = "key") -> DataFrame:
    """(w, bits): which slots of a fixed-size bitmap the keys fall in."""
    slot = F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    return keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit).alias("bits"))


def marked(df: DataFrame, bits: DataFrame, name: str = "key") -> DataFrame:
    """df with ``hit``: whether its key's slot is set. The broadcast has
    BITMAP_BITS / 64 rows at most, whatever the number of keys."""
    slot = F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))
    there = F.call_function("shiftright", F.col("__bits"), (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    words = bits.select(F.col("w").alias("__w"), F.col("bits").alias("__bits"))
    return (
        df.withColumn("__w", F.shiftright(slot, 6)).join(F.broadcast(words), "__w", "left")
        .withColumn("hit", F.coalesce(there, F.lit(False))).drop("__w", "__bits")
    )


def without_ids(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """df without the rows whose id is in ``ids``; null ids stay.

    Rows that the fixed-size bitmap clears need no shuffle; only the others are
    held against the ids themselves.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{name}`").alias("key"))
    gone = ids.select(F.col(name).alias("key"))
    split = marked(packed, bitmap(gone))
    clear = split.filter("not hit").select("row.*")
    return clear.unionByName(split.filter("hit").drop("hit").join(gone, "key", "left_anti").select("row.*"))
