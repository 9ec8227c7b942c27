"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: the cluster's where spark.checkpoint.dir is
    set, else a new temporary one if all runs in one process (tests). A cluster without
    the setting is an error, as its machines share no temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="arterial-"))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


FRAME_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_frames(spark: SparkSession) -> None:
    """Python workers get rows in frames of 4 MB at most, where the session has Spark's own 64 MB:
    both sides hold a frame in memory outside of the heap."""
    if spark.conf.get(FRAME_BYTES) == "67108864b":
        spark.conf.set(FRAME_BYTES, "4m")


def release() -> None:
    """Gives memory that is free back to the system, where the C library can: Python workers live
    on from stage to stage, beside an executor's other memory."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Tables:
    """Tables written to the shared checkpoint folder between the steps of an operator.

    Unlike a checkpoint they are compressed, know their size, so that Spark can tell a
    small one, and can be let go as soon as a step no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = with_checkpoints(spark)
        self.root = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *kept: DataFrame) -> None:
        """Removes the files of tables that ``keep`` returned."""
        sc = self.spark.sparkContext
        for df in kept:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = sc._jvm.org.apache.hadoop.fs.Path(path)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
