"""Session helpers: the folder that all executors share, and materialised cuts of a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders that are already marked to go.
_MARKED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local master gets one below the system's
    temporary folder (tests, a single machine); on a cluster that is an error,
    since executors don't see each other's folders.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set; name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "orbisframe-checkpoints")


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one. It goes when the
    driver's JVM ends in an orderly way, since nothing can read it then."""
    sc = spark.sparkContext
    folder = f"{shared_folder(spark)}/cuts-{sc.applicationId}"
    if folder not in _MARKED:
        _MARKED.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back.

    A written table has its own size as its statistics. ``checkpoint()`` would
    keep the planner's estimate of the plan it replaces; in a loop of joins
    these are products of products, until no join is planned as a broadcast
    and the number itself gets too long to compute with.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
