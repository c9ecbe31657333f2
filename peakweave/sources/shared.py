"""Cuts in the lineage, and Python functions on the executors.

Intermediate tables go as Parquet to the folder that the cluster names in
``spark.checkpoint.dir``, which every executor sees, so a lost executor costs
at most the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from peakweave.sources.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set and all runs in one process (tests, a laptop), a temporary one for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("peakweave.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("executors share no local folder: set spark.checkpoint.dir")
        found = f"file://{tempfile.mkdtemp(prefix='peakweave-')}"
        spark.conf.set("peakweave.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_part(spark)}/{uuid.uuid4().hex}-{name}"


def _own_part(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/peakweave/{spark.sparkContext.applicationId}"


def remove_intermediates(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; only when no result that still reads it is wanted."""
    store, at = _hadoop(spark, _own_part(spark))
    store.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop names them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text_file(df: DataFrame, path: str) -> None:
    """The rows of ``df``, text in a global order, as one file.

    Tasks write parts beside it; their bytes are then passed on one after another, so that no more than a buffer of them is
    held. An earlier output at the path is replaced.
    """
    spark = df.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.write.text(parts)
    store, folder = _hadoop(spark, parts)
    _, to = _hadoop(spark, path)
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        store.delete(to, True)
        out = store.create(to, True)
        try:
            names = sorted(s.getPath().toString() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-"))
            for name in names:
                part = store.open(spark._jvm.org.apache.hadoop.fs.Path(name))
                try:
                    copy(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()
    finally:
        store.delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and it is computed once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # Snappy's direct buffers pile up where the heap is seldom collected
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package on the executors: a function takes along what is shipped when it is made."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
