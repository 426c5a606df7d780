"""Cutting lineage with tables in the folder that all executors share.

The folder is the cluster's ``spark.checkpoint.dir``.  Only on a local master a session without one (tests, a laptop)
gets a temporary folder; on a cluster that would be another disk for every executor, so there it is an error.  A
written table survives the loss of executors and gives the optimiser true sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_ROOTS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="geolith-")
        found = _LOCAL[application]
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of every query this application has run; results not yet read are lost."""
    for root in _ROOTS.pop(spark.sparkContext.applicationId, ()):
        remove(spark, root)


class Scratch:
    """Written intermediate tables of one operator run.

    ``save`` writes a table once and reads it back; ``drop`` removes one that later steps no longer need.  The
    tables behind a returned DataFrame stay, as that DataFrame is lazy, until ``clear`` of this module is called or the
    folder goes with the cluster.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def save(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """by: columns whose values name the folders, so that a reader of one value reads only its folder."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        schema = df.schema
        for field in schema.fields:
            field.nullable = True
        out = self.spark.read.schema(schema).parquet(path).select(*df.columns)
        self.paths[id(out)] = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            if path := self.paths.pop(id(df), None):
                remove(self.spark, path)
