"""Session helpers shared by the operators: reliable checkpoints, tables written for a while, and table reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; an error where none is set."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder is the session's ``spark.checkpoint.dir``, which has to be one
    that the driver and all executors share. ``spark.cleaner.referenceTracking.
    cleanCheckpoints`` removes what is no longer in use.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared checkpoint folder that go when the ``with`` block ends.

    What is read from them has to be written elsewhere before that.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0

    def __enter__(self) -> Scratch:
        self.path = f"{_folder(self.spark)}/tables-{uuid.uuid4().hex}"
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """All that was added under ``name`` so far."""
        df.write.mode("append").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
