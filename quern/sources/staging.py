"""Tables that a job reads in many passes, written once where all executors reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import q


def _folder(spark: SparkSession) -> str | None:
    given = spark.conf.get("spark.checkpoint.dir", None)
    return tempfile.mkdtemp(prefix="staging-") if given is None and spark.sparkContext.master.startswith("local") else given


class Staging:
    """A folder of staged tables inside the one the cluster names in spark.checkpoint.dir; a local session without one gets a
    temporary folder, a cluster without one caches the tables instead. `release` deletes it; as a context manager, at the end."""

    def __init__(self, spark: SparkSession) -> None:
        shared = _folder(spark)
        self.spark, self.folder, self.cached = spark, shared and f"{shared}/staging-{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame) -> DataFrame:
        """`df` as it is now, computed once. Columns are stored by place, so any name will do."""
        if self.folder is None:
            self.cached.append(df.persist())
            return df
        place = f"{self.folder}/{uuid.uuid4().hex}"
        df.select(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).write.parquet(place)
        stored = self.spark.read.parquet(place)
        return stored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()
        if self.folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.release()
