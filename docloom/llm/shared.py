"""Places and table helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    Where that setting is absent, a folder in the warehouse, which is shared as well, takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written to the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables written on the way to a result, which are deleted when it no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str, str | None]] = {}

    def written(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """As `written`; with `by` in buckets of that column, so that joins on it move the other side only."""
        path, label = scratch(self.spark, name), None
        if by is None:
            df.write.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            label = f"docloom_{uuid.uuid4().hex}"
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(parts, by).write.bucketBy(parts, by).sortBy(by).option("path", path).saveAsTable(label)
            out = self.spark.table(label)
        self.paths[id(out)] = out, path, label
        return out

    def clear(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        for key in [id(t) for t in tables] or list(self.paths):
            _, path, label = self.paths.pop(key)
            if label is not None:
                self.spark.sql(f"DROP TABLE {label}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(column: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))
