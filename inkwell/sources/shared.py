"""Intermediate tables in the folder that driver and executors share, for jobs in rounds and for rows that are read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. In local mode, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def beside(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A table to be joined by broadcast if it has at most ``most`` rows, which are counted; else as it is, to be shuffled."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def dealt(table: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """A table dealt out by a key to partitions of about ``most`` rows, which are counted.

    For rows that shrink so much in a shuffle that its bytes tell nothing of the memory they take: partitions of so many are not
    put together again. Rows of one value of the key stay together.
    """
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // most)), key)


class Tables:
    """Tables of one job. A table that was written needs nothing of what it was made from, so a lost executor costs no round."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """(the table, its path)."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path
