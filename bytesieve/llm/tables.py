"""Reading the given tables, and frames written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytesieve import session


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below the shared work folder and read again: lineage ends there and lost executors take
    nothing with them."""
    path = session.new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows of whole texts go to Python workers in batches of at most `rows`: at Spark's own 10,000 the executor and each
    of its workers would hold tens of megabytes of texts several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


class Scratch:
    """Stored tables of one computation; all that it does not keep are deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = session.new_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for keyed work: the cluster's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
