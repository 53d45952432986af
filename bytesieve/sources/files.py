"""File headers without reading whole files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.sources.header_source import HeaderSource, Store


def prefix(path: Column, size: int = rules.HEADER_SIZE) -> Column:
    """The first ``size`` bytes of each named file, read in the tasks."""

    @F.arrow_udf("binary")
    def run(paths: pa.Array) -> pa.Array:
        stores = [None if p is None else Store(p) for p in paths.to_pylist()]
        return pa.array([None if s is None else s.prefix(s.root, size) for s in stores], pa.binary())

    return run(path)


def _source(spark: SparkSession, path: str, glob: str | None, **options) -> DataFrame:
    spark.dataSource.register(HeaderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(HeaderSource.name()).options(**options)
    return (reader.option("glob", glob) if glob is not None else reader).load(path)


def list_files(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Path and size of every file, empty ones included (Spark's own file source would leave those out); nothing is
    opened."""
    return _source(spark, path, glob, recursive=recursive, size=0).drop("header")


def file_headers(spark: SparkSession, path: str, *, size: int = rules.HEADER_SIZE, glob: str | None = None,
                 recursive: bool = True, per_task: int = 20_000) -> DataFrame:
    """(path, file_size, header) for a folder of files of any size, ``per_task`` files to a task.

    Each task reads only the prefixes of its files; a whole-file reader would load every file and give each big one a
    task of its own.
    """
    return _source(spark, path, glob, recursive=recursive, size=size, filesPerTask=per_task)


def sample_folders(spark: SparkSession, path: str, labels: dict[str, int], **kw) -> DataFrame:
    """Headers of labelled folders: the folder name below ``path`` gives the label."""
    root = Store(path).root.rstrip("/") + "/"
    folder = F.substring_index(F.substring_index("path", root, -1), "/", 1)  # the first one below path
    out = F.lit(None).cast("int")
    for name, value in labels.items():
        out = F.when(folder == name, F.lit(value)).otherwise(out)
    return file_headers(spark, path, **kw).withColumn("label", out)


def header_table(df: DataFrame, data: str = "data", size: int = rules.HEADER_SIZE, out: str = "header") -> DataFrame:
    """Header prefix of a byte column."""
    return df.withColumn(out, F.substring(data, 1, size))


def response_prefix(df: DataFrame, size: int = rules.HEADER_SIZE, body: str = "body", status: str = "http_status") -> DataFrame:
    """First bytes of successful responses (200-299, which includes 206)."""
    return header_table(df.where(F.col(status).between(200, 299)), body, size)
