"""File sources and sinks (S1-S9): JSON / CSV ticket files, partitioned split and feature
tables, fitted-state and index tables, reports. Paths live under a base folder the caller
names; ``scratch_path`` derives one from the session's (shared) checkpoint folder."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written as a Parquet table under the shared folder and read back: lineage is cut, rows are computed
    once, and the planner knows the size. The tables stay until that folder is cleaned.

    With ``release`` the shuffle files go at once that no plan holds any more."""
    return _written(df, scratch_path(df.sparkSession, name), release)


@contextmanager
def passing(df: DataFrame, name: str, release: bool = False) -> Iterator[DataFrame]:
    """``materialise`` for as long as the block runs; the table is deleted at its end, so what is read from it must be written by then."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        yield _written(df, path, release)
    finally:
        _delete(spark, path)


@contextmanager
def passing_bucketed(df: DataFrame, by: str, buckets: int) -> Iterator[DataFrame]:
    """``passing`` with a table of ``save_bucketed``, not sorted."""
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    name = save_bucketed(df, path, by, buckets, release=True, ordered=False)
    del df
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _written(df: DataFrame, path: str, release: bool) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    if release:
        _release(spark)
    return spark.read.schema(schema).parquet(path)


def _release(spark: SparkSession) -> None:
    """The context cleaner drops finished shuffles once both garbage collectors have let go of the plan."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON tickets with an explicit schema (no inference); ``multiline`` for JSON arrays."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S3 (CSV form): header, quoted multi-line fields."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV split scan with an explicit schema, multi-line quoted fields."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path))


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet partitioned by split (and target); readers prune partitions."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def scan_partition(spark: SparkSession, path: str, **eq: str) -> DataFrame:
    """Partition-pruned read (the filter reaches the file listing)."""
    df = spark.read.parquet(path)
    for k, v in eq.items():
        df = df.where(F.col(k) == v)
    return df


def save_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Fitted state or index as one Parquet table per name (postings sorted by term so
    a later range scan on a term reads few row groups)."""
    for name, df in tables.items():
        w = df.sortWithinPartitions("term") if "term" in df.columns else df
        w.write.mode("overwrite").parquet(f"{base}/{name}")


def save_bucketed(df: DataFrame, path: str, by: str, buckets: int, release: bool = False, ordered: bool = True) -> str:
    """``df`` as a table bucketed and (where ``ordered``) sorted by ``by``; joins and aggregations on it read it without an exchange.
    Returns the table's name in the session's catalogue; the data lie under ``path``. ``release`` as in ``materialise``."""
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    out = df.write.bucketBy(buckets, by)
    (out.sortBy(by) if ordered else out).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    del df, out
    if release:
        _release(spark)
    return name


def load_tables(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def scan_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The JSON report at ``path``; one that does not exist is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
