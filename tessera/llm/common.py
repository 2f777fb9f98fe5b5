"""Shared helpers: written intermediate tables, ASCII lower-casing, bounded lookups.

``stage`` cuts lineage with a Parquet table in the folder that ``spark.checkpoint.dir`` names, so
a lost executor costs at most the running phase, and Spark knows the table's size when it plans
the joins that read it.
"""

from __future__ import annotations

import gc
import string
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space, as a Java / RE2 class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may go without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tessera-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return shared_dir(spark)


def stage(df: DataFrame, release: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files can then go.

    Without ``release`` they go whenever the collectors next run (for the small tables of loops)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    for _ in range(2 if release else 0):  # the context cleaner drops finished shuffles once both garbage collectors have let go of the plan
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts (most) take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
