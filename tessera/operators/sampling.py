"""Sampling and splitting (P1-P3) without a global window.

``row_index`` numbers rows in a total order the way ``zipWithIndex`` does, but in DataFrame
form: range-partition + sort within partitions, tag rows with ``monotonically_increasing_id``
(partition id in the high bits), count rows per partition (a tiny table), turn the counts into
offsets and add them back through a broadcast join. No task ever sees more than its own range,
so a skewed key cannot pull all rows into one partition of a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def row_index(df: DataFrame, order: Sequence[str], out: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order of ``order`` (ties must not occur: include a key)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .persist(StorageLevel.MEMORY_AND_DISK)  # fixes the ids used by both branches below
    )
    counts = tagged.groupBy(F.shiftright("_m", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window over it is cheap
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (
        tagged.join(F.broadcast(offsets), F.shiftright(tagged["_m"], 33) == offsets["_pid"])
        .withColumn(out, F.col("_off") + F.col("_m").bitwiseAND(F.lit(_LOW)))
        .drop("_m", "_pid", "_off")
    )


def split_label(pos: Column, n: Column, fractions: Sequence[float], names: Sequence[str]) -> Column:
    """Label by position: the first floor(f1*n) rows get names[0], the next floor(f2*n) names[1],
    ..., the remainder the last name."""
    expr = None
    edge = F.lit(0)
    for f, name in zip(fractions, names[:-1]):
        edge = edge + F.floor(F.lit(float(f)) * n)
        expr = F.when(pos < edge, F.lit(name)) if expr is None else expr.when(pos < edge, F.lit(name))
    return expr.otherwise(F.lit(names[-1]))


def _with_split(df: DataFrame, id_col: str, keys: Sequence[str], label: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """``df`` with the column ``split`` that ``label`` gives to its keys (``id_col`` among them); it gets the keys and the
    columns that break their ties.

    Only keys are sorted and kept; the rows themselves, whole texts among them, meet their split in one join. Where ids
    repeat or are null, rows of equal keys are told apart by their number ``_nth``."""
    light = df.select(*keys)
    repeated = light.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if repeated.isEmpty():
        split = label(light, []).select(F.col(id_col).alias("_id"), "split")
        return df.join(split, df[id_col] == split["_id"]).drop("_id")
    number = lambda x: x.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    own, split = number(df), label(number(light), ["_nth"]).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_nth").alias("_own"), "split")
    same = [own[c].eqNullSafe(split[f"_{c}"]) for c in keys]
    return own.join(split, [*same, own["_nth"] == split["_own"]]).select(*df.columns, "split")


def split_ordered(df: DataFrame, order: str, fractions: Sequence[float] = (0.7, 0.15),
                  names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Ordered split with floor counts, remainder to the last split."""
    def label(keys: DataFrame, ties: Sequence[str]) -> DataFrame:
        n = keys.agg(F.count(F.lit(1)).alias("_total"))
        return row_index(keys, [order, *ties]).crossJoin(F.broadcast(n)).withColumn(  # one-row side
            "split", split_label(F.col("row_idx"), F.col("_total"), fractions, names))
    return _with_split(df, order, [order], label)


def seeded_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random order key: md5 of id || seed (same in any SQL engine)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def split_stratified(df: DataFrame, id_col: str, stratum: str, seed: int = 42,
                     fractions: Sequence[float] = (0.7, 0.15), names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Per stratum, rows in seeded pseudo-random order split by floor counts.

    Rank within a stratum = global position (in stratum, key order) - the stratum's first
    position, so a stratum holding a third of the rows is still spread over many tasks.
    """
    def label(keys: DataFrame, ties: Sequence[str]) -> DataFrame:
        idx = row_index(keys.withColumn("_k", seeded_key(id_col, seed)), [stratum, "_k", id_col, *ties])
        first = idx.groupBy(stratum).agg(F.min("row_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
        return idx.join(first, stratum).withColumn("split", split_label(F.col("row_idx") - F.col("_first"), F.col("_n"), fractions, names))
    return _with_split(df, id_col, [id_col, stratum], label)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``n`` rows = the n smallest seeded keys (top-k, no full sort)."""
    return df.withColumn("_k", seeded_key(id_col, seed)).orderBy("_k", id_col).limit(n).drop("_k")
