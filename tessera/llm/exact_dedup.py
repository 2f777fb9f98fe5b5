"""Exact dedup (10): counting quotient filters per partition, merged by sorted remainders.

1. Every text is normalised (runs of white space become one space) and fingerprinted.
2. Each partition builds a counting quotient filter over its fingerprints: the high bits
   (quotient) choose a slot, the sorted remainders of a slot form its run, each with a counter.
   A filter leaves its partition as blocks of consecutive quotients, one row a block, so a group of
   copies, however large, is one entry per partition.
3. Blocks of the same quotients meet in one group and merge losslessly: runs are merged by sorted
   remainder, counters are added. Fingerprints counted once are done.
4. Fingerprints counted more often route their texts to byte verification: grouping by the bytes
   themselves, pre-aggregated in each partition. Different texts that share a fingerprint part here.

Defined cases: a null text is an empty text; a null id is larger than every id; of rows that repeat
both id and text one stays; an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, stage
from tessera.llm.registry import query, table

#: Repeated fingerprints up to which they are sent to the scan (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints; exact, as quotient and remainder keep every bit.

    ``slots`` are the occupied quotients in order, ``ends`` where each one's run of remainders ends.
    """

    def __init__(self, bits: int, fingerprints: np.ndarray, counts: np.ndarray | None = None):
        self.bits = bits
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        added = np.ones(len(ordered), np.int64) if counts is None else counts[order]
        self.counts = np.add.reduceat(added, heads) if len(heads) else added
        keys = ordered[heads]
        shift = np.uint64(64 - bits)
        quotients = keys >> shift
        self.remainders = keys & np.uint64((1 << (64 - bits)) - 1)
        self.slots, first = np.unique(quotients, return_index=True)
        self.ends = np.append(first[1:], len(keys)).astype(np.int64)

    def fingerprints(self) -> np.ndarray:
        runs = np.diff(np.concatenate(([0], self.ends)))
        return (np.repeat(self.slots, runs) << np.uint64(64 - self.bits)) | self.remainders

    def blocks(self, block_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, fingerprints, counters) of consecutive quotients."""
        keys = self.fingerprints()
        of = (keys >> np.uint64(64 - block_bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(of)) + 1
        for k, c in zip(np.split(keys, cut), np.split(self.counts, cut), strict=True):
            if len(k):
                yield int(k[0] >> np.uint64(64 - block_bits)), k.tobytes(), c.astype("<i8").tobytes()

    @classmethod
    def merge(cls, bits: int, parts: list[tuple[bytes, bytes]]) -> QuotientFilter:
        keys = np.concatenate([np.frombuffer(k, "<u8") for k, _ in parts])
        return cls(bits, keys, np.concatenate([np.frombuffer(c, "<i8") for _, c in parts]))


QUOTIENT_BITS = 24


def _build(block_bits: int):
    def build(batches):
        kept = None
        for b in batches:  # the filter holds each distinct fingerprint of the partition once
            new = QuotientFilter(QUOTIENT_BITS, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            kept = new if kept is None else QuotientFilter(QUOTIENT_BITS, np.concatenate((kept.fingerprints(), new.fingerprints())), np.concatenate((kept.counts, new.counts)))
        rows = list(kept.blocks(block_bits)) if kept is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "keys", "counts"])
    return build


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    merged = QuotientFilter.merge(QUOTIENT_BITS, list(zip(pdf["keys"], pdf["counts"], strict=True)))
    more = merged.counts > 1
    return pd.DataFrame({"fp": merged.fingerprints()[more].view(np.int64), "n": merged.counts[more]})


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints (column ``fp``) that occur more than once."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    block_bits = min(QUOTIENT_BITS, max(4, (4 * parts - 1).bit_length()))  # blocks grow in number with the job, not in size
    blocks = fps.select("fp").mapInArrow(_build(block_bits), "block int, keys binary, counts binary")
    return blocks.groupBy("block").applyInPandas(_repeated, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, and _fp (of the normalised text)."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    texts = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("_fp", F.xxhash64("_norm"))
    slim = texts.select("_id", "_fp", F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    first = F.row_number().over(Window.partitionBy("_id", "_fp", "_sha").orderBy("_id"))  # of rows that repeat id and text
    slim = stage(slim.withColumn("_first", first == 1))
    repeated = stage(repeated_fingerprints(slim.select(F.col("_fp").alias("fp"))))
    n = repeated.count()
    route = repeated.select(F.col("fp").alias("_fp"))
    routed = texts.join(F.broadcast(route) if n <= BROADCAST_ROWS else route, "_fp", "left_semi")
    verified = routed.groupBy("_fp", "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = verified.select("_fp", F.unhex(F.sha2("_norm", 256)).alias("_sha"), "keep_id", "group_size").where("group_size > 1")
    out = slim.join(stage(classes), ["_fp", "_sha"], "left")
    out = out.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")),
                           "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      (F.col("_id").eqNullSafe(F.col("keep_id")) & F.col("_first")).alias("kept"),
                      F.lower(F.hex("_sha")).alias("text_sha256"), "_fp")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: all columns, one row of each group of equal texts."""
    kept = stage(exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__t_id"), F.col("_fp").alias("__t_fp"), "text_sha256"))
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    cols = docs.columns
    keyed = docs.withColumn("__t_fp", F.xxhash64(norm)).withColumn("__t_id", F.col(id_col))
    on = keyed["__t_fp"].eqNullSafe(kept["__t_fp"]) & keyed["__t_id"].eqNullSafe(kept["__t_id"])
    rest = keyed.join(kept, on, "left_semi")
    one = F.row_number().over(Window.partitionBy("__t_fp", "__t_id").orderBy(*[F.col(c) for c in cols]))
    return rest.withColumn("__t_one", one).where("__t_one = 1").select(*cols)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query("op10_exact_dedup", ORACLE)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_fp")
