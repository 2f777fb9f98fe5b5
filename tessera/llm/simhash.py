"""SimHash near-dedup (9): Golay-code fuzzy hashing of fingerprint segments.

1. Fingerprints: every 3-word shingle, repeats included, is hashed (XXH64, seed 42); a bit is set if
   it is set in over half of the hashes. Numpy over Arrow batches, whole texts.
2. Equal fingerprints are one node. A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.
   With at most 3 differing bits, at least two of the three segments differ in at most one bit.
3. The binary Golay code (23, 12, distance 7) is perfect: each 23-bit word lies within 3 bits of
   exactly one codeword, which it decodes to. Of two words that differ in one bit, the codeword of
   the one lies within 4 bits of the other. A segment has one to six codewords within 4 bits. A key
   is two codeword indices (24 bits) with the number of the segments' pair: each fingerprint has three
   keys of its own and meets, as a neighbour, all keys (84 on average) that its lists allow.
4. Own keys and neighbour keys are joined; the bit distance is verified inside the join, and a link is
   reported for the first pair of segments only, so the join gives each link once and nothing else.
5. Components by alternating large-star and small-star rounds over the links, each round written to
   the shared folder.

Defined cases: null texts and texts without words have fingerprint zero and link like any other;
fewer than 3 words are one shingle; a null id is larger than every id (its component has the
smallest other id, or null); repeated rows fall in one component; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.registry import query, table
from tessera.llm.words import MASKS, U, chunks, joined, lanes

SHINGLE = 3
MAX_BITS = 3
SEED = 42

# ---- XXH64 of spans under 32 bytes, many at a time (the published algorithm's constants: fixed values)
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:end] for each span; ``data`` is padded by 8 bytes."""
    length = end - start
    out = np.empty(len(start), U)
    small = np.flatnonzero(length < 32)
    view = memoryview(data)
    for i in np.flatnonzero(length >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(view[int(start[i]):int(end[i])], seed)
    eight = lanes(data)
    at, left = start[small].astype(np.int64), length[small].astype(np.int64)
    h = U(seed) + P5 + left.astype(U)
    for k in range(3):  # up to three lanes of eight bytes
        use = np.flatnonzero(left >= 8 * (k + 1))
        if not len(use):
            break
        lane = _rotl(eight[at[use] + 8 * k] * P2, 31) * P1
        h[use] = _rotl(h[use] ^ lane, 27) * P1 + P4
    at, left = at + (left & ~7), left & 7
    use = np.flatnonzero(left >= 4)
    if len(use):
        h[use] = _rotl(h[use] ^ ((eight[at[use]] & MASKS[4]) * P1), 23) * P2 + P3
        at[use] += 4
        left[use] -= 4
    for k in range(3):
        use = np.flatnonzero(left > k)
        if not len(use):
            break
        h[use] = _rotl(h[use] ^ (data[at[use] + k].astype(U) * P5), 11) * P1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    out[small] = h ^ (h >> U(32))
    return out


EACH_BYTE = U(0x0101010101010101)


def majority_bits(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each group [edges[i], edges[i+1]) of hashes: the bits set in over half of them; 0 for an empty group."""
    n = np.diff(edges)
    out = np.zeros(len(n), U)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    # cut groups into runs of at most 255, so that eight one-byte counters fit a 64-bit sum
    parts = (n[full] + 254) // 255
    of = np.repeat(np.arange(len(full)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = edges[full][of] + 255 * k
    counts = np.empty((len(full), 64), np.int64)
    group = np.searchsorted(of, np.arange(len(full)))
    for bit in range(8):
        runs = np.add.reduceat((hashes >> U(bit)) & EACH_BYTE, begin)
        counts[:, bit::8] = np.add.reduceat(runs.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
    major = counts * 2 > n[full][:, None]
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(shingle: int):
    def of_chunk(c) -> np.ndarray:
        data, start, end = joined(c)
        count = c.counts()
        n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))  # shingles of each text
        edges = np.concatenate(([0], np.cumsum(n)))
        inside = np.arange(edges[-1]) - np.repeat(edges[:-1], n)
        first = np.repeat(c.row0[:-1], n) + inside
        last = first + np.repeat(np.minimum(count, shingle) - 1, n)
        return majority_bits(xxh64(data, start[first], end[last]), edges)

    def run(batches):
        for b in batches:
            parts = [of_chunk(c) for c in chunks(b.column(1), lower=True)]
            fp = np.concatenate(parts) if parts else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["_id", "_th", "fp"])
    return run


def text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _th, fp) of every row; _th is a hash of the raw text, fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), text_key(text_col).alias("_th"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(_fingerprints(shingle), f"_id {kind}, _th long, fp long")


# ---- the binary Golay code (23, 12, 7), systematic: index in the high 12 bits, parity in the low 11
GENERATOR = 0b110001110101


def _parity() -> np.ndarray:
    out = np.zeros(4096, np.int64)
    for info in range(4096):
        rest = info << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        out[info] = rest
    return out


PARITY = _parity()


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the error patterns of up to 4 bits (six at most), and how many there are."""
    syndrome = lambda x: PARITY[x >> 11] ^ (x & 2047)
    one = 1 << np.arange(23)
    found: list[list[int]] = [[] for _ in range(2048)]
    level = np.zeros(1, np.int64)
    for weight in range(5):
        for e, s in zip(level.tolist(), syndrome(level).tolist(), strict=True):
            found[s].append(e)
        grown = (level[:, None] | one[None, :]).ravel()
        level = np.unique(grown[np.bitwise_count(grown) == weight + 1])
    most = max(map(len, found))
    table_ = np.array([x + [0] * (most - len(x)) for x in found], np.int64)
    return table_, np.array([len(x) for x in found])


PATTERNS, N_PATTERNS = _patterns()
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each 23-bit word (a row each), and how many there are."""
    s = PARITY[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ PATTERNS[s]) >> 11, N_PATTERNS[s]


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> U(at)) & U((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]


def _own(batches):
    """One key a pair of segments: the codewords that the segments decode to."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
        near = [codewords(x)[0][:, 0] for x in _segments(fp)]  # patterns are listed by weight
        key = np.concatenate([(pair << 24) | (near[i] << 12) | near[j] for pair, (i, j) in enumerate(PAIRS)])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.tile(fp, len(PAIRS)).view(np.int64))], names=["key", "fp"])


def _keys(batches):
    """All keys: the codewords within 4 bits of the segments, a pair of segments at a time."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
        cut = [codewords(x) for x in _segments(fp)]
        for pair, (i, j) in enumerate(PAIRS):
            (a, na), (c, nc) = cut[i], cut[j]
            width = a.shape[1]
            keep = (np.arange(width)[None, :, None] < na[:, None, None]) & (np.arange(width)[None, None, :] < nc[:, None, None])
            key = (pair << 24) | (a[:, :, None] << 12) | c[:, None, :]
            row = np.broadcast_to(np.arange(len(fp))[:, None, None], keep.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].astype(np.int32)), pa.array(fp[row[keep]].view(np.int64))], names=["key", "fp"])


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp of ``nodes``, distinct) within ``max_bits`` <= 3 bits, each once."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys guarantee at most 3 bits")
    a = nodes.select("fp").mapInArrow(_own, "key int, fp long").withColumnRenamed("fp", "a")
    b = nodes.select("fp").mapInArrow(_keys, "key int, fp long").withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))

    def close(k: int):
        at, size = SEGMENTS[k]
        mask = ((1 << size) - 1) << at
        return F.bit_count(differ.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))) <= 1
    # a pair is reported for the first pair of segments in which it is close
    pair = F.when(close(0) & close(1), 0).when(close(0) & close(2), 1).otherwise(2)
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & (F.shiftright(a["key"], 24) == pair)
    # a hint, since the planner takes either side for as small as the nodes that it was made from
    return a.join(b.hint("merge"), (a["key"] == b["key"]) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Large-star links each larger neighbour of a node to the smallest one, small-star each smaller
    neighbour; no neighbour list is gathered. Ends when a round changes nothing.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
        if large:
            return hung.where("a > u").select("a", "b").distinct()
        return hung.select("a", "b").union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, after = None, mark(now)
    while before != after:
        now = stage(star(star(now, True), False))
        before, after = after, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id (the smallest id reachable over links), _th (hash of the raw text)."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle))
    nodes = stage(fps.groupBy("fp").agg(F.min("_id").alias("first_id")))
    roots = components(links(nodes, max_bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stage(named.join(smallest, "root").select("fp", "component_id"))
    return fps.join(classes, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "_th")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all columns. Rows of the same id and component are one document."""
    gone = near_dedup(docs, id_col, text_col, shingle, max_bits).where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = stage(gone.select(F.col(id_col).alias("__t_gid"), F.col("_th").alias("__t_gth")).distinct())
    keyed = docs.withColumn("__t_th", text_key(text_col))
    return keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__t_gid")) & (F.col("__t_th") == F.col("__t_gth")), "left_anti").drop("__t_th")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
