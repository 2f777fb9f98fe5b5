"""Mixing sources to target weights (3), native: Sainte-Lague apportionment of equal-token blocks.

1. One scan takes each document's size; everything after it works on (id, source, size) rows.
2. Targets: sources in code-point order weigh 3, 1, 2, repeating, and share ``share`` x all words.
   A target stops at ``repeats`` x its source's size; the excess goes to the others by weight. The
   level at which nobody is above is found from prefix sums over the sources sorted by cap / weight.
3. The words of all targets are cut into equal blocks. Sainte-Lague gives the blocks to sources by
   the highest quotients target / (2s - 1). A seat count lies between two divisors that are known
   beforehand, so only about three quotients a party are listed, not one a block.
4. A source's blocks go to its shards (documents dealt by a seeded hash, about ``shard_words`` words
   each) by the same rule: integer quotas per shard. A hot source has more shards, not larger ones.
5. In a shard the documents stand in seeded order on a line of words that is cut into blocks. Whole
   passes first; what is left of the quota falls on blocks chosen by a seeded permutation, the last
   one in part. A document's share is the overlap of its span with the blocks taken.

Every step is a built-in expression; the only windows are over the sources, over one source's
shards and over one shard. The number of sources is bounded by ``MAX_SOURCES`` (an error beyond).

Defined cases: a null text has size 0; size 0 takes 0; a null source is a source of its own, last;
a null id is an id like any other; rows that repeat an id are mixed like different documents (equal
rows are interchangeable); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stage
from tessera.llm.registry import query, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
#: The multiplier of the block permutation, a prime above any number of blocks of a shard.
STEP = 1_000_000_007
SEED = 17
MAX_SOURCES = 1_000_000


def seats(parties: DataFrame, by: list[str], name: str, votes: str, total: Column, house: Column) -> DataFrame:
    """Sainte-Lague: gives ``house`` seats in each group ``by`` to the parties ``name`` by the highest quotients votes / (2s - 1).

    ``total`` (sum of votes) and ``house`` are columns of ``parties`` (the same in all rows of a
    group). With k parties, the final divisor lies between total / (house + k/2) and
    total / (house - k/2); this bounds each party's seats from both sides, and the quotients
    between the bounds, about three a party, are ranked. Adds ``seats``.
    """
    group = Window.partitionBy(*by)
    v = F.col(votes).cast("double")
    total = F.when(total > 0, total).otherwise(F.lit(1.0))
    p = parties.withColumn("_k", F.count(F.when(v > 0, 1)).over(group)).withColumns({
        "_low": F.greatest(F.lit(0), F.floor(v * F.greatest(F.lit(0.0), house - F.col("_k") / 2) / total + 0.5) - 1),
        "_high": F.ceil(v * (house + F.col("_k") / 2) / total + 0.5) + 1})
    p = p.withColumn("_left", house - F.sum("_low").over(group))
    asked = p.where(v > 0).withColumn("_s", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    asked = asked.withColumn("_rank", F.row_number().over(group.orderBy((v / (2 * F.col("_s") - 1)).desc(), F.col(name).asc_nulls_last(), F.col("_s"))))
    keys = list(dict.fromkeys([*by, name]))
    won = asked.where("_rank <= _left").groupBy(*[F.col(c).alias(f"_won_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in keys]
    out = p.join(won, on, "left").drop(*[f"_won_{c}" for c in keys])
    return out.withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_k", "_low", "_high", "_left", "_won")


def targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """(source, source_size) -> with weight, target, _total (words of all targets)."""
    one = Window.partitionBy("_one")
    s = sources.withColumn("_one", F.lit(1))
    order = F.row_number().over(one.orderBy(F.col("_source").asc_nulls_last()))
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((order - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("_total", F.sum("source_size").over(one) * F.lit(float(share)))
    cap = F.col("source_size") * repeats
    by_ratio = one.orderBy(F.col("source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
    s = s.withColumns({"_rn": F.row_number().over(by_ratio),
                       "_before": F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                       "_rest": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    s = s.withColumn("_capped", F.col("_level") * F.col("_w") >= cap)
    s = s.withColumn("_final", F.min_by("_level", F.when(~F.col("_capped"), F.col("_rn"))).over(one))
    return s.withColumn("target", F.when(F.col("_capped"), cap.cast("double")).otherwise(F.col("_final") * F.col("_w"))).drop("_rn", "_before", "_rest", "_level", "_capped", "_final", "_one")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE,
        repeats: int = REPEATS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken."""
    sizes = stage(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                              F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    by_source = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    plan = targets(by_source, share, repeats).withColumns({"_house": F.floor(F.col("_total") / block + 0.5), "_n": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)), "_all": F.lit(1)})
    plan = stage(seats(plan, ["_all"], "_source", "target", F.col("_total"), F.col("_house")).select("_source", "source_size", "target", "_n", F.col("seats").alias("_quota")))
    if plan.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    plan = plan.withColumnRenamed("_source", "_of")
    dealt = sizes.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    dealt = dealt.withColumn("_key", key).withColumn("_shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_n"))
    shards = dealt.groupBy("_source", "_shard").agg(F.sum("size").alias("_len"), F.first("source_size").alias("_votes"), F.first("_quota").alias("_q"))
    quotas = stage(seats(shards.where("_len > 0"), ["_source"], "_shard", "_len", F.col("_votes"), F.col("_q")).select("_source", "_shard", "_len", F.col("seats").alias("_seats")))

    line = Window.partitionBy("_source", "_shard").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_stop", F.sum("size").over(line))
    quotas = quotas.withColumnsRenamed({"_source": "_of", "_shard": "_in"})
    out = placed.join(quotas, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_in")), "left")
    take = F.least(F.col("_seats") * block, F.col("_len") * repeats)
    out = out.withColumn("_passes", F.expr(f"div(least(_seats * {block}L, _len * {repeats}L), _len)")).withColumn("_rest", take - F.col("_passes") * F.col("_len"))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("_source", F.lit("null")), F.col("_shard").cast("string"))), 1, 8), 16, 10).cast("long")
    out = out.withColumns({"_full": F.expr(f"div(_len, {block}L)"), "_k": F.expr(f"div(_rest, {block}L)"), "_offset": offset}).withColumn("_part", F.col("_rest") - F.col("_k") * block)

    def words(j: Column) -> Column:
        """Words taken of block j beyond the whole passes."""
        turn = (j * STEP + F.col("_offset")) % F.greatest(F.col("_full"), F.lit(1))
        inner = F.when(turn < F.col("_k"), F.lit(block).cast("long")).when(turn == F.col("_k"), F.col("_part")).otherwise(F.lit(0).cast("long"))
        return F.when(j < F.col("_full"), inner).when(F.col("_k") >= F.col("_full"), F.col("_part")).otherwise(F.lit(0).cast("long"))

    first, stop = F.col("_stop") - F.col("size"), F.col("_stop")
    blocks = F.sequence(F.floor(first / block), F.floor((stop - 1) / block))
    extra = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, j: a + F.greatest(F.lit(0).cast("long"), F.least(stop, j * block + words(j)) - F.greatest(first, j * block)))
    taken = F.when((F.col("size") > 0) & (F.col("_rest") > 0), F.col("_passes") * F.col("size") + extra).otherwise(F.coalesce(F.col("_passes") * F.col("size"), F.lit(0).cast("long")))
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def _seats_sql(name: str, source: str, by: str, key: str, votes: str, total: str, house: str) -> str:
    return f"""
{name}_b AS (SELECT *, greatest(0, floor({votes}::DOUBLE * greatest(0.0, {house} - k / 2) / {total} + 0.5) - 1)::BIGINT AS low,
    ceil({votes}::DOUBLE * ({house} + k / 2) / {total} + 0.5)::BIGINT + 1 AS high
  FROM (SELECT *, count(*) FILTER ({votes} > 0) OVER (PARTITION BY {by}) AS k FROM {source})),
{name}_q AS (SELECT *, {house} - sum(low) OVER (PARTITION BY {by}) AS remain FROM {name}_b),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {votes}::DOUBLE / (2 * s - 1) DESC, {key} NULLS LAST, s) AS rk
  FROM (SELECT *, unnest(range(low + 1, high + 1)) AS s FROM {name}_q WHERE {votes} > 0)),
{name} AS (SELECT q.*, low + coalesce(won, 0) AS seats FROM {name}_q q
  LEFT JOIN (SELECT {by} AS g, {key} AS p, count(*) AS won FROM {name}_r WHERE rk <= remain GROUP BY ALL) w
  ON w.g IS NOT DISTINCT FROM q.{by} AND w.p IS NOT DISTINCT FROM q.{key})"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT 1 AS g1, source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, row_number() OVER o AS rn, (total - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s1 WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
s3 AS (SELECT *, CASE WHEN lev * w >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE w * (SELECT arg_min(lev, rn) FROM s2 WHERE lev * w < 2 * source_size) END AS target,
  floor(total / {BLOCK_WORDS} + 0.5)::BIGINT AS house, greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS n FROM s2),
{_seats_sql('a', 's3', 'g1', 'source', 'target', 'total', 'house')},
e0 AS (SELECT d.*, a.source_size, a.target, a.n, a.seats AS quota, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % n AS shard FROM e0),
h AS (SELECT source, shard, sum(size)::BIGINT AS len, any_value(source_size) AS votes, any_value(quota) AS q FROM e GROUP BY ALL HAVING sum(size) > 0),
{_seats_sql('b', 'h', 'source', 'shard', 'len', 'votes', 'q')},
p AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM e),
t AS (SELECT p.*, len, least(seats * {BLOCK_WORDS}, 2 * len)::BIGINT AS tk, ('0x' || substr(md5('{SEED}:' || coalesce(p.source, 'null') || ':' || p.shard), 1, 8))::BIGINT AS off
  FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard),
u AS (SELECT *, tk // len AS passes, tk % len AS rest, len // {BLOCK_WORDS} AS f, (tk % len) // {BLOCK_WORDS} AS k, (tk % len) % {BLOCK_WORDS} AS part, stop - size AS first FROM t),
x AS (SELECT *, list_sum(list_transform(range(first // {BLOCK_WORDS}, (stop - 1) // {BLOCK_WORDS} + 1), lambda j: greatest(0, least(stop, j * {BLOCK_WORDS} +
    CASE WHEN j < f THEN CASE WHEN (j * {STEP} + off) % f < k THEN {BLOCK_WORDS} WHEN (j * {STEP} + off) % f = k THEN part ELSE 0 END WHEN k >= f THEN part ELSE 0 END)
    - greatest(first, j * {BLOCK_WORDS})))) AS extra FROM u)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN passes * size + extra ELSE 0 END)::BIGINT AS taken FROM x
"""


@query("op3_mix_sources", ORACLE)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
