"""Streaming monitors and file round-trip queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as TX
from tessera.operators import anomaly as A
from tessera.operators import retrieval as R
from tessera.operators import sampling as P
from tessera.operators.answers import answer
from tessera.plans import analytics as AN
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.plans.search import _fast_index, _fast_sql
from tessera.sources import files as IO
from tessera.sources.tables import benchmark_queries, v_text
from tessera.streaming import monitor as V

FMT = "'%Y-%m-%d %H:%M:%S'"
#: The events arrive in this many files, cut by time; every LATE-th event comes DELAY files late.
FILES, LATE, DELAY = 6, 50, 2


def _arrival(us: str, low: str, high: str) -> str:
    """File number of an event: its share of the time range, and the delay of late ones (the last file takes the rest)."""
    return f"least({FILES - 1}, CAST(floor(({us} - {low}) * {FILES} / ({high} - {low} + 1)) AS BIGINT) + CASE WHEN event_id % {LATE} = 0 THEN {DELAY} ELSE 0 END)"


def _event_files(spark, sf):
    """Stand-in input: the events table as files in the order of arrival."""
    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = ev.agg(F.min("_us"), F.max("_us")).first()
    placed = IO.materialise(ev.withColumn("part", F.expr(_arrival("_us", str(low), str(high)))).drop("_us"), "arrivals")
    path = IO.scratch_path(spark, "events")
    for i in range(FILES):  # one file after the other, as the file source takes them by time
        placed.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


# Twin of the stream: a file's watermark is the greatest event time of the files two and more before it (Spark filters late
# rows by the watermark of the batch before), in milliseconds, less the delay; windows that end by then take no more rows.
EV_SQL = f"""ev0 AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS low, max(epoch_us(ts)) OVER () AS high FROM events),
ev1 AS (SELECT event_id AS id, ts, us, event_type AS category, value, 'prod' || CAST(user_id % 4 AS VARCHAR) AS product, event_type <> 'error' AS resolution_helpful,
  {_arrival('us', 'low', 'high')} AS part FROM ev0),
mx AS (SELECT part, max(max(us)) OVER (ORDER BY part) AS seen FROM ev1 GROUP BY part),
ev AS (SELECT ev1.*, seen FROM ev1 LEFT JOIN mx ON mx.part = ev1.part - 2)"""
SLIDE_SQL = """sl AS (SELECT *, date_trunc('minute', ts) - to_minutes(k) AS ws FROM ev, (SELECT unnest(range(5)) AS k))"""


def _in_time(end: str, delay_minutes: int) -> str:
    return f"(seen IS NULL OR epoch_us({end}) > (seen // 1000) * 1000 - {delay_minutes * 60_000_000})"


def _w(start: str, length: str) -> str:
    return f"strftime({start}, {FMT}) AS window_start, strftime({start} + INTERVAL {length}, {FMT}) AS window_end"


def _run(spark, sf, monitor, keys, name):
    return V.run_to_table(spark, monitor(V.arriving(spark, _event_files(spark, sf))), keys, name)


# ---------------------------------------------------------------- V1-V6 (micro-batches with late rows, checked against SQL twins)
@query("stream_period_stats", f"""WITH {EV_SQL}
SELECT {_w("date_trunc('day', ts)", "24 hours")}, category, count(*) AS n, avg(value) AS avg_resolution_time,
       avg(CAST(resolution_helpful AS DOUBLE)) AS success_rate FROM ev
WHERE {_in_time("date_trunc('day', ts) + INTERVAL 24 hours", 60)} GROUP BY date_trunc('day', ts), category""")
def stream_period_stats(spark, sf):
    """V1: counters of each day; rows later than the watermark change nothing."""
    return _run(spark, sf, V.period_stats, ["window_start", "category"], "period_stats")


@query("stream_rate", f"""WITH {EV_SQL}, {SLIDE_SQL}
SELECT {_w("ws", "5 minutes")}, category, count(*) AS n, count(*) / 300.0 AS rate FROM sl WHERE {_in_time("ws + INTERVAL 5 minutes", 10)} GROUP BY ws, category""")
def stream_rate(spark, sf):
    return _run(spark, sf, V.rate, ["window_start", "category"], "rate")


@query("stream_error_ratio", f"""WITH {EV_SQL}, {SLIDE_SQL}
SELECT {_w("ws", "5 minutes")}, count(*) FILTER (WHERE category = 'error') AS errors, count(*) AS n,
       count(*) FILTER (WHERE category = 'error') / count(*) AS error_ratio FROM sl WHERE {_in_time("ws + INTERVAL 5 minutes", 10)} GROUP BY ws""")
def stream_error_ratio(spark, sf):
    return _run(spark, sf, V.error_ratio, ["window_start"], "error_ratio")


@query("stream_last_value", f"""WITH {EV_SQL}
SELECT {_w("date_trunc('hour', ts)", "1 hour")}, product, arg_max(value, {{'ts': ts, 'id': id}}) AS last_value
FROM ev WHERE {_in_time("date_trunc('hour', ts) + INTERVAL 1 hour", 60)} GROUP BY date_trunc('hour', ts), product""")
def stream_last_value(spark, sf):
    return _run(spark, sf, V.last_value, ["window_start", "product"], "last_value")


@query("stream_sum_by", f"""WITH {EV_SQL}
SELECT category, count(*) AS n, count(*) FILTER (WHERE value > 150) AS high_value FROM ev GROUP BY category""")
def stream_sum_by(spark, sf):
    """V6: running counts without a window, so late rows count too."""
    return _run(spark, sf, V.sum_by, ["category"], "sum_by")


@query("exact_quantile", f"""WITH ev AS (SELECT ts, value FROM events), {SLIDE_SQL}
SELECT {_w("ws", "5 minutes")}, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM sl GROUP BY ws""")
def exact_quantile(spark, sf):
    """V3, exact twin on the table."""
    return V.quantiles(V.event_batch(spark, sf), exact=True)


@query("stream_quantile", f"""WITH {EV_SQL}, {SLIDE_SQL}
SELECT {_w("ws", "5 minutes")}, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM sl WHERE {_in_time("ws + INTERVAL 5 minutes", 10)} GROUP BY ws""")
def stream_quantile(spark, sf):
    """V3 on the stream: approximate quantiles, which are exact (the nearest value) in windows of fewer than 10,000 rows, as
    those of the twin are."""
    return _run(spark, sf, V.quantiles, ["window_start"], "quantile")


#: The last days of the events arrive as a stream, hours together in a file; what is before them is the baseline.
STREAM_DAYS, FILE_HOURS = 2, 6


def _anomaly_sql() -> str:
    current = f"created_at >= (SELECT date_trunc('hour', max(created_at)) FROM v_event) - INTERVAL {STREAM_DAYS} DAYS"
    before = f"(SELECT * FROM v_event WHERE NOT ({current}))"
    base = f"(SELECT * FROM {before} WHERE created_at >= (SELECT max(created_at) FROM {before}) - INTERVAL 30 DAYS)"
    parts = [AN._share_sql(dim, kind, text) for dim, kind, text in (
        ("category", "category_volume_anomaly", "Unusual volume for category ''%s'': baseline rate %.4f, current rate %.4f"),
        ("customer_sentiment", "sentiment_shift_anomaly", "Sentiment shift for ''%s'': baseline rate %.4f, current rate %.4f"))]
    parts += [S.with_views(x.format(period=AN.SQL_HOUR)) for x in (AN.RES_SQL, AN.SUCC_SQL)]
    out = []
    for p in parts:
        views, body = p.split("\nSELECT", 1)  # the views stay, the body reads the two parts
        body = body.replace(AN.BASE_SQL, "base30").replace("FROM v_event", "FROM cur")
        out.append(f"SELECT * FROM ({views}, cur AS (SELECT * FROM v_event WHERE {current}), base30 AS {base}\nSELECT{body})")
    return " UNION ALL ".join(out)


@query("stream_anomaly", _anomaly_sql())
def stream_anomaly(spark, sf):
    """V8: each arriving micro-batch is scored by the four detectors, hour by hour, against the baseline of the events before
    the stream (stream-static)."""
    names = {"ts": "created_at", "value": "resolution_time_hours"}
    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    start = ev.agg((F.date_trunc("hour", F.max("ts")) - F.expr(f"INTERVAL {STREAM_DAYS} DAYS")).alias("s")).first().s
    hist = IO.materialise(V.event_columns(ev.where(F.col("ts") < F.lit(start))).withColumnsRenamed(names), "history")
    path = IO.scratch_path(spark, "events")
    slot = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / (3600 * FILE_HOURS))
    for i in range(24 * STREAM_DAYS // FILE_HOURS + 1):
        ev.where((F.col("ts") >= F.lit(start)) & (slot == i)).coalesce(1).write.mode("append").parquet(path)

    def score(batch, batch_id):
        cur = batch.withColumnsRenamed(names).withColumn("hour", F.date_format("created_at", "yyyy-MM-dd HH"))
        return A.detect_all(cur, hist, ["hour"])

    return V.run_to_table(spark, V.arriving(spark, path), [], "anomaly", per_batch=score)


# ---------------------------------------------------------------- S1-S9 (write, read back)
TEXT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("subject", T.StringType()),
                            T.StructField("description", T.StringType()), T.StructField("category", T.StringType()),
                            T.StructField("product", T.StringType())])


@query("scan_json", """SELECT d.doc_id AS id, split_part(coalesce(d.text, ''), chr(10), 1) AS subject, d.text AS description, d.lang AS category,
  d.source AS product, form FROM documents d, (SELECT unnest(['lines', 'array']) AS form)""")
def scan_json(spark, sf):
    """Tickets written as JSON lines and as JSON arrays (one a line of text files), scanned back with an explicit schema."""
    rows = v_text(spark, sf).select(*TEXT_SCHEMA.fieldNames())
    lines, arrays = IO.scratch_path(spark, "json"), IO.scratch_path(spark, "json_array")
    IO.write_json(rows, lines)
    rows.select(F.to_json(F.array(F.struct(*rows.columns)))).write.text(arrays)
    return IO.scan_json(spark, lines, TEXT_SCHEMA).withColumn("form", F.lit("lines")).unionByName(
        IO.scan_json(spark, arrays, TEXT_SCHEMA).withColumn("form", F.lit("array")))


@query("csv_roundtrip", """
SELECT d.doc_id AS id, d.lang AS category, length(d.text) AS description_length, md5(d.text) AS description_md5
FROM documents d""")
def csv_roundtrip(spark, sf):
    """CSV with multi-line quoted text written and read back unchanged."""
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(v_text(spark, sf).select(*TEXT_SCHEMA.fieldNames()), path)
    back = IO.scan_csv(spark, path, TEXT_SCHEMA)
    return back.select("id", "category", F.length("description").alias("description_length"),
                       F.md5("description").alias("description_md5"))


@query("split_sink", """
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val'
              ELSE 'test' END AS split
  FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)) GROUP BY split""")
def split_sink(spark, sf):
    """S3: the ordered split written partitioned by split, then counted per partition."""
    path = IO.scratch_path(spark, "splits")
    IO.write_partitioned(P.split_ordered(v_text(spark, sf), "id"), path, ["split"])
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("index_roundtrip", _fast_sql(False))
def index_roundtrip(spark, sf):
    """The fast index written as bucketed tables, read back, and searched from the reloaded tables."""
    idx = _fast_index(spark, sf)
    again = R.load_index(spark, R.save_index(idx, IO.scratch_path(spark, "index")), "fast", idx.tfidf.cfg, idx.patterns)
    idx.release()
    return R.search_fast(again, benchmark_queries(spark, sf), 10).withColumn("rank", F.col("rank").cast("long"))


def _postings(spark, sf):
    v = v_text(spark, sf)
    docs = R.prepare_solutions(v, "full")
    parts = [docs.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.col(c).alias("key"), F.col("doc_id").alias("id")) for c in R.FIELDS]
    ents = R.doc_entities(docs, TX.ENTITY_PATTERNS_FULL | TX.LONG_WORDS).select(F.col("type").alias("kind"), F.col("value").alias("key"), F.col("doc_id").alias("id"))
    out = ents
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


POSTINGS_SQL = f"""long AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT 'category' AS kind, category AS key, id FROM v_text UNION ALL SELECT 'product', product, id FROM v_text UNION ALL SELECT 'subcategory', subcategory, id FROM v_text
  UNION ALL SELECT e.type, e.value, id FROM (SELECT id, unnest({S.entity_list_unicode(S.norm('subject') + " || ' ' || " + S.norm('description') + " || ' '", S.UNICODE_FULL | S.UNICODE_LONG)}) AS e FROM v_text)) WHERE key IS NOT NULL)"""


@query("postings_export", S.with_views("""SELECT kind, key, chunk, min(id) AS first_id, count(*) AS n, coalesce(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY id) FILTER (r % 64 <> 0), '') AS gaps FROM (
  SELECT kind, key, id, r, CAST(r // 64 AS BIGINT) AS chunk, id - lag(id) OVER (PARTITION BY kind, key ORDER BY id) AS gap FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY id) - 1 AS r FROM long)) GROUP BY kind, key, chunk""", POSTINGS_SQL))
def postings_export(spark, sf):
    """Posting lists of categories, products, subcategories and entities in chunks of 64 ids, delta-coded."""
    return R.posting_chunks(_postings(spark, sf), 64).withColumn("gaps", F.array_join("gaps", ","))


@query("postings_expanded", S.with_views("SELECT kind, key, id FROM long", POSTINGS_SQL))
def postings_expanded(spark, sf):
    """The chunks expanded again."""
    return R.posting_ids(R.posting_chunks(_postings(spark, sf), 64))


def _answers_sql() -> str:
    plain, filtered = _fast_sql(False), _fast_sql(True)
    again = f"SELECT * REPLACE (query_id + 2000000 AS query_id) FROM ({plain})"
    return f"SELECT * FROM ({plain}) UNION ALL {again} UNION ALL SELECT * REPLACE (query_id + 1000000 AS query_id) FROM ({filtered})"


@query("answer_queries", _answers_sql())
def answer_queries(spark, sf):
    """A first batch fills the answer store; the second repeats it, holds every request twice and brings filtered ones.
    Only requests that the store does not hold are searched; the rows are those of searching every request."""
    idx = _fast_index(spark, sf)
    plain, filtered = benchmark_queries(spark, sf), benchmark_queries(spark, sf, True)
    folder = IO.scratch_path(spark, "answers")
    search = lambda q: R.search_fast(idx, q, 10)
    answer(plain, search, folder, "1")
    batch = plain.unionByName(plain.withColumn("query_id", F.col("query_id") + 2_000_000)).unionByName(filtered.withColumn("query_id", F.col("query_id") + 1_000_000))
    rows, _ = answer(batch, search, folder, "1")
    return rows.withColumn("rank", F.col("rank").cast("long"))
