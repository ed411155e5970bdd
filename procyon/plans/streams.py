"""Registered streaming queries: the events table read as a stream, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ingest_batch
from ..sources.state import materialise
from ..streaming import streams
from .registry import AS_OF, QUERIES, SQL, Tables, item_sources


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.read_events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_id") % 41 == 0, "RUNNING").otherwise("COMPLETED")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").alias("started_at"), status.alias("status"), F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"))


def t2_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = streams.stream_change_feed(streams.read_events(spark, sf_dir), "click", "2024-01-15 00:00:00")
    return streams.run_available(feed.select("event_id", "user_id"))


def t3_quota_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("user_id") % 3 == 0, "FREE").when(F.col("user_id") % 3 == 1, "STANDARD").otherwise("PREMIUM")
    requests = streams.read_events(spark, sf_dir).select(F.col("user_id").alias("client"), tier.alias("tier"), "ts")
    out = streams.run_available(streams.quota_windows(requests, {"FREE": 1, "STANDARD": 2, "PREMIUM": 5}), "update", ["client", "start"])
    return out.select("client", "tier", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "hits", "allowed", F.col("remaining").cast("bigint").alias("remaining"))


def _with_end(turns: list[DataFrame], key: str, at: str) -> list[DataFrame]:
    """turns, and one more of a single row, of no key that is asked for, whose time lets the watermark pass all others."""
    last = turns[0]
    for x in turns[1:]:
        last = last.union(x)
    end = last.agg(F.max(at).alias("top")).select((F.col("top") + F.expr("INTERVAL 400 DAYS")).alias(at), F.lit(-1).cast("bigint").alias(key))
    return [*turns, end.select(*[F.col(f.name) if f.name in (at, key) else F.lit(None).cast(f.dataType).alias(f.name) for f in turns[0].schema])]


def t4_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the events' users; every third run comes a turn after those that are newer than it."""
    t = Tables(spark, sf_dir)
    runs = t.source_runs.select("id", "source_id", F.col("started_at").cast("timestamp").alias("started_at"), "status", "duration_ms")
    turn = F.least(F.lit(2), F.floor(F.dayofmonth("started_at") / 11) + F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    out = streams.run_in_turns(_with_end([runs.where(turn == i) for i in range(3)], "source_id", "started_at"), lambda s: streams.stream_source_health(s, "40 days"), "update", ["source_id"])
    return out.where("source_id >= 0").select("source_id", "runs", "consecutive_failures", "health")


def t5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the orders' lines as they arrive in four turns, a third of them a turn late; equals e5_version_history."""
    t = Tables(spark, sf_dir)
    hour = F.col("opportunity_id") % 997
    at = F.timestamp_seconds(F.lit(1704067200) + hour * 3600 + F.col("seq") * 600)
    obs = t.observations.select("opportunity_id", at.alias("at"), F.col("seq").cast("bigint").alias("seq"), F.date_format("closing_at", "yyyy-MM-dd HH:mm:ss").alias("closing_at"), "status", "submission_method", "document_url")
    turn = F.least(F.lit(3), F.floor(hour / 250) + F.when(F.xxhash64("opportunity_id", "seq") % 3 == 0, 1).otherwise(0))
    obs = materialise(obs.withColumn("turn", turn))
    turns = [obs.where(F.col("turn") == i).drop("turn") for i in range(4)]
    out = streams.run_in_turns(_with_end(turns, "opportunity_id", "at"), lambda s: streams.stream_versions(s, ["closing_at", "status", "submission_method"], late="600 hours"))
    return out.where("opportunity_id >= 0").select("opportunity_id", "seq", "version", "closing_at", "status", "submission_method", "document_added")


def t6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = streams.stream_exact_dedup(streams.read_events(spark, sf_dir), ["user_id", "event_type"], "60 days")
    return streams.run_available(seen.select("user_id", "event_type"))


def t7_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.sliding_counts(streams.read_events(spark, sf_dir), "2 hours", "1 hour"), "update", ["event_type", "start"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def t7_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding counts of events that arrive in three turns, some of them a turn or two late."""
    events = Tables(spark, sf_dir).events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    turn = F.least(F.lit(2), F.floor(F.dayofmonth("ts") / 11) + F.when(F.col("event_id") % 7 == 3, 1).when(F.col("event_id") % 11 == 5, 2).otherwise(0))
    out = streams.run_in_turns([events.where(turn == i) for i in range(3)], lambda s: streams.sliding_counts_with_late(s, "2 hours", "1 hour", "10 minutes", "40 days"), "update", ["event_type", "start"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "late")


def t7_edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.edit_sessions(streams.read_events(spark, sf_dir), "30 minutes", "user_id"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def t8_stale_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_available(streams.stream_stale_alerts(_runs(spark, sf_dir), 24 * 3600))


def ingest_items(t: Tables, again: bool) -> DataFrame:
    """Stand-in items of a first batch, one for each order, and of a later one, by the last digit of the order's key.

    First: 7 has the reference of 1 of its ten, 9 is 5 once more under another address, 6 has no reference, 8 no title.
    Again: 0 is cancelled, 2 has another reference, 3 another title, 4 lost its reference and is awarded, 6 has a longer
    title, 8 has a title; the others are not seen again.
    """
    k, of = F.col("o_orderkey"), F.col("o_orderkey") % 10
    own = F.when(of == 7, k - 6).when(of == 9, k - 4).otherwise(k)
    title = F.concat(F.lit("Contract "), F.md5(F.when(of == 9, own).otherwise(k).cast("string")))
    reference = F.when(of != 6, F.concat(F.lit("R/"), own))
    status, page = F.lit("open"), F.concat(F.lit("https://www.example.org/t/"), k)
    if again:
        title = F.when(of == 3, F.concat(F.lit("Renamed "), F.md5(k.cast("string")))).when(of == 6, F.concat(title, F.lit(" v2"))).otherwise(title)
        reference = F.when(of == 2, F.concat(F.lit("N/"), k)).when(of != 4, reference)
        status = F.when(of == 0, "cancelled").when(of == 4, "awarded").otherwise("open")
    else:
        title = F.when(of != 8, title)
    at = F.date_format(F.timestamp_seconds(F.lit(1735689600) + k * 60), "dd/MM/yyyy HH:mm")
    values = {"title": title, "reference": reference, "summary": F.concat(F.lit("Order "), k), "date": at, "deadline": F.lit("5 March 2026"), "status": status}
    fields = F.map_filter(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull())
    rows = t.orders.where(of.isin(0, 2, 3, 4, 6, 8)) if again else t.orders
    first = t.supplier.agg(F.min("s_suppkey").alias("lowest"), F.count("*").alias("suppliers"))  # one row
    source = F.col("lowest") + F.floor(k / 10) % F.col("suppliers")
    return rows.crossJoin(F.broadcast(first)).select(source.alias("source_id"), page.alias("source_url"), fields.alias("fields"))


def t1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that two batches of items make; the stream stops between them and goes on from its checkpoint."""
    t, folder = Tables(spark, sf_dir), streams.own_folder(spark)
    for again in (False, True):
        ingest_items(t, again).repartition(spark.sparkContext.defaultParallelism).write.mode("append").parquet(f"{folder}/items")
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/items").schema).parquet(f"{folder}/items")
        streams.stream_ingest(stream, f"{folder}/out", lambda batch, current: ingest_batch(batch, item_sources(t), current, AS_OF), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out/versions").select(F.col("batch_id").cast("int").alias("batch"), "version", "title", "status")


_T1 = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 10 AS of, CASE o_orderkey % 10 WHEN 7 THEN o_orderkey - 6 WHEN 9 THEN o_orderkey - 4 ELSE o_orderkey END AS own FROM orders),
i AS (SELECT *, 'Contract ' || md5(CAST(CASE of WHEN 9 THEN own ELSE k END AS VARCHAR)) AS title, row_number() OVER (PARTITION BY own ORDER BY k) AS n, count(*) OVER (PARTITION BY own) AS seen FROM k),
first AS (SELECT own, CAST(max(n) AS BIGINT) AS version, arg_max(title, n) AS title FROM i WHERE of <> 8 GROUP BY own)
SELECT 0 AS batch, version, title, 'OPEN' AS status FROM first
UNION ALL SELECT 1, CASE WHEN of IN (2, 8) THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END, CASE of WHEN 3 THEN 'Renamed ' || md5(CAST(k AS VARCHAR)) WHEN 6 THEN title || ' v2' ELSE title END,
  CASE of WHEN 0 THEN 'CANCELLED' WHEN 4 THEN 'AWARDED' ELSE 'OPEN' END FROM i WHERE of IN (0, 2, 3, 4, 6, 8)"""


def t1_ingest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of their users: exact repeats of a title are left out, the rest are kept and counted."""
    folder = streams.own_folder(spark)

    def process(batch: DataFrame, current: DataFrame | None) -> dict[str, DataFrame]:
        fresh = batch.dropDuplicates(["source_id", "title"]).withColumn("id", F.xxhash64("source_id", "title"))
        if current is not None:
            fresh = fresh.join(current.select("source_id", "title"), ["source_id", "title"], "left_anti")
        return {"opportunities": fresh, "versions": fresh.drop("id").withColumn("version", F.lit(1))}

    items = streams.read_events(spark, sf_dir).select(F.col("user_id").alias("source_id"), F.concat_ws(" ", "event_type", "props").alias("title"))
    streams.stream_ingest(items, folder, process, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/versions").select("source_id", "title", F.col("version").cast("bigint").alias("version"))


for _f in (t1_ingest, t1_ingest_exact, t2_change_feed, t3_quota_windows, t4_source_health, t5_versions, t6_exact_dedup, t7_sliding_counts, t7_late_counts, t7_edit_sessions, t8_stale_alerts):
    QUERIES[_f.__name__] = _f

SQL |= {
    "t1_ingest": _T1,
    "t1_ingest_exact": "SELECT DISTINCT user_id AS source_id, event_type || ' ' || props AS title, CAST(1 AS BIGINT) AS version FROM events",
    "t2_change_feed": "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-15 00:00:00'",
    "t3_quota_windows": "SELECT user_id AS client, CASE user_id % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'STANDARD' ELSE 'PREMIUM' END AS tier, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS hits, count(*) <= CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS allowed, greatest(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END - count(*), 0) AS remaining FROM events GROUP BY user_id, date_trunc('minute', ts)",
    "t4_source_health": SQL["o5_source_health"].replace("source_id, runs, consecutive_failures, strftime(last_run_at, '%Y-%m-%d %H:%M:%S') AS last_run_at, strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at,", "source_id, runs, consecutive_failures,"),
    "t5_versions": SQL["e5_version_history"],
    "t7_late_counts": """WITH e AS (SELECT event_type, ts, least(2, floor(day(ts) / 11.0) + CASE WHEN event_id % 7 = 3 THEN 1 WHEN event_id % 11 = 5 THEN 2 ELSE 0 END) AS turn FROM events),
      m AS (SELECT t.turn, (SELECT max(ts) FROM e WHERE e.turn < t.turn) AS newest FROM (SELECT DISTINCT turn FROM e) t),
      w AS (SELECT event_type, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS start, newest FROM e JOIN m USING (turn), range(0, 2) r(k))
      SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (NOT coalesce(start + INTERVAL 2 HOUR <= newest - INTERVAL 10 MINUTE, false)) AS n, count(*) FILTER (coalesce(start + INTERVAL 2 HOUR <= newest - INTERVAL 10 MINUTE, false)) AS late FROM w GROUP BY event_type, start""",
    "t8_stale_alerts": "SELECT user_id AS source_id, CAST(floor(epoch_us(max(ts)) / 1000.0) AS BIGINT) AS last_success_ms FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "t6_exact_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "t7_edit_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "t7_sliding_counts": "SELECT event_type, strftime(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY 1, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER))",
}
