"""Batch twins of the streaming flows, and readers of the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmark.plans.registry import query, scratch
from pressmark.sources import web
from pressmark.streaming import flows, stateful


@query("stream_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.event_windows(rows, "ts", "1 hour", "1 hour", None, "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding_windows", "SELECT s AS start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) WHERE ts < s + INTERVAL 1 HOUR GROUP BY 1")
def sliding(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.event_windows(rows, "ts", "1 hour", "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def sessions(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.sessions(rows, "ts", "1 hour", "6 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _fed(t, rows, build, parts: int = 4):
    """What a stream over rows gives that is stopped and started again: the earlier half by ``ts`` comes first, then the rest. State is dealt over all cores, ``parts`` at least."""
    parts = max(parts, t.spark.sparkContext.defaultParallelism)
    path = scratch(t.spark, "stream")
    # found once, one number: an approximate percentile found anew for each half may differ, and rows between come twice or never
    middle = F.timestamp_micros(F.lit(rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]).cast("long"))
    for part in (rows.filter(F.col("ts") <= middle), rows.filter(F.col("ts") > middle)):
        part.write.mode("append").parquet(f"{path}/in")
        stateful.drain(build(flows.folder_stream(t.spark, f"{path}/in", rows.schema, 1_000_000)), f"{path}/out", f"{path}/checkpoint", parts)
    return t.spark.read.parquet(f"{path}/out")


def _events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_resumed_ingest", "SELECT event_id, user_id, event_type FROM events")
def resumed(t):
    return _fed(t, _events(t).select("event_id", "user_id", "event_type", "ts"), lambda s: s).select("event_id", "user_id", "event_type")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def first_seen(t):
    return _fed(t, _events(t).select("user_id", "event_type", "ts"), lambda s: flows.first_seen(s, "ts", "3650 days", "user_id", "event_type")).select("user_id", "event_type")


@query("stream_token_bucket", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 b AS (SELECT user_id, event_id, s, n, 2.0::DOUBLE AS tokens FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.s, e.n, least(2.0, b.tokens - (b.tokens >= 1)::INT + (e.s - b.s) * (1.0::DOUBLE / 36000.0)) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
 SELECT user_id, event_id, tokens >= 1 AS allowed FROM b""")
def bucket(t):
    return _fed(t, _events(t).select("user_id", "event_id", "ts"), lambda s: stateful.token_bucket(s, "user_id", "ts", "event_id", 1 / 36000, 2.0))


@query("stream_daily_budget", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)::INT AS used, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) <= 20 AS within FROM events")
def budget(t):
    return _fed(t, _events(t).select("event_type", "event_id", "ts"), lambda s: stateful.daily_budget(s, "event_type", "ts", "event_id", 20))


@query("stream_ledger", """SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent, round(coalesce(max(CASE WHEN last = event_id AND event_type = 'signup' THEN value END), 0), 4) AS reserved, count(*) AS n
 FROM (SELECT *, max_by(event_id, (ts, event_id)) FILTER (WHERE event_type IN ('signup', 'error')) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY user_id""")
def ledger(t):
    kind = F.when(F.col("event_type") == "purchase", "spend").when(F.col("event_type") == "signup", "reserve").when(F.col("event_type") == "error", "release").otherwise("other")
    rows = _events(t).select("user_id", "event_id", "ts", "value", kind.alias("kind"), F.lit("call").alias("name"))
    told = _fed(t, rows, lambda s: stateful.ledger(s, "user_id", "ts", "event_id", "name", "kind", "value", 3650 * 86400.0))
    return stateful.last_of(told, "user_id", "n").select("user_id", F.round("spent", 4).alias("spent"), F.round("reserved", 4).alias("reserved"), "n")


@query("src11_web_pages", None)
def src11(t):
    return web.pages(t.pages, "page_id", "html").select("page_id", "title", F.char_length("text").alias("n_chars"), F.map_keys("meta").alias("meta"))


_TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g')), '')"
MARKS = ("<meta name='Robots' content='noai, noindex'>", '<META CONTENT="2001-02-03" NAME="dcterms.issued">', "<p>Date modified: 2004-05-06</p>", "")


def _marked(t):
    """Pages with something that sites say in their markup put before it, by page: a robots tag, a date tag, a written date, or nothing."""
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", F.concat(mark, F.coalesce("html", F.lit(""))).alias("html"))


@query("src12_meta_tags", f"SELECT page_id, {_TITLE} AS title, CASE WHEN page_id % 4 = 0 THEN 'noai, noindex' END AS robots, CASE WHEN page_id % 4 = 1 THEN '2001-02-03' END AS issued FROM pages")
def src12(t):
    tags = web.meta_tags(F.col("html"))
    return _marked(t).select("page_id", web.page_title(F.col("html")).alias("title"), F.try_element_at(tags, F.lit("robots")).alias("robots"), F.try_element_at(tags, F.lit("dcterms.issued")).alias("issued"))


@query("sc50_publication_date", "SELECT page_id, CASE page_id % 4 WHEN 1 THEN DATE '2001-02-03' WHEN 2 THEN DATE '2004-05-06' END AS day FROM pages")
def sc50(t):
    read = _marked(t).select("page_id", web.meta_tags(F.col("html")).alias("meta"), web.page_text(F.col("html")).alias("text"))
    return read.select("page_id", web.publication_date(F.col("meta"), F.col("text")).alias("day"))


@query("sc51_restriction_state", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN true WHEN page_id % 3 = 0 THEN NULL ELSE false END AS restricts FROM pages")
def sc51(t):
    said = F.coalesce(F.try_element_at(web.meta_tags(F.col("html")), F.lit("robots")).contains("noai"), F.lit(False))
    return _marked(t).select("page_id", web.restricts(said, F.col("page_id") % 3 != 0, F.lit(True)).alias("restricts"))
