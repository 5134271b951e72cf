"""Search services: paged reads with retries, counts, and guards against answers that are not to be trusted.

What fetches is a parameter (``get(url) -> (status, headers, body)``), so nothing here needs a network;
pages once fetched are kept as JSON files and read back by Spark.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Get = Callable[[str], tuple[int, dict[str, str], str]]


class SearchError(RuntimeError):
    """A service that fails, or answers what cannot be true."""


def wait_before(attempt: int, headers: dict[str, str], base: float, most: float, spread: float) -> float:
    """Seconds until the next try: what the service asks for, else doubling from base up to most; plus a random part."""
    asked = headers.get("retry-after", "")
    return (float(asked) if asked.isdigit() else min(most, base * 2**attempt)) + spread


def fetch(get: Get, url: str, sleep: Callable[[float], None], tries: int = 6, base: float = 2.0, most: float = 60.0, seed: int = 0) -> dict:
    """The parsed answer; 429 and 503 are tried again, anything else is an error."""
    draw = random.Random(seed)
    for attempt in range(tries):
        status, headers, body = get(url)
        if status == 200:
            answer = json.loads(body)
            if isinstance(answer, dict) and answer.get("error"):
                raise SearchError(f"{url}: {answer['error']}")
            return answer
        if status not in (429, 503) or attempt == tries - 1:
            raise SearchError(f"{url}: status {status}")
        sleep(wait_before(attempt, headers, base, most, draw.uniform(0, base)))
    raise AssertionError


def by_cursor(fetch_page: Callable[[str], dict], address: str, query: str, size: int = 1000) -> Iterator[dict]:
    """The items of all pages, following each page's cursor; a cursor that comes back is an error."""
    cursor, seen = None, set()
    while True:
        page = fetch_page(f"{address}?{urlencode({'q': query, 'count': size} | ({'cursor': cursor} if cursor else {}))}")
        yield from page.get("items", [])
        cursor = page.get("cursor")
        if not cursor:
            return
        if cursor in seen:
            raise SearchError(f"the cursor {cursor} came twice")
        seen.add(cursor)


def by_number(fetch_page: Callable[[str], dict], address: str, query: str, rows: int = 500, most: int = 10_000) -> Iterator[dict]:
    """The documents of numbered pages in a fixed order, up to the service's limit."""
    for number in range(1, most // rows + 1):
        docs = fetch_page(f"{address}?{urlencode({'q': query, 'rows': rows, 'page': number, 'sort': 'identifier asc'})}")["response"]["docs"]
        yield from docs
        if len(docs) < rows:
            return


def count(fetch_page: Callable[[str], dict], address: str, query: str) -> int:
    return int(fetch_page(f"{address}?{urlencode({'q': query, 'rows': 0})}")["response"]["numFound"])


def query_of(media: str | None, collections: list[str], topic: str | None) -> str:
    """The clauses that are given, joined by AND; several collections by OR."""
    parts = [f"mediatype:{media}" if media else "", "(" + " OR ".join(f"collection:{c}" for c in collections) + ")" if collections else "", f"({topic})" if topic else ""]
    return " AND ".join(p for p in parts if p)


def healthy(canary: int, canary_most: int, baseline: int, least: int, most: int) -> int:
    """The baseline count, if a nonsense query finds next to nothing and the baseline is plausible."""
    if canary > canary_most:
        raise SearchError(f"the canary found {canary}: queries are not being honoured")
    if not least <= baseline <= most:
        raise SearchError(f"the baseline {baseline} is not between {least} and {most}")
    return baseline


def complete(rows: DataFrame, expected: int, least: float = 0.95) -> DataFrame:
    """rows, with an error when they are read if there are fewer than a share of what was expected."""
    n = rows.agg(F.count("*").alias("_n"))
    short = F.col("_n") < F.lit(expected) * least
    checked = n.select(F.when(short, F.raise_error(F.concat(F.lit(f"expected {expected} rows, got "), F.col("_n").cast("string")))).otherwise(F.lit(True)).alias("_ok"))
    return rows.crossJoin(F.broadcast(checked)).filter("_ok").drop("_ok")  # one row


def cached_pages(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of cached page files, first of each identifier by page and position. item: their type, with an identifier."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.from_json("value", f"struct<items:array<{item}>>")["items"].alias("items"))
    rows = pages.select("page", F.posexplode("items").alias("pos", "i"))
    first = rows.groupBy("i.identifier").agg(F.min_by("i", F.struct("page", "pos")).alias("i"))
    return first.select("i.*")


def download_tasks(items: DataFrame, cached: DataFrame, most: int) -> DataFrame:
    """identifier, name, dest of files to fetch: each content once, without what is cached, at most so many (the feature of a bounded run)."""
    files = items.select("identifier", F.explode("files").alias("f")).select("identifier", F.col("f.name").alias("name"), F.col("f.md5").alias("md5")).filter("md5 is not null")
    tasks = files.withColumn("dest", F.concat(F.lit("ocr/"), F.substring("md5", 1, 2), F.lit("/"), "md5", F.lit("__"), "name"))
    one = tasks.groupBy("dest").agg(F.min(F.struct("identifier", "name")).alias("m")).select("m.identifier", "m.name", "dest")
    return one.join(cached.select("dest"), "dest", "left_anti").orderBy("identifier", "name").limit(most)
