"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressmark.session import shared_folder
from pressmark.tables import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_parts: dict[str, str] = dict(SQL)


def part(name: str, sql: str) -> None:
    """A named common table expression that queries can use as @name."""
    _parts[name] = sql


def expand(sql: str) -> str:
    """Puts the parts named by @name before the query, each once and after those it needs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"@(\w+)", text):
            if name not in order:
                need(_parts[name])
                if name not in order:
                    order.append(name)

    need(sql)
    body = re.sub(r"@(\w+)", r"\1", sql).strip()
    if not order:
        return body
    ctes = ",\n".join(re.sub(r"@(\w+)", r"\1", _parts[n]) for n in order)
    return f"WITH {ctes},\n{body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Registers f(tables) as a query of (spark, folder)."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return f

    return add


def _own_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(path):
        fs.deleteOnExit(path)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path for what a query writes and reads again."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, folder: str, table: str, name: str) -> str:
    """A path that is the same for every query of an application while the table's files are the same: for what is built once and read often."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    said = f"{folder} {table} {fs.getContentSummary(path).getLength()} {fs.getFileStatus(path).getModificationTime()}"
    return f"{_own_folder(spark)}/{name}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"
