"""A table of keyed rows with versions: rows are replaced by key, and a change is there wholly or not at all.

Rows lie in a fixed number of buckets of their key, as Parquet files that are never rewritten. A version is a
small manifest that names the files of each bucket; it is written last and put in place by a rename that does
not overwrite, so of two writers of one version only one succeeds. What a killed writer leaves is named by no
manifest and read by nobody. The other writer looks at the versions made since: where none touches its
buckets its change is put on top of them, else it is a ``Conflict``, and the caller does it again.

A change reads and writes the buckets of its keys alone. Rows are dealt by Spark's own joins and writers; the
driver sees manifests, whose size grows with the number of buckets, and bucket numbers.

Defined cases: a null in a key is a value like others; a replacement whose rows repeat a key keeps all of them
(delete, then insert); no rows change nothing and make no version; a table that only takes appends refuses
everything else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressmark.operators import upserts
from pressmark.sources.sinks import Store

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has changed a bucket since it was read."""


class Snapshots:
    """One table below a folder; see the module."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._store = Store(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, key: list[str], buckets: int = 64, append_only: bool = False) -> "Snapshots":
        """An empty table as version 0; one that is there already is an error."""
        table = cls(spark, root)
        first = {"version": 0, "schema": schema.json(), "key": key, "buckets": buckets, "append_only": append_only, "parts": [], "changed": [], "meta": {}}
        if not table._put(first):
            raise FileExistsError(root)
        return table

    # -- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, manifest: dict) -> bool:
        """Puts a version in place; false if it is there already."""
        return self._store.put(f"versions/{manifest['version']:012d}.json", json.dumps(manifest).encode(), overwrite=False)

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._path("versions"))
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version, the last one unless it is named."""
        return json.loads(self._store.read(f"versions/{self.versions()[-1] if version is None else version:012d}.json"))

    # -- reading

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.root}/{p['path']}" for p in manifest["parts"] if buckets is None or p["bucket"] in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        m = self.manifest()
        asked = keys.select(*[F.col(k).alias(f"_asked_{k}") for k in m["key"]])
        return self._rows(m, self._buckets(m, keys)).join(asked, _all(F.col(k).eqNullSafe(F.col(f"_asked_{k}")) for k in m["key"]), "left_semi")

    def missing(self, rows: DataFrame) -> DataFrame:
        """Those of the rows whose key the table has not: what is left to do after an interruption."""
        m = self.manifest()
        return _without(rows, self._rows(m, self._buckets(m, rows)), m["key"])

    # -- changing

    def append(self, rows: DataFrame, meta: dict | None = None) -> int:
        """Adds rows as they are; gives the version. Never in conflict with another change."""
        base = self.manifest()
        return self._commit(base, set(), self._written(base, rows), meta)

    def replace(self, rows: DataFrame, meta: dict | None = None) -> int:
        """Deletes all rows of the keys that ``rows`` has and inserts ``rows``; done twice it gives the same."""
        return self._change(rows, lambda old, new, key: _without(old, new, key).unionByName(new), meta)

    def delete(self, keys: DataFrame) -> int:
        return self._change(keys, _without, None)

    def upsert(self, rows: DataFrame, order: list[Column]) -> int:
        """Replaces by key; of rows with the same key the first in order stays."""
        return self._change(rows, lambda old, new, key: _without(old, new, key).unionByName(upserts.latest(new, key, order)), None)

    def insert_missing(self, rows: DataFrame) -> int:
        """Adds one row for each key that is not there."""
        return self._change(rows, lambda old, new, key: old.unionByName(_without(new.dropDuplicates(key), old, key)), None)

    def merge_keep(self, rows: DataFrame, keep: list[str]) -> int:
        """New values over old ones but for the columns to keep; one row a key, and a key of one column."""
        return self._change(rows, lambda old, new, key: upserts.merge_keep(old, new, *key, keep), None)

    def compact(self) -> int:
        """Each bucket's files as one set again."""
        base = self.manifest()
        self._writable(base)
        return self._commit(base, {p["bucket"] for p in base["parts"]}, self._written(base, self._rows(base)), None)

    def vacuum(self, keep: int = 1, seconds: float = 3600.0) -> int:
        """Removes all but the last versions, and files that none of these names, if older than so many seconds; gives their number."""
        kept = self.versions()[-keep:]
        named = {p["path"].split("/")[1] for v in kept for p in self.manifest(v)["parts"]}
        for v in self.versions():
            if v < kept[0]:
                self._fs.delete(self._path(f"versions/{v:012d}.json"), False)
        if not self._fs.exists(self._path("data")):
            return 0
        now = self.spark._jvm.System.currentTimeMillis()
        gone = [f.getPath() for f in self._fs.listStatus(self._path("data")) if f.getPath().getName() not in named and now - f.getModificationTime() >= 1000 * seconds]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    # -- how

    def _writable(self, manifest: dict) -> None:
        if manifest["append_only"]:
            raise PermissionError(f"{self.root} only takes appends")

    def _buckets(self, manifest: dict, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(_bucket(manifest)).distinct().collect()}  # at most as many as there are buckets

    def _written(self, manifest: dict, rows: DataFrame) -> list[dict]:
        """Writes rows as new files of their buckets, which nobody reads yet."""
        names = StructType.fromJson(json.loads(manifest["schema"])).names
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*names, _bucket(manifest).alias(BUCKET)).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder)) if f.isDirectory()]
        return [{"bucket": int(n.split("=")[1]), "path": f"{folder}/{n}"} for n in found if n.startswith(f"{BUCKET}=")]

    def _change(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame, list[str]], DataFrame], meta: dict | None) -> int:
        base = self.manifest()
        self._writable(base)
        touched = self._buckets(base, rows)
        if not touched:
            return base["version"]
        return self._commit(base, touched, self._written(base, how(self._rows(base, touched), rows, base["key"])), meta)

    def _commit(self, base: dict, replaced: set[int], added: list[dict], meta: dict | None) -> int:
        if not replaced and not added and meta is None:
            return base["version"]
        changed = replaced | {p["bucket"] for p in added}
        last = base
        while True:
            parts = [p for p in last["parts"] if p["bucket"] not in replaced] + added
            if self._put(last | {"version": last["version"] + 1, "parts": parts, "changed": sorted(changed), "meta": last["meta"] | (meta or {})}):
                return last["version"] + 1
            last = self.manifest(last["version"] + 1)
            if replaced & set(last["changed"]):
                raise Conflict(f"version {last['version']} has changed the same buckets")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _bucket(manifest: dict) -> Column:
    return F.pmod(F.xxhash64(*manifest["key"]), F.lit(manifest["buckets"])).cast("int")


def _without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key others have not; a null is a value like others."""
    there = others.select(*[F.col(k).alias(f"_other_{k}") for k in key]).distinct()
    return rows.join(there, _all(F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in key), "left_anti")
