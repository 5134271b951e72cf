"""Writers: exports by decade, reports, bucketed indexes, tagged rows into tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_decade(rows: DataFrame, path: str) -> DataFrame:
    """JSON in a folder for each decade; gives decade, n and a digest of the ids that does not depend on order."""
    rows.write.mode("overwrite").partitionBy("decade").json(path)
    digest = F.sum(F.conv(F.substring(F.sha2("item_id", 256), 1, 14), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy("decade").agg(F.count("*").alias("n"), digest.alias("digest"))


def report(rows: DataFrame, key: str, path: str) -> None:
    """Counts in falling order as CSV, one file; one row for each value of the key."""
    rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


POINTER = "shards.json"


def bucketed_index(frequencies: DataFrame, buckets: int, root: str, shards: DataFrame | None = None) -> dict:
    """term, shard, df as lines ``term TAB shard:df,...`` in a folder for each bucket of the term's hash; the pointer comes last.

    shards: shard, passages, tokens; one row a shard (without it the pointer tells no sizes). Each build writes a folder of its own, then puts the pointer
    in place at once, so a reader has the last index that was finished. Gives the pointer: the folder, a digest of the lines that does not depend
    on how they are dealt, and the collection's size. Terms with a tab or a line break are left out.
    """
    from pressmark.functions.text import fnv1a

    spark = frequencies.sparkSession
    folder = uuid.uuid4().hex
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "df"))), lambda e: F.concat(e["shard"], F.lit(":"), e["df"].cast("string"))), ",")
    lines = frequencies.filter(~F.col("term").rlike("[\t\n]")).groupBy("term").agg(entries.alias("e")).select((fnv1a("term") % buckets).alias("bucket"), F.concat("term", F.lit("\t"), "e").alias("value"))
    lines.repartition("bucket").sortWithinPartitions("bucket", "value").write.partitionBy("bucket").text(f"{root}/{folder}")
    digest = F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 14), 16, 10).cast("decimal(38,0)")).cast("string")
    written = spark.read.text(f"{root}/{folder}").agg(F.count("*").alias("terms"), digest.alias("digest")).first()
    held = {r["shard"]: {"passages": r["passages"], "tokens": r["tokens"]} for r in (shards.collect() if shards is not None else [])}  # one row a shard
    n, tokens = (sum(h[k] for h in held.values()) for k in ("passages", "tokens"))
    pointer = {"folder": folder, "buckets": buckets, "terms": written["terms"], "digest": written["digest"], "N": n, "tokens": tokens, "avgdl": tokens / n if n else 0.0, "shards": held}
    Store(spark, root).put(POINTER, json.dumps(pointer).encode())
    return pointer


def read_index(spark, root: str, terms: list[str] | None = None) -> DataFrame:
    """term, shard, df of the index that the pointer names; of the buckets of these terms alone, if any are given."""
    from pressmark.functions.text import fnv1a

    pointer = json.loads(Store(spark, root).read(POINTER))
    rows = spark.read.text(f"{root}/{pointer['folder']}")
    parts = F.split("value", "\t")
    if terms is not None:
        asked = spark.createDataFrame([(t,) for t in terms], "t string").select((fnv1a("t") % pointer["buckets"]).alias("b")).distinct().collect()  # a row a term
        rows = rows.filter(F.col("bucket").isin([r["b"] for r in asked]) & parts[0].isin(terms))
    split = rows.select(parts[0].alias("term"), F.explode(F.split(parts[1], ",")).alias("e"))
    at = F.length("e") - F.length(F.substring_index("e", ":", -1))
    return split.select("term", F.substring("e", F.lit(1), at - 1).alias("shard"), F.substring_index("e", ":", -1).cast("long").alias("df"))


def demultiplexed(tagged: DataFrame, path: str, kinds: dict[str, list[str]]) -> dict[str, int]:
    """Writes rows of each kind, its columns only, to a table of its own; gives their numbers."""
    counts = {r["kind"]: r["n"] for r in tagged.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # one row a kind
    for kind, columns in kinds.items():
        tagged.filter(F.col("kind") == kind).select(*columns).write.mode("overwrite").parquet(f"{path}/{kind}")
    return {k: counts.get(k, 0) for k in kinds}


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that rows have, and only these: what is not in ``rows`` is gone from them.

    For whole partitions, such as a decade's export. Single items are replaced in a table of versions (``snapshots``).
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def vectors(rows: DataFrame, key: str, column: str, path: str, parts: int = 8) -> DataFrame:
    """Writes vectors in order of their key and gives their manifest: rows, dim (null where they differ), digest.

    The digest adds a hash of each row, so it depends on what is kept and not on how it is dealt.
    """
    rows.select(key, column).repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    said = F.concat_ws(":", F.col(key).cast("string"), F.array_join(F.transform(column, lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ","))
    digest = F.sum(F.conv(F.substring(F.sha2(said, 256), 1, 14), 16, 10).cast("decimal(38,0)")).cast("string")
    size = F.size(column)
    return kept.agg(F.count("*").alias("rows"), F.when(F.min(size) == F.max(size), F.min(size)).alias("dim"), digest.alias("digest"))


class Store:
    """Objects by key below a folder that the cluster shares: put, get, head, list."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str):
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"no key of a store: {key}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, key: str, body: bytes, overwrite: bool = True) -> bool:
        """The object as a whole, by a rename, so that nobody reads half of it; false if it is there and must not be overwritten."""
        path, fs = self._path(key)
        hadoop, conf = self.spark._jvm.org.apache.hadoop, self.spark._jsc.hadoopConfiguration()
        temporary = hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        kinds = getattr(hadoop.fs, "Options$Rename")
        how = self.spark._sc._gateway.new_array(kinds, int(overwrite))
        if overwrite:
            how[0] = kinds.OVERWRITE
        context = hadoop.fs.FileContext.getFileContext(path.toUri(), conf)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(path), how)
            return True
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if not overwrite and e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                return False
            raise

    def read(self, key: str) -> bytes:
        """A small object, on the driver."""
        path, fs = self._path(key)
        source = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source))
        finally:
            source.close()

    def head(self, key: str) -> int | None:
        """The object's size; null where there is none."""
        path, fs = self._path(key)
        return fs.getFileStatus(path).getLen() if fs.exists(path) else None

    def get(self, keys: str) -> DataFrame:
        """key, size, content of the objects that a pattern of keys names, read where the executors are."""
        found = self.spark.read.format("binaryFile").load(f"{self.root}/{keys}")
        return found.select(F.substring_index("path", self.root.split("://")[-1] + "/", -1).alias("key"), F.col("length").alias("size"), "content")

    def list(self, prefix: str) -> DataFrame:
        """key, size of every object below a prefix."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/{prefix}")
        return found.select(F.substring_index("path", self.root.split("://")[-1] + "/", -1).alias("key"), F.col("length").alias("size"))


def checksum_lines(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """A manifest's lines: digest, two spaces, name."""
    return rows.select(F.concat(F.col(digest), F.lit("  "), F.col(name)).alias("value"))


def read_checksums(lines: DataFrame) -> DataFrame:
    """name, digest of a manifest's lines; blank lines and those that begin with # are passed over, others are errors."""
    kept = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    sound = F.col("value").rlike(r"^[0-9a-f]{64} [ *]\S")
    checked = F.when(sound, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no line of a manifest: "), "value")))
    return kept.select(checked.alias("v")).select(F.expr("substring(v, 67)").alias("name"), F.substring("v", 1, 64).alias("digest"))
