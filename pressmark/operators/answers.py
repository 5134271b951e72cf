"""Answers from drafted sentences: what may be kept, what is said instead, how far the evidence goes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.functions.text import years


def judged(sentences: DataFrame, cites: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every sentence with ``reason`` (null: kept).

    sentences: answer, pos, text; cites: answer, pos, passage_id; evidence: answer, passage_id,
    item_id, year, text. A sentence without a citation is dropped, then one that cites what is
    not among the evidence, then one that names a year which no cited passage has.
    """
    known = evidence.select("answer", "passage_id", "item_id", F.col("year").alias("_y"), F.col("text").alias("_t"))
    joined = cites.select("answer", "pos", "passage_id").distinct().join(known, ["answer", "passage_id"], "left")
    per = joined.groupBy("answer", "pos").agg(
        F.bool_and(F.col("item_id").isNotNull()).alias("sound"),
        F.collect_set("item_id").alias("items"),
        F.array_distinct(F.concat(F.collect_set("_y"), F.flatten(F.collect_list(years("_t"))))).alias("allowed"),
    )  # a sentence cites a few passages
    rows = sentences.join(per, ["answer", "pos"], "left")
    leaks = F.size(F.array_except(years("text"), F.coalesce("allowed", F.array().cast("array<int>")))) > 0
    reason = F.when(F.col("sound").isNull(), "no citation").when(~F.col("sound"), "citation failed").when(leaks, "names a year that is not cited")
    return rows.select("answer", "pos", "text", "items", reason.alias("reason"))


def composed(judgements: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row for each answer: its text from the kept sentences, its state, and why it abstains.

    proposals: answer, proposed (SUPPORTED, PARTIALLY_SUPPORTED, CONFLICTING, INCOMPARABLE or
    INSUFFICIENT_EVIDENCE). A state is only ever moved towards caution: conflict needs two items,
    full support no dropped sentence.
    """
    kept = F.col("reason").isNull()
    per = judgements.groupBy("answer").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "text")))), lambda s: s["text"]), " ").alias("text"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("dropped"),
        F.bool_or(F.coalesce(F.col("reason") != "no citation", F.lit(True))).alias("reached"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(kept, F.col("items")))))).alias("items"),
    )  # an answer has a few sentences
    rows = proposals.join(per, "answer", "left")
    none = F.coalesce("kept", F.lit(0)) == 0
    careful = F.when(F.col("proposed").isin("CONFLICTING", "INCOMPARABLE") & (F.col("items") < 2), "PARTIALLY_SUPPORTED").when((F.col("proposed") == "SUPPORTED") & (F.col("dropped") > 0), "PARTIALLY_SUPPORTED").otherwise(F.col("proposed"))
    return rows.select(
        "answer",
        F.when(~none, F.col("text")).alias("text"),
        F.when(none, "INSUFFICIENT_EVIDENCE").otherwise(careful).alias("state"),
        F.when(none, F.when(F.coalesce("reached", F.lit(False)), "unverified").otherwise("uncited")).alias("abstains"),
    )


def page_dated(rows: DataFrame, pages: DataFrame, front: int = 6, tasks: int | None = None) -> DataFrame:
    """item_id, leaf, year, method, page_leaf: where a catalogue year is written, on the page itself or else in the front matter.

    rows: item_id, leaf, year; pages: item_id, leaf, text. tasks: over how many the rows are dealt, the session's shuffle partitions unless given.
    """
    told = pages.select("item_id", F.col("leaf").alias("page_leaf"), F.explode(years("text")).alias("year"))
    if tasks:
        rows, told = (d.repartition(tasks, "item_id", "year") for d in (rows, told))
    # each row meets one row at most: the pages of its item that name its year
    named = told.groupBy("item_id", "year").agg(F.min(F.when(F.col("page_leaf") < front, F.col("page_leaf"))).alias("ahead"), F.collect_set("page_leaf").alias("leaves"))
    out = rows.join(named, ["item_id", "year"], "left").withColumn("own", F.array_contains("leaves", F.col("leaf")))
    at = F.when(F.col("own"), F.col("leaf")).otherwise(F.col("ahead"))
    method = F.when(at.isNull(), "not_found").when(F.col("own"), "read_from_page").otherwise("read_from_front_matter")
    return out.select("item_id", "leaf", F.when(at.isNotNull(), F.col("year")).alias("year"), method.alias("method"), at.alias("page_leaf"))


def cut_around(text: str, keep: str, most: int) -> str:
    """A long text cut to about ``most`` characters at line breaks around a kept quote."""
    if len(text) <= most:
        return text
    at = max(0, text.lower().find(keep.lower())) if keep else 0
    end = min(len(text), max(0, at - most // 3) + most)
    start = max(0, end - most)
    start = text.rfind("\n", 0, start + 1) + 1
    stop = text.find("\n", end)
    return text[start : len(text) if stop < 0 else stop]


def swept(configs: dict[str, object], run) -> DataFrame:
    """The rows that run(config) gives for every configuration, under its name."""
    out = None
    for name, config in configs.items():
        one = run(config).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


class Memo:
    """Results kept by what they were asked with, in a folder that the cluster shares, so that a sweep asks once."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root
        self.hits = self.misses = 0

    def get(self, asked: object, run) -> DataFrame:
        """The kept result for ``asked`` (anything that JSON can hold), else that of run(), kept whole before it is read."""
        path = f"{self.root}/{hashlib.sha256(json.dumps(asked, sort_keys=True).encode()).hexdigest()}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            self.hits += 1
        else:
            self.misses += 1
            run().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
