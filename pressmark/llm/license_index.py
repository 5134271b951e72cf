"""License scans: a positional index of notices, in DataFrame functions alone.

Every template of a licence notice is indexed by its words' positions. A file keeps the
positions of the licence words in it (those of the index; few in most files). All of
them are looked up in the index: word w at file position p and at template position q
speaks for that template lying at p - q, and where they agree in relative position the
postings intersect. Such a place is verified: all words of the template's mandatory
phrase must stand there (two words at least), and the words found there must carry
``LEAST`` of the IDF of the template's indexed words. A place is judged by its own words
alone, whatever else the file holds. IDF is counted over all files.

Beside it the base labels: places where the words of a fixed phrase stand one after
another.

The score of a file is the largest share of IDF of an accepted template, or half of one
for a base phrase without one, or 0.

Defined cases: a null text is empty and has no words; repeated rows get equal results
each; other columns are never read; equal IDF goes by word.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmark.llm.shared import checkpointed

#: Fixed values of the base: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, notice, mandatory phrase); public notices in lower case, words parted by spaces.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "writing software distributed"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "promote products derived"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "damages arising"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "neighboring rights"),
)
#: Words too common to index unless a mandatory phrase needs them.
COMMON = frozenset("a all an and any are as be by can copy for from has in into is it its may name names no nor of on or that the this to under use used will with without work you 0 1 2 3 4 v".split())

LEAST = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index() -> list[tuple[int, str, str, int, bool]]:
    """(template, label, word, position, mandatory) of every indexed word."""
    out = []
    for t, (label, notice, phrase) in enumerate(TEMPLATES):
        words, need = notice.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        for q, w in enumerate(words):
            must = at <= q < at + len(need)
            if must or w not in COMMON:
                out.append((t, label, w, q, must))
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, _, w, _, _ in index()} | {w for p in BASE for w in p.split()})


def _starts(hits: Column, phrase: str) -> Column:
    """The positions in hits (p, w) at which the phrase's words stand one after another."""
    words = phrase.split()

    def here(h: Column, i: Column) -> Column:
        found = h["w"] == words[0]
        for k, w in enumerate(words[1:], 1):
            nxt = F.get(hits, i + k)
            found = found & F.coalesce((nxt["w"] == w) & (nxt["p"] == h["p"] + k), F.lit(False))
        return F.when(found, h["p"])

    return F.filter(F.transform(hits, here), lambda p: p.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    words = docs.select("doc_id", F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    vocab = vocabulary()
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda h: h["w"].isin(vocab))
    files = checkpointed(words.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")).withColumn("row", F.monotonically_increasing_id()))

    # one row for each word of the vocabulary, a fixed size
    df = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    spark = docs.sparkSession
    total = files.select(F.count("*").alias("n"))
    idf = (
        spark.createDataFrame([(w,) for w in vocab], "w string").join(F.broadcast(df), "w", "left").crossJoin(F.broadcast(total))
        .select("w", F.round(F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1, 6).alias("idf"))
    )
    weight = {r["w"]: r["idf"] for r in idf.collect()}  # as many rows as the vocabulary has words
    idf_of = F.create_map(*chain.from_iterable((F.lit(w), F.lit(weight[w])) for w in vocab))

    rows = index()
    all_of, musts = {}, {}
    for t, _, w, _, must in rows:
        all_of[t] = all_of.get(t, 0.0) + weight[w]
        musts[t] = musts.get(t, 0) + must
    postings = spark.createDataFrame([(t, label, w, q, must, weight[w], all_of[t], musts[t]) for t, label, w, q, must in rows], "t int, label string, w string, q int, must boolean, idf double, whole double, n_must int")

    spread = files.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", F.col("h.p").alias("p"), F.col("h.w").alias("w"))
    places = (
        spread.join(F.broadcast(postings), "w")  # the index of the templates above, a fixed size
        .groupBy("row", "t", "label", (F.col("p") - F.col("q")).alias("at"), "whole", "n_must")
        .agg(F.sum("idf").alias("found"), F.sum(F.col("must").cast("int")).alias("must"))
        .withColumn("share", F.round(F.col("found") / F.col("whole"), 6))
        .filter((F.col("must") == F.col("n_must")) & (F.col("share") >= LEAST))
    )
    accepted = places.groupBy("row").agg(F.collect_set("label").alias("found_labels"), F.max("share").alias("best"))

    own = {p: _starts(F.col("hits"), p) for p in BASE}
    based = files.select("row", "doc_id", "n_words", F.concat(*own.values()).alias("starts"), F.array_compact(F.array(*[F.when(F.size(s) > 0, BASE[p]) for p, s in own.items()])).alias("base"))
    return based.join(accepted, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    vocab = ", ".join(f"({quoted(w)})" for w in vocabulary())
    entries = ", ".join(f"({t}, {quoted(label)}, {quoted(w)}, {q}, {int(must)})" for t, label, w, q, must in index())
    base = []
    for phrase, label in BASE.items():
        w = phrase.split()
        joins = " ".join(f"JOIN hits h{k} ON h{k}.rid = h0.rid AND h{k}.p = h0.p + {k} AND h{k}.w = {quoted(w[k])}" for k in range(1, len(w)))
        base.append(f"SELECT h0.rid, h0.p, {quoted(label)} AS label FROM hits h0 {joins} WHERE h0.w = {quoted(w[0])}")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
vocab(w) AS (VALUES {vocab}),
idx(t, label, w, q, must) AS (VALUES {entries}),
hits AS (SELECT rid, i - 1 AS p, w FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs) JOIN vocab USING (w)),
idf AS (SELECT w, round(ln((SELECT count(*) + 1 FROM docs)::DOUBLE / (count(DISTINCT rid) + 1)) + 1, 6) AS idf FROM vocab LEFT JOIN hits USING (w) GROUP BY w),
whole AS (SELECT t, sum(idf) AS whole, sum(must) AS n_must FROM idx JOIN idf USING (w) GROUP BY t),
places AS (
  SELECT h.rid, x.t, x.label, h.p - x.q AS at, round(sum(i.idf) / any_value(o.whole), 6) AS share
  FROM hits h JOIN idx x ON x.w = h.w JOIN idf i ON i.w = h.w JOIN whole o ON o.t = x.t
  GROUP BY h.rid, x.t, x.label, h.p - x.q
  HAVING sum(x.must) = any_value(o.n_must) AND round(sum(i.idf) / any_value(o.whole), 6) >= {LEAST}),
base AS ({" UNION ALL ".join(base)}),
per_base AS (SELECT rid, count(*) AS n, min(p) AS lo, max(p) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY rid),
per_place AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS best FROM places GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  coalesce(m.best, CASE WHEN b.n > 0 THEN 0.5 END, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN per_base b USING (rid) LEFT JOIN per_place m USING (rid)"""


SQL = {"op4_license_scan": _sql()}
