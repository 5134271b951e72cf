"""Small tables with nulls, empty and long texts, ties, repeats and columns with clashing names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])


def prose(n, seed, words="the of and river stone école ñandú wind ready cold over under light house paper".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (".\n" if r.random() < 0.1 else "") for _ in range(n))


ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "a b c d e f g h a b c d e f g h", "same line\nsame line\n\nother\nsame line", "é" * 50, "x" * 5000,
    "tab\tvt\x0bff\x0ccr\rnbsp end", "### $$$ %%% | | <b>", prose(40, 1), prose(40, 1), prose(300, 2), prose(3000, 3), "😀 " * 30, "  lead and trail  ",
    "Released under the MIT License.", "the GNU General Public License, version 3. Apache license, mit LICENSE", "word " * 100,
]


def docs(spark, texts=None, ids=None):
    texts = ODD_TEXTS if texts is None else texts
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "src0", None, "clash") for i, t in zip(ids, texts)], DOCS)


def write(spark, path, texts=None, labels=None, ids=None):
    docs(spark, texts, ids).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)
