"""Rows without an id, with the same id, and columns whose names clash: every row of documents comes back once."""

import pytest

from pressmark.llm import queries
from tests.llm.fixtures import prose, write

TEXTS = [prose(60, 1), prose(60, 1), None, prose(60, 2), "", prose(60, 3), prose(60, 3), "short"]
IDS = [None, 5, None, 5, 7, 7, None, 9]
PER_ROW = [q for q in queries.queries() if q.split("_")[0] in ("op1", "op4", "op5", "op7", "op8", "op9", "op10")]


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_once(spark, tmp_path, name):
    path = write(spark, tmp_path, TEXTS, [(5, 1, 0), (7, 0, 0), (None, 1, None)], IDS)
    rows = queries.queries()[name](spark, path).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, IDS))


def test_packing_keeps_every_row(spark, tmp_path):
    rows = queries.queries()["op3_packing"](spark, write(spark, tmp_path, TEXTS, [], IDS)).collect()
    assert sum(r.start == 0 for r in rows) == len(TEXTS)


def test_native_scan_runs_no_python(spark, tmp_path):
    p = queries.queries()["op4_license_scan"](spark, write(spark, tmp_path, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Pandas" not in p and "InArrow" not in p


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_kinds_of_ids(spark, tmp_path, kind):
    from pyspark.sql import functions as F

    from pressmark.llm import bpe_tree, license_index, order_minhash, packing, prefix_hash, quality_crf, quality_rules, suffix_dedup
    from tests.llm.fixtures import docs

    ids = list(range(len(TEXTS)))
    own = docs(spark, TEXTS, ids).withColumn("doc_id", (F.concat(F.lit("d"), F.col("doc_id").cast("string")) if kind == "string" else F.col("doc_id").cast("int")))
    want = sorted(f"d{i}" if kind == "string" else i for i in ids)
    labels = own.select("doc_id", F.lit(1).alias("quality"))
    file = bpe_tree.tokenizer_file()
    for rows in (quality_crf.score(own, quality_crf.fit(own, labels)), quality_rules.judge(own, quality_rules.fit(own, labels)), license_index.scan(own), order_minhash.near_duplicates(own), suffix_dedup.removed(own)):
        assert sorted(r.doc_id for r in rows.collect()) == want and rows.schema["doc_id"].dataType.simpleString() == kind
    pieces = packing.pieces(own, file)
    assert sorted(r.doc_id for r in pieces.collect() if r.start == 0) == want and pieces.schema["doc_id"].dataType.simpleString() == kind
    if kind == "string":
        with pytest.raises(TypeError):
            prefix_hash.with_successors(own.select("doc_id", "text"), "doc_id", ["text"], 2)


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    good = [prose(60, k) for k in range(8)]
    texts = [*good, good[0], good[1], None, "", good[2] + " more words"]
    ids = [0, 1, 2, 2, None, None, 6, 7, 0, 99, None, 3, 8]
    path = write(spark, tmp_path, texts, [(0, 1, 0), (1, 1, 0), (None, 1, 0)], ids)
    rows = corpus_pipeline.run(spark, path).collect()
    firsts = [r.doc_id for r in rows if r.start == 0]
    assert sorted(str(i) for i in firsts) == sorted(str(i) for i in [0, 1, 2, 2, None, None, 6, 7])


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from pressmark.session import shared_folder

    unset = SimpleNamespace(isDefined=lambda: False)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,512]", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))))
    with pytest.raises(ValueError):
        shared_folder(fake)
