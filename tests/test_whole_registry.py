import __spark_entry__ as entry
from tests.whole import whole, write


def test_evidence_rows_of_all_documents(spark):
    got, want = whole(spark, "flt13_evidence_rows", " WHERE doc_id < 60")
    assert got == want and len(got) > 60


def close(a, b):
    """An edit distance of one, by characters."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_of_all_items(spark, tmp_path):
    # pairs within an item, between early items, and of items past the eighth; accents count as one character
    texts = ["stone stones wind", "être wind", "otre stone", "", "étre", "wand", "band bind x", "y", "bands wends", "winds ab abc", "étres stonés wend", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {w for t in texts if t for w in t.split()}
    want = sorted((a, b) for a in words for b in words if len(a) >= 4 and close(a, b))
    got = sorted(tuple(r) for r in entry.queries()["sc34_near_words"](spark, str(tmp_path)).select("word", "near").collect())
    assert got == want and ("stone", "stones") in got and ("wends", "winds") in got


def test_care_detection_reads_every_document(spark, tmp_path):
    texts = ["plain"] * 201 + ["Wörthless", "worthless", "see the", None]  # only cited rows (even ids) speak of worth
    found = lambda x, to: entry.queries()["sc38_care_detection"](spark, write(spark, to, x)).first().topics
    assert found(texts, tmp_path / "a") == ["scorn-upgraded", "worth"]
    assert found(texts[:201] + ["worthless", "plain"], tmp_path / "b") == ["scorn"]
    assert found([], tmp_path / "c") == ["scorn"]
