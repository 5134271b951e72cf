import __spark_entry__ as entry
from pressmark.operators.matching import containing
from tests.whole import write

QUOTES = ["profit", "rofi", "a  profit", "it was a profit.", "", " ", None, "none", "two words", "no profit"] + [f"q{i}" for i in range(600)]
TEXTS = ["It was a profit.", "profits", "unprofitable", "for it was a profit. Yes", "two wordsmiths", "", None, "a  profit", "q599q3"]


def test_short_quotes_meet_every_text(spark, tmp_path):
    quotes, texts = (spark.createDataFrame(list(enumerate(x)), "k long, t string") for x in (QUOTES, TEXTS))
    got = {tuple(r) for r in containing(quotes.toDF("i", "q"), texts.toDF("d", "t"), "i", "q", "d", "t").select("i", "d").collect()}
    assert got == {(i, d) for i, q in enumerate(QUOTES) for d, t in enumerate(TEXTS) if q is not None and t is not None and q in t}


def test_recall_counts_short_items(spark, tmp_path):
    path = write(spark, tmp_path, ["all profit.", "unrelated"])
    spark.createDataFrame([(0, "profit"), (1, "loss")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert tuple(entry.queries()["ev10_source_recall"](spark, path).select("questions", "found").first()) == (2, 1)
