"""Readers, writers and streams on small files."""

import pytest
from pyspark.sql import functions as F

from pressmark.sources import readers, sinks, web
from pressmark.streaming import flows


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"identifier": "x", "page_count": 3, "year": 1990}\n\n# note\n{"identifier": "y"}\n{"identifier": "to')
    rows = readers.json_lines(spark, p, "identifier string, page_count int", comments=True, tolerant=True).collect()
    assert [(r.identifier, r.page_count) for r in rows] == [("x", 3), ("y", None)]
    with pytest.raises(Exception):
        readers.json_lines(spark, p, "identifier string", comments=True).collect()
    log = spark.createDataFrame([("a", "hocr"), ("b", "error"), ("c", None), ("a", "error")], "id string, kind string")
    assert sorted(r.id for r in readers.done(log, "id").collect()) == ["a", "c"]


def test_rules(spark, tmp_path):
    p = put(tmp_path / "r.csv", "kind,pattern,jurisdiction,specificity\n# c,c,c,9\ntext,Canada,federal,1\ntext,Health Canada,federal,3\ntext,Ontario,ontario,1\n")
    assert readers.rules(spark, p) == [("health canada", "federal"), ("canada", "federal"), ("ontario", "ontario")]


def test_pages(spark, tmp_path):
    files = spark.createDataFrame([("a", "one\ftwo\f"), ("b", None), ("c", "only")], "k string, text string")
    assert [(r.k, r.leaf, r.text) for r in readers.page_texts(files, "k", "text").orderBy("k", "leaf").collect()] == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("b", 0, ""), ("c", 0, "only")]
    hocr = spark.createDataFrame([("a", "<html><div class='ocr_page' id=p1><span>One &amp;</span> two</div><div class=\"ocr_page\">three</div></html>"), ("b", None)], "k string, h string")
    assert [(r.k, r.leaf, r.text) for r in readers.hocr_pages(hocr, "k", "h").collect()] == [("a", 0, "One & two"), ("a", 1, "three")]
    p = put(tmp_path / "d.xml", "<DjVuXML><BODY><OBJECT><PARAGRAPH><LINE><WORD>Annual</WORD><WORD>report</WORD></LINE><LINE><WORD>1970</WORD></LINE></PARAGRAPH></OBJECT><OBJECT><PARAGRAPH><LINE><WORD>Two</WORD></LINE></PARAGRAPH></OBJECT></BODY></DjVuXML>")
    assert sorted(r.text for r in readers.xml_pages(spark, p).collect()) == ["Annual report 1970", "Two"]
    labels = spark.createDataFrame([("a", '{"pages": [{"leafNum": 0, "pageNumber": ""}, {"leafNum": 1, "pageNumber": "iv"}]}')], "k string, j string")
    assert [(r.leaf, r.label) for r in readers.page_labels(labels, "k", "j").collect()] == [(0, None), (1, "iv")]


def test_offsets_fail_closed(spark):
    good = spark.createDataFrame([("a", "abcdefgh", [[0, 3], [3, 5], [5, 8]], [0, 2])], "k string, t string, o array<array<int>>, s array<int>")
    assert [(r.leaf, r.text) for r in readers.offset_pages(good, "k", "t", "o", "s").orderBy("leaf").collect()] == [(0, "abc"), (1, "fgh")]
    with pytest.raises(Exception):
        readers.offset_pages(good.withColumn("s", F.array(F.lit(7))), "k", "t", "o", "s").collect()


def test_source_choice(spark):
    rows = spark.createDataFrame([([("x_hocr.html",), ("x_djvu.xml",)],), ([("a.pdf",)],), ([("q_djvu.txt",), ("q_djvu.xml",)],)], "files array<struct<name:string>>")
    assert [r.n for r in rows.select(readers.chosen_source(F.col("files"))["name"].alias("n")).collect()] == ["x_djvu.xml", None, "q_djvu.txt"]


def test_web(spark):
    html = "<head><title>A  b</title><meta name='Date' content='2001-02-03'></head><body><script>x()</script><p>One &amp;</p><div>two</div>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<meta content=b name=x><META NAME=\"X\" CONTENT='c d'><!-- <p>no --><title> </title>1 < 2<br>&eacute;<svg>q</svg>")], "k int, h string")
    got = {r.k: (r.title, r.text, r.meta) for r in web.pages(rows, "k", "h").collect()}
    assert got == {1: ("A b", "One &\ntwo", {"date": "2001-02-03"}), 2: (None, "", {}), 3: (None, "1 < 2\né", {"x": "c d"})}


def test_robots(spark):
    robots = "User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: *\nDisallow: /\n# end"

    def reads(text, agent, path):
        return web.allowed(spark.createDataFrame([(1, text, path)], "k int, r string, p string"), "k", "r", "p", agent).first().allowed

    assert [reads(robots, a, p) for a, p in (("a", "/x/1"), ("b", "/x/ok"), ("b", "/y"), ("c", "/y"), ("a", "/"))] == [False, True, True, False, True]
    assert reads("User-agent: *\nDisallow: /*.pdf$", "z", "/a.pdf") is False and reads("", "z", "/") is True and reads(None, "z", "/") is True
    assert reads("User-agent: *\nDisallow: /*.pdf$", "z", "/a.pdfx") is True and reads("User-agent: z\n\nUser-agent: *\nDisallow: /", "z", "/q") is False


def test_publication_date(spark):
    rows = spark.createDataFrame([({"date": "1999-01-02x"}, ""), ({}, "Date modified: 2003-04-05 end"), ({}, "none")], "m map<string,string>, t string")
    assert [str(r.d) for r in rows.select(web.publication_date(F.col("m"), F.col("t")).alias("d")).collect()] == ["1999-01-02", "2003-04-05", "None"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1960s"), ("b", "1960s"), ("c", "1970s")], "item_id string, decade string")
    assert {(r.decade, r.n) for r in sinks.by_decade(rows, str(tmp_path / "d")).collect()} == {("1960s", 2), ("1970s", 1)}
    sinks.report(rows, "decade", str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("1960s", "2"), ("1970s", "1")]
    df = spark.createDataFrame([("x", "s1", 3), ("x", "s0", 2), ("y", "s1", 1)], "term string, shard string, df long")
    sinks.bucketed_index(df, 4, str(tmp_path / "i"))
    assert {tuple(r) for r in sinks.read_index(spark, str(tmp_path / "i")).collect()} == {("x", "s1", 3), ("x", "s0", 2), ("y", "s1", 1)}
    tagged = spark.createDataFrame([("item", "a", None), ("page", "a", 1), ("page", "a", 2)], "kind string, k string, leaf int")
    assert sinks.demultiplexed(tagged, str(tmp_path / "t"), {"item": ["k"], "page": ["k", "leaf"], "skipped": ["k"]}) == {"item": 1, "page": 2, "skipped": 0}
    for _ in range(2):
        sinks.replace_partitions(rows, str(tmp_path / "p"), "decade")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(k, 1, f"2024-01-01 00:{k:02d}:00", 1.0) for k in range(6)], "event_id long, user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.filter("event_id < 4").coalesce(1).write.parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        flows.ingest_available(flows.folder_stream(spark, src, rows.schema), out, ck)
    assert spark.read.parquet(out).count() == 4
    rows.filter("event_id >= 4").coalesce(1).write.mode("append").parquet(src)
    flows.ingest_available(flows.folder_stream(spark, src, rows.schema), out, ck)
    assert spark.read.parquet(out).count() == 6

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    counted = run(flows.event_windows(flows.folder_stream(spark, src, rows.schema), "ts", "1 hour", "3 minutes", None), "w", "complete")
    assert sorted(r.n for r in counted) == [3, 3]
    allowed = run(flows.limited(flows.folder_stream(spark, src, rows.schema), "user_id", "ts", 1 / 120, 2.0), "lim")
    assert [r.allowed for r in sorted(allowed, key=lambda r: r.event_id)] == [True, True, True, False, True, False]
    assert len(run(flows.first_seen(flows.folder_stream(spark, src, rows.schema), "ts", "1 hour", "user_id"), "fs")) == 1


def test_an_index_is_there_once_its_pointer_is(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    df = spark.createDataFrame([("x", "s:1", 3), ("x", "s0", 2), ("y", "s:1", 1), ("a\tb", "s0", 1)], "term string, shard string, df long")
    shards = spark.createDataFrame([("s:1", 4, 40), ("s0", 6, 20)], "shard string, passages long, tokens long")
    said = sinks.bucketed_index(df, 4, root, shards)
    assert (said["N"], said["tokens"], said["avgdl"], said["terms"]) == (10, 60, 6.0, 2)
    with monkeypatch.context() as m:
        m.setattr(sinks.Store, "put", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            sinks.bucketed_index(df.filter("term = 'y'"), 4, root, shards)
    assert {tuple(r) for r in sinks.read_index(spark, root).collect()} == {("x", "s:1", 3), ("x", "s0", 2), ("y", "s:1", 1)}
    assert {tuple(r) for r in sinks.read_index(spark, root, ["y", "none"]).collect()} == {("y", "s:1", 1)}
    assert sinks.bucketed_index(df.repartition(3), 4, root, shards)["digest"] == said["digest"]
