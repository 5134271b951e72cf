import json

import pytest

from pressmark.operators import answers
from pressmark.sources import search


def test_fetch_waits_and_gives_up():
    answers_ = [(503, {}, ""), (429, {"retry-after": "7"}, ""), (200, {}, '{"a": 1}')]
    waited = []
    assert search.fetch(lambda url: answers_.pop(0), "u", waited.append) == {"a": 1}
    assert 2 <= waited[0] <= 4 and 7 <= waited[1] <= 9
    with pytest.raises(search.SearchError):
        search.fetch(lambda url: (503, {}, ""), "u", lambda s: None, tries=3)
    with pytest.raises(search.SearchError):
        search.fetch(lambda url: (404, {}, ""), "u", lambda s: None)
    with pytest.raises(search.SearchError):
        search.fetch(lambda url: (200, {}, '{"error": "no"}'), "u", lambda s: None)


def test_paging_and_guards():
    pages = {None: {"items": [{"identifier": "a"}], "cursor": "c1"}, "c1": {"items": [{"identifier": "b"}]}}
    page = lambda url: pages["c1" if "cursor=c1" in url else None]
    assert [i["identifier"] for i in search.by_cursor(page, "http://x", "q")] == ["a", "b"]
    with pytest.raises(search.SearchError):
        list(search.by_cursor(lambda url: {"items": [], "cursor": "same"}, "http://x", "q"))
    docs = [{"identifier": str(k)} for k in range(5)]
    numbered = lambda url: {"response": {"docs": docs[(n := int(url.split("page=")[1].split("&")[0]) - 1) * 2 : n * 2 + 2], "numFound": 5}}
    assert len(list(search.by_number(numbered, "http://x", "q", rows=2))) == 5
    assert search.count(lambda url: {"response": {"numFound": 5}}, "http://x", "q") == 5
    assert search.query_of("texts", ["a", "b"], "health") == "mediatype:texts AND (collection:a OR collection:b) AND (health)"
    assert search.healthy(0, 5, 100, 50, 200) == 100
    for bad in ((9, 5, 100, 50, 200), (0, 5, 10, 50, 200)):
        with pytest.raises(search.SearchError):
            search.healthy(*bad)


def test_cached_pages_and_tasks(spark, tmp_path):
    for name, items in (("p1.json", [{"identifier": "a", "title": "first"}, {"identifier": "b", "title": "b"}]), ("p2.json", [{"identifier": "a", "title": "later"}])):
        (tmp_path / name).write_text(json.dumps({"items": items}))
    rows = search.cached_pages(spark, str(tmp_path), "struct<identifier:string,title:string>")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "first"), ("b", "b")]
    assert search.complete(rows, 2).count() == 2
    with pytest.raises(Exception):
        search.complete(rows, 100).collect()
    items = spark.createDataFrame([("a", [("x.txt", "ff00"), ("y.txt", None)]), ("b", [("x.txt", "ff00"), ("z.txt", "aa11")])], "identifier string, files array<struct<name:string,md5:string>>")
    done = spark.createDataFrame([("ocr/aa/aa11__z.txt",)], "dest string")
    assert [(r.identifier, r.name, r.dest) for r in search.download_tasks(items, done, 10).collect()] == [("a", "x.txt", "ocr/ff/ff00__x.txt")]


def test_cut_around():
    text = "\n".join(f"line {k} of some length" for k in range(50))
    cut = answers.cut_around(text, "line 25 of", 120)
    assert "line 25 of" in cut and len(cut) < 200 and all(x in text.split("\n") for x in cut.split("\n"))
    assert answers.cut_around("short", "x", 100) == "short"
