"""The table of versions: neighbours stay, killed and competing writers, appends only."""

import pytest
from pyspark.sql import functions as F

from pressmark.sources.snapshots import Conflict, Snapshots

SCHEMA = "item string, page int, text string"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, buckets=4, **more):
    return Snapshots.create(spark, str(path), made(spark, []).schema, ["item"], buckets, **more)


def rows(df):
    return sorted((r.item or "", r.page, r.text) for r in df.collect())


def test_replacing_an_item_keeps_its_neighbours(spark, tmp_path):
    t = table(spark, tmp_path / "t", 2)
    t.append(made(spark, [(f"i{k}", p, "old") for k in range(10) for p in range(2)] + [(None, 0, "old")]))
    want = [("i3", 0, "new")] + [(f"i{k}", p, "old") for k in range(10) if k != 3 for p in range(2)] + [("", 0, "old")]
    for _ in range(2):
        t.replace(made(spark, [("i3", 0, "new")]))
        assert rows(t.read()) == sorted(want)
    t.replace(made(spark, [(None, 7, "new")]))
    assert ("", 7, "new") in rows(t.read()) and ("", 0, "old") not in rows(t.read())
    assert rows(t.read(1)) == rows(made(spark, [(f"i{k}", p, "old") for k in range(10) for p in range(2)] + [(None, 0, "old")]))
    assert rows(t.lookup(made(spark, [("i3", 0, ""), ("no", 0, "")]))) == [("i3", 0, "new")]
    assert rows(t.missing(made(spark, [("i3", 0, ""), ("no", 0, "")]))) == [("no", 0, "")]
    t.delete(made(spark, [("i3", 0, "")]))
    assert all(i != "i3" for i, *_ in rows(t.read()))


def test_only_the_buckets_of_the_keys_are_written(spark, tmp_path):
    t = table(spark, tmp_path / "t", 16)
    t.append(made(spark, [(f"i{k}", 0, "old") for k in range(200)]))
    before = {p["path"] for p in t.manifest()["parts"]}
    t.replace(made(spark, [("i7", 0, "new")]))
    assert len(t.manifest()["changed"]) == 1 and len(before & {p["path"] for p in t.manifest()["parts"]}) == len(before) - 1


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.append(made(spark, [("a", 0, "old"), ("b", 0, "old")]))

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_put", killed)
        with pytest.raises(KeyboardInterrupt):
            t.replace(made(spark, [("a", 0, "new")]))
    again = Snapshots(spark, str(tmp_path / "t"))
    assert rows(again.read()) == [("a", 0, "old"), ("b", 0, "old")] and again.versions() == [0, 1]
    bad = made(spark, [("a", 0, "new")]).withColumn("page", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        again.replace(bad)
    assert again.versions() == [0, 1]
    assert again.replace(made(spark, [("a", 0, "new")])) == 2 and rows(again.read()) == [("a", 0, "new"), ("b", 0, "old")]
    assert again.vacuum(keep=1, seconds=0) >= 1 and rows(again.read()) == [("a", 0, "new"), ("b", 0, "old")] and again.versions() == [2]


def test_competing_writers(spark, tmp_path):
    t = table(spark, tmp_path / "t", 64)
    t.append(made(spark, [("a", 0, "old"), ("b", 0, "old")]))
    base = t.manifest()
    bucket = {k: next(iter(t._buckets(base, made(spark, [(k, 0, "")])))) for k in "ab"}
    assert bucket["a"] != bucket["b"]
    first = t._written(base, made(spark, [("a", 0, "one")]))
    other = t._written(base, made(spark, [("b", 0, "two")]))
    same = t._written(base, made(spark, [("a", 0, "three")]))
    assert t._commit(base, {bucket["a"]}, first, None) == 2
    assert t._commit(base, {bucket["b"]}, other, None) == 3
    with pytest.raises(Conflict):
        t._commit(base, {bucket["a"]}, same, None)
    assert t._commit(base, set(), same, None) == 4  # an append is never in conflict
    assert rows(t.read()) == [("a", 0, "one"), ("a", 0, "three"), ("b", 0, "two")]
    assert t.compact() == 5 and rows(t.read()) == [("a", 0, "one"), ("a", 0, "three"), ("b", 0, "two")]


def test_upserts(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append(made(spark, [("a", 1, "x"), ("b", 1, "x")]))
    t.upsert(made(spark, [("a", 2, "y"), ("a", 3, "z"), ("c", 9, "n")]), [F.desc("page")])
    assert rows(t.read()) == [("a", 3, "z"), ("b", 1, "x"), ("c", 9, "n")]
    t.insert_missing(made(spark, [("a", 5, "no"), ("d", 5, "yes"), ("d", 5, "yes")]))
    assert rows(t.read()) == [("a", 3, "z"), ("b", 1, "x"), ("c", 9, "n"), ("d", 5, "yes")]
    t.merge_keep(made(spark, [("a", 8, "new"), ("e", 8, "new")]), ["page"])
    assert rows(t.read()) == [("a", 3, "new"), ("b", 1, "x"), ("c", 9, "n"), ("d", 5, "yes"), ("e", 8, "new")]
    v = t.manifest()["version"]
    assert t.replace(made(spark, [])) == v and t.append(made(spark, [])) == v


def test_appends_only(spark, tmp_path):
    t = table(spark, tmp_path / "t", append_only=True)
    t.append(made(spark, [("a", 1, "x")]))
    t.append(made(spark, [("a", 2, "x")]))
    for change in (t.replace, t.delete, t.insert_missing):
        with pytest.raises(PermissionError):
            change(made(spark, [("a", 1, "y")]))
    assert rows(t.read()) == [("a", 1, "x"), ("a", 2, "x")]
    with pytest.raises(FileExistsError):
        table(spark, tmp_path / "t")
