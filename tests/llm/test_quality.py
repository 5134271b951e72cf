import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from pressmark.llm import chain_crf, flat, gbdt, quality_crf, quality_rules
from tests.llm.fixtures import ODD_TEXTS, prose, write


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_counts_match_brute_force():
    counts, failed, _ = quality_rules.verdicts(gbdt.fit(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0), np.zeros(len(quality_rules.FEATURES))), pa.array(ODD_TEXTS, pa.string()))
    assert counts.tolist() == [brute(t) for t in ODD_TEXTS]
    assert failed.tolist() == [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in map(brute, ODD_TEXTS)]


def test_flat_words_and_lines():
    texts = ["a b", "", None, "c", " d\n", "\n"]
    data, offs = flat.text_buffers(pa.array(texts, pa.string()).slice(0))
    s, e, n = flat.words(data, offs)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["a", "b", "c", "d"] and n.tolist() == [2, 0, 0, 1, 1, 0]
    s, e, n = flat.lines(data, offs)
    assert n.tolist() == [1, 1, 1, 1, 2, 2] and [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["a b", "", "", "c", " d", "", "", ""]


def test_crf_matches_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    m = chain_crf.ChainCRF(r.normal(size=(4, 2)), r.normal(size=(2, 2)))
    lengths = [3, 1, 5]
    x = r.normal(size=(9, 4))
    p, best = m.marginals(x, lengths), m.decode(x, lengths)
    at = 0
    for n in lengths:
        e = m.emissions(x[at : at + n])
        paths = list(product(range(2), repeat=n))
        v = np.array([sum(e[i, y[i]] for i in range(n)) + sum(m.step[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
        q = np.exp(v) / np.exp(v).sum()
        for i in range(n):
            assert abs(p[at + i, 1] - sum(q[k] for k, y in enumerate(paths) if y[i])) < 1e-9
        assert tuple(best[at : at + n]) == paths[int(v.argmax())]
        at += n


def test_crf_learns_chains():
    r = np.random.default_rng(1)
    lengths = np.full(200, 6)
    y = np.repeat(r.integers(0, 2, 200), 6)
    x = np.stack([y + r.normal(size=len(y)) * 0.9, np.ones(len(y))], 1)
    m = chain_crf.fit(x, y, lengths)
    assert ((m.marginals(x, lengths)[:, 1] > 0.5) == y).mean() > 0.85


def test_trees_keep_monotone_constraints():
    r = np.random.default_rng(2)
    x = r.normal(size=(800, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + 0.5 * r.normal(size=800) > 0).astype(float)
    f = gbdt.fit(x, y, np.array([1, 0, -1]))
    assert ((f.probability(x) > 0.5) == y).mean() > 0.85
    for _ in range(50):
        row = np.repeat(r.normal(size=(1, 3)), 40, 0)
        row[:, 0] = np.linspace(-3, 3, 40)
        assert (np.diff(f.margin(row)) >= -1e-12).all()
        row = np.repeat(r.normal(size=(1, 3)), 40, 0)
        row[:, 2] = np.linspace(-3, 3, 40)
        assert (np.diff(f.margin(row)) <= 1e-12).all()


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    good = [prose(60, k) for k in range(60)]
    bad = [" ".join(w + "###" for w in prose(60, 100 + k).split()) for k in range(40)]
    texts = good + bad + ODD_TEXTS
    return write(spark, tmp_path_factory.mktemp("q"), texts, [(k, int(k < 60), 0) for k in range(100)] + [(None, 1, 0), (3, None, None)])


def test_op7(spark, labelled):
    rows = quality_crf.op7_quality_classifier(spark, labelled).collect()
    assert len(rows) == 100 + len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 100]
    assert sum(r.predicted == (r.doc_id < 60) for r in held) >= 0.95 * len(held)


def test_op1(spark, labelled):
    rows = {r.doc_id: r for r in quality_rules.op1_quality_rules(spark, labelled).collect()}
    assert len(rows) == 100 + len(ODD_TEXTS)
    assert sum(rows[k].kept == (k < 60) for k in range(100)) >= 95
    assert not any(r.kept and r.base_failed for r in rows.values())


def test_without_labels_or_rows(spark, tmp_path):
    d = write(spark, tmp_path / "a", ["text"])
    assert quality_crf.op7_quality_classifier(spark, d).first().score == 0.5
    assert quality_rules.op1_quality_rules(spark, d).count() == 1
    d = write(spark, tmp_path / "b", [])
    assert quality_crf.op7_quality_classifier(spark, d).count() == 0 and quality_rules.op1_quality_rules(spark, d).count() == 0


# -- the queries against plain Python: one text, one line, one node at a time

SYMBOLS = b"#*$%&|<>"


def plain_statistics(text):
    text = text or ""
    raw, w = text.encode(), [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute(text)
    wide, size = max(n_words, 1), max(len(raw), 1)
    lines = max(sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")), 1)
    upper = lambda c: 65 <= c <= 90
    share = lambda kind: sum(kind(c) for c in raw) / size
    return [
        np.log1p(n_words), word_chars / wide, n_symbols / max(word_chars, 1), n_dup / lines, n_repeat / wide, sum(upper(x[0]) and upper(x[min(1, len(x) - 1)]) for x in w) / wide,
        share(lambda c: c == 124), share(lambda c: c == 33), share(lambda c: 48 <= c <= 57), share(lambda c: c in b".,;:?"), share(lambda c: c >= 128), n_words / lines,
        len(set(w)) / np.sqrt(wide), sum(a == b for a, b in zip(w, w[1:])) / wide, sum(x[-1] in SYMBOLS + b"!" for x in w) / wide,
    ]


def walked(forest, x):
    total = forest.start
    for node in forest.root:
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return 1 / (1 + np.exp(-total))


def all_texts(spark, path):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}


def test_op1_against_plain_python(spark, labelled):
    model = quality_rules.fit(spark.read.parquet(f"{labelled}/documents.parquet"), spark.read.parquet(f"{labelled}/labels.parquet"))
    assert len(model.root) > 10
    texts = all_texts(spark, labelled)
    for r in quality_rules.op1_quality_rules(spark, labelled).collect():
        counts, score = brute(texts[r.doc_id]), walked(model, plain_statistics(texts[r.doc_id]))
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == failed and r.kept == (not failed and score >= 0.5) and abs(r.score - score) < 1e-9


def plain_lines(text):
    """Features of every line by the text of it and of its neighbours."""
    lines = (text or "").split("\n")
    out, before = [], None
    for line in lines:
        raw, w = line.encode(), [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        size, wide = max(len(line), 1), max(len(w), 1)
        share = lambda kind, raw=raw, size=size: sum(kind(c) for c in raw) / size
        symbol, bang, bar, upper = share(lambda c: c in b"#*$%&|<>@^~=+_\\/{}[]"), share(lambda c: c in b"!?"), share(lambda c: c == 124), share(lambda c: 65 <= c <= 90)
        marked, again = sum(x[-1] in b"#*$%&|<>@^~=+_\\/{}[]!?" for x in w) / wide, 0
        for x in w:
            again, before = again + (x == before), x
        mean = sum(len(x.decode()) for x in w) / wide
        out.append([
            upper, upper > 0.3, share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), symbol, symbol > 0.02, share(lambda c: c in b".,;:?!'\"()-"), share(lambda c: c >= 128), bang, bang > 0.05,
            bar, bar > 0.01, marked, marked > 0.3, sum(65 <= x[0] <= 90 for x in w) / wide, again / wide, again / wide > 0.2, bool(w) and lines.count(line) > 1, min(mean, 20) / 10, mean > 10, mean < 2.5,
            np.log1p(len(w)) / 4, not w, len(w) < 4, np.log1p(len(line)) / 6,
        ])
    none = [0.0] * len(out[0])
    rows = [[*own, *(out[i - 1] if i else none), *(out[i + 1] if i + 1 < len(out) else none), i == 0, i == len(out) - 1, 1] for i, own in enumerate(out)]
    return np.array(rows, float), [max(len(x), 1) for x in lines]


def plain_score(model, text):
    """The weighted mean of the probability "good", by sums over all beginnings and all ends of the chain."""
    x, weight = plain_lines(text)
    e = [[float(np.dot(row, model.weights[:, y])) for y in (0, 1)] for row in x]
    add = lambda a, b: max(a, b) + np.log(1 + np.exp(-abs(a - b)))
    ahead, back = [e[0]], [[0.0, 0.0]]
    for i in range(1, len(e)):
        ahead.append([e[i][y] + add(*(ahead[-1][z] + model.step[z, y] for z in (0, 1))) for y in (0, 1)])
    for i in range(len(e) - 2, -1, -1):
        back.insert(0, [add(*(model.step[y, z] + e[i + 1][z] + back[0][z] for z in (0, 1))) for y in (0, 1)])
    good = [1 / (1 + np.exp((a[0] + b[0]) - (a[1] + b[1]))) for a, b in zip(ahead, back)]
    return sum(g * w for g, w in zip(good, weight)) / sum(weight)


def test_op7_against_plain_python(spark, labelled):
    model = quality_crf.fit(spark.read.parquet(f"{labelled}/documents.parquet"), spark.read.parquet(f"{labelled}/labels.parquet"))
    texts = all_texts(spark, labelled)
    for r in quality_crf.op7_quality_classifier(spark, labelled).collect():
        want = plain_score(model, texts[r.doc_id])
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5), r.doc_id


def test_stages_against_plain_python(spark, labelled):
    docs, labels = spark.read.parquet(f"{labelled}/documents.parquet"), spark.read.parquet(f"{labelled}/labels.parquet")
    texts = all_texts(spark, labelled)
    crf, trees = quality_crf.fit(docs, labels), quality_rules.fit(docs, labels)
    kept = {r.doc_id for r in quality_crf.keep(docs, crf).collect()}
    assert kept == {i for i, x in texts.items() if plain_score(crf, x) >= 0.5}
    kept = {r.doc_id for r in quality_rules.keep(docs, trees).collect()}
    bad = {i for i, c in ((i, brute(x)) for i, x in texts.items()) if c[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert kept == {i for i, x in texts.items() if i not in bad and walked(trees, plain_statistics(x)) >= 0.5}


def test_very_long_texts_and_other_ids(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = ["word other " * 300_000, "a line of words\n" * 200_000, prose(60, 3), None]
    path = write(spark, tmp_path, texts, [(k, k % 2, 0) for k in range(4)])
    assert len(quality_crf.op7_quality_classifier(spark, path).collect()) == len(quality_rules.op1_quality_rules(spark, path).collect()) == 4
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.read.parquet(f"{path}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(r.doc_id for r in quality_crf.score(docs, quality_crf.fit(docs, labels)).collect()) == ["d0", "d1", "d2", "d3"]
    assert sorted(r.doc_id for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()) == ["d0", "d1", "d2", "d3"]


def test_training_rows_are_bounded(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select((F.col("id") % 3).alias("doc_id"), F.lit("some words").alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality_crf.labelled(rows, labels).count() <= 3
    assert quality_crf.labelled(rows, labels, longest=3).count() == 0
