"""Texts of hundreds of thousands of characters beside short and missing ones, through every operator that had none so long in its tests."""

import hashlib
import random
import re

import pytest

from pressmark.llm import queries
from tests.llm.fixtures import write

WORDS = [f"{a}{b}{c}" for a in ("st", "br", "m", "l", "é") for b in ("a", "o", "ie") for c in ("n", "rt", "lly", "m")]


def long_text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    first = long_text(1, 60_000)
    words = first.split(" ")
    for k in range(0, len(words), 4_000):
        words[k] = "changed"
    return [first, " ".join(words), long_text(2, 50_000), None, "short", "x" * 300_000]


def run(spark, tmp_path_factory, texts, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, write(spark, tmp_path_factory.mktemp("long"), texts)).collect()}


def test_scan_and_fingerprints(spark, tmp_path_factory, texts):
    rows = run(spark, tmp_path_factory, texts, "op4_license_scan")
    assert [rows[i].n_words for i in range(6)] == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for t in texts]
    rows = run(spark, tmp_path_factory, texts, "op5_fingerprints")
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()


def test_near_copies_and_simhash(spark, tmp_path_factory, texts):
    assert [run(spark, tmp_path_factory, texts, "op8_order_minhash")[i].class_id for i in range(6)] == [0, 0, 2, 3, 4, 5]
    rows = run(spark, tmp_path_factory, texts, "op12_covering_simhash")
    assert rows[0].component_id == rows[1].component_id == 0 and rows[3].fingerprint == "0" * 16


def test_suffix_dedup(spark, tmp_path_factory, texts):
    rows = run(spark, tmp_path_factory, texts, "op10_suffix_dedup")
    raws = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for raw in raws:
        for i in range(len(raw) - 199):
            w = hash(raw[i : i + 200])  # 64 bits: no chance meeting among some million windows
            (twice if w in seen else seen).add(w)
    for i, raw in enumerate(raws):
        kept, end = bytearray(), 0
        for k in range(len(raw)):
            if k + 200 <= len(raw) and hash(raw[k : k + 200]) in twice:
                end = k + 200
            if k >= end:
                kept.append(raw[k])
        assert rows[i].n_removed == len(raw) - len(kept) and rows[i].kept_sha256 == hashlib.sha256(bytes(kept)).hexdigest()


def test_packing(spark, tmp_path_factory, texts):
    from tokenizers import Tokenizer

    from pressmark.llm import bpe_tree

    library = Tokenizer.from_buffer(bpe_tree.tokenizer_file())
    rows = queries.queries()["op3_packing"](spark, write(spark, tmp_path_factory.mktemp("long"), texts)).collect()
    for i, t in enumerate(texts):
        own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        want = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == want


def test_conversations(spark, tmp_path, texts):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    one = {r.conv_id: r for r in queries.queries()["op6_chat_formatting"](spark, str(tmp_path)).collect()}[1]
    said = [t or "" for t in texts[1::2]]
    assert one.loss_chars == sum(map(len, said)) and one.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
    nodes = queries.queries()["op13_conversation_trie"](spark, str(tmp_path)).collect()
    assert sorted(r.depth for r in nodes) == list(range(len(nodes))) and all(r.n_convs == 1 and r.saved_tokens == 0 for r in nodes)
