import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.fixtures import ODD_TEXTS, prose, write
from tests.llm.test_near import brute as near_classes
from tests.llm.test_near import edited
from tests.llm.test_suffix import W

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers

    r = random.Random(4)
    good = [prose(r.randint(40, 120), k) for k in range(60)]
    bad = [" ".join(w + "###" for w in prose(r.randint(40, 120), 100 + k).split()) for k in range(30)]
    passage = prose(70, 500)
    texts = good + bad + [edited(t, 1, r) for t in good[:10]] + [good[11]] + [prose(60, 600 + k) + " " + passage for k in range(5)] + ODD_TEXTS
    path = write(spark, tmp_path, texts, [(k, int(k < 60), 0) for k in range(90)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows: dict = {}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        rows[k] = docs.collect()
        if k < 4:
            assert docs.columns == COLUMNS
            rows[k] = {x.doc_id: x for x in rows[k]}
    # the classifier and the rules: junk goes, clean documents of 20 words and more stay
    assert not any(60 <= i < 90 for i in rows[0]) and all(i in rows[0] for i in range(60))
    assert set(rows[1]) <= set(rows[0]) and all(i in rows[1] for i in range(60)) and all(len((x.text or "").split()) >= 20 for x in rows[1].values())
    # near duplicates: the least id of every class of what was left
    ids = sorted(rows[1])
    classes = near_classes([rows[1][i].text for i in ids])
    assert sorted(rows[2]) == sorted({ids[c] for c in classes.values()}) and all(rows[2][i] == rows[1][i] for i in rows[2])
    # repeated passages of what was left
    raws = {i: x.text.encode() for i, x in rows[2].items()}
    seen: dict = defaultdict(int)
    for raw in raws.values():
        for a in range(len(raw) - W + 1):
            seen[raw[a : a + W]] += 1
    for i, raw in raws.items():
        hit = np.zeros(len(raw), bool)
        for a in range(len(raw) - W + 1):
            if seen[raw[a : a + W]] > 1:
                hit[a : a + W] = True
        left = bytes(c for c, h in zip(raw, hit) if not h).decode("utf-8", "ignore")
        assert rows[3][i].text == left and rows[3][i].n_chars == len(left)
    assert sorted(rows[3]) == sorted(rows[2]) and any(rows[3][i].text != rows[2][i].text for i in rows[2])
    # packing
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = defaultdict(list)
    for x in rows[4]:
        own[x.doc_id].append(x)
    for i, x in rows[3].items():
        ids, at = np.array([*library.encode(x.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(own[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)


def test_run_is_the_stages(spark, tmp_path):
    path = write(spark, tmp_path, [prose(60, 1), prose(60, 1), None], [(0, 1, 0)])
    assert {x.doc_id for x in P.run(spark, path).collect()} == {0}
    assert P.run(spark, write(spark, tmp_path / "e", [])).count() == 0
