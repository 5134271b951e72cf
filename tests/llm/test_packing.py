import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from pressmark.llm import bpe_tree, packing
from tests.llm.fixtures import ODD_TEXTS, prose, write


def test_differencing_is_near_equal_and_whole():
    r = np.random.default_rng(0)
    for n, k in ((1, 1), (1, 4), (7, 3), (200, 16), (500, 64)):
        sizes = r.integers(1, 512, n)
        out = packing.difference(sizes, k)
        assert len(out) == k and sorted(i for w in out for i in w) == list(range(n))
        if n > 8 * k:
            sums = [sizes[w].sum() for w in out]
            assert max(sums) - min(sums) <= 64


def test_two_way_textbook_case():
    out = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in out) == [14, 16]


def test_count_rises_until_capacity_holds():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(1, 1025, r.integers(1, 60))
        out = packing.deal(sizes)
        assert all(sizes[w].sum() <= 1024 for w in out) and sorted(i for w in out for i in w) == list(range(len(sizes)))


def test_op3(spark, tmp_path):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    texts = [*ODD_TEXTS, *(prose(r.randint(1, 400), k) for k in range(300))]
    rows = packing.op3_packing(spark, write(spark, tmp_path, texts)).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for x in rows:
        docs[x.doc_id].append(x)
        seqs[x.sequence_id].append(x)
    total = 0
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for x in sorted(docs[k], key=lambda x: x.start):
            assert x.start == at and x.length > 0 and x.doc_tokens == len(ids)
            assert x.ids_crc32 == crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 1024
    assert len(seqs) <= total / 1024 * 1.02 + 4  # one unfilled sequence for each of the splits
    assert packing.op3_packing(spark, write(spark, tmp_path / "e", [])).count() == 0
