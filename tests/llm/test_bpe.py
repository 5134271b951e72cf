import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from pressmark.llm import bpe_tree
from tests.llm.fixtures import ODD_TEXTS, prose, write


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 16])
def test_tree_equals_library(library, leaf):
    e = bpe_tree.TreeEncoder(bpe_tree.tokenizer_file(), leaf=leaf)
    r = random.Random(leaf)
    pool = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\t", "é", "ß", "😀", "中", "1", "२", "'", "s", "'ll", "'s", "!", "...", "<|endoftext|>", " ", "\x85", "<|", "A"]
    for k in range(1500):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 40)))
        assert e.encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert e.decode(e.encode(t)) == library.decode(e.encode(t), skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [5, 64, 300])
def test_long_unsplit_text(library, leaf):
    e = bpe_tree.TreeEncoder(bpe_tree.tokenizer_file(), leaf=leaf)
    r = random.Random(leaf)
    for letters in ("a", "ab", "etaoinshrdlu", "!", "=-", " ", "\n ", "0", "éa", "中文", "😀"):
        t = "".join(r.choice(letters) for _ in range(3000))
        for x in (t, "b " + t, t + " c", t + "\n\n" + t):
            assert e.encode(x) == library.encode(x, add_special_tokens=False).ids, (leaf, letters)


def test_half_characters_decode_as_the_library(library):
    e = bpe_tree.TreeEncoder(bpe_tree.tokenizer_file())
    r = random.Random(5)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(6)]
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_op9(spark, library, tmp_path):
    texts = [*ODD_TEXTS, "<|endoftext|> " * 3, prose(9000, 4), "ab" * 40000]
    rows = {r.doc_id: r for r in bpe_tree.op9_bpe_roundtrip(spark, write(spark, tmp_path, texts)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_tree.op9_bpe_roundtrip(spark, write(spark, tmp_path / "e", [])).count() == 0
