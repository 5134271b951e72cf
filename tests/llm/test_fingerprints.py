import hashlib
import random

import numpy as np

from pressmark.llm import prefix_hash as P
from tests.llm.fixtures import ODD_TEXTS, docs, prose, write


def direct(text):
    return P.of_text(P.PrefixHash(P.code_points(text)))[0]


def test_spans_and_extensions_match_strings():
    r = random.Random(0)
    a, b = ("".join(r.choice("ab") for _ in range(60)) for _ in range(2))
    x, y = P.PrefixHash(P.code_points(a)), P.PrefixHash(P.code_points(b))
    for _ in range(500):
        i, j, k = r.randrange(60), r.randrange(60), r.randrange(20)
        k = min(k, 60 - i, 60 - j)
        assert x.equal(i, y, j, k) == (a[i : i + k] == b[j : j + k])
        n = 0
        while i + n < 60 and j + n < 60 and a[i + n] == b[j + n]:
            n += 1
        assert x.common_extension(i, y, j) == n
    assert (x.spans(np.arange(55), 5).tolist()) == [x.span(i, 5) for i in range(55)]


def brute(rows):
    """(doc_id, text) in order, to the contract's columns."""
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), direct(t), direct(e), P.likeness(direct(t), direct(e)), P.likeness(direct(t), direct(nxt))))
    return out


def check(found, rows):
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(rows).items()}


def test_op5(spark, tmp_path):
    texts = [*ODD_TEXTS, *(prose(k % 90, k) for k in range(120))]
    check(P.op5_fingerprints(spark, write(spark, tmp_path, texts)).collect(), list(enumerate(texts)))
    for parts in (1, 3, 40):
        check(P.fingerprints(docs(spark, texts), parts).collect(), list(enumerate(texts)))


def test_ties_single_and_empty(spark):
    rows = sorted([(5, "b" * 9), (5, "a" * 30), (5, "a" * 30), (9, prose(50, 1)), (2, None)], key=lambda x: (x[0], x[1] or ""))
    check(P.fingerprints(docs(spark, [t for _, t in rows], [i for i, _ in rows]), 4).collect(), rows)
    check(P.fingerprints(docs(spark, ["only one text, longer than a span of it"]), 4).collect(), [(0, "only one text, longer than a span of it")])
    assert P.fingerprints(docs(spark, []), 4).count() == 0


def test_likeness_tells_near_from_far():
    t, u = prose(400, 1), prose(400, 2)
    assert P.likeness(direct(t), direct(t)) == 1 and P.likeness(direct(t), direct(t[:-100] + u[:100])) > 0.6 and P.likeness(direct(t), direct(u)) < 0.15
    assert P.likeness(direct(""), direct("")) == 1 and P.likeness(direct(""), direct("x")) == 0
