"""Notices of long texts and of texts with several notices, against a recount in plain Python."""

import math
import re

from pressmark.llm import license_index as L
from tests.llm.fixtures import ODD_TEXTS, write

OTHER = "The binary of this foundation is in the public domain, obtaining it needs the following conditions. "
NOTICES = {
    "cc-by-nc": "Licensed under CC BY-NC 4.0. ", "mpl": "Subject to the terms of the Mozilla Public License, v. 2.0. ", "agpl": "Licensed under the GNU Affero General Public License version 3. ",
    "unlicense": "This is free and unencumbered software released into the public domain. ", "lgpl": "Licensed under the GNU Lesser General Public License, version 3. ",
}
TEXTS = [
    NOTICES["cc-by-nc"] + OTHER, OTHER + NOTICES["lgpl"], NOTICES["cc-by-nc"] + NOTICES["mpl"] + NOTICES["agpl"] + NOTICES["unlicense"],
    ("plain words here " * 700 + OTHER).join(["", *NOTICES.values()]), OTHER, "",
    *[words for _, words, _ in L.TEMPLATES], " and ".join(words for _, words, _ in L.TEMPLATES), *ODD_TEXTS,
]


def recount(texts):
    """labels and score of every text: every template at every place, by its own words."""
    lower = {ord(a): b for a, b in zip(L._UPPER, L._LOWER)}
    files = [re.findall(L.WORD, (t or "").translate(lower)) for t in texts]
    idf = {w: round(math.log((len(files) + 1) / (sum(w in f for f in files) + 1)) + 1, 6) for w in L.vocabulary()}
    out = []
    for f in files:
        base = {label for p, label in L.BASE.items() if any(f[i : i + len(p.split())] == p.split() for i in range(len(f)))}
        found = {}
        for t in range(len(L.TEMPLATES)):
            rows = [(label, w, q, must) for x, label, w, q, must in L.index() if x == t]
            whole = sum(idf[w] for _, w, _, _ in rows)
            for at in range(-len(L.TEMPLATES[t][1].split()), len(f)):
                here = [0 <= at + q < len(f) and f[at + q] == w for _, w, q, _ in rows]
                share = round(sum(idf[w] for (_, w, _, _), h in zip(rows, here) if h) / whole, 6)
                if share >= L.LEAST and all(h for (_, _, _, must), h in zip(rows, here) if must):
                    found[rows[0][0]] = max(share, found.get(rows[0][0], 0.0))
        out.append((",".join(sorted(base | set(found))), max(found.values()) if found else 0.5 if base else 0.0))
    return out


def test_notices_beside_other_licence_words(spark, tmp_path):
    texts = TEXTS
    got = {r.doc_id: r for r in L.op4_license_scan(spark, write(spark, tmp_path, texts)).collect()}
    want = recount(texts)
    assert (got[0].labels, got[1].labels, got[2].labels) == ("cc-by-nc", "gpl,lgpl", "agpl,cc-by-nc,gpl,mpl,unlicense")
    assert got[3].labels == "agpl,cc-by-nc,gpl,lgpl,mpl,unlicense"
    for i, (labels, score) in enumerate(want):
        assert got[i].labels == labels and abs(got[i].score - score) < 2e-6, i
