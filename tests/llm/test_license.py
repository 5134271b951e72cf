import duckdb
import pytest

from pressmark.llm import license_index as L
from tests.llm.fixtures import ODD_TEXTS, write

MORE = [
    "Licensed under CC BY-NC 4.0.", "cc by nc", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT license mit License",
    "Licensed under the GNU Lesser General Public License, version 3.", "free software foundation redistribute modify", "licenſe mit ſ", "mIt\x00license", "mitlicense mit-license", "MİT license",
    "This work is licensed under the GNU General Public License, version 3. Redistribution and use in source and binary forms are permitted",
    "the apache apache license apache license license", "worK Kind", "license " * 3000,
]


def oracle(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con.execute(L.SQL["op4_license_scan"]).fetchall()


@pytest.mark.parametrize("texts", [ODD_TEXTS + MORE, MORE[:1] * 30, [None]])
def test_op4_against_sql(spark, tmp_path, texts):
    path = write(spark, tmp_path, texts)
    got = sorted(tuple(r) for r in L.op4_license_scan(spark, path).collect())
    want = sorted(oracle(path))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(a[7] - b[7]) < 1e-6 for a, b in zip(got, want))


def test_labels(spark, tmp_path):
    path = write(spark, tmp_path, ["Licensed under CC BY-NC 4.0.", "Released under the MIT License. And the Apache license", "General Public License", "nothing here"])
    rows = {r.doc_id: r for r in L.op4_license_scan(spark, path).collect()}
    assert (rows[0].labels, rows[0].base_labels, rows[0].n_base, rows[0].first_word) == ("cc-by-nc", "", 0, None)
    assert (rows[1].labels, rows[1].base_labels, rows[1].n_base, rows[1].first_word, rows[1].last_word) == ("apache,mit", "apache,mit", 2, 3, 7)
    assert (rows[2].labels, rows[2].score) == ("gpl", 0.5) and (rows[3].labels, rows[3].score) == ("", 0.0)
    assert L.op4_license_scan(spark, write(spark, tmp_path / "e", [])).count() == 0
