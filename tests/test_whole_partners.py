from tests.whole import whole


def test_partners_of_all_pages(spark):
    got, want = whole(spark, "jn13_partner_page", " WHERE o_orderkey % 3 = 0")
    assert got == want
    assert any(int(v.lstrip("o")) % 3 for r in got for v in r if isinstance(v, str) and v.startswith("o"))
