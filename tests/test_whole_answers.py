import pytest

from tests.whole import whole


@pytest.mark.parametrize("name", ["mx91_judged_sentences", "sc56_composed_answers"])
def test_answers_of_all_conversations(spark, name):
    got, want = whole(spark, name, " WHERE conv_id < 60", folder="/root/testdata/sf0.01")
    assert got == want
    assert len({v for r in got for v in r if isinstance(v, int) and v >= 60}) > 0
