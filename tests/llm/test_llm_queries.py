import pytest

from caselens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("p4", "p7"))))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).count()


def test_every_text_comes_back(spark, sf):
    assert QUERIES["p8_round_trip"](spark, sf).count() == 0
