"""The SQL of the training-data queries on the small tables."""

import os

import pytest

from lorekeep.llm import catalogue
from tests.test_catalogue import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_problem_has_its_query():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6)} | {"p7_ids", "p8_packed", "p9_pieces"} <= set(catalogue.queries())
