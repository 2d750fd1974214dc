"""Every registered trace query against its SQL."""

from __future__ import annotations

import pytest
from compare import same

from recscope.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Empty at the smallest scale.
MAY_BE_EMPTY = {"filter_any_param", "filter_compound", "search_formatted_text", "filter_function_call", "filter_const_substring", "find_by_expression"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    n = same(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert n or name in MAY_BE_EMPTY
