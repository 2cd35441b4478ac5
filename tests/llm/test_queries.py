"""Queries of the training-data operators against SQL on the small tables."""

import pytest

from cairnlake.llm import queries

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    # the twelve labels of the smallest tables teach nothing, so abuse is looked for in the next larger ones
    assert queries.QUERIES[name](spark, SMALL.replace("sf0.001", "sf0.01") if name == "p10_found" else SMALL).count() > 0
