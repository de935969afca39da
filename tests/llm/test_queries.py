from __future__ import annotations

import oracle
import pytest

from tickloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = oracle.database(sf_dir).execute(queries.SQL[name]).df()
    assert not oracle.differences(got, want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
