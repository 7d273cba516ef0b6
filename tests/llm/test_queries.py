"""The registered queries that have SQL, over whole tables."""

import pytest
from helpers import duck, spark_rows

from kithgraph.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DIR)) == duck(queries.ORACLE_SQL[name], DIR)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
