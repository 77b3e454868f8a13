import pytest

from emberline.llm import queries
from tests.oracle import check, database

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, database(SF), queries.queries()[name], queries.oracle_sql()[name], SF)


def test_all_operators_and_the_pipeline_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
