import pytest
from compare import compare
from conftest import DATA

from lociflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], f"{DATA}/sf0.01")
