import pytest
from compare import compare
from conftest import DATA

from lociflow import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, name):
    if name in registry.ORACLES:
        compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], f"{DATA}/sf0.001")
    else:
        assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
