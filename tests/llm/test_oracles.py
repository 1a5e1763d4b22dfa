import pytest

from lodestone.llm import registry
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.01", registry.queries()[name], registry.oracle_sql()[name])[:3] == []


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in registry.queries() if name != "pipeline"]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in registry.queries()
