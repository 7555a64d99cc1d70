import pytest

from quadrille.llm import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_corpus_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.compare(spark, oracle.connection(sf), name, registry.QUERIES[name], registry.ORACLE[name], sf) is None
