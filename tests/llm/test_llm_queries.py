import pytest

from orefold.llm import queries
from tests.test_queries import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_llm_query(spark, name):
    compare(spark, name, queries.QUERIES, queries.SQL)


@pytest.mark.parametrize("name", ["p2_found", "p2_ranking"])
def test_large_runs_are_ranked_alike(spark, rows, name):
    """Every run by the whole cluster gives what one task per run gives."""
    one, all_ = (queries.QUERIES[name](spark, str(DATA), most) for most in (1 << 40, 0))
    columns = ["run_id", "target_id", *(["rank_no"] if name == "p2_ranking" else [])]
    assert rows(one.select(*columns)) == rows(all_.select(*columns))
