import pytest
from oracle import assert_same

from lodestrand.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_no_python_in_plans(spark):
    for name in ("tfidf_topk", "embedding_topk", "chunk_windows", "citation_renumber", "record_parse_flows"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["embedding_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in plan
    plan = catalogue.QUERIES["unlinked_docs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
