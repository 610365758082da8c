import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "lane", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_columns_down(spark):
    plan = entry.queries()["p3_found"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "size_bytes" not in plan and "CartesianProduct" not in plan
