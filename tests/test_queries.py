import pytest

from palimpsest.jobs import catalogue
from tests.oracle import SMALL, check

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_has_the_rows_of_its_sql(spark, name):
    check(spark, catalogue.queries()[name], SQL[name])


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:3] == ["query_id", "rank", "id"] and df.count() > 0


def test_scans_read_only_what_they_need(spark):
    df = catalogue.queries()["indexed_path_state"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
