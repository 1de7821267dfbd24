import duckdb
import pytest

from gridtrace import catalog
from gridtrace.session import ship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(df):
    cols = sorted(df.columns)
    val = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return cols, sorted(str(tuple(val(v) for v in r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    got = canon(catalog.QUERIES[name](ship(spark), SF).toPandas())
    assert got == canon(sql.execute(catalog.SQL[name]).df())


def test_queries_without_sql_run(spark):
    for name in catalog.QUERIES.keys() - catalog.SQL.keys():
        assert catalog.QUERIES[name](ship(spark), SF).count() > 0


def test_plans_push_down_and_prune(spark):
    plan = catalog.table(spark, SF, "lineitem").where("l_quantity > 10").groupBy("l_suppkey").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan and "l_comment" not in plan
    plan = catalog.point_location(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReadSchema: struct<ts:timestamp,value:double>" in plan.replace("timestamp_ntz", "timestamp")


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
