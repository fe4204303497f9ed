"""The registered XPath queries against their SQL, on the smallest tables."""

import decimal

import duckdb
import pytest
from arborel import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in (*queries.TABLES, "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6)
    return str(x)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name,pushed,read", [("xp_path_predicate", "GreaterThan(l_quantity,45.0)", "l_quantity:double,l_extendedprice:double"), ("xp_path_equal", "EqualTo(o_orderstatus,F)", "o_orderstatus:string,o_totalprice:double")])
def test_predicates_reach_the_scan(spark, name, pushed, read):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan and f"struct<{read}>" in plan


@pytest.mark.parametrize("name,table", [("xp_date_string", "orders"), ("xp_durations", "lineitem"), ("xp_format_date", "orders")])
def test_dates_over_whole_tables(spark, name, table):
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_strings_over_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.queries()["xp_strings"](spark, SF).collect():
        t = texts[r["k"]]
        assert (r["u"], r["a"]) == (t.lower(), t.partition(" ")[2])
        assert r["t"] == t.translate(str.maketrans("aei", "AEI", "ou"))
