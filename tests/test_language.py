import duckdb
import pytest

from brookql import catalog_queries as cq
from brookql.plans.lexer import QueryError
from brookql.plans.parser import Parser
from brookql.session import Session, TestFailure

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in cq.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(cq.PAIRS))
def test_against_sql(spark, oracle, name):
    df = cq.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in cq.ORACLE_SQL:
        assert got
        return
    want = oracle.sql(cq.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert sorted(tuple(str(r[c]) for c in cols) for r in got) == sorted(tuple(map(str, r)) for r in want.project(quoted).fetchall())


def test_precedence(spark):
    assert Session(spark).run("select x = 2*3+4, y = 10-2-3").first() == (10, 5)
    assert Parser("a or b and c").expr()[0] == "or"


def test_limit_then_where(spark):
    assert Session(spark).run("from [[1],[2],[3]] as t(a) order by a limit 2 where a > 1").collect() == [(2,)]


@pytest.mark.parametrize("text", ["select count(*) from t", "select count(*)\nfrom t", "from t limit 1 from u limit 1", "from t selectt a", "from t where", "from t group a"])
def test_texts_that_are_refused(spark, text):
    s = Session(spark)
    s.register("t", spark.range(3).toDF("a"))
    s.register("u", spark.range(3).toDF("a"))
    with pytest.raises(Exception) as e:
        s.run(text)
    assert "Error" in type(e.value).__name__ or "Exception" in type(e.value).__name__


def test_select_before_from_says_what_to_do(spark):
    with pytest.raises(QueryError, match="SQL"):
        Session(spark).run("select count(*) from t")


@pytest.mark.parametrize("text", [
    "def f(x) = f(x)\nselect f(1)",
    "def f(x) = g(x)\ndef g(x) = f(x)\nselect f(1)",
    "model m = { from m }\nfrom m",
    "model a = { from b }\nmodel b = { from a }\nfrom a",
    "def p(x) = | p(x)\nfrom t | p(1)",
    "def f(x) = x\nselect f(1, 2)",
    "def f(x) = x\nselect f(y = 2)",
    "from t | nothing(1)",
    "from t delete limit 1",
])
def test_definitions_that_are_refused(spark, text):
    s = Session(spark)
    s.register("t", spark.range(3).toDF("a"))
    with pytest.raises(QueryError):
        s.run(text)


def test_failing_tests_and_too_many_rows(spark):
    s = Session(spark, most_rows=5)
    s.register("t", spark.range(10).toDF("a"))
    with pytest.raises(TestFailure):
        s.run("from t test _.size should be 9")
    with pytest.raises(QueryError, match="most_rows"):
        s.run("from t test _.rows should be []")
    s.run("from t limit 2 test _.rows should be [[0], [1]]")


def test_subqueries_leave_no_views(spark):
    s = Session(spark)
    s.register("t", spark.range(10).toDF("a"))
    assert s.run("from t where a in (from t where a > 7 select a) and exists { from t where a = 1 } count").first()[0] == 2
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("_brook_")]


def test_asof_ranges_agree_with_one_window(spark):
    from brookql.operators import relational as ops

    left = spark.range(400).selectExpr("id as i", "id % 3 as k", "if(id % 17 = 0, null, id * 7 % 401) as t")
    right = spark.range(150).selectExpr("id as j", "if(id % 11 = 0, null, id % 4) as k2", "id * 13 % 409 as u")
    for op in ("<=", "<", ">=", ">"):
        for equal in ([("k", "k2")], []):
            for how in ("left", "inner"):
                found = [sorted(map(tuple, ops.asof_join(left, right, equal, ("t", op, "u"), how, split=x).collect()), key=str) for x in (True, False)]
                assert found[0] == found[1]


def test_pivot_names_that_clash_are_an_error(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([("a", "b_c"), ("a_b", "c")], "x string, y string"))
    with pytest.raises(ValueError, match="one name"):
        s.run("from t pivot on x, y")


def test_hive_strings_and_errors(spark):
    s = Session(spark)
    assert s.sql(r"select 'a\tb' as x", hive=True).first()[0] == "a\tb"
    assert s.sql(r"select 'a\tb' as x, 'it''s' as y").first() == (r"a\tb", "it's")
    with pytest.raises(QueryError):
        s.sql("execute nothing")
    with pytest.raises(QueryError):
        s.sql("select (1")


def test_merge_with_two_source_rows_for_one_is_an_error(spark):
    s = Session(spark)
    s.sql("create table merge_twice as select 1 as k, 'a' as v")
    with pytest.raises(QueryError, match="several"):
        s.sql("merge into merge_twice t using (values (1, 'x'), (1, 'y') as s(k, v)) s on t.k = s.k when matched then update set v = s.v")
    assert s.sql("select * from merge_twice").collect() == [(1, "a")]
    s.sql("drop table merge_twice")


def test_delete_keeps_rows_of_unknown_truth(spark):
    s = Session(spark)
    s.sql("create table del_nulls as select * from values (1), (null), (3) as t(a)")
    assert sorted(s.run("from del_nulls where a > 2 | delete").collect(), key=str) == [(1,), (None,)]
    with pytest.raises(QueryError):
        s.run("from [[1]] as t(a) delete")
    s.sql("drop table del_nulls")
