import io
import json
import threading

import duckdb
import pytest

from brookql import assist, catalog_queries, printer
from brookql.__main__ import main, prompt
from brookql.plans.flow_text import from_sql, order_rank, query
from brookql.plans.lexer import QueryError
from brookql.plans.parser import Parser
from brookql.service import QueryService
from brookql.session import Session
from brookql.sources.connectors import DuckDb, Folder, Rows, load_profile
from brookql.streaming import subscribe as streams

SF = "/root/testdata/sf0.001"


def _queries():
    for name, (text, _) in catalog_queries.PAIRS.items():
        if not text.startswith("sql:") and "flow " not in text:
            for s in Parser(text.replace("{t}", "t_")).statements():
                if s.kind == "query" and s.parts["query"].source is None or s.kind == "query" and s.parts["query"].source.kind not in ("tool", "run_flow"):
                    yield name, s.parts["query"]


def test_print_and_parse_again():
    n = 0
    for name, q in _queries():
        text = query(q)
        assert query(Parser(text).query()) == text, name
        n += 1
    assert n > 120


@pytest.mark.parametrize("name", ["q3_shipping", "a4_group_select", "j2_left", "b9_exists", "n2_frames", "e6_case", "a13_pivot_agg", "e13_lambdas", "b5_tuple_in", "e1_arithmetic", "a10_filter"])
def test_printed_text_means_the_same(spark, name):
    text = catalog_queries.PAIRS[name][0]
    q = Parser(text).query()
    rows = [sorted(map(str, catalog_queries.session(spark, SF).run(t).collect())) for t in (text, query(q))]
    assert rows[0] == rows[1]


SQL = [
    "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 5",
    "SELECT n_regionkey AS k, count(*) AS n FROM nation n GROUP BY n_regionkey HAVING count(*) > 1 ORDER BY k DESC LIMIT 3",
    "SELECT n.n_name, r.r_name reg FROM nation n JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE 'A%'",
    "SELECT * FROM region",
    "SELECT DISTINCT n_regionkey FROM (SELECT n_regionkey FROM nation WHERE n_nationkey < 9) t",
    "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') UNION ALL SELECT r_name FROM region",
    "WITH a AS (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 12) SELECT n_regionkey, max(n_name) AS m FROM a GROUP BY n_regionkey",
    "SELECT r_name, CASE WHEN r_regionkey > 2 THEN 'hi' ELSE 'lo' END AS c FROM region",
]


@pytest.mark.parametrize("sql", SQL)
def test_sql_to_flow(spark, sql):
    s = catalog_queries.session(spark, SF)
    assert sorted(map(str, map(tuple, s.run(from_sql(sql)).collect()))) == sorted(map(str, map(tuple, s.sql(sql).collect())))


def test_order_rank():
    assert order_rank("from t where a select b") == 1 and order_rank("select b from t where a") < 1


def test_printer(spark):
    df = spark.createDataFrame([(1, "a", None, [1, 2], True), (22, "long text", 2.5, [], False)], "i int, s string, d double, xs array<int>, b boolean")
    assert printer.box(df.select("i", "s")) == "\n".join([
        "┌─────┬───────────┐", "│  i  │     s     │", "│ int │  string   │", "├─────┼───────────┤", "│   1 │ a         │", "│  22 │ long text │", "├─────┴───────────┤", "│ 2 rows          │", "└─────────────────┘",
    ])
    assert printer.show(df, "tsv").splitlines()[1] == "1\ta\t\t[1, 2]\ttrue"
    assert json.loads(printer.show(df, "jsonl").splitlines()[0]) == {"i": 1, "s": "a", "d": None, "xs": [1, 2], "b": True}
    assert len(json.loads(printer.show(df, "json"))) == 2 and printer.box(df, 1).endswith("┘") and "1+ rows" in printer.box(df, 1)
    assert "0 rows" in printer.box(df.limit(0))


def test_connectors_and_profiles(spark, tmp_path, monkeypatch):
    con = duckdb.connect(str(tmp_path / "x.db"))
    con.sql("create table fruit as select range as id, 'f' || range as name, range * 0.5 as price from range(100)")
    con.close()
    s = Session(spark)
    s.connectors["duck"], s.connectors["files"] = DuckDb(str(tmp_path / "x.db"), 3), Folder(SF)
    s.connectors["chat"] = Rows({"channels": ("id int, name string", lambda k, n: iter([(k, f"c{k}")]))}, parts=4)
    assert s.run("from duck.fruit where id < 10 agg n = _.count, p = price.sum").first() == (10, 22.5)
    assert s.run("from duck.fruit as f join files.nation as n on f.id = n.n_nationkey count").first()[0] == 25  # no staging
    assert s.run("from chat.channels order by id select name").collect() == [(f"c{k}",) for k in range(4)]
    s.run("use connector files")
    assert s.run("from region count").first()[0] == 5
    with pytest.raises(QueryError):
        s.run("use connector nowhere")
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"profiles": [{"name": "a", "connectors": [{"name": "tables", "type": "files", "path": "${BROOK_TEST_DIR}"}], "settings": {"spark.sql.session.timeZone": "UTC"}}]}))
    with pytest.raises(QueryError, match="BROOK_TEST_DIR"):
        load_profile(s, str(path))
    monkeypatch.setenv("BROOK_TEST_DIR", SF)
    assert load_profile(s, str(path)) == "a" and s.run("from tables.region count").first()[0] == 5
    with pytest.raises(QueryError):
        load_profile(s, str(path), "b")


def test_tools(spark):
    s = Session(spark)
    s.tools["chat.post"] = lambda channel, text: {"sent": f"{channel}: {text}"}
    s.tools["chat.fail"] = lambda: 1 / 0
    assert s.run("call chat.post(channel: 'x', text: 'hi')").first() == ("chat", "post", "ok", '{"sent": "x: hi"}')
    assert s.run("call chat.fail() select status").first()[0] == "error"
    with pytest.raises(QueryError):
        s.run("call chat.nothing()")


def test_assist(spark):
    s = catalog_queries.session(spark, SF)
    s.run("--- big ones ---\nmodel big(k: int) = { from nation where n_nationkey > k }\nflow f = { stage a = from nation }")
    text = "from nation where n_re"
    assert assist.complete(s, text, len(text)) == ["n_regionkey"]
    assert "nation" in assist.complete(s, "from na", 7) and "n_name" not in assist.complete(s, "from na", 7)
    assert "sum" in assist.complete(s, "from nation agg n_nationkey.su", 30) and "substring" in assist.complete(s, "from nation agg n_nationkey.su", 30)
    assert assist.hover(s, text, 20) is None and assist.hover(s, "from nation where n_name", 21) == "n_name: string"
    assert assist.hover(s, "from big(3)", 6) == "model big(k): big ones" and assist.hover(s, "run flow f", 9) == "flow f: a"
    whole = "model m = { from nation }\nfrom m"
    assert assist.definition(whole, len(whole)) == 6


def test_catalog_as_text(spark):
    spark.sql("create table cat_a (k int, v string, d decimal(5,2), xs array<int>)")
    try:
        text = assist.export_catalog(spark)
        assert "type cat_a in default = { `k`: int; `v`: string; `d`: decimal(5,2); `xs`: array(int) }" in text and "def upper(x: any) = native" in text
    finally:
        spark.sql("drop table cat_a")
    s = Session(spark)
    assert "cat_a" in assist.use_catalog(s, text)
    assert s.run("from cat_a where k > 1 select v.upper, d").dtypes[1] == ("d", "decimal(5,2)")
    with pytest.raises(Exception, match="nothing"):
        s.run("from cat_a select nothing")


def test_service(spark):
    service = QueryService(catalog_queries.session(spark, SF), most_rows=15)
    good, bad, sql = service.submit("from nation order by n_nationkey select n_name"), service.submit("from nowhere_at_all"), service.submit("select count(*) as n from region", sql=True)
    for _ in range(300):
        if all(service.info(x)["state"] in ("FINISHED", "FAILED") for x in (good, bad, sql)):
            break
        threading.Event().wait(0.1)
    first = service.info(good, 0, 10)
    assert first["state"] == "FINISHED" and first["total"] == 25 and len(first["rows"]) == 10 and first["next"] == 1
    assert len(service.info(good, 1, 10)["rows"]) == 5 and service.info(good, 1, 10)["next"] is None
    assert service.info(bad)["state"] == "FAILED" and service.info(bad)["error"] and service.info(sql)["rows"] == [{"n": 5}]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.flow").write_text("flow good(k: int = 1) with { schedule: cron('0 2 * * *') } = { stage a = from [[1], [2]] as t(x) | where x <= k }\nflow bad = { stage a = from no_such_table_q }\nfrom no_such_table_q")

    def say(*argv):
        out = io.StringIO()
        return main([*argv, "-w", str(tmp_path)], out), out.getvalue()

    assert say("run", "-c", "select a = 1, b = 'x'", "--format", "json") == (0, '[{"a": 1, "b": "x"}]\n')
    assert say("run", "-c", "select 2 as n", "--sql", "--format", "tsv") == (0, "n\n2\n")
    assert "Physical Plan" in say("explain", "select a = 1")[1] and say("to-flow", "select a from t")[1] == "from t\nselect a\n"
    assert say("flow", "list")[1] == "good\t1 stages\t0 2 * * *\nbad\t1 stages\t\n"
    assert say("flow", "show", "good")[1].splitlines()[0] == "flow good"
    assert say("flow", "run", "good(k = 2)")[0] == 0 and say("flow", "run", "bad")[0] == 1
    assert say("flow", "backfill", "good", "--from", "2024-01-01", "--to", "2024-01-03")[1] == "2 windows\n"
    lines = say("flow", "session", "list")[1].splitlines()
    assert len(lines) == 4 and sum("\tfailed\t" in x for x in lines) == 1
    run_id = next(x for x in lines if "\tbad\t" in x).split("\t")[0]
    assert "failed" in say("flow", "session", "show", run_id)[1] and say("flow", "session", "resume", run_id)[0] == 1
    assert "runs" in say("flow", "scheduler", "--once")[1] and "removed" in say("flow", "session", "clean")[1]
    with pytest.raises(SystemExit):
        say("nothing")


def test_prompt(spark):
    lines, out = iter(["select a = 1", ";", "from nowhere_at_all;", "help", "rows 1", "from [[1], [2]] as t(x);", "quit"]), io.StringIO()
    prompt(Session(spark), lambda _: next(lines), out)
    text = out.getvalue()
    assert "1 rows" in text and "Exception" in text and "1+ rows" in text


def test_markdown_and_files(spark, tmp_path):
    (tmp_path / "doc.md").write_text("# Title\n```flow\nval k = 3\n```\ntext\n```sql\nselect 5 as n\n```\n```python\nnot this\n```\n```flow\nselect x = k + 1\n```\n")
    (tmp_path / "h.hive.sql").write_text(r"select 'a\tb' as x")
    s = Session(spark)
    assert s.run_file(str(tmp_path / "doc.md")).collect() == [(4,)]
    assert s.run_file(str(tmp_path / "h.hive.sql")).first()[0] == "a\tb"


# --- streams ----------------------------------------------------------------------------------------------------------
def test_streams(spark, tmp_path):
    import pyspark.sql.functions as F

    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"2024-01-01 0{i // 10}:{i % 10}0:00" if i % 10 < 6 else "2024-01-01 05:00:00") for i in range(30)]
    spark.createDataFrame(rows, "i int, at string").select("i", F.to_timestamp("at").alias("ts")).write.parquet(src)
    s = Session(spark)
    s.register("flow_in", spark.readStream.schema("i int, ts timestamp").parquet(src))
    s.register("batch_in", spark.read.parquet(src))
    s.run(f"from flow_in where i % 2 = 0 select i, ts save to '{target}' with checkpoint: '{tmp_path}/c1'")
    assert sorted(r.i for r in spark.read.parquet(target).collect()) == list(range(0, 30, 2))
    spark.createDataFrame([(100,)], "i int").selectExpr("i", "timestamp '2024-01-02 00:00:00' as ts").write.mode("append").parquet(src)
    s.run(f"from flow_in where i % 2 = 0 select i, ts save to '{target}' with checkpoint: '{tmp_path}/c1'")
    assert spark.read.parquet(target).count() == 16  # only what is new
    with pytest.raises(QueryError, match="checkpoint"):
        s.run(f"from flow_in save to '{target}x'")
    wins = streams.subscribe(spark.readStream.schema("i int, ts timestamp").parquet(src), "ts", "1h")
    q = wins.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    live = {(r.window.start, r.n) for r in spark.table("wins").collect()}
    still = {(r.window.start, r.n) for r in streams.subscribe(spark.read.parquet(src), "ts", "1 hour").collect()}
    assert live == still and len(live) > 3
    sliding = streams.subscribe(spark.read.parquet(src), "ts", "2h", slide="1h").agg(F.sum("n")).first()[0]
    assert sliding == 62
    sessions = streams.subscribe(spark.read.parquet(src), "ts", gap="15m")
    assert sessions.agg(F.sum("n")).first()[0] == 31 and sessions.count() == 3


def test_incremental(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    load = lambda: streams.incremental(spark, src, "inc_target", f"{tmp_path}/c", lambda d: d.where("id % 2 = 0"))
    assert load() == 5 and load() == 5
    spark.range(10, 20).write.mode("append").parquet(src)
    assert load() == 10
    with pytest.raises(QueryError):
        streams.incremental(spark, src, "inc_other", f"{tmp_path}/d", lambda d: d.groupBy("id").count())
    spark.sql("drop table inc_target")
