import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from brookql.flow.cron import Cron
from brookql.flow.model import plan_text, seconds
from brookql.flow.run import Clock, FlowRunner, retry_delay
from brookql.flow.schedule import Scheduler
from brookql.flow.store import FileStore, RunStore, SqliteStore
from brookql.plans.lexer import QueryError
from brookql.session import Session

UTC = dt.timezone.utc


class FakeClock(Clock):
    """Time passes when somebody waits for nothing else; attempts end at once."""

    def __init__(self):
        self.t, self.slept = 1_700_000_000.0, []

    def now(self):
        return self.t

    def wait(self, futures, timeout):
        if futures:
            return super().wait(futures, 5)
        self.t += timeout
        return set()

    def sleep(self, s, stop):
        self.slept.append(s)
        self.t += s


def states(result):
    return {s.stage.name: s.state for s in result.stages}


def runner(spark, text, **how):
    s = Session(spark)
    s.run(text)
    return FlowRunner(s, clock=FakeClock(), **how)


def test_delays():
    assert [retry_delay(n, 2) for n in (1, 2, 3)] == [2, 4, 8]
    assert [retry_delay(n, 2, "linear") for n in (1, 2, 3)] == [2, 4, 6]
    assert [retry_delay(n, 2, "constant") for n in (1, 9)] == [2, 2]
    assert retry_delay(5, 2, most=7) == 7
    assert retry_delay(90, 1) == 2**30
    assert (seconds("5m"), seconds("10 ms"), seconds("7 days")) == (300, 0.01, 604800)


def test_triggers_and_skips(spark):
    r = runner(spark, """flow f = {
      stage bad with { retries: 2, retry_delay: 10s } = from no_such_table_x
      stage after = from bad
      stage later = from after
      stage onskip if after.failed = from [[1]] as t(a)
      stage fix if bad.failed = from [[1]] as t(a)
      stage all_ if after.done and fix.done = from [[2]] as t(a) }""")
    out = r.run("f")
    assert states(out) == {"bad": "failed", "after": "skipped", "later": "skipped", "onskip": "skipped", "fix": "success", "all_": "success"}
    assert out.stages[0].attempts == 3 and r.clock.t - 1_700_000_000 >= 30


def test_failure_of_a_run_and_hooks(spark, tmp_path):
    seen = []
    r = runner(spark, "flow f with { on_failure: activate('note', x: 'y'), on_success: activate('never') } = { stage a = from no_such_table_x }")
    r.session.sinks["note"] = lambda df, **p: seen.append((df.columns, [tuple(x)[2:4] for x in df.collect()], p))
    out = r.run("f")
    assert out.state == "failed" and seen == [(["flow", "run_id", "stage", "state", "attempts", "error"], [("a", "failed")], {"x": "y"})]
    r.session.sinks["note"] = lambda df, **p: 1 / 0
    assert r.run("f").state == "failed"


def test_sink_errors_fail_attempts(spark):
    r = runner(spark, "flow f = { stage a with { retries: 1 } = from [[1]] as t(x) | activate('bad') }")
    calls = []

    def bad(df, **p):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("down")

    r.session.sinks["bad"] = bad
    out = r.run("f")
    assert states(out) == {"a": "success"} and out.stages[0].attempts == 2


def test_sensor_polls_and_passes_all_rows(spark):
    s = Session(spark)
    count = []

    def source():
        count.append(1)
        return spark.createDataFrame([(1, "no"), (2, "ready" if len(count) > 2 else "no")], "i int, status string")

    s.run("flow f = { stage gate with { poll_interval: 7s } = from src | wait until _.status = 'ready' | select i }")
    r = FlowRunner(s, clock=FakeClock())
    s.relations = type("Fresh", (dict,), {})(src=source)
    s.frame = lambda n: source()
    out = r.run("f")
    assert out.state == "success" and r.clock.slept == [7, 7]
    assert spark.table(out.stages[0].table).count() == 2


def test_timeout_cancels_and_retries(spark):
    s = Session(spark)
    s.run("flow f = { stage a with { timeout: 200ms, retries: 1, retry_delay: 1ms } = from [[1]] as t(x) | wait('30 s') }")
    out = FlowRunner(s).run("f")
    assert states(out) == {"a": "failed"} and out.stages[0].attempts == 2 and out.stages[0].error == "timeout"


def test_cancel_and_resume(spark):
    s = Session(spark, store=RunStore())
    s.run("flow f(k: int) = { stage a = from [[1], [2], [3]] as t(x) | where x <= k\n stage b = from a | wait('60 s') | select x, d = run_date }")
    r = FlowRunner(s)
    done = []
    t = threading.Thread(target=lambda: done.append(r.run("f", [(None, _num("2"))], run_time=dt.datetime(2024, 3, 1, tzinfo=UTC))))
    t.start()
    for _ in range(300):
        runs = s.store.runs("f")
        if runs and any(x["state"] == "success" for x in runs[0]["stages"]):
            break
        threading.Event().wait(0.1)
    assert s.store.cancel(s.store.runs("f")[0]["run_id"])
    t.join(30)
    assert done[0].state == "cancelled" and states(done[0]) == {"a": "success", "b": "cancelled"}
    again = FlowRunner(s, clock=FakeClock()).resume(done[0].run_id)
    assert again.state == "success" and again.stages[0].attempts == 1
    assert sorted(spark.table(again.stages[1].table).collect()) == [(1, "2024-03-01"), (2, "2024-03-01")]


def _num(text):
    from brookql.plans.nodes import Expr

    return Expr("num", (text,))


@pytest.mark.parametrize("text", [
    "flow f = { stage a if b.failed = from [[1]] as t(x) }",
    "flow f = { stage a = merge b, c }",
    "flow f = { stage b = from [[1]] as t(x)\n stage a = merge b, b on b.x = b.x }",
    "flow f = { stage a = from [[1]] as t(x) | route { case _.x > 1 -> nowhere } }",
    "flow f = { stage a = from b\n stage b = from a }",
    "flow f = { stage a = from [[1]] as t(x)\n stage a = from [[1]] as t(x) }",
    "flow f with { schedule: cron('61 * * * *') } = { stage a = from [[1]] as t(x) }",
    "flow f = { stage a if b.started = from [[1]] as t(x) }",
])
def test_flows_that_are_refused(spark, text):
    with pytest.raises(QueryError):
        Session(spark).run(text)


def test_arguments(spark):
    s = Session(spark)
    s.run("flow f(a: string, b: int = 3) = { stage x = from [[1]] as t(v) | select v, p = a, q = b }")
    for call in ("f()", "f('x', c = 1)", "f(1)", "f('x', 'y')", "f('x', 1, 2)", "g()"):
        with pytest.raises(QueryError):
            s.run(f"run flow {call}")
    out = FlowRunner(s).run("f", [("a", __import__("brookql.plans.nodes", fromlist=["Expr"]).Expr("str", ("z",)))])
    assert spark.table(out.stages[0].table).collect() == [(1, "z", 3)]


def test_dependencies_between_flows(spark):
    r = runner(spark, "flow up = { stage a = from [[1]] as t(x) }\nflow down depends on up = { stage b = from [[1]] as t(x) }\nflow mend if up.failed = { stage c = from [[1]] as t(x) }\nflow after if up.done = { stage d = from [[1]] as t(x) }")
    assert r.run("down").state == "skipped" and r.run("after").state == "skipped"
    r.run("up")
    assert r.run("down").state == "success" and r.run("mend").state == "skipped" and r.run("after").state == "success"


def test_jumps_end(spark):
    r = runner(spark, "flow a = { stage x = from [[1]] as t(x) | -> b }\nflow b = { stage y = from [[1]] as t(x) | -> a }", depth=3)
    out, n = r.run("a"), 0
    while out.next:
        out, n = out.next[0], n + 1
    assert n == 3


def test_cron():
    at = lambda *x: dt.datetime(*x, tzinfo=UTC)
    assert Cron("0 2 * * *").next(at(2024, 2, 28, 3)) == at(2024, 2, 29, 2)
    assert Cron("*/15 9-10 * * 1-5").next(at(2024, 6, 7, 10, 46)) == at(2024, 6, 10, 9)
    assert Cron("0 0 13 * 5").next(at(2024, 9, 1)) == at(2024, 9, 6)  # either day field
    assert Cron("0 0 * * 7").matches(at(2024, 6, 9)) and Cron("0 0 * * 0").matches(at(2024, 6, 9))
    assert Cron("30 2 * * *", "America/New_York").next(at(2024, 3, 10, 0)) == at(2024, 3, 11, 6, 30)  # 02:30 isn't there on the 10th
    assert Cron("0 12 1 1 *").last(at(2024, 6, 1)) == at(2024, 1, 1, 12)
    for bad in ("* * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *", "0 24 * * *"):
        with pytest.raises(QueryError):
            Cron(bad)


def test_schedules(spark):
    s = Session(spark)
    s.run("flow day with { schedule: cron('0 2 * * *'), keep_runs: 2 } = { stage a = from [[1]] as t(x) | select d = run_date }\nflow other = { stage a = from [[1]] as t(x) }")
    sched = Scheduler(s, FlowRunner(s, clock=FakeClock()))
    at = lambda d, h, m=0: dt.datetime(2024, 5, d, h, m, tzinfo=UTC)
    assert not sched.once(at(1, 3)) and len(sched.once(at(1, 2))) == 1
    assert not sched.catch_up(at(1, 23)) and len(sched.catch_up(at(2, 5))) == 1
    assert not sched.tick(at(3, 1, 59)) and len(sched.tick(at(3, 2))) == 1 and not sched.tick(at(3, 2, 1))
    out, failed = sched.backfill("day", at(5, 0), at(7, 3))
    assert [spark.table(r.stages[0].table).first()[0] for r in out] == ["2024-05-05", "2024-05-06", "2024-05-07"] and failed is None
    assert sched.sweep() == 4 and len(s.store.runs("day")) == 2
    with pytest.raises(QueryError):
        sched.backfill("other", at(1, 0), at(2, 0))


@pytest.mark.parametrize("make", [lambda p: RunStore(), lambda p: FileStore(str(p / "runs")), lambda p: SqliteStore(str(p / "runs.db"))])
def test_stores(tmp_path, make):
    store = make(tmp_path)
    base = {"flow": "f", "args": {}, "run_time": "2024-01-01T00:00:00+00:00", "stages": [], "state": "running", "cancel": False}
    assert store.claim(base | {"run_id": "a", "started": 1.0}, 1)
    assert not store.claim(base | {"run_id": "b", "started": 2.0}, 1)
    assert store.cancel("a") and store.get("a")["cancel"]
    store.save(base | {"run_id": "a", "started": 1.0, "state": "cancelled", "lease": 0})
    assert store.claim(base | {"run_id": "b", "started": 2.0}, 1)
    assert [r["run_id"] for r in store.runs("f")] == ["b", "a"] and store.latest("f")["run_id"] == "b"
    store.save(base | {"run_id": "b", "started": 2.0, "lease": 0})  # its lease is over: it died
    assert [r["run_id"] for r in store.sweep({"f": 1})] == ["a"] and store.get("b")["state"] == "failed"


def test_webhook(spark):
    got = []

    class Take(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Take)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    r = runner(spark, f"flow f = {{ stage a = from [[1], [2], [3]] as t(x) | activate('webhook', url: '{url}')\n stage b = from a order by x | activate('webhook', url: '{url}', format: 'ndjson', max_rows: 2) }}")
    assert r.run("f").state == "success"
    server.shutdown()
    assert sorted(x["x"] for x in json.loads(got[0][1])) == [1, 2, 3] and got[1][0].endswith("ndjson") and len(got[1][1].splitlines()) == 2


def test_plan_text(spark):
    s = Session(spark)
    s.run("flow f = { stage a = from [[1]] as t(x)\n stage b if a.done = from a | activate('email') }")
    assert plan_text(s.flows["f"]).splitlines() == ["flow f", "  stage a", "  stage b; reads a; if a.done; activates email"]
