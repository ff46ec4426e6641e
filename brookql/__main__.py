"""Command line: run, explain, to-flow, export, flow list|show|run|backfill|scheduler|session, and a prompt."""

from __future__ import annotations

import argparse
import datetime as dt
import glob
import sys

from pyspark.sql import SparkSession

from . import assist, printer
from .flow.model import plan_text, schedule_text
from .flow.run import FlowRunner
from .flow.schedule import Scheduler
from .flow.store import FileStore, SqliteStore
from .plans.flow_text import from_sql, order_rank
from .plans.parser import Parser
from .session import Session


def make_session(a: argparse.Namespace) -> Session:
    spark = SparkSession.builder.appName("brookql").getOrCreate()
    s = Session(spark, path=(a.work,))
    if a.profile:
        from .sources.connectors import load_profile

        load_profile(s, a.profile)
    s.store = SqliteStore(f"{a.work}/target/flow-runs/registry.db") if a.store == "sqlite" else FileStore(f"{a.work}/target/flow-runs")
    return s


def load_flows(s: Session, folder: str) -> None:
    """Definitions of flows, models and functions in the files of a folder; their queries aren't run."""
    for path in sorted(glob.glob(f"{folder}/**/*.flow", recursive=True) + glob.glob(f"{folder}/**/*.wv", recursive=True)):
        with open(path) as f:
            for st in Parser(f.read()).statements():
                if st.kind in ("flow", "model", "def", "type", "val", "table"):
                    s.statement(st)


def _call(text: str) -> tuple[str, list]:
    p = Parser(text)
    return p.name(), p.args() if p.is_("(") else []


def _time(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def flow_command(a: argparse.Namespace, out) -> int:
    s = make_session(a)
    load_flows(s, a.work)
    runner = FlowRunner(s)
    if a.what == "list":
        for f in s.flows.values():
            print(f"{f.name}\t{len(f.stages)} stages\t{schedule_text(f) if 'schedule' in f.config else ''}", file=out)
    elif a.what == "show":
        print(plan_text(s.flows[a.args[0]]), file=out)
    elif a.what == "run":
        name, args = _call(a.args[0])
        r = runner.run(name, args)
        print(printer.box(r.summary(s.spark)), file=out)
        return 0 if r.state == "success" else 1
    elif a.what == "backfill":
        name, args = _call(a.args[0])
        done, failed = Scheduler(s, runner).backfill(name, _time(a.since), _time(a.until) if a.until else dt.datetime.now(dt.timezone.utc), args)
        print(f"{len(done)} windows" + (f"; failed: go on with --from {failed.isoformat()}" if failed else ""), file=out)
        return 1 if failed else 0
    elif a.what == "scheduler":
        sched = Scheduler(s, runner)
        now = dt.datetime.now(dt.timezone.utc)
        runs = sched.catch_up(now) if a.catchup else []
        if a.once:
            runs += sched.once(now)
            print(f"{len(runs)} runs", file=out)
        else:
            sched.serve(lambda: load_flows(s, a.work), retention=a.retention)
    elif a.what == "session":
        verb = a.args[0]
        if verb == "list":
            for r in s.store.runs():
                print(f"{r['run_id']}\t{r['flow']}\t{r['state']}\t{r['run_time']}", file=out)
        elif verb == "show":
            r = s.store.get(a.args[1])
            print(f"{r['flow']}({', '.join(f'{k} = {v}' for k, v in r['args'].items() if not k.startswith('run_'))}) at {r['run_time']}: {r['state']}", file=out)
            for st in r["stages"]:
                print(f"  {st['stage']}\t{st['state']}\t{st['attempts']}\t{st['error']}", file=out)
        elif verb == "cancel":
            print("asked to stop" if s.store.cancel(a.args[1]) else "not running", file=out)
        elif verb == "resume":
            return 0 if runner.resume(a.args[1]).state == "success" else 1
        elif verb == "clean":
            gone = s.store.sweep({f: 1 for f in s.flows}, 0)
            runner.clean(gone)
            print(f"{len(gone)} runs removed", file=out)
    return 0


def prompt(s: Session, read=input, out=sys.stdout) -> None:
    """Statements end with ; or an empty line; ``help`` and ``quit`` are words of the prompt, ``rows n`` bounds what is shown."""
    limit, held = 40, ""
    while True:
        try:
            line = read("> " if not held else ". ")
        except EOFError:
            return
        if not held and line.strip() in ("quit", "exit"):
            return
        if not held and line.strip() == "help":
            print("from ..., select ..., show tables, describe t, explain ...; rows n; quit", file=out)
            continue
        if not held and line.split()[:1] == ["rows"] and line.split()[1:]:
            limit = int(line.split()[1])
            continue
        held += line + "\n"
        if line.strip() and not line.rstrip().endswith(";"):
            continue
        text, held = held.strip().rstrip(";"), ""
        if text:
            try:
                df = s.run(text)
                if df is not None:
                    print(printer.box(df, limit), file=out)
            except Exception as e:  # the prompt goes on
                print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=out)


def main(argv: list[str] | None = None, out=None) -> int:
    out = out or sys.stdout
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-w", "--work", default=".", help="folder of the definitions")
    common.add_argument("--profile", help="a JSON file of connectors")
    common.add_argument("--store", choices=("file", "sqlite"), default="file")
    top = argparse.ArgumentParser("brookql", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", parents=[common])
    run.add_argument("-f", "--file")
    run.add_argument("-c", "--text")
    run.add_argument("--sql", action="store_true")
    run.add_argument("--format", choices=("box", "tsv", "jsonl", "json"), default="box")
    run.add_argument("--rows", type=int, default=40)
    for name in ("explain", "to-flow", "rank"):
        p = sub.add_parser(name, parents=[common])
        p.add_argument("text")
    export = sub.add_parser("export", parents=[common])
    export.add_argument("schema", nargs="?", default="default")
    sub.add_parser("prompt", parents=[common])
    flow = sub.add_parser("flow", parents=[common])
    flow.add_argument("what", choices=("list", "show", "run", "backfill", "scheduler", "session"))
    flow.add_argument("args", nargs="*")
    flow.add_argument("--from", dest="since")
    flow.add_argument("--to", dest="until")
    flow.add_argument("--once", action="store_true")
    flow.add_argument("--catchup", action="store_true")
    flow.add_argument("--retention")
    a = top.parse_args(argv)
    if a.command == "to-flow":
        print(from_sql(a.text), file=out)
        return 0
    if a.command == "rank":
        print(round(order_rank(a.text), 3), file=out)
        return 0
    if a.command == "flow":
        return flow_command(a, out)
    s = make_session(a)
    if a.command == "prompt":
        prompt(s, out=out)
    elif a.command == "export":
        print(assist.export_catalog(s.spark, a.schema), file=out)
    elif a.command == "explain":
        print(s.explained(s.query(Parser(a.text).query(), assist.Scope(s))).first()[0], file=out)
    else:
        df = s.run_file(a.file) if a.file else s.sql(a.text) if a.sql else s.run(a.text)
        if df is not None:
            print(printer.show(df, a.format, a.rows), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
