"""Schedules: which flows are due, missed windows, backfill and the daemon's loop."""

from __future__ import annotations

import datetime as dt
import time
from typing import TYPE_CHECKING

from ..plans.lexer import QueryError
from ..plans.nodes import FlowDef
from .cron import Cron
from .model import SUCCESS, schedule_text, seconds
from .run import FlowResult, FlowRunner

if TYPE_CHECKING:
    from ..session import Session


class Scheduler:
    def __init__(self, session: Session, runner: FlowRunner | None = None) -> None:
        self.session, self.runner = session, runner or FlowRunner(session)
        self.due: dict[str, tuple[str, dt.datetime | None]] = {}

    def crons(self) -> dict[str, Cron]:
        return {f.name: self.cron(f) for f in self.session.flows.values() if "schedule" in f.config}

    @staticmethod
    def cron(flow: FlowDef) -> Cron:
        return Cron(schedule_text(flow), flow.config.get("timezone", "UTC"))

    def once(self, now: dt.datetime) -> list[FlowResult]:
        """Run the flows that are due in the minute of ``now``."""
        minute = now.replace(second=0, microsecond=0)
        return [self.runner.run(n, run_time=minute) for n, c in self.crons().items() if c.matches(minute)]

    def catch_up(self, now: dt.datetime) -> list[FlowResult]:
        """Run each flow whose latest window has no run at or after it, with that window's time."""
        out = []
        for n, c in self.crons().items():
            missed = c.last(now)
            if missed is None:
                continue
            times = [dt.datetime.fromisoformat(r["run_time"]) for r in self.runner.store.runs(n)]
            if not any(t >= missed for t in times):
                out.append(self.runner.run(n, run_time=missed))
        return out

    def tick(self, now: dt.datetime) -> list[FlowResult]:
        """Run what fell due since the last tick; a flow whose schedule didn't change keeps its time when definitions are read anew."""
        out = []
        for n, c in self.crons().items():
            text = schedule_text(self.session.flows[n])
            if n not in self.due or self.due[n][0] != text:
                self.due[n] = (text, c.next(now))
            at = self.due[n][1]
            if at is not None and at <= now:
                self.due[n] = (text, c.next(now))
                out.append(self.runner.run(n, run_time=at))
        return out

    def backfill(self, name: str, start: dt.datetime, end: dt.datetime, args: list | tuple = ()) -> tuple[list[FlowResult], dt.datetime | None]:
        """Run each window from ``start`` to ``end`` in order; the first that fails ends it and is returned to go on from."""
        flow = self.session.flows.get(name)
        if flow is None or "schedule" not in flow.config:
            raise QueryError(f"a backfill needs a flow with a schedule: {name}")
        out = []
        for at in self.cron(flow).between(start, end):
            out.append(self.runner.run(name, args, run_time=at))
            if out[-1].state != SUCCESS:
                return out, at
        return out, None

    def sweep(self, retention: str | None = None) -> int:
        keep = {f.name: int(f.config["keep_runs"]) for f in self.session.flows.values() if "keep_runs" in f.config}
        gone = self.runner.store.sweep(keep, seconds(retention) if retention else None)
        self.runner.clean(gone)
        return len(gone)

    def serve(self, reload=None, every: float = 5.0, retention: str | None = None, stop=None) -> None:
        """Tick for ever, or until ``stop()``; ``reload()`` reads the definitions anew and may raise to keep the old ones."""
        swept = 0.0
        while stop is None or not stop():
            if reload is not None:
                try:
                    reload()
                except Exception as e:  # keep what was loaded before
                    print(f"definitions not reloaded: {e}")
            self.tick(dt.datetime.now(dt.timezone.utc))
            if time.time() - swept > 300:
                self.sweep(retention)
                swept = time.time()
            time.sleep(every)
