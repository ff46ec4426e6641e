"""Queries as a service: submit a text, ask for its state and pages of its rows."""

from __future__ import annotations

import concurrent.futures as cf
import itertools
import threading
from dataclasses import dataclass, field
from typing import Any

from .printer import plain, type_name
from .session import Session

QUEUED, RUNNING, FINISHED, FAILED, CANCELLED = "QUEUED", "RUNNING", "FINISHED", "FAILED", "CANCELLED"


@dataclass
class _Query:
    text: str
    state: str = QUEUED
    error: str = ""
    columns: list[tuple[str, str]] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    total: int | None = None


class QueryService:
    """Runs queries of one session on a pool; ``most_rows`` of a result are kept, and all are counted."""

    def __init__(self, session: Session, workers: int = 4, most_rows: int = 10_000) -> None:
        self.session, self.most_rows = session, most_rows
        self.pool, self.lock, self.ids = cf.ThreadPoolExecutor(workers), threading.Lock(), itertools.count(1)
        self.queries: dict[str, _Query] = {}

    def submit(self, text: str, sql: bool = False) -> str:
        """The id of a query that is now queued."""
        with self.lock:
            id_ = f"q{next(self.ids)}"
            q = self.queries[id_] = _Query(text)
        self.pool.submit(self._run, id_, q, sql)
        return id_

    def _run(self, id_: str, q: _Query, sql: bool) -> None:
        if q.state == CANCELLED:
            return
        q.state = RUNNING
        spark = self.session.spark
        spark.addTag(id_)
        try:
            df = self.session.sql(q.text) if sql else self.session.run(q.text)
            if df is not None:
                q.columns = [(f.name, type_name(f.dataType)) for f in df.schema]
                rows = df.limit(self.most_rows + 1).collect()
                q.total = len(rows) if len(rows) <= self.most_rows else df.count()
                q.rows = [plain(r) for r in rows[: self.most_rows]]
            q.state = FINISHED if q.state == RUNNING else q.state
        except Exception as e:  # the caller learns of it from info
            if q.state != CANCELLED:
                q.state, q.error = FAILED, str(e)
        finally:
            spark.removeTag(id_)

    def info(self, id_: str, page: int = 0, size: int = 100) -> dict[str, Any]:
        """State, error, columns, total and one page of rows; ``next`` is the following page, if there is one."""
        q = self.queries[id_]
        rows = q.rows[page * size : (page + 1) * size] if q.state == FINISHED else []
        more = q.state == FINISHED and (page + 1) * size < len(q.rows)
        return {"id": id_, "state": q.state, "error": q.error, "columns": q.columns, "total": q.total, "rows": rows, "next": page + 1 if more else None}

    def cancel(self, id_: str) -> None:
        q = self.queries[id_]
        if q.state in (QUEUED, RUNNING):
            q.state = CANCELLED
            self.session.spark.interruptTag(id_)
