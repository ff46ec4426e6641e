"""Records of flow runs: in memory, as a file a run, or in SQLite."""

from __future__ import annotations

import copy
import json
import os
import sqlite3
import threading
import time
from typing import Any

LEASE = 60.0


class RunStore:
    """Records are dicts with run_id, flow, state, started, updated, lease, stages, args, run_time and cancel.  This one keeps them in memory."""

    def __init__(self) -> None:
        self._runs: dict[str, dict] = {}
        self._lock = threading.RLock()

    def _load(self) -> list[dict]:
        return list(self._runs.values())

    def _put(self, record: dict) -> None:
        self._runs[record["run_id"]] = copy.deepcopy(record)

    def _drop(self, run_id: str) -> None:
        self._runs.pop(run_id, None)

    def save(self, record: dict) -> None:
        with self._lock:
            old = self.get(record["run_id"])
            if old and old.get("cancel"):
                record = record | {"cancel": True}
            self._put(record | {"updated": time.time()})

    def get(self, run_id: str) -> dict | None:
        with self._lock:
            return next((copy.deepcopy(r) for r in self._load() if r["run_id"] == run_id), None)

    def runs(self, flow: str | None = None) -> list[dict]:
        """Records, the most recent first."""
        with self._lock:
            found = [copy.deepcopy(r) for r in self._load() if flow is None or r["flow"] == flow]
        return sorted(found, key=lambda r: (r["started"], r["run_id"]), reverse=True)

    def latest(self, flow: str) -> dict | None:
        return next(iter(self.runs(flow)), None)

    def claim(self, record: dict, slots: int | None) -> bool:
        """Save a run as running if its flow has a free slot."""
        with self._lock:
            now = time.time()
            busy = [r for r in self._load() if r["flow"] == record["flow"] and r["state"] == "running" and r["lease"] > now and r["run_id"] != record["run_id"]]
            if slots is not None and len(busy) >= slots:
                return False
            self.save(record | {"state": "running", "lease": now + LEASE})
            return True

    def cancel(self, run_id: str) -> bool:
        with self._lock:
            record = self.get(run_id)
            if record is None or record["state"] != "running":
                return False
            self._put(record | {"cancel": True})
            return True

    def sweep(self, keep: dict[str, int], age: float | None = None) -> list[dict]:
        """Mark runs whose lease is over as failed; drop finished runs beyond the policy and return them.  A flow's latest stays."""
        gone = []
        with self._lock:
            now = time.time()
            for r in self._load():
                if r["state"] == "running" and r["lease"] <= now:
                    self._put(r | {"state": "failed", "updated": now})
            for flow in {r["flow"] for r in self._load()}:
                done = [r for r in self.runs(flow) if r["state"] != "running"]
                for k, r in enumerate(done):
                    if k and (flow in keep and k >= keep[flow] or age is not None and now - r["updated"] > age):
                        self._drop(r["run_id"])
                        gone.append(r)
        return gone


class FileStore(RunStore):
    """One JSON file a run, in a folder of the driver's machine."""

    def __init__(self, folder: str) -> None:
        super().__init__()
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, run_id: str) -> str:
        return os.path.join(self.folder, f"{run_id}.json")

    def _load(self) -> list[dict]:
        out = []
        for n in sorted(os.listdir(self.folder)):
            if n.endswith(".json"):
                with open(os.path.join(self.folder, n)) as f:
                    out.append(json.load(f))
        return out

    def _put(self, record: dict) -> None:
        part = self._path(record["run_id"]) + ".part"
        with open(part, "w") as f:
            json.dump(record, f, default=str)
        os.replace(part, self._path(record["run_id"]))

    def _drop(self, run_id: str) -> None:
        if os.path.exists(self._path(run_id)):
            os.remove(self._path(run_id))


class SqliteStore(RunStore):
    """One database; claims hold across processes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path = path
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self._db = sqlite3.connect(path, check_same_thread=False, isolation_level=None, timeout=30)
        self._db.execute("pragma journal_mode=wal")
        self._db.execute("create table if not exists runs (run_id text primary key, record text not null)")

    def _load(self) -> list[dict]:
        return [json.loads(r) for (r,) in self._db.execute("select record from runs")]

    def _put(self, record: dict) -> None:
        self._db.execute("insert or replace into runs values (?, ?)", (record["run_id"], json.dumps(record, default=str)))

    def _drop(self, run_id: str) -> None:
        self._db.execute("delete from runs where run_id = ?", (run_id,))

    def _whole(self, work: Any) -> Any:
        with self._lock:
            self._db.execute("begin immediate")
            try:
                out = work()
            except BaseException:
                self._db.execute("rollback")
                raise
            self._db.execute("commit")
            return out

    def claim(self, record: dict, slots: int | None) -> bool:
        return self._whole(lambda: RunStore.claim(self, record, slots))

    def cancel(self, run_id: str) -> bool:
        return self._whole(lambda: RunStore.cancel(self, run_id))
