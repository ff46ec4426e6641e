"""Where stages and hooks deliver rows."""

from __future__ import annotations

import json
import logging
import urllib.request
from typing import Any

from pyspark.sql import DataFrame

from ..printer import plain
from ..sources import files

log = logging.getLogger("brookql.flow")
#: Rows that a webhook is sent, unless max_rows says otherwise.
MOST_ROWS = 1000


def file(df: DataFrame, path: str = "", format: str = "", **options: Any) -> None:
    """Files in ``path``, by its extension or ``format``."""
    if not path:
        raise ValueError("activate('file') needs a path")
    files.write(df, path if not format or path.endswith(f".{format}") else f"{path}.{format}", "overwrite", {k: str(v) for k, v in options.items()})


def webhook(df: DataFrame, url: str = "", format: str = "json", max_rows: Any = MOST_ROWS, timeout: Any = 30, **_: Any) -> None:
    """POST of the rows as a JSON array, or as lines with ``format: 'ndjson'``; at most ``max_rows``."""
    if not url:
        raise ValueError("activate('webhook') needs a url")
    rows = [json.dumps(plain(r)) for r in df.limit(int(max_rows)).collect()]
    lines = format == "ndjson"
    body = ("\n".join(rows) if lines else f"[{','.join(rows)}]").encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/x-ndjson" if lines else "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=float(timeout)) as answer:
        if answer.status >= 300:
            raise OSError(f"{url} answered {answer.status}")


BUILT_IN = {"file": file, "webhook": webhook}


def deliver(sinks: dict, target: str, df: DataFrame, params: dict) -> None:
    """To a sink of ``sinks`` or a built-in one; an unknown target is only logged."""
    sink = sinks.get(target) or BUILT_IN.get(target)
    if sink is None:
        log.warning("no sink is called %s: its rows aren't delivered", target)
        return
    sink(df, **params)
