"""Five-field cron expressions."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from ..plans.lexer import QueryError

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, dash, b = span.partition("-")
        try:
            start, end = (low, high) if span == "*" else (int(a), int(b) if dash else high if step else int(a))
            by = int(step) if step else 1
        except ValueError:
            raise QueryError(f"can't read {text!r} in a cron expression") from None
        if not low <= start <= end <= high or by < 1:
            raise QueryError(f"{text!r} is out of range in a cron expression")
        out |= set(range(start, end + 1, by))
    return out


class Cron:
    """Minute, hour, day, month, weekday (Sunday 0 or 7); if both day fields are restricted, either may match."""

    def __init__(self, text: str, zone: str = "UTC") -> None:
        parts = text.split()
        if len(parts) != 5:
            raise QueryError(f"a cron expression has five fields: {text!r}")
        self.minutes, self.hours, self.days, self.months, weekdays = (_field(p, *r) for p, r in zip(parts, _RANGES))
        self.weekdays = {d % 7 for d in weekdays}
        self.either = parts[2] != "*" and parts[4] != "*"
        self.zone = ZoneInfo(zone)

    def _day(self, t: dt.datetime) -> bool:
        day, weekday = t.day in self.days, t.isoweekday() % 7 in self.weekdays
        return t.month in self.months and (day or weekday if self.either else day and weekday)

    def matches(self, t: dt.datetime) -> bool:
        t = t.astimezone(self.zone)
        return self._day(t) and t.hour in self.hours and t.minute in self.minutes

    def next(self, after: dt.datetime) -> dt.datetime | None:
        """The first time after ``after``, within five years; an hour that a change of clocks leaves out isn't met."""
        t = (after.astimezone(self.zone) + dt.timedelta(minutes=1)).replace(second=0, microsecond=0)
        last = t + dt.timedelta(days=366 * 5)
        while t < last:
            if not self._day(t):
                t = (t + dt.timedelta(days=1)).replace(hour=0, minute=0)
            elif t.hour not in self.hours:
                t = (t + dt.timedelta(hours=1)).replace(minute=0)
            elif t.minute not in self.minutes:
                t += dt.timedelta(minutes=1)
            elif t.astimezone(dt.timezone.utc).astimezone(self.zone).hour != t.hour:
                t += dt.timedelta(minutes=1)
            else:
                return t.astimezone(dt.timezone.utc)
        return None

    def last(self, until: dt.datetime) -> dt.datetime | None:
        """The latest time at or before ``until``, within a year."""
        t, span = until, dt.timedelta(hours=1)
        while span < dt.timedelta(days=400):
            found, step = None, self.next(t - span)
            while step is not None and step <= until:
                found, step = step, self.next(step)
            if found is not None:
                return found
            span *= 4
        return None

    def between(self, start: dt.datetime, end: dt.datetime) -> list[dt.datetime]:
        """All times from ``start`` to ``end``, both included."""
        out, t = [], self.next(start - dt.timedelta(minutes=1))
        while t is not None and t <= end:
            out.append(t)
            t = self.next(t)
        return out
