"""Temporal phrases in queries: detection, ranges and filters. Runs on the driver, on one query."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta, timezone

# The phrases that count as a hint.
HINT = re.compile(
    r"\b(today|yesterday"
    r"|(?:this|last|past|next) (?:week|month|quarter|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
    r"|(?:this|last|past|next) \w+"
    r"|(?:in|during|before|after|since) [\w\s,]{2,30}"
    r"|\d{1,2} ?(?:months?|weeks?|days?|years?) ago"
    r"|(?:earlier )?this year|this month"
    r"|\d{4})\b",
    re.I,
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def extract_hint(text: str) -> str | None:
    m = HINT.search(text)
    return m[0].strip() if m else None


def _months(at: datetime, n: int) -> datetime:
    y, m = divmod(at.year * 12 + at.month - 1 + n, 12)
    return at.replace(year=y, month=m + 1, day=min(at.day, monthrange(y, m + 1)[1]))


def _day(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def parse_date(phrase: str, now: datetime) -> datetime | None:
    """A small grammar: ISO dates, years, months with or without a year, weekdays, units ago, this and last units."""
    low = phrase.lower().strip(" ,.")
    try:
        at = datetime.fromisoformat(low)
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    except ValueError:
        pass
    if low in ("today", "now"):
        return now
    if low == "yesterday":
        return now - timedelta(days=1)
    if m := re.search(r"(\d{1,3}) ?(day|week|month|year)s? ago", low):
        n = int(m[1])
        return {"day": now - timedelta(days=n), "week": now - timedelta(weeks=n), "month": _months(now, -n), "year": _months(now, -12 * n)}[m[2]]
    if m := re.search(r"(this|last|past|next) (day|week|month|quarter|year)", low):
        n = {"this": 0, "next": 1}.get(m[1], -1)
        return {"day": now + timedelta(days=n), "week": now + timedelta(weeks=n), "month": _months(now, n), "quarter": _months(now, 3 * n), "year": _months(now, 12 * n)}[m[2]]
    for i, name in enumerate(DAYS):
        if name in low.split():
            back = (now.weekday() - i) % 7 or 7
            return now - timedelta(days=back)
    for i, name in enumerate(MONTHS, 1):
        if re.search(rf"\b{name}\b", low):
            year = re.search(r"\b(\d{4})\b", low)
            y = int(year[1]) if year else now.year - (i > now.month)
            return now.replace(year=y, month=i, day=1)
    if m := re.search(r"\b(\d{4})\b", low):
        return now.replace(year=int(m[1]), month=1, day=1)
    return None


def date_range(phrase: str, now: datetime) -> tuple[datetime, datetime] | None:
    """Start and end of the week, month, year or day that a phrase names."""
    base = parse_date(phrase, now)
    if base is None:
        return None
    low = phrase.lower()
    if "week" in low:
        start = _day(base - timedelta(days=base.weekday()))
        return start, start + timedelta(days=7)
    if "month" in low:
        start = _day(base).replace(day=1)
        return start, _months(start, 1)
    if "year" in low or re.fullmatch(r"\d{4}", low.strip()):
        start = _day(base).replace(month=1, day=1)
        return start, _months(start, 12)
    start = _day(base)
    return start, start + timedelta(days=1)


def time_filter(query: str, now: datetime, column: str = "modified_at") -> tuple[dict | None, str]:
    """A filter on a timestamp column with inclusive bounds, and a label; (None, "") without a hint."""
    hint = extract_hint(query)
    if not hint:
        return None, ""
    low = hint.lower()
    for word, bound in (("before ", "lte"), ("after ", "gte"), ("since ", "gte")):
        if low.startswith(word):
            words = low[len(word) :].split()
            for n in range(len(words), 0, -1):  # the phrase may run into other words
                if at := parse_date(" ".join(words[:n]), now):
                    return {column: {bound: at}}, hint
            return None, ""
    found = date_range(hint, now)
    return ({column: {"gte": found[0], "lte": found[1]}}, hint) if found else (None, "")
