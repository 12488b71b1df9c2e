"""Structured log lines and timed spans, on the standard library's logging."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any, TextIO

LOG = logging.getLogger("millrace")


class JsonLines(logging.Formatter):
    """One JSON object a line: time, level, event, what was bound to it and, for an error, its text."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"at": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname.lower(), "event": record.getMessage()} | getattr(record, "bound", {})
        if record.exc_info:
            row["error"] = str(record.exc_info[1])
        return json.dumps(row, default=str, ensure_ascii=False)


def configure(level: str = "INFO", to: TextIO | None = None) -> None:
    """Write the library's log lines to a stream, in place of where they went before."""
    handler = logging.StreamHandler(to or sys.stderr)
    handler.setFormatter(JsonLines())
    LOG.handlers, LOG.propagate = [handler], False
    LOG.setLevel(level.upper())


def event(name: str, **bound: Any) -> None:
    LOG.info(name, extra={"bound": bound})


@contextmanager
def span(name: str, **bound: Any) -> Iterator[dict]:
    """Log an event with its seconds when the block ends, also by an error, which goes on. The block may add to what is bound."""
    began, failed = time.monotonic(), False
    try:
        yield bound
    except BaseException:
        failed = True
        raise
    finally:
        seconds = {"seconds": round(time.monotonic() - began, 3)}
        LOG.log(logging.ERROR if failed else logging.INFO, name, extra={"bound": bound | seconds}, exc_info=failed)


def traced(f: Callable) -> Callable:
    """f in a span of its name."""

    @wraps(f)
    def run(*args: Any, **kwargs: Any) -> Any:
        with span(f.__qualname__):
            return f(*args, **kwargs)

    return run
