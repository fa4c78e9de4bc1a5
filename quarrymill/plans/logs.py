"""Logs as JSON lines, for the driver's side of a run; executors' logs are Spark's."""

from __future__ import annotations

import json
import logging
import logging.handlers
from collections import Counter

#: What a record has besides fields that a caller gives by ``extra``.
_OWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """time, level, logger, message, place, error, and the fields of ``extra``."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "place": f"{record.module}:{record.lineno}"}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out | {k: v for k, v in record.__dict__.items() if k not in _OWN}, default=str)


class Topics(logging.Filter):
    """Lets records through whose logger, or field ``topic``, starts with one of the names."""

    def __init__(self, *names: str):
        super().__init__()
        self.names = names

    def filter(self, record: logging.LogRecord) -> bool:
        return f"{getattr(record, 'topic', '')}".startswith(self.names) or record.name.startswith(self.names)


class Counts(logging.Handler):
    """Counts records by level."""

    def __init__(self):
        super().__init__()
        self.by_level: Counter[str] = Counter()

    def emit(self, record: logging.LogRecord) -> None:
        self.by_level[record.levelname] += 1


def set_up(level: str = "INFO", path: str | None = None, topics: dict[str, tuple[str, ...]] | None = None, name: str = "quarrymill", max_bytes: int = 10 << 20, backups: int = 5) -> Counts:
    """Sends the library's records to stderr, to ``path`` and, by topic, to further files; files roll over at max_bytes.
    Handlers of an earlier call go. Returns the counts, which grow from now on."""
    logger = logging.getLogger(name)
    for h in logger.handlers[:]:
        logger.removeHandler(h)
        h.close()
    logger.setLevel(level)
    file = lambda p: logging.handlers.RotatingFileHandler(p, maxBytes=max_bytes, backupCount=backups, encoding="utf-8", delay=True)
    handlers: list[logging.Handler] = [logging.StreamHandler(), *([file(path)] if path else [])]
    for p, names in (topics or {}).items():
        handlers.append(file(p))
        handlers[-1].addFilter(Topics(*names))
    counts = Counts()
    for h in (*handlers, counts):
        h.setFormatter(JsonLines())
        logger.addHandler(h)
    return counts
