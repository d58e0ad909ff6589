"""Log records as JSON lines."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

_PLAIN = frozenset(logging.makeLogRecord({}).__dict__) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    """Time, level, logger and message, with whatever the call gave as ``extra``, and the exception if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in record.__dict__.items() if k not in _PLAIN}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str, ensure_ascii=False)


def configure(level: int = logging.INFO) -> None:
    """Send the engine's log lines to standard error as JSON."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logger = logging.getLogger("wickline")
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(level)
