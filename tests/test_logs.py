import json
import logging
import sys

from wickline import logs


def test_lines_are_json():
    try:
        raise ValueError("é")
    except ValueError:
        record = logging.LogRecord("wickline.x", logging.ERROR, __file__, 1, "took %d s", (3,), sys.exc_info())
    record.rows = 5
    line = json.loads(logs.JsonLines().format(record))
    assert (line["level"], line["logger"], line["message"], line["rows"]) == ("ERROR", "wickline.x", "took 3 s", 5)
    assert "ValueError: é" in line["exception"] and line["time"].endswith("+00:00")


def test_configure_is_idempotent():
    logs.configure()
    logs.configure(logging.DEBUG)
    logger = logging.getLogger("wickline")
    assert len(logger.handlers) == 1 and logger.level == logging.DEBUG
