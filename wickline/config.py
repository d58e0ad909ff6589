"""Validated parameters, checked when a plan is built."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal

# The units of a timeframe, in seconds.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def timeframe_seconds(timeframe: str) -> int:
    """Seconds of a timeframe such as ``1m`` or ``4h``."""
    found = re.fullmatch(r"(\d+)([smhd])", timeframe)
    if not found or int(found[1]) <= 0:
        raise ValueError("UNSUPPORTED_TIMEFRAME")
    return int(found[1]) * UNIT_SECONDS[found[2]]


def utc(value: datetime, name: str) -> datetime:
    """The instant in UTC; naive datetimes are refused."""
    offset = value.utcoffset()
    if offset is None:
        raise ValueError(f"{name} must be timezone-aware")
    return (value - offset).replace(tzinfo=timezone.utc)


def _number(kinds: type | tuple, low: float, high: float, what: str):
    """A check of a parameter: a number of these kinds, not a truth value, from ``low`` to ``high``; no NaN is."""

    def check(value, name: str):
        fits = type(value) is not bool and isinstance(value, kinds) and low <= value <= high
        if not fits:
            raise ValueError(f"{name} must be {what}")
        return value

    return check


_share = _number((int, float), 0, 1, "between 0.0 and 1.0")
_not_negative = _number(Decimal, 0, Decimal("1E+999999"), "finite and not negative")


def unit_interval(value: float, name: str) -> float:
    """A number in [0, 1]."""
    return float(_share(value, name))


def _whole(value: int, least: int, name: str) -> None:
    _number(int, least, math.inf, f"a whole number of {least} or more")(value, name)


def _decimal(value, name: str) -> None:
    number = Decimal(value)
    _not_negative(Decimal(-1) if number.is_nan() else number, name)  # NaN has no order


def plain(value) -> str:
    """A number without exponent or trailing zeros."""
    return format(Decimal(str(value)).normalize(), "f")


@dataclass(frozen=True)
class AnalysisConfig:
    trend_pairs: int
    lateral_window: int
    lateral_max_range: Decimal
    minimum_quality: float

    def __post_init__(self) -> None:
        _whole(self.trend_pairs, 1, "trend_pairs")
        _whole(self.lateral_window, 3, "lateral_window")
        _decimal(self.lateral_max_range, "lateral_max_range")
        unit_interval(self.minimum_quality, "minimum_quality")

    @property
    def needed(self) -> int:
        """Closed candles that an analysis looks at."""
        return max(self.trend_pairs + 1, self.lateral_window)


@dataclass(frozen=True)
class OutcomeConfig:
    horizon: int
    threshold: Decimal

    def __post_init__(self) -> None:
        _whole(self.horizon, 1, "horizon")
        _decimal(self.threshold, "threshold")
