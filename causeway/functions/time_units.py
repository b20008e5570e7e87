"""Fixed-length time units in microseconds: a year is 365 days and a month 30, an unknown unit is 0."""

from __future__ import annotations

MICROS = {
    "year": 365 * 86_400_000_000,
    "month": 30 * 86_400_000_000,
    "day": 86_400_000_000,
    "hour": 3_600_000_000,
    "minute": 60_000_000,
    "second": 1_000_000,
    "millisecond": 1_000,
    "microsecond": 1,
}


def micros(n: int, unit: str) -> int:
    return n * MICROS.get(unit, 0)
