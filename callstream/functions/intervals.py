"""Lengths of time given as text, such as ``"10 minutes"``."""

from __future__ import annotations

from datetime import timedelta


def interval_micros(interval: str) -> int:
    """Microseconds in an interval of one or more numbers with their units."""
    words = interval.lower().split()
    parts = zip(words[::2], words[1::2], strict=True)
    length = timedelta(**{unit.rstrip("s") + "s": int(number) for number, unit in parts})
    return length // timedelta(microseconds=1)
