"""Frequency strings: `3MS`, `QS-DEC`, `2W`, `YE-MAY`."""

from __future__ import annotations

import operator
import re
from typing import NamedTuple

#: Months, and days that a step of a base has, about.
ANCHORS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DAYS = {"s": 1 / 86400, "min": 1 / 1440, "h": 1 / 24, "D": 1.0, "M": 30.4375, "Q": 91.3125, "Y": 365.25}


class Offset(NamedTuple):
    multiple: int
    base: str
    start: bool
    anchor: str | None


def parse(freq: str) -> Offset:
    """Weeks count as seven days each; steps under a month start where they stand."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+?)(S|E)?(?:-([A-Z]{3}))?", freq)
    if m and m[2] + (m[3] or "") in DAYS and m[2] not in "MQY":
        return Offset(int(m[1] or 1), m[2] + (m[3] or ""), True, None)
    if m and m[2] == "W":
        return Offset(7 * int(m[1] or 1), "D", True, None)
    if not m or m[2] not in ("M", "Q", "Y", "A"):
        raise ValueError(f"unknown frequency {freq!r}")
    base = "Y" if m[2] == "A" else m[2]
    start = m[3] == "S"
    anchor = None if base == "M" else m[4] or ("JAN" if start else "DEC")
    if anchor is not None and anchor not in ANCHORS:
        raise ValueError(f"unknown anchor in {freq!r}")
    return Offset(int(m[1] or 1), base, start, anchor)


def length(freq: str) -> float:
    o = parse(freq)
    return o.multiple * DAYS[o.base]


def construct(multiple: int, base: str, start: bool, anchor: str | None) -> str:
    return f"{multiple if multiple > 1 else ''}{base}{('S' if start else 'E') if base in 'MQY' else ''}{f'-{anchor}' if anchor and base in 'QY' else ''}"


def begins_period(month: int, freq: str) -> bool:
    """Whether a month is the first of a period of the frequency."""
    o = parse(freq)
    if o.base not in "QY":
        return True
    first = ANCHORS.index(o.anchor) + (0 if o.start else 1)
    step = 3 if o.base == "Q" else 12
    return (month - 1 - first) % step == 0


#: Months of a step.
MONTHS = {"M": 1, "Q": 3, "Y": 12}
COMPARE = {"<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">=": operator.ge, ">": operator.gt}


def compare(one: str, op: str, other: str) -> bool:
    """Whether the length of one frequency is less than, ... that of the other."""
    if op not in COMPARE:
        raise ValueError(f"op is one of {sorted(COMPARE)}")
    return COMPARE[op](length(one), length(other))


def months(freq: str) -> tuple[int, int]:
    """Months of a step, and the first month (from 0) of a base period."""
    o = parse(freq)
    if o.base not in MONTHS:
        raise ValueError(f"{freq!r} has no whole months")
    first = 0 if o.anchor is None else ANCHORS.index(o.anchor) + (0 if o.start else 1)
    return o.multiple * MONTHS[o.base], first % MONTHS[o.base]
