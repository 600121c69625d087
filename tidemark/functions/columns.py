"""Column expressions: calendars, corrections, hash uniforms, table lookups, transforms.

All of them stay in the JVM. A missing value is NULL; NaN is made NULL on reading (see sources).
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPS = ("time", "time.month", "time.season", "time.dayofyear", "time.week")
#: Seasons by code.
SEASONS = ("DJF", "MAM", "JJA", "SON")
COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne, "gt": operator.gt, "lt": operator.lt, "ge": operator.ge, "le": operator.le, "eq": operator.eq, "ne": operator.ne}
EARTH_KM = 6367.0


def compare(op: str, left: Column, right: Column, allowed: Sequence[str] | None = None) -> Column:
    if op not in COMPARE or allowed is not None and op not in allowed:
        raise ValueError(f"operation {op!r} isn't one of {sorted(allowed or COMPARE)}")
    return COMPARE[op](left, right)


def group_key(time: Column, group: str) -> Column:
    """The group of a time: 1 for the whole series, else month, season (0 is DJF), day of year or ISO week."""
    if group == "time":
        return F.lit(1)
    return {"time.month": F.month(time), "time.season": F.floor(F.pmod(F.month(time), F.lit(12)) / 3).cast("int"), "time.dayofyear": F.dayofyear(time), "time.week": F.weekofyear(time)}[group]


def group_index(time: Column, group: str) -> Column:
    """The continuous group index that interpolation runs over."""
    if group == "time.month":
        return F.month(time) - 0.5 + F.dayofmonth(time) / F.dayofmonth(F.last_day(time))
    if group == "time.season":
        length = F.dayofyear(F.make_date(F.year(time), F.lit(12), F.lit(31)))
        return F.dayofyear(time) / length * 4 - F.lit(1 / 6)
    if group == "time.dayofyear":
        return F.dayofyear(time).cast("double")
    raise ValueError(f"no continuous index for {group!r}")


def group_count(group: str) -> int:
    return {"time": 1, "time.month": 12, "time.season": 4, "time.dayofyear": 366, "time.week": 53}[group]


def check_kind(kind: str) -> str:
    if kind not in ("+", "*"):
        raise ValueError(f"kind must be + or *, not {kind!r}")
    return kind


def correction(x: Column, y: Column, kind: str) -> Column:
    """What brings x to y: y - x, or y / x (NULL where x is 0)."""
    return y - x if check_kind(kind) == "+" else F.try_divide(y, x)


def corrected(x: Column, factor: Column, kind: str) -> Column:
    return x + factor if check_kind(kind) == "+" else x * factor


def inverse(x: Column, kind: str) -> Column:
    return -x if check_kind(kind) == "+" else F.try_divide(F.lit(1.0), x)


def nodes(n: int, eps: float | None = None) -> list[float]:
    """Mid-points of n equal bins of [0, 1], with end points at eps and 1 - eps if that is given."""
    out = [(i + 0.5) / n for i in range(n)]
    return out if eps is None else [eps, *out, 1 - eps]


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that a task run again gives the same."""
    text = F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def quantiles(value: Column | str, q: Sequence[float]) -> Column:
    """All quantiles of a group from one sort of it; linear between the order statistics."""
    return F.percentile(value, F.array(*map(F.lit, q)))


def nearest(x: Column, xq: Column, yq: Column) -> Column:
    """yq at the knot nearest to x; half-way the lower one; constant beyond the ends. xq is sorted."""
    middle = F.zip_with(F.slice(xq, 1, F.size(xq) - 1), F.slice(xq, 2, F.size(xq) - 1), lambda a, b: (a + b) / 2)
    return F.when(x.isNotNull(), F.get(yq, F.size(F.filter(middle, lambda m: m < x))))


def linear(x: Column, xq: Column, yq: Column, constant: bool = True) -> Column:
    """yq interpolated at x; beyond the ends its end values, or NULL."""
    below = F.size(F.filter(xq, lambda k: k <= x))
    i = F.greatest(F.lit(1), F.least(below, F.size(xq) - 1)) - 1
    x0, x1, y0, y1 = F.get(xq, i), F.get(xq, i + 1), F.get(yq, i), F.get(yq, i + 1)
    first, last = F.get(xq, F.lit(0)), F.get(xq, F.size(xq) - 1)
    inner = y0 + (x - x0) * F.coalesce(F.try_divide(y1 - y0, x1 - x0), F.lit(0.0))
    low, high = (F.get(yq, F.lit(0)), F.get(yq, F.size(yq) - 1)) if constant else (F.lit(None), F.lit(None))
    return F.when(x < first, low).when(x > last, high).when(x.isNotNull(), inner)


def cubic(x: Column, xq: Column, yq: Column, bend: Column, constant: bool = True) -> Column:
    """A cubic spline at x by its second derivatives at the knots; beyond the ends as linear()."""
    below = F.size(F.filter(xq, lambda k: k <= x))
    i = F.greatest(F.lit(1), F.least(below, F.size(xq) - 1)) - 1
    x0, x1, y0, y1, m0, m1 = (F.get(a, j) for a in (xq, yq, bend) for j in (i, i + 1))
    h, t = x1 - x0, x - x0
    inner = y0 + t * ((y1 - y0) / h - h * (2 * m0 + m1) / 6) + t * t * m0 / 2 + t * t * t * (m1 - m0) / (6 * h)
    low, high = (F.get(yq, F.lit(0)), F.get(yq, F.size(yq) - 1)) if constant else (F.lit(None), F.lit(None))
    return F.when(x < F.get(xq, F.lit(0)), low).when(x > F.get(xq, F.size(xq) - 1), high).when(x.isNotNull(), inner)


def to_additive(x: Column, lower: float, upper: float | None = None, trans: str = "log", clip: str | None = None) -> Column:
    """log: ln(x - lower); logit: ln(p / (1 - p)) of p = (x - lower) / (upper - lower); bounds give infinities.

    clip: None leaves bounds; "strict" moves values on a bound next to it (outside values raise);
    "permissive" also moves values beyond the bounds.
    """
    if clip not in (None, "strict", "permissive"):
        raise ValueError(f"clip is None, strict or permissive, not {clip!r}")
    if clip is not None:
        low = math.nextafter(lower, math.inf)
        high = None if upper is None else math.nextafter(upper, -math.inf)
        if clip == "strict":
            outside = (x < lower) | (F.lit(False) if upper is None else x > upper)
            x = F.when(outside, F.raise_error(F.lit("a value lies beyond the bounds")).cast("double")).otherwise(x)
        x = F.when(x <= lower, F.lit(low)).when(F.lit(high is not None) & (x >= F.lit(upper)), F.lit(high)).otherwise(x)
    if trans == "log":
        return F.when(x == lower, F.lit(-math.inf)).otherwise(F.ln(x - lower))
    if trans != "logit" or upper is None:
        raise ValueError("trans is log, or logit with an upper bound")
    p = (x - lower) / (upper - lower)
    return F.when(x == lower, F.lit(-math.inf)).when(x == upper, F.lit(math.inf)).otherwise(F.ln(p / (1 - p)))


def from_additive(y: Column, lower: float, upper: float | None = None, trans: str = "log") -> Column:
    if trans == "log":
        return F.exp(y) + lower
    if trans != "logit" or upper is None:
        raise ValueError("trans is log, or logit with an upper bound")
    return (upper - lower) / (1 + F.exp(-y)) + lower


def cos2_mask(alpha: Column, low: float, high: float) -> Column:
    """1 below low, 0 above high, a squared cosine between."""
    return F.when(alpha <= low, 1.0).when(alpha >= high, 0.0).otherwise(F.pow(F.cos((alpha - low) / (high - low) * (math.pi / 2)), 2))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres between two points given in degrees."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    across = F.pow(F.cos(b) * F.sin(d), 2) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), 2)
    return EARTH_KM * F.atan2(F.sqrt(across), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def circular_difference(sim: Column, ref: Column, period: int = 365) -> Column:
    """The shorter way round from ref to sim, with its sign."""
    d = F.pmod(sim - ref, F.lit(period))
    d = F.when(d > period / 2, period - d).otherwise(d)
    return F.when(ref >= sim, d).otherwise(-d)
