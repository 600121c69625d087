"""Units of columns: parsing, conversion factors, sampling steps. Factors are worked out on the driver, conversion is one expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factor to base units, offset, and powers of metre, kilogram, second, kelvin.
UNITS = {
    "1": (1.0, 0.0, (0, 0, 0, 0)), "": (1.0, 0.0, (0, 0, 0, 0)), "%": (0.01, 0.0, (0, 0, 0, 0)),
    "m": (1.0, 0.0, (1, 0, 0, 0)), "mm": (1e-3, 0.0, (1, 0, 0, 0)), "cm": (1e-2, 0.0, (1, 0, 0, 0)), "km": (1e3, 0.0, (1, 0, 0, 0)),
    "kg": (1.0, 0.0, (0, 1, 0, 0)), "g": (1e-3, 0.0, (0, 1, 0, 0)),
    "s": (1.0, 0.0, (0, 0, 1, 0)), "min": (60.0, 0.0, (0, 0, 1, 0)), "h": (3600.0, 0.0, (0, 0, 1, 0)), "d": (86400.0, 0.0, (0, 0, 1, 0)), "day": (86400.0, 0.0, (0, 0, 1, 0)), "days": (86400.0, 0.0, (0, 0, 1, 0)), "week": (604800.0, 0.0, (0, 0, 1, 0)), "yr": (31557600.0, 0.0, (0, 0, 1, 0)),
    "K": (1.0, 0.0, (0, 0, 0, 1)), "degC": (1.0, 273.15, (0, 0, 0, 1)), "degF": (5 / 9, 459.67 * 5 / 9, (0, 0, 0, 1)),
    "Pa": (1.0, 0.0, (-1, 1, -2, 0)), "hPa": (100.0, 0.0, (-1, 1, -2, 0)), "kPa": (1000.0, 0.0, (-1, 1, -2, 0)), "J": (1.0, 0.0, (2, 1, -2, 0)), "W": (1.0, 0.0, (2, 1, -3, 0)), "N": (1.0, 0.0, (1, 1, -2, 0)),
}
#: Mass of water over an area against its depth: kg m-2 is a mm.
WATER = 1e-3


@dataclass(frozen=True)
class Unit:
    factor: float
    offset: float
    powers: tuple[int, int, int, int]


def parse(text: str) -> Unit:
    """`kg m-2 s-1`, `mm/d`, `m^3/kg`, `degC`; an offset holds for a unit that stands alone."""
    text = text.strip()
    if text in UNITS:
        return Unit(*UNITS[text])
    factor, powers = 1.0, [0, 0, 0, 0]
    for sign, part in zip([1] + [-1] * text.count("/"), text.split("/")):
        for token in part.replace("*", " ").split():
            m = re.fullmatch(r"([A-Za-z%]+|1)(?:\^|\*\*)?(-?\d+)?", token)
            if not m or m[1] not in UNITS:
                raise ValueError(f"unknown unit {token!r} in {text!r}")
            own, _, dims = UNITS[m[1]]
            power = sign * int(m[2] or 1)
            factor *= own**power
            powers = [p + power * d for p, d in zip(powers, dims)]
    return Unit(factor, 0.0, tuple(powers))


def conversion(source: str, target: str) -> tuple[float, float]:
    """(a, b) of target = a x + b; water fluxes pass between mass over area and depth."""
    a, b = parse(source), parse(target)
    if a.powers != b.powers:
        mass = tuple(p - q for p, q in zip(a.powers, b.powers))
        if mass == (-3, 1, 0, 0):
            a = Unit(a.factor * WATER, 0.0, b.powers)
        elif mass == (3, -1, 0, 0):
            a = Unit(a.factor / WATER, 0.0, b.powers)
        else:
            raise ValueError(f"{source!r} and {target!r} measure different things")
    return a.factor / b.factor, (a.offset - b.offset) / b.factor


def convert(x: Column, source: str, target: str) -> Column:
    a, b = conversion(source, target)
    return x if (a, b) == (1.0, 0.0) else x * a + b


def quantity(text: str, target: str) -> float:
    """`"1 mm d-1"` as a number of target units."""
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*)", text)
    if not m:
        raise ValueError(f"no number in {text!r}")
    a, b = conversion(m[2], target)
    return float(m[1]) * a + b


def harmonised(units: list[str | None]) -> str | None:
    """The first unit, if all have one and all convert to it; None if none has."""
    if all(u is None for u in units):
        return None
    if any(u is None for u in units):
        raise ValueError("either all or none of the series have units")
    for u in units[1:]:
        conversion(u, units[0])
    return units[0]


def sampling(df: DataFrame, by: list[str] | None = None, time: str = "time") -> tuple[int, str]:
    """(n, unit) of the most frequent step."""
    step = F.unix_timestamp(F.col(time).cast("timestamp")) - F.lag(F.unix_timestamp(F.col(time).cast("timestamp"))).over(Window.partitionBy(*(by or [])).orderBy(time))
    row = df.select(step.alias("step")).where("step > 0").groupBy("step").count().orderBy(F.desc("count"), "step").first()
    if row is None:
        raise ValueError("a step needs two times")
    for unit, size in (("d", 86400), ("h", 3600), ("min", 60), ("s", 1)):
        if row[0] % size == 0:
            return row[0] // size, unit
    raise AssertionError


def to_wavenumber(wavelength: Column, delta: float) -> Column:
    """Normalised wavenumber of a wavelength on a grid of that spacing."""
    return 2 * delta / wavelength


def to_wavelength(alpha: Column, delta: float) -> Column:
    return 2 * delta / alpha


#: Temperature is told on its scale or as a difference.
TEMPERATURE = (0, 0, 0, 1)


def symbol(text: str) -> str:
    """A unit as symbols with signed powers: `mm/d` is `mm d-1`."""
    out = []
    for sign, part in zip([1] + [-1] * text.count("/"), text.strip().split("/")):
        for token in part.replace("*", " ").split():
            m = re.fullmatch(r"(?:delta_)?([A-Za-z%]+|1)(?:\^|\*\*)?(-?\d+)?", token)
            if not m or m[1] not in UNITS:
                raise ValueError(f"unknown unit {token!r} in {text!r}")
            power = sign * int(m[2] or 1)
            if m[1] != "1":
                out.append(m[1] + ("" if power == 1 else str(power)))
    return " ".join(out) or "1"


def cf_attributes(text: str, is_difference: bool | None = None) -> dict[str, str]:
    """Attributes of a unit: `units`, and for temperatures whether they are on a scale or differences."""
    if "delta_" in text:
        is_difference = True
    out = {"units": symbol(text)}
    if parse(out["units"]).powers == TEMPERATURE:
        out["units_metadata"] = "temperature: " + {True: "difference", False: "on_scale", None: "unknown"}[is_difference]
    return out


def product(x: Column, unit: str, quantity_text: str, target: str | None = None) -> tuple[Column, str]:
    """A column in some unit times a quantity: the column, and its unit, the target if one is given."""
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*)", quantity_text)
    if not m:
        raise ValueError(f"no number in {quantity_text!r}")
    own = symbol(f"{symbol(unit)} {symbol(m[2] or '1')}")
    out = x * float(m[1])
    return (out, own) if target is None else (convert(out, own, target), target)


def harmonise(frames: list[DataFrame], value: str = "value") -> list[DataFrame]:
    """Frames whose values are all in the unit of the first, as their metadata tell; none of them may lack one that others have."""
    found = [df.schema[value].metadata.get("units") for df in frames]
    unit = harmonised(found)
    return [df if u == unit else df.withColumn(value, convert(F.col(value), u, unit).alias(value, metadata={**df.schema[value].metadata, "units": unit})) for df, u in zip(frames, found)]
