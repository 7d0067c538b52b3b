"""Colour conversions and predicates as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of a struct of values, each of which is computed once however often f names it (columns are otherwise copied into every use)."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), f)[0]


def _converted(r: Column, g: Column, b: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    def with_extremes(c: Column) -> Column:
        return bound({"r": c.r, "g": c.g, "b": c.b, "top": F.greatest(c.r, c.g, c.b), "low": F.least(c.r, c.g, c.b)}, from_range)

    def from_range(c: Column) -> Column:
        d = c.top - c.low
        turn = F.when(c.top == c.r, F.pmod(60.0 * ((c.g - c.b) / d) + 360.0, F.lit(360.0))).when(c.top == c.g, 60.0 * ((c.b - c.r) / d) + 120.0).otherwise(60.0 * ((c.r - c.g) / d) + 240.0)
        parts = {"h": F.when(d == 0, 0.0).otherwise(turn), "s": F.when(c.top == 0, 0.0).otherwise(d / c.top), "v": c.top}
        return bound(parts, lambda x: f(x.h, x.s, x.v))

    return bound({"r": r / 255.0, "g": g / 255.0, "b": b / 255.0}, with_extremes)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees (0 for grey), saturation and value of 0..255 colours."""
    return tuple(_converted(r, g, b, lambda *x, i=i: x[i]) for i in range(3))


def is_sky(r: Column, g: Column, b: Column, hue: tuple[float, float] = (180.0, 250.0), saturation: tuple[float, float] = (0.2, 0.8), value: float = 0.3) -> Column:
    """Whether a colour is dropped by the mask: blue hue, saturation outside its range, or dark."""
    return _converted(r, g, b, lambda h, s, v: ((h > hue[0]) & (h < hue[1])) | (s < saturation[0]) | (s > saturation[1]) | (v < value))


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(0.0)


def gli(r: Column, g: Column, b: Column) -> Column:
    """Green leaf index."""
    return _ratio(2.0 * g - r - b, 2.0 * g + r + b)


def ngrdi(r: Column, g: Column) -> Column:
    """Normalised green-red difference."""
    return _ratio(g - r, g + r)


def exr(r: Column, g: Column, b: Column) -> Column:
    """Excess red scaled to about 0..1; a black cell has (0 + 1) / 2.4."""
    s = r + g + b
    return ((1.4 * r - g) / F.when(s == 0, 1.0).otherwise(s) + 1.0) / 2.4


def brightness(*channels: Column) -> Column:
    """Length of the vector of all channels."""
    total = F.lit(0.0)
    for c in channels:
        total = total + c * c
    return F.sqrt(total)


def brightness_of(vector: Column) -> Column:
    """``brightness`` of the elements of an array."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
