"""Colours and pixel columns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 1), saturation and value of channels from 0 to 255; grey has hue 0."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = most - least
    sixths = F.when(most == r, (g - b) / span).when(most == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(sixths / 6, F.lit(1.0)))
    return hue, F.when(most == 0, F.lit(0.0)).otherwise(span / most), most / 255


def packed_bits(rows: Column) -> Column:
    """An array of booleans, the first of them as bit 0, as a number."""
    bits = F.transform(rows, lambda on, k: F.when(on, F.call_function("shiftleft", F.lit(1), k)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, x: a.bitwiseOR(x))


def upper_median(values: Column) -> Column:
    """Of an array: the middle value, the greater of two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)
