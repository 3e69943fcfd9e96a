"""Colours as column expressions over 0-255 channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_code(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def hsv_l(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue (0-1), saturation and value of HSV, lightness of HLS."""
    x, y, z = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    span = top - low
    h = F.when(span == 0, 0.0).when(top == x, ((y - z) / span) % 6.0).when(top == y, (z - x) / span + 2.0).otherwise((x - y) / span + 4.0)
    h = F.when(h < 0, h + 6.0).otherwise(h) / 6.0
    return {"h": h, "s": F.when(top == 0, 0.0).otherwise(span / top), "v": top, "l": (top + low) / 2.0}


def chromatic(parts: dict[str, Column]) -> Column:
    return (parts["s"] >= 0.60) & (parts["v"] >= 0.50) & (parts["l"] <= 0.70)
