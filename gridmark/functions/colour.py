"""Colour arithmetic: packing, hue-saturation-value, luminance, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("int")


def red(rgb: Column) -> Column:
    return F.shiftright(rgb, 16)


def green(rgb: Column) -> Column:
    return F.shiftright(rgb, 8).bitwiseAND(F.lit(255))


def blue(rgb: Column) -> Column:
    return rgb.bitwiseAND(F.lit(255))


def as_rgb(channels: Column) -> Column:
    """Channel array of any length to three channels: grey repeats, extra channels are cut."""
    return F.when(F.size(channels) == 1, F.array_repeat(F.get(channels, F.lit(0)), 3)).otherwise(
        F.slice(channels, 1, 3))


def distance2(a: Column, b: Column) -> Column:
    """Squared RGB distance of two packed colours."""
    dr, dg, db = red(a) - red(b), green(a) - green(b), blue(a) - blue(b)
    return dr * dr + dg * dg + db * db


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees [0, 360), saturation and value in [0, 1], from 0-255 channels."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = (hi - lo).cast("double")
    sector = (F.when(hi == r, (g - b) / span).when(hi == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span))
    hue = F.when(span > 0, F.pmod(sector * 60, F.lit(360.0))).otherwise(F.lit(0.0))
    return {"h": hue, "s": F.when(hi > 0, span / hi).otherwise(F.lit(0.0)), "v": hi / F.lit(255.0)}


def hsv_bytes(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The 8-bit convention: hue 0-179, saturation and value 0-255, halves rounded up exactly."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo

    def half_up(numerator: Column, denominator: Column) -> Column:
        return F.floor((numerator * 2 + denominator) / (denominator * 2)).cast("int")

    hue = (F.when(hi == r, half_up((g - b) * 30, span)).when(hi == g, half_up((b - r) * 30, span) + 60)
           .otherwise(half_up((r - g) * 30, span) + 120))
    return {"h": F.when(span > 0, F.pmod(hue, F.lit(180))).otherwise(F.lit(0)),
            "s": F.when(hi > 0, half_up(span * 255, hi)).otherwise(F.lit(0)), "v": hi.cast("int")}


def luminance(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 grey in integer arithmetic (weights 19595, 38470, 7471 over 65536, rounded)."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def channel_mean(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def in_window(h: Column, s: Column, v: Column, lower: Column, upper: Column) -> Column:
    """Inside an HSV window (bounds cut to whole bytes); a hue with low end above high end wraps."""
    lo = [F.floor(F.get(lower, F.lit(i))) for i in range(3)]
    hi = [F.floor(F.get(upper, F.lit(i))) for i in range(3)]
    hue = F.when(lo[0] > hi[0], (h >= lo[0]) | (h <= hi[0])).otherwise(h.between(lo[0], hi[0]))
    return hue & s.between(lo[1], hi[1]) & v.between(lo[2], hi[2])


def scale_window(lower: Column, upper: Column, factor: float) -> dict[str, Column]:
    """Widen or tighten about the centre; hue clips to [0, 179], the rest to [0, 255]."""
    centre = F.zip_with(lower, upper, lambda a, b: (a + b) / 2)
    half = F.zip_with(lower, upper, lambda a, b: (b - a) / 2 * factor)
    top = F.array(F.lit(179.0), F.lit(255.0), F.lit(255.0))

    def clip(raw: Column) -> Column:
        return F.zip_with(raw, top, lambda v, t: F.greatest(F.lit(0.0), F.least(v, t)))

    return {"lower": clip(F.zip_with(centre, half, lambda c, k: c - k)),
            "upper": clip(F.zip_with(centre, half, lambda c, k: c + k))}


def dark(grey: Column, threshold: float) -> Column:
    """Two-value label of a grey cut: 1 below the threshold."""
    return F.when(grey < threshold, 1).otherwise(0)
