"""Colours: gradients and cyclic palettes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.scalars import hex_byte, number_text, round_half_up


def rgb(color: str) -> tuple[int, int, int]:
    """Channels of ``#rrggbb``, white or black."""
    color = {"white": "#ffffff", "black": "#000000"}.get(color, color)
    return int(color[1:3], 16), int(color[3:5], 16), int(color[5:7], 16)


def rgba(color: Column, alpha: float) -> Column:
    """``#rrggbb``, white or black as ``rgba(r, g, b, a)``; an rgba text stays."""
    full = F.when(color == "white", "#ffffff").when(color == "black", "#000000").otherwise(color)
    parts = [F.conv(F.substring(full, k, 2), 16, 10) for k in (2, 4, 6)]
    text = F.concat(F.lit("rgba("), F.concat_ws(", ", *parts, number_text(F.lit(alpha))), F.lit(")"))
    return F.when(color.startswith("rgba"), color).otherwise(text)


def grey(intensity: Column, alpha: float) -> Column:
    """A grey of an intensity from 0 to 1."""
    level = number_text(round_half_up(intensity * 255))
    return F.concat(F.lit("rgba("), F.concat_ws(", ", level, level, level, number_text(F.lit(alpha))), F.lit(")"))


def parse_gradient(text: str) -> list[tuple[str, float]]:
    """``color stop, color stop`` with stops as numbers or percents, in given order."""
    stops = []
    for part in text.split(","):
        color, _, stop = part.strip().rpartition(" ")
        stops.append((color, float(stop[:-1]) / 100 if stop.endswith("%") else float(stop)))
    return stops


def css_gradient(stops: list[tuple[str, float]]) -> str:
    """Stops as a CSS list."""
    return ", ".join(f"{c} {s * 100:g}%" for c, s in stops)


def gradient(value: Column, stops: list[tuple[str, float]]) -> Column:
    """The colour at a value, linear between stops (channels rounded down); the last colour above, the first below."""
    out = F.lit(stops[-1][0])
    for (c0, s0), (c1, s1) in reversed(list(zip(stops, stops[1:]))):
        share = (value - s0) / (s1 - s0) if s1 > s0 else F.lit(0.0)
        mixed = F.concat(F.lit("#"), *(hex_byte(F.floor(a + (b - a) * share)) for a, b in zip(rgb(c0), rgb(c1))))
        out = F.when(value < s1, mixed).otherwise(out)
    return F.when(value < stops[0][1], F.lit(stops[0][0])).otherwise(out)


def cyclic_color(index: Column, colors: list[str], zero: str = "GhostWhite") -> Column:
    """Colour number ``index`` from 1, starting over after the last; 0 has its own."""
    return F.when(index == 0, F.lit(zero)).otherwise(F.get(F.array(*map(F.lit, colors)), F.pmod(index - 1, F.lit(len(colors))).cast("int")))


def hue_palette(n: int) -> list[str]:
    """``n`` colours around the hue circle, by rule."""
    import colorsys

    return ["#" + "".join(f"{int(255 * c):02x}" for c in colorsys.hls_to_rgb(k / n, 0.55, 0.6)) for k in range(n)]
