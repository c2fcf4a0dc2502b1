"""Colors: parsing for the parser pass, and contrast as column expressions."""

from __future__ import annotations

import re
from math import floor

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: color names that are understood, as hexadecimal
NAMED = dict(
    x.split("=")
    for x in """
black=000000 white=ffffff red=ff0000 green=008000 blue=0000ff yellow=ffff00 orange=ffa500
purple=800080 gray=808080 grey=808080 silver=c0c0c0 maroon=800000 olive=808000 lime=00ff00
aqua=00ffff cyan=00ffff teal=008080 navy=000080 fuchsia=ff00ff magenta=ff00ff pink=ffc0cb
brown=a52a2a gold=ffd700 indigo=4b0082 violet=ee82ee beige=f5f5dc ivory=fffff0 khaki=f0e68c
salmon=fa8072 tan=d2b48c crimson=dc143c coral=ff7f50 turquoise=40e0d0 lavender=e6e6fa
plum=dda0dd orchid=da70d6 whitesmoke=f5f5f5 lightgray=d3d3d3 lightgrey=d3d3d3 darkgray=a9a9a9
darkgrey=a9a9a9 dimgray=696969 slategray=708090 slategrey=708090 lightblue=add8e6
darkblue=00008b skyblue=87ceeb steelblue=4682b4 royalblue=4169e1 dodgerblue=1e90ff
darkgreen=006400 lightgreen=90ee90 forestgreen=228b22 seagreen=2e8b57 darkred=8b0000
firebrick=b22222 tomato=ff6347 goldenrod=daa520 chocolate=d2691e linen=faf0e6 snow=fffafa
azure=f0ffff ghostwhite=f8f8ff aliceblue=f0f8ff honeydew=f0fff0 mintcream=f5fffa
seashell=fff5ee oldlace=fdf5e6 gainsboro=dcdcdc lightsteelblue=b0c4de midnightblue=191970
darkslategray=2f4f4f
""".split()
)
Color = tuple[float, float, float, float]


def half_up(x: float) -> int:
    return floor(x + 0.5)


def number(text: str) -> float | None:
    m = re.match(r"[+-]?(\d+\.?\d*|\.\d+)", text)
    return float(m[0]) if m else None


def parse_color(text: str | None) -> Color | None:
    """(r, g, b, a) of a literal color; None for what only a browser could resolve."""
    value = (text or "").strip().lower()
    if value == "transparent":
        return 0, 0, 0, 0
    digits = NAMED.get(value) or (value[1:] if value.startswith("#") else None)
    if digits is not None:
        if len(digits) in (3, 4):
            digits = "".join(c + c for c in digits)
        if not re.fullmatch(r"[0-9a-f]{6}([0-9a-f]{2})?", digits):
            return None
        r, g, b, a = (int((digits + "ff")[i : i + 2], 16) for i in (0, 2, 4, 6))
        return r, g, b, a / 255
    m = re.fullmatch(r"(rgb|hsl)a?\(([^)]+)\)", value)
    if not m:
        return None
    parts = [p for p in re.split(r"[,/\s]+", m[2]) if p]
    values = [number(p) for p in parts[:4]]
    if len(parts) < 3 or None in values:
        return None
    alpha = min(max(values[3] / (100 if parts[3].endswith("%") else 1), 0), 1) if len(parts) > 3 else 1
    if m[1] == "rgb":
        scaled = [half_up(v * 2.55) if p.endswith("%") else v for p, v in zip(parts, values[:3], strict=False)]
        r, g, b = (min(max(v, 0), 255) for v in scaled)
        return r, g, b, alpha
    import colorsys

    hue, sat, light = values[0] % 360 / 360, *(min(max(v / 100, 0), 1) for v in values[1:3])
    r, g, b = (half_up(c * 255) for c in colorsys.hls_to_rgb(hue, light, sat))
    return r, g, b, alpha


def over(top: Color, under: Color) -> Color:
    """A color laid over an opaque one."""
    a = top[3]
    if a >= 1:
        return (*top[:3], 1)
    r, g, b = (half_up(x * a + y * (1 - a)) for x, y in zip(top[:3], under[:3], strict=True))
    return r, g, b, 1


def hex_of(color: Color) -> str:
    return "#" + "".join(f"{half_up(c):02x}" for c in color[:3])


def channel(hexa: Column, i: int) -> Column:
    return F.conv(F.substring(hexa, 2 + 2 * i, 2), 16, 10).cast("double")


def _linear(v: Column) -> Column:
    s = v / 255
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance_of(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * _linear(r) + 0.7152 * _linear(g) + 0.0722 * _linear(b)


def luminance(hexa: Column) -> Column:
    """Relative luminance of #rrggbb."""
    return luminance_of(channel(hexa, 0), channel(hexa, 1), channel(hexa, 2))


def ratio_of(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def contrast_ratio(front: Column, back: Column) -> Column:
    return ratio_of(luminance(front), luminance(back))


def required_ratio(px: Column, bold: Column, level: str = "AA") -> Column:
    large = (px >= 24) | (bold & (px >= 18.66))
    return F.when(large, 4.5 if level == "AAA" else 3.0).otherwise(7.0 if level == "AAA" else 4.5)


def suggested_color(front: Column, back: Column, target: Column) -> Column:
    """The first of a hundred steps away from the background that reaches the target, else null.

    The colors are taken apart once for all steps, and the steps looked
    through once for all channels: values in arrays of one, as Spark repeats
    an expression wherever it stands.
    """

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def moved(x: Column, name: str, step: Column) -> Column:
        c = x[name]
        return F.floor(F.when(x["light"] > 0.5, c * (1 - step / 100)).otherwise(c + (255 - c) * step / 100) + 0.5)

    def first_good(x: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda s: F.struct(*(moved(x, k, s).alias(k) for k in "rgb")))
        return F.get(F.filter(steps, lambda s: once(luminance_of(s["r"], s["g"], s["b"]), lambda lum: ratio_of(lum, x["light"]) >= x["target"])), 0)

    two = lambda v: F.lower(F.lpad(F.hex(v.cast("long")), 2, "0"))
    spelled = lambda best: F.when(best.isNotNull(), F.concat(F.lit("#"), *(two(best[k]) for k in "rgb")))
    known = F.struct(*(channel(front, i).alias(k) for i, k in enumerate("rgb")), luminance(back).alias("light"), target.alias("target"))
    return once(once(known, first_good), spelled)


def computed(value: Column) -> Column:
    """struct(r, g, b, a) of a computed ``rgb()`` or ``rgba()`` value; null for others."""
    parts = F.transform(F.regexp_extract_all(value, F.lit(r"([0-9]*\.?[0-9]+)"), 1), lambda x: x.try_cast("double"))
    alpha = F.least(F.coalesce(F.get(parts, 3), F.lit(1.0)), F.lit(1.0))
    found = F.struct(*(F.get(parts, i).alias(k) for i, k in enumerate("rgb")), alpha.alias("a"))
    return F.when(value.rlike(r"(?i)^\s*rgba?\(") & (F.size(parts) >= 3), found)


def nearest_backdrop(backgrounds: Column) -> Column:
    """Of the backgrounds from an element outwards, the first of over 95 % opacity; white where none is."""
    opaque = F.filter(backgrounds, lambda b: F.coalesce(computed(b)["a"] > 0.95, F.lit(False)))
    return F.coalesce(F.get(opaque, 0), F.lit("rgb(255, 255, 255)"))


def painted(color: str, background: str, opacity: Column) -> tuple[Column, Column]:
    """Hexadecimal text color and backdrop as seen: the backdrop over white, the text, with its opacity, over the backdrop."""
    front, back = computed(F.col(color)), computed(F.col(background))
    alpha = front["a"] * F.when(opacity < 1, opacity).otherwise(1.0)

    def mixed(top: Column, under: Column, a: Column) -> Column:
        return F.when(a >= 1, top).otherwise(F.floor(top * a + under * (1 - a) + 0.5))

    def spelled(channels: list[Column]) -> Column:
        return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.floor(v + 0.5).cast("long")), 2, "0")) for v in channels))

    return spelled([mixed(front[k], back[k], alpha) for k in "rgb"]), spelled([mixed(back[k], F.lit(255.0), back["a"]) for k in "rgb"])
