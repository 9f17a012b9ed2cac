"""Column functions with exact rounding, clamping and integer rules. All stay inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_extend(v: Column, bits: int) -> Column:
    """The lowest `bits` bits read as a two's complement number."""
    return F.shiftright(F.shiftleft(v.cast("int"), 32 - bits), 32 - bits)


def fixed16(raw: Column) -> Column:
    return raw / F.lit(65536.0)


def fixed8(raw: Column) -> Column:
    return raw / F.lit(256.0)


def float16(raw: Column) -> Column:
    """Half-precision bits (binary16, with a bias of 15) as a double, infinities and NaN included."""
    sign = F.when(raw.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(raw, 10).bitwiseAND(0x1F)
    fraction = raw.bitwiseAND(0x3FF).cast("double")
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = fraction * 2.0**-24
    return sign * F.when(exponent == 31, special).when(exponent == 0, small).otherwise((1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15))


def float16_special(raw: Column) -> Column:
    """'none', 'inf' or 'nan' for half-precision bits."""
    return F.when(F.shiftright(raw, 10).bitwiseAND(0x1F) != 31, "none").when(raw.bitwiseAND(0x3FF) == 0, "inf").otherwise("nan")


def round_away(x: Column) -> Column:
    """Half away from zero, with no negative zero."""
    return F.round(x).cast("long")


def round_even(x: Column) -> Column:
    """Half to even."""
    return F.rint(x).cast("long")


def round_up(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5).cast("long")


def rounded_div(n: Column, d: Column) -> Column:
    """Integer division to nearest, symmetric about zero."""
    q = F.floor((F.abs(n) + F.floor(d / 2)) / d).cast("long")
    return F.when(n < 0, -q).otherwise(q)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def colour_transform(c: Column, mult: Column, add: Column) -> Column:
    """A channel times a 8.8 factor plus an offset, rounded half up and held to a byte."""
    return clamp(round_up(c * mult / 256 + add), 0, 255)


def blend(source: Column, alpha: Column, target: Column) -> Column:
    """Source over target for one channel, rounded half to even, as a clamped byte array does."""
    return clamp(round_even((source * alpha + target * (255 - alpha)) / 255.0), 0, 255)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """(1 - t) a + t b, exact at both ends."""
    return F.when(t == 0, a).when(t == 1, b).otherwise((1 - t) * a + t * b)


def next_pow2(n: Column, cap: int) -> Column:
    """The smallest power of two that is at least n, held to `cap`."""
    out = F.lit(cap)
    p = cap // 2
    while p >= 1:
        out = F.when(n <= p, F.lit(p)).otherwise(out)
        p //= 2
    return out


def spread(t: Column, mode: str) -> Column:
    """A gradient position outside [0, 1] padded, reflected or repeated."""
    if mode == "pad":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    if mode == "repeat":
        return t - F.floor(t)
    folded = t - 2 * F.floor(t / 2)
    return F.when(folded > 1, 2 - folded).otherwise(folded)


def affine(a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point (x, y) under the matrix [a c tx; b d ty]."""
    return a * x + c * y + tx, b * x + d * y + ty


def transformed_rect(a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column, Column]:
    """The upright rectangle around the four transformed corners."""
    x0, y0, x1, y1 = box
    xs, ys = zip(*[affine(a, b, c, d, tx, ty, x, y) for x in (x0, x1) for y in (y0, y1)], strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def distance_to_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the line through a and b; from a itself where these are one point."""
    length = F.hypot(bx - ax, by - ay)
    across = F.abs((px - ax) * (by - ay) - (py - ay) * (bx - ax))
    return F.when(length == 0, F.hypot(px - ax, py - ay)).otherwise(F.try_divide(across, length))


def segments(deviation: Column, tolerance: float = 0.1, most: int = 8) -> Column:
    """Line segments for a curve: 1 within the tolerance, else the root of deviation over tolerance, from 2 to `most`.

    A quadratic's deviation is half its control point's distance from the line between its ends; a tolerance that is not
    positive counts as 0.1.
    """
    tolerance = tolerance if tolerance > 0 else 0.1
    return F.when(deviation <= tolerance, 1).otherwise(F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.sqrt(deviation / tolerance))))).cast("int")


def srgb_to_linear(c: Column) -> Column:
    """A channel byte from the sRGB curve to linear light in [0, 1]."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    """The other way round: linear light, held to [0, 1], as a channel byte rounded half up."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return round_up(255 * F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)).cast("int")


def morph(a: Column, b: Column, ratio: Column) -> Column:
    """A coordinate between two shapes at a ratio of 0 to 65535, rounded half to even and exact at both ends."""
    t = ratio / 65535.0
    return round_even(lerp(a.cast("double"), b.cast("double"), t))
