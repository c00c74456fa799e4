"""Box and image-size arithmetic as Column expressions. Boxes are (x0, y0, x1, y1), half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def unclip(x0: Column, y0: Column, x1: Column, y1: Column, ratio: float, max_w: Column, max_h: Column) -> Column:
    """A shrunken text box grown back by area * ratio / perimeter on every side."""
    w, h = x1 - x0, y1 - y0
    d = F.when(w + h > 0, w * h * ratio / (2.0 * (w + h))).otherwise(0.0)
    return F.struct(clamp(x0 - d, 0, max_w).alias("x0"), clamp(y0 - d, 0, max_h).alias("y0"), clamp(x1 + d, 0, max_w).alias("x1"), clamp(y1 + d, 0, max_h).alias("y1"))


def scale_to(x0: Column, y0: Column, x1: Column, y1: Column, sx: Column, sy: Column, max_w: Column, max_h: Column) -> Column:
    """Back to source pixels: the least corner down, the greatest up."""
    down, up = (lambda v, s: F.floor(v / s).cast("double")), (lambda v, s: F.ceil(v / s).cast("double"))
    return F.struct(
        clamp(down(x0, sx), 0, max_w).alias("x0"), clamp(down(y0, sy), 0, max_h).alias("y0"), clamp(up(x1, sx), 0, max_w).alias("x1"), clamp(up(y1, sy), 0, max_h).alias("y1")
    )


def aspect_width(width: Column, height: Column, to_height: int, most: int) -> Column:
    """Width at another height, rounded up, 1 to most."""
    return F.least(F.greatest(F.when(height > 0, F.ceil(width * to_height / height)).otherwise(F.lit(1)), F.lit(1)), F.lit(most)).cast("int")


def round_to_32(n: Column) -> Column:
    """The nearest multiple of 32, 32 at least."""
    return F.greatest(F.floor((n + 16) / 32) * 32, F.lit(32)).cast("int")


def detector_size(width: Column, height: Column, limit: int) -> Column:
    """(w, h, scale_x, scale_y): the longest side within limit, both sides rounded to 32."""
    longest = F.greatest(width, height)
    ratio = F.when(longest > limit, F.lit(float(limit)) / longest).otherwise(1.0)
    w, h = round_to_32(F.round(width * ratio)), round_to_32(F.round(height * ratio))
    return F.struct(w.alias("w"), h.alias("h"), (w / width).alias("scale_x"), (h / height).alias("scale_y"))
