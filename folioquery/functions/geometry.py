"""Points, rectangles and affine matrices as Column expressions over structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    """From any two opposite corners."""
    c = [F.lit(v) if not isinstance(v, Column) else v for v in (x0, y0, x1, y1)]
    return F.struct(F.least(c[0], c[2]).alias("x0"), F.least(c[1], c[3]).alias("y0"), F.greatest(c[0], c[2]).alias("x1"), F.greatest(c[1], c[3]).alias("y1"))


def rect_of(values: Column) -> Column:
    """From an array of four numbers."""
    return rect(values[0], values[1], values[2], values[3])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def is_empty(r: Column) -> Column:
    return (width(r) <= 0) | (height(r) <= 0)


def intersect(a: Column, b: Column) -> Column:
    """May be inverted, and then is empty."""
    return F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))


def union(a: Column, b: Column) -> Column:
    """An empty one adds nothing."""
    both = F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def area(r: Column) -> Column:
    return F.when(is_empty(r), F.lit(0.0)).otherwise(width(r) * height(r))


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def translation(x, y) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scaling(x, y) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def concat(m: Column, n: Column) -> Column:
    """m first, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def apply_vector(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y).alias("x"), (m["b"] * x + m["d"] * y).alias("y"))


def apply_rect(m: Column, r: Column) -> Column:
    """The bounds of the four corners."""
    p = [apply(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    return F.struct(F.least(*[q["x"] for q in p]).alias("x0"), F.least(*[q["y"] for q in p]).alias("y0"), F.greatest(*[q["x"] for q in p]).alias("x1"), F.greatest(*[q["y"] for q in p]).alias("y1"))


def rotation(m: Column) -> Column:
    return F.atan2(m["b"], m["a"])


def x_scale(m: Column) -> Column:
    return F.hypot(m["a"], m["b"])


def y_scale(m: Column) -> Column:
    return F.hypot(m["c"], m["d"])


def invert(m: Column) -> Column:
    """Null where the determinant is about 0."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    inv = matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when(F.abs(det) >= 1e-12, inv)
