"""Vector arithmetic on arrays and 3-D geometry on structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.keys import col

XYZ = ("x", "y", "z")


# --- arrays -----------------------------------------------------------------

def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda p, q: p * q))


def norm2(a) -> Column:
    return total(F.transform(col(a), lambda p: p * p))


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def abs_sum(a) -> Column:
    return total(F.transform(col(a), lambda p: F.abs(p)))


def max_abs(a) -> Column:
    return F.array_max(F.transform(col(a), lambda p: F.abs(p)))


def distance2(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda p, q: (p - q) * (p - q)))


def distance(a, b) -> Column:
    return F.sqrt(distance2(a, b))


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda p, q: p + q)


def sub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda p, q: p - q)


def scale(a, k: float) -> Column:
    return F.transform(col(a), lambda p: p * k)


def constant(n, c: float) -> Column:
    return F.array_repeat(F.lit(float(c)), n)


def to_unit_interval(lo, width) -> tuple[Column, Column]:
    """Slope and offset that map [lo, lo + width] to [0, 1]; a flat interval maps to 0."""
    k = F.when(col(width) > 1e-20, F.lit(1.0) / col(width)).otherwise(0.0)
    return k, -k * col(lo)


def every(a, d: int) -> Column:
    """Last element of each full stretch of d."""
    n = F.floor(F.size(col(a)) / d).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(col(a), i * d))).otherwise(
        F.slice(col(a), 1, 0))


# --- structs ----------------------------------------------------------------

def vec3(x, y, z) -> Column:
    return F.struct(*[col(c).alias(n) for c, n in zip((x, y, z), XYZ)])


def _each(fn) -> Column:
    return F.struct(*[fn(n).alias(n) for n in XYZ])


def dot3(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross3(a: Column, b: Column) -> Column:
    nxt = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    return _each(lambda n: a[nxt[n][0]] * b[nxt[n][1]] - a[nxt[n][1]] * b[nxt[n][0]])


def norm3(a: Column) -> Column:
    return F.sqrt(dot3(a, a))


def unit3(a: Column) -> Column:
    n = norm3(a)
    return _each(lambda k: F.when(n > 1e-12, a[k] / n).otherwise(0.0))


def reflect3(v: Column, n: Column) -> Column:
    """Mirror image of v at a surface with unit normal n."""
    d = dot3(v, n) * 2.0
    return _each(lambda k: v[k] - n[k] * d)


def refract3(v: Column, n: Column, eta: float) -> Column:
    """Direction after a surface with index ratio eta; unchanged on total reflection."""
    d = dot3(v, n)
    k = F.lit(1.0) - (F.lit(1.0) - d * d) * (eta * eta)
    bend = d * eta + F.sqrt(F.greatest(k, F.lit(0.0)))
    return _each(lambda c: F.when(k < 0, v[c]).otherwise(v[c] * eta - n[c] * bend))


def segment_distance2(p: tuple, a: tuple, b: tuple) -> Column:
    """Squared distance of a 2-D point to the line through a segment, or to its nearer
    end when the foot lies outside."""
    px, py = (col(c) for c in p)
    (ax, ay), (bx, by) = ((F.lit(float(c)) for c in q) for q in (a, b))
    ux, uy = bx - ax, by - ay
    wx, wy = px - ax, py - ay
    len2 = ux * ux + uy * uy
    t = F.greatest(F.least((wx * ux + wy * uy) / F.when(len2 > 0, len2), F.lit(1.0)), F.lit(0.0))
    t = F.coalesce(t, F.lit(0.0))
    dx, dy = wx - ux * t, wy - uy * t
    return dx * dx + dy * dy


def stereographic(p, q) -> tuple[Column, Column]:
    """Gradient (p, q) to the stereographic plane."""
    r = F.lit(1.0) + F.sqrt(F.lit(1.0) + col(p) * col(p) + col(q) * col(q))
    return col(p) / r, col(q) / r


def stereographic_inverse(f, g) -> tuple[Column, Column]:
    r = col(f) * col(f) + col(g) * col(g) - 1.0
    back = lambda c: F.when(F.abs(r) < 1e-12, 0.0).otherwise(col(c) * -2.0 / F.when(F.abs(r) >= 1e-12, r))
    return back(f), back(g)


def gradient_normal(gx, gy) -> Column:
    """Upward unit normal of a height field with slopes (gx, gy)."""
    return unit3(vec3(-col(gx), -col(gy), F.lit(1.0)))


def normal_gradient(n: Column) -> tuple[Column, Column]:
    return -n["x"] / n["z"], -n["y"] / n["z"]


def angles_normal(tilt, slant) -> Column:
    s = F.sin(col(slant))
    return vec3(s * F.cos(col(tilt)), s * F.sin(col(tilt)), F.cos(col(slant)))


def normal_angles(n: Column) -> tuple[Column, Column]:
    """Tilt in [0, 2 pi) and slant of a unit normal."""
    flat = (F.abs(n["x"]) < 1e-12) & (F.abs(n["y"]) < 1e-12)
    t = F.atan2(n["y"], F.when(flat, 1e-12).otherwise(n["x"]))
    return F.when(t < 0, t + 6.283185307179586).otherwise(t), F.acos(n["z"])


def ray_cell(pos: tuple, direction: tuple, corner: tuple, edge) -> dict[str, Column]:
    """Entry and exit times of a ray through a cube; hit is false when it misses."""
    eps = 1e-7
    near, far = [], []
    for p, d, c in zip(pos, direction, corner):
        p, d, c = col(p), col(d), col(c)
        inv = F.when(F.abs(d) > eps, F.lit(1.0) / F.when(F.abs(d) > eps, d)).otherwise(1.0 / eps)
        a, b = (c - p) * inv, (c + edge - p) * inv
        near.append(F.when(inv >= 0, a).otherwise(b))
        far.append(F.when(inv >= 0, b).otherwise(a))
    t0, t1 = F.greatest(*near), F.least(*far)
    return {"t_in": t0, "t_out": t1, "hit": t0 <= t1}
