"""Pair and bonded energies, their derivatives and mixing rules, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R_MIN = 1e-6


def clamped(r: Column) -> Column:
    return F.greatest(r, F.lit(R_MIN))


def geometric(a: Column, b: Column) -> Column:
    return F.sqrt(a * b + 1e-12)


def arithmetic(a: Column, b: Column) -> Column:
    return (a + b) * 0.5


def lorentz_berthelot(eps: tuple[Column, Column], sigma: tuple[Column, Column]) -> tuple[Column, Column]:
    return geometric(*eps), arithmetic(*sigma)


def power(x: Column, n: int) -> Column:
    """An integer power by products, which is cheaper than ``pow`` and the same in every engine."""
    if n == 1:
        return x
    half = power(x, n // 2)
    return half * half if n % 2 == 0 else half * half * x


def apart(r: Column) -> Column:
    """1, and 0 for distances under the least one. Under a condition, Spark computes each repeated part of an expression again,
    and its code for a join with such sums gets too long to be compiled."""
    return (r >= R_MIN).cast("double")


def lennard_jones(r: Column, eps: Column, sigma: Column) -> Column:
    q6 = power(sigma / clamped(r), 6)
    return eps * 4 * (q6 * q6 - q6)


def lennard_jones_slope(r: Column, eps: Column, sigma: Column) -> Column:
    q6 = power(sigma / clamped(r), 6)
    return eps * 4 * (q6 * 6 - q6 * q6 * 12) / clamped(r) * apart(r)


def repulsion(r: Column, eps: Column, lam: Column, r_star: Column, s: float = 1.5) -> Column:
    r = clamped(r)
    return eps * F.exp(lam * (1 - r / r_star)) + power(F.lit(s) / r, 12)


def repulsion_slope(r: Column, eps: Column, lam: Column, r_star: Column, s: float = 1.5) -> Column:
    d = clamped(r)
    return F.when(r < R_MIN, 0.0).otherwise(-(eps * lam / r_star) * F.exp(lam * (1 - d / r_star)) - power(F.lit(s) / d, 12) * 12 / d)


def dispersion(r: Column, c6: Column, r_star: Column, s: float = 120.0) -> Column:
    return -c6 / (power(r_star, 6) * s + power(clamped(r), 6))


def dispersion_slope(r: Column, c6: Column, r_star: Column, s: float = 120.0) -> Column:
    d = clamped(r)
    below = power(r_star, 6) * s + power(d, 6)
    return c6 * 6 * power(d, 5) / (below * below) * apart(r)


def charge_transfer(r: Column, eps: Column, lam: Column, r_star: Column) -> Column:
    r = clamped(r)
    return eps / power(r, 4) * F.exp(-power(lam * r_star / r, 3))


def charge_transfer_slope(r: Column, eps: Column, lam: Column, r_star: Column) -> Column:
    d = clamped(r)
    u3 = power(lam * r_star / d, 3)
    return F.when(r < R_MIN, 0.0).otherwise(eps / power(d, 4) * F.exp(-u3) * (u3 * 3 - 4) / d)


def harmonic(value: Column, k: Column, at: Column) -> Column:
    return k * 0.5 * (value - at) * (value - at)


def erfc(x: Column) -> Column:
    """A rational approximation (absolute error at most 1.5e-7) for x >= 0."""
    # fixed values: Abramowitz and Stegun, formula 7.1.26
    p = 0.3275911
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + x * p)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return poly * F.exp(-x * x)


def ewald_direct(r: Column, q1: Column, q2: Column, alpha: float, coulomb: float = 1.0) -> Column:
    """The short-range part of an Ewald sum for one pair; no self-energy and no net-charge term."""
    return q1 * q2 * coulomb * erfc(r * alpha) / r


def ewald_excluded(r: Column, q1: Column, q2: Column, alpha: float, coulomb: float = 1.0) -> Column:
    """What an excluded pair takes off the reciprocal part."""
    return -(q1 * q2 * coulomb * (1 - erfc(r * alpha)) / r)


def ewald_direct_slope(r: Column, q1: Column, q2: Column, alpha: float, coulomb: float = 1.0) -> Column:
    x = r * alpha
    return -(q1 * q2 * coulomb) * (erfc(x) / (r * r) + F.exp(-x * x) * (2 * alpha / math.sqrt(math.pi)) / r)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: tuple[Column, ...], eps: float = 1e-8) -> tuple[Column, ...]:
    n = norm(a) + eps
    return tuple(c / n for c in a)


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def angle(u: tuple[Column, ...], v: tuple[Column, ...]) -> Column:
    return F.acos(bounded(dot(unit(u), unit(v))))


def dihedral(b1: tuple[Column, ...], b2: tuple[Column, ...], b3: tuple[Column, ...]) -> Column:
    """Signed angle of four atoms from three bonds; the difference to a minimum is not wrapped."""
    n1, n2 = unit(cross(b1, b2)), unit(cross(b2, b3))
    return F.atan2(dot(cross(n1, n2), unit(b2)), bounded(dot(n1, n2)))


def scaled(a: tuple[Column, ...], by: Column | float) -> tuple[Column, ...]:
    return tuple(c * by for c in a)


def plus(*vectors: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(sum(parts[1:], parts[0]) for parts in zip(*vectors, strict=True))


def distance_gradient(b: tuple[Column, ...]) -> list[tuple[Column, ...]]:
    """Gradients of ``|b|`` at both atoms of a bond ``b = p2 - p1``."""
    u = scaled(b, 1 / clamped(norm(b)))
    return [scaled(u, -1.0), u]


def angle_gradient(u: tuple[Column, ...], v: tuple[Column, ...]) -> list[tuple[Column, ...]]:
    """Gradients of the angle between ``u = p1 - p2`` and ``v = p3 - p2`` at the three atoms; none at a straight or
    folded angle."""
    nu, nv = clamped(norm(u)), clamped(norm(v))
    a, b = scaled(u, 1 / nu), scaled(v, 1 / nv)
    cos = bounded(dot(a, b))
    sin = F.sqrt(1 - cos * cos)
    inverse = F.when(sin > 1e-8, -1 / sin).otherwise(0.0)
    first = scaled(plus(b, scaled(a, -cos)), inverse / nu)
    last = scaled(plus(a, scaled(b, -cos)), inverse / nv)
    return [first, scaled(plus(first, last), -1.0), last]


def dihedral_gradient(b1: tuple[Column, ...], b2: tuple[Column, ...], b3: tuple[Column, ...]) -> list[tuple[Column, ...]]:
    """Gradients of the signed angle of four atoms at each of them; none where three atoms are in line."""
    m, n, g = cross(b1, b2), cross(b2, b3), clamped(norm(b2))
    mm, nn = dot(m, m), dot(n, n)
    live = (mm > 1e-16) & (nn > 1e-16)
    first = scaled(m, F.when(live, -g / mm).otherwise(0.0))
    last = scaled(n, F.when(live, g / nn).otherwise(0.0))
    s, t = dot(b1, b2) / (g * g), dot(b3, b2) / (g * g)
    second = plus(scaled(first, -1 - s), scaled(last, t))
    return [first, second, plus(scaled(first, s), scaled(last, -1 - t)), last]
