"""Radial and angular features, activations and labels, as column expressions."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.physics import erfc


def bessel(r: Column, cutoff: float, n: int, eps: float = 1e-8) -> list[Column]:
    """``sqrt(2/rc) sin(k pi r / rc) / (r + eps)`` for k = 1..n."""
    return [F.sin(r * (k * math.pi / cutoff)) * math.sqrt(2 / cutoff) / (r + eps) for k in range(1, n + 1)]


def bessel_statistics(cutoff: float, n: int, points: int = 4096, eps: float = 1e-8) -> tuple[list[float], list[float]]:
    """Mean and sample deviation of each basis function on a grid over (0, cutoff]."""
    import numpy as np

    r = np.linspace(0, cutoff, points + 1)[1:]
    k = np.arange(1, n + 1)[:, None]
    phi = np.sqrt(2 / cutoff) * np.sin(k * np.pi * r / cutoff) / (r + eps)
    return phi.mean(1).tolist(), phi.std(1, ddof=1).tolist()


def gaussian(r: Column, cutoff: float, n: int) -> list[Column]:
    """``exp(-((r - c) / w)^2)`` at n even centers over [0, cutoff], ``w = cutoff / n``; a single center is 0."""
    w = cutoff / n
    return [F.exp(-((r - c) / w) * ((r - c) / w)) for c in (cutoff * k / max(1, n - 1) for k in range(n))]


def cosine_cutoff(r: Column, cutoff: float) -> Column:
    return F.when(r < cutoff, (F.cos(r * (math.pi / cutoff)) + 1) * 0.5).otherwise(0.0)


def polynomial_cutoff(r: Column, cutoff: float, p: int = 6) -> Column:
    x = r / cutoff
    xp = x
    for _ in range(p - 1):
        xp = xp * x
    a, b, c = (p + 1) * (p + 2) / 2, float(p * (p + 2)), p * (p + 1) / 2
    return F.when(x < 1, 1 - xp * a + xp * x * b - xp * x * x * c).otherwise(0.0)


def spherical_basis(x: Column, y: Column, z: Column, compat: bool = False) -> list[Column]:
    """Real spherical harmonics up to l = 2 of a unit vector, in the order 1; y, z, x; xy, yz, 3z^2-1, xz,
    x^2-y^2. ``compat`` halves the coefficient of xy."""
    c0, c1 = 0.5 / math.sqrt(math.pi), math.sqrt(3 / (4 * math.pi))
    c2, c20 = 0.5 * math.sqrt(15 / math.pi), 0.25 * math.sqrt(5 / math.pi)
    xy = c2 / 2 if compat else c2
    return [F.lit(c0), y * c1, z * c1, x * c1, x * y * xy, y * z * c2, (z * z * 3 - 1) * c20, x * z * c2, (x * x - y * y) * (c2 / 2)]


def spherical_harmonics(x: Column, y: Column, z: Column, l_max: int) -> list[Column]:
    """Orthonormal real harmonics of a unit vector up to ``l_max`` <= 3, by degree and then m from -l to l."""
    if not 0 <= l_max <= 3:
        raise ValueError("degrees 0 to 3 only")
    low = spherical_basis(x, y, z)
    out = [low[0], *low[1:4], *low[4:9]]
    a, b, c, d = (math.sqrt(v / math.pi) for v in (35 / 2, 105.0, 21 / 2, 7.0))
    out += [
        y * (x * x * 3 - y * y) * (a / 4),
        x * y * z * (b / 2),
        y * (z * z * 5 - 1) * (c / 4),
        z * (z * z * 5 - 3) * (d / 4),
        x * (z * z * 5 - 1) * (c / 4),
        z * (x * x - y * y) * (b / 4),
        x * (x * x - y * y * 3) * (a / 4),
    ]
    return out[: (l_max + 1) ** 2]


def rotate(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> tuple[Column, Column, Column]:
    """``v @ R^T``."""
    return tuple(x * row[0] + y * row[1] + z * row[2] for row in matrix)


def axis_rotation(axis: str, angle: float) -> list[list[float]]:
    """Rotation about a coordinate axis."""
    c, s = math.cos(angle), math.sin(angle)
    a, b = [(1, 2), (2, 0), (0, 1)]["xyz".index(axis)]
    m = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    m[a][a], m[a][b], m[b][a], m[b][b] = c, -s, s, c
    return m


def random_rotation(seed: int) -> list[list[float]]:
    """A rotation drawn evenly from all rotations, by a unit quaternion."""
    rng = random.Random(seed)
    q = [rng.gauss(0, 1) for _ in range(4)]
    n = math.sqrt(sum(v * v for v in q))
    w, x, y, z = (v / n for v in q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotate_irreps(features: list[Column], irreps: str, matrix: list[list[float]]) -> list[Column]:
    """Feature columns under a rotation, for names such as ``16x0e + 16x1o``: scalars stay, vectors (all x, then all y,
    then all z of a block) are rotated, and blocks of higher degree stay as they are."""
    blocks = [(int(count), int(kind.strip("eo"))) for count, kind in (b.strip().split("x") for b in irreps.split("+"))]
    if sum(n * (2 * degree + 1) for n, degree in blocks) != len(features):
        raise ValueError(f"{irreps} does not have {len(features)} columns")
    out: list[Column] = []
    for n, degree in blocks:
        own = features[len(out) : len(out) + n * (2 * degree + 1)]
        if degree == 1:
            turned = [rotate(own[k], own[n + k], own[2 * n + k], matrix) for k in range(n)]
            own = [turned[k][axis] for axis in range(3) for k in range(n)]
        out += own
    return out


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def gelu(x: Column) -> Column:
    """``x/2 (1 + erf(x / sqrt 2))``, with erf to 1.5e-7."""
    tail = erfc(F.abs(x) / math.sqrt(2))
    return x * 0.5 * F.when(x < 0, tail).otherwise(2 - tail)


ACTIVATIONS = {"silu": silu, "relu": lambda x: F.greatest(x, F.lit(0.0)), "gelu": gelu, "tanh": F.tanh, "softplus": softplus}


def softmax(xs: Column) -> Column:
    """Softmax of an array, with its largest entry taken off first."""
    e = F.transform(xs, lambda v: F.exp(v - F.array_max(xs)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(xs: Column) -> Column:
    return F.array_position(xs, F.array_max(xs)) - 1


#: The elements that a proxy label tells apart, in label order.
PROXY_ELEMENTS = [1, 6, 7, 8, 9, 15, 16, 17, 35, 53]


def proxy_label(z_num: Column) -> Column:
    """Position in :data:`PROXY_ELEMENTS`, or their number."""
    at = F.array_position(F.array(*map(F.lit, PROXY_ELEMENTS)), z_num)
    return F.when(at > 0, at - 1).otherwise(len(PROXY_ELEMENTS)).cast("int")


def irreps(dim: int, l_max: int) -> str:
    """Names such as ``16x0e + 16x1o``."""
    return " + ".join(f"{dim}x{k}{'e' if k % 2 == 0 else 'o'}" for k in range(l_max + 1))


def mlp(inputs: list[Column], weights: list[tuple[list[list[float]], list[float]]], activation: str = "silu") -> list[Column]:
    """A small dense network, one expression per output; no activation behind the last layer."""
    for k, (w, b) in enumerate(weights):
        inputs = [sum((x * v for x, v in zip(inputs, row, strict=True)), F.lit(bias)) for row, bias in zip(w, b, strict=True)]
        if k + 1 < len(weights):
            inputs = [ACTIVATIONS[activation](x) for x in inputs]
    return inputs
