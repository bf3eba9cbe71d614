"""Real harmonics of any degree, couplings of two of them, and symmetric products of several.

A feature has ``(l_max + 1)^2`` numbers for each channel: those of degree ``l`` stand at ``l^2 ... (l + 1)^2 - 1``, a
vector as ``x, y, z``, other degrees by order ``m`` from ``-l`` to ``l``. A degree ``l`` changes its sign ``l`` times under
inversion, and only products that keep this are used."""

from __future__ import annotations

from functools import cache
from itertools import combinations_with_replacement, permutations
from math import factorial, prod, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def degree(k: int) -> slice:
    """The places of a degree among the harmonics."""
    return slice(k * k, (k + 1) ** 2)


@cache
def _norm(k: int, m: int) -> float:
    return sqrt((2 * k + 1) * (2 if m else 1) * factorial(k - m) / factorial(k + m))


def _placed(parts: dict[tuple[int, int], object], l_max: int) -> list:
    """Parts by ``(l, m)`` in the order of a feature."""
    return [parts[k, m] for k in range(l_max + 1) for m in ((1, -1, 0) if k == 1 else range(-k, k + 1))]


def _solid(x, y, z, one, l_max: int) -> list:
    """Harmonics as polynomials of three arrays (or columns): recursions on the order for the angle around z, and on the
    degree for the other."""
    square = x * x + y * y + z * z
    cos, sin = [one], [one * 0]
    for m in range(l_max):
        cos.append(x * cos[m] - y * sin[m])
        sin.append(x * sin[m] + y * cos[m])
    parts = {}
    for m in range(l_max + 1):
        before, now = None, one * float(prod(range(1, 2 * m, 2)))
        for k in range(m, l_max + 1):
            if k > m:
                after = z * now * ((2 * k - 1) / (k - m))
                if before is not None:
                    after = after - square * before * ((k + m - 1) / (k - m))
                before, now = now, after
            parts[k, m] = cos[m] * now * _norm(k, m)
            if m:
                parts[k, -m] = sin[m] * now * _norm(k, m)
    return _placed(parts, l_max)


def harmonics(u: np.ndarray, l_max: int) -> np.ndarray:
    """``[n, (l_max + 1)^2]`` of unit vectors; the squares of a degree's parts add up to ``2 l + 1``."""
    if l_max < 0:
        raise ValueError("degrees begin at 0")
    x, y, z = u.T
    return np.stack(_solid(x, y, z, np.ones(len(u)), l_max), axis=1)


@cache
def _polynomials(l_max: int) -> list[dict[tuple[int, int, int], float]]:
    """The same as coefficients of ``x^a y^b z^c``."""

    class Polynomial(dict):
        def __mul__(self, other):
            out = Polynomial()
            for p, v in self.items():
                for q, w in other.items() if isinstance(other, dict) else [((0, 0, 0), other)]:
                    at = tuple(i + j for i, j in zip(p, q, strict=True))
                    out[at] = out.get(at, 0.0) + v * w
            return out

        def __add__(self, other):
            return Polynomial({p: self.get(p, 0.0) + other.get(p, 0.0) for p in {**self, **other}})

        def __sub__(self, other):
            return self + other * -1.0

    x, y, z, one = (Polynomial({p: 1.0}) for p in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)))
    return [{p: v for p, v in q.items() if abs(v) > 1e-13} for q in _solid(x, y, z, one, l_max)]


def nested(terms: dict[tuple[int, ...], Column], xs: list[Column]) -> Column:
    """A polynomial by Horner's scheme: ``terms`` has the coefficient of each product of ``xs``, named by its factors'
    places in falling order."""
    by_first: dict[int, dict[tuple[int, ...], Column]] = {}
    out = terms.get(())
    for key, value in terms.items():
        if key:
            by_first.setdefault(key[0], {})[key[1:]] = value
    for first, rest in sorted(by_first.items()):
        part = xs[first] * nested(rest, xs)
        out = part if out is None else out + part
    return F.lit(0.0) if out is None else out


def harmonic_columns(x: Column, y: Column, z: Column, l_max: int) -> list[Column]:
    """:func:`harmonics` as column expressions."""
    return [nested({(2,) * c + (1,) * b + (0,) * a: F.lit(v) for (a, b, c), v in terms.items()}, [x, y, z]) for terms in _polynomials(l_max)]


# -- couplings


def _clebsch_gordan(a: int, i: int, b: int, j: int, c: int, k: int) -> float:
    """``<a i b j | c k>`` by Racah's sum."""
    if i + j != k:
        return 0.0
    f = factorial
    outer = (2 * c + 1) * f(a + b - c) * f(a - b + c) * f(b + c - a) / f(a + b + c + 1)
    outer *= f(a + i) * f(a - i) * f(b + j) * f(b - j) * f(c + k) * f(c - k)
    total = 0.0
    for t in range(a + b - c + 1):
        below = [t, a + b - c - t, a - i - t, b + j - t, c - b + i + t, c - a - j + t]
        if min(below) >= 0:
            total += (-1) ** t / prod(map(f, below))
    return sqrt(outer) * total


@cache
def _real(k: int) -> np.ndarray:
    """Real harmonics of a degree from complex ones."""
    out = np.zeros((2 * k + 1, 2 * k + 1), complex)
    out[k, k] = 1
    for m in range(1, k + 1):
        sign = (-1) ** m
        out[k + m, [k + m, k - m]] = sign / sqrt(2), 1 / sqrt(2)
        out[k - m, [k - m, k + m]] = 1j / sqrt(2), -1j * sign / sqrt(2)
    return out[[2, 0, 1]] if k == 1 else out


@cache
def coupling(a: int, b: int, c: int) -> np.ndarray:
    """``[2 a + 1, 2 b + 1, 2 c + 1]``: the part of degree ``c`` in the product of two degrees; the squares add up to ``2 c + 1``.
    With an even sum of degrees, a harmonic's product with another of the same direction has a positive part."""
    if not abs(a - b) <= c <= a + b:
        raise ValueError(f"{a} and {b} have no part of degree {c}")
    t = np.array([[[_clebsch_gordan(a, i, b, j, c, k) for k in range(-c, c + 1)] for j in range(-b, b + 1)] for i in range(-a, a + 1)])
    t = np.einsum("ijk,ai,bj,ck->abc", t, _real(a).conj(), _real(b).conj(), _real(c))
    t = t.imag if (a + b + c) % 2 else t.real * np.sign(_clebsch_gordan(a, 0, b, 0, c, 0))
    t = np.where(np.abs(t) < 1e-12, 0.0, t)
    t.flags.writeable = False
    return t


@cache
def couplings(l_max: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Every :func:`coupling` up to a degree that keeps the parity."""
    each = range(l_max + 1)
    return {(a, b, c): coupling(a, b, c) for a in each for b in each for c in each if abs(a - b) <= c <= a + b and (a + b + c) % 2 == 0}


def paths(l_max: int) -> list[tuple[int, int, int]]:
    return sorted(couplings(l_max))


# -- symmetric products


@cache
def _products(l_max: int, order: int, k: int, parity: int) -> np.ndarray:
    """``[n, 2 k + 1, size, ..., size]``: independent symmetric products of ``order`` features with a part of degree ``k``."""
    size = (l_max + 1) ** 2
    if order == 1:
        return np.eye(size)[None, degree(k)] if k <= l_max and parity == k % 2 else np.zeros((0, 2 * k + 1, size))
    kept: list[np.ndarray] = []
    span = np.zeros((0, (2 * k + 1) * size**order))
    for inner in range((order - 1) * l_max + 1):
        for inner_parity in (0, 1):
            for one in _products(l_max, order - 1, inner, inner_parity):
                for last in range(l_max + 1):
                    if abs(inner - last) <= k <= inner + last and (inner_parity + last) % 2 == parity:
                        made = np.zeros((2 * k + 1, *[size] * order))
                        made[..., degree(last)] = np.einsum("i...,ijk->k...j", one, coupling(inner, last, k))
                        made = sum(np.transpose(made, (0, *(1 + i for i in p))) for p in permutations(range(order)))
                        flat = made.ravel()
                        length = np.sqrt(flat @ flat)
                        if length < 1e-9:
                            continue
                        flat = flat / length
                        rest = flat - span.T @ (span @ flat)
                        rest = rest - span.T @ (span @ rest)
                        if np.sqrt(rest @ rest) > 1e-6:
                            span = np.vstack([span, rest / np.sqrt(rest @ rest)])
                            sign = np.sign(flat[np.argmax(np.abs(flat) > 1e-9)])
                            kept.append((flat * sign * sqrt(2 * k + 1)).reshape(made.shape))
    out = np.array(kept) if kept else np.zeros((0, 2 * k + 1, *[size] * order))
    out[np.abs(out) < 1e-12] = 0
    return out


def symmetric_products(l_max: int, order: int, k: int) -> np.ndarray:
    """``[n, 2 k + 1, size, ..., size]``: tensors that make the part of degree ``k`` of a product of ``order`` equal
    features, of every kind that there is once. They are nested couplings, made symmetric, without those that depend on
    others before them; the squares of each add up to ``2 k + 1``."""
    return _products(l_max, order, k, k % 2)


def contraction_shapes(species: int, channels: int, l_max: int, order: int, degrees: list[int]) -> dict[str, tuple[int, ...]]:
    """The weights of :func:`contract`: ``<order>_<degree>``, for each species, product and channel."""
    return {f"{n}_{k}": (species, len(symmetric_products(l_max, n, k)), channels) for n in range(1, order + 1) for k in degrees}


def contract(x: np.ndarray, kinds: np.ndarray, weights: dict[str, np.ndarray], l_max: int, order: int, degrees: list[int]) -> list[np.ndarray]:
    """Symmetric contraction of features ``[n, c, size]``: for each degree ``[n, c, 2 k + 1]``, the weighted sum of all products
    of one to ``order`` factors of a channel, by Horner's scheme: the highest tensor is multiplied by the features, the
    next one is added, and so on, so that no product of features is ever stored."""
    size, c = (l_max + 1) ** 2, x.shape[1]
    out = [np.zeros((len(x), c, 2 * k + 1)) for k in degrees]
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        for k, made in zip(degrees, out, strict=True):
            tensors = [np.einsum("p...,pc->c...", symmetric_products(l_max, n, k), weights[f"{n}_{k}"][kind]) for n in range(1, order + 1)]
            for ch in range(c):
                own = x[rows, ch]
                acc = tensors[-1][ch].reshape(-1, size) @ own.T
                for t in tensors[-2::-1]:
                    acc = np.einsum("ksn,ns->kn", acc.reshape(-1, size, len(rows)) + t[ch].reshape(-1, size, 1), own)
                made[rows, ch] = acc.T
    return out


def contracted(x: list[Column], weights: list[list[Column]], l_max: int, k: int) -> list[Column]:
    """The same for one channel of columns: ``weights`` has for each order, from 1, a column for each product."""
    terms: list[dict[tuple[int, ...], Column]] = [{} for _ in range(2 * k + 1)]
    for order, own in enumerate(weights, 1):
        tensors = symmetric_products(l_max, order, k)
        if len(own) != len(tensors):
            raise ValueError(f"{len(tensors)} products of order {order}, {len(own)} weights")
        for w, tensor in zip(own, tensors, strict=True):
            for m in range(2 * k + 1):
                for factors in combinations_with_replacement(range(len(x)), order):
                    value = sum(tensor[(m, *p)] for p in set(permutations(factors)))
                    if abs(value) > 1e-12:
                        key = tuple(reversed(factors))
                        part = w * float(value)
                        terms[m][key] = terms[m][key] + part if key in terms[m] else part
    return [nested(t, x) for t in terms]
