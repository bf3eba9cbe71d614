"""Harmonics of any degree, couplings and symmetric products."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.features import random_rotation
from graphloom.operators import harmonics as H


def directions(n, seed=1):
    u = np.random.default_rng(seed).normal(size=(n, 3))
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def turned(l_max, seed=4):
    """A rotation, and the matrix of each degree under it."""
    turn, u = np.array(random_rotation(seed)), directions(200)
    y, after = H.harmonics(u, l_max), H.harmonics(u @ turn.T, l_max)
    return turn, [np.linalg.lstsq(y[:, H.degree(k)], after[:, H.degree(k)], rcond=None)[0].T for k in range(l_max + 1)]


def test_harmonics_are_orthonormal_up_to_degree_six():
    z, weight = np.polynomial.legendre.leggauss(8)
    phi = 2 * np.pi * np.arange(16) / 16
    u = np.array([[(1 - c * c) ** 0.5 * np.cos(p), (1 - c * c) ** 0.5 * np.sin(p), c] for c in z for p in phi])
    y = H.harmonics(u, 6)
    gram = np.einsum("n,ni,nj->ij", np.repeat(weight, len(phi)) / 32, y, y)
    assert np.allclose(gram, np.eye(49), atol=1e-12)
    assert np.allclose(H.harmonics(np.array([[0.0, 0, 2.0]]), 5)[0, [0, 3, 6, 12, 20, 30]], [2**k * (2 * k + 1) ** 0.5 for k in range(6)])
    assert np.allclose(H.harmonics(np.zeros((1, 3)), 2)[0], [1] + [0] * 8)
    with pytest.raises(ValueError):
        H.harmonics(u, -1)


def test_degrees_turn_among_themselves():
    _, d = turned(5)
    for m in d:
        assert np.allclose(m @ m.T, np.eye(len(m)), atol=1e-9)


def test_columns_are_the_arrays(spark):
    u = directions(20)
    df = spark.createDataFrame([tuple(map(float, v)) for v in u], "x double, y double, z double")
    got = np.array(df.select(*H.harmonic_columns(F.col("x"), F.col("y"), F.col("z"), 4)).collect())
    assert np.allclose(got, H.harmonics(u, 4), atol=1e-12)


@pytest.mark.parametrize("triple", [(1, 1, 1), (1, 2, 2), (2, 3, 5), (4, 4, 4), (5, 5, 1), (3, 4, 2)])
def test_couplings_turn_with_their_arguments(triple):
    _, d = turned(5)
    t = H.coupling(*triple)
    assert np.allclose(np.einsum("ijk,ai,bj,ck->abc", t, *(d[k] for k in triple)), t, atol=1e-8)
    assert (t * t).sum() == pytest.approx(2 * triple[2] + 1)


def test_couplings_of_even_sum_are_integrals():
    u = directions(3)
    y = H.harmonics(u, 4)
    for (a, b, c), t in H.couplings(4).items():
        own = [y[:, H.degree(k)] for k in (a, b, c)]
        part = np.einsum("ni,nj,ijk->nk", own[0], own[1], t)
        scale = (part * own[2]).sum(1)
        assert (scale > 0).all() and np.allclose(part, own[2] * (scale / (2 * c + 1))[:, None], atol=1e-9)
    assert len(H.paths(2)) == 11 and (0, 1, 0) not in H.paths(2)
    with pytest.raises(ValueError):
        H.coupling(1, 1, 3)


def copies(l_max, order, degree):
    """How many parts of a degree the symmetric power of a feature has, by characters of rotations and inversions."""
    z, weight = np.polynomial.legendre.leggauss(60)
    angle = np.pi * (z + 1) / 2
    chi = lambda k, a: np.sin((2 * k + 1) * a / 2) / np.sin(a / 2)
    total = 0.0
    for sign in (1, -1):
        power = [sum(sign ** (n * k) * chi(k, n * angle) for k in range(l_max + 1)) for n in range(1, order + 1)]
        made = {1: lambda p: p[0], 2: lambda p: (p[0] ** 2 + p[1]) / 2, 3: lambda p: (p[0] ** 3 + 3 * p[0] * p[1] + 2 * p[2]) / 6}[order](power)
        total += (weight * made * sign**degree * chi(degree, angle) * (1 - np.cos(angle))).sum() / 4
    return round(total)


@pytest.mark.parametrize("l_max,order,degree", [*itertools.product((1, 2), (1, 2, 3), (0, 1)), (2, 3, 2), (3, 2, 3), (3, 3, 0)])
def test_symmetric_products_are_all_there_is(l_max, order, degree):
    t = H.symmetric_products(l_max, order, degree)
    assert len(t) == copies(l_max, order, degree)
    _, d = turned(l_max, 6)
    whole = np.zeros(((l_max + 1) ** 2,) * 2)
    for k, m in enumerate(d):
        whole[H.degree(k), H.degree(k)] = m
    for one in t:
        moved = np.tensordot(d[degree], one, 1)
        for axis in range(1, order + 1):
            moved = np.moveaxis(np.tensordot(whole, moved, ([1], [axis])), 0, axis)
        assert np.allclose(moved, one, atol=1e-8) and (one * one).sum() == pytest.approx(2 * degree + 1)
        assert np.allclose(one, np.swapaxes(one, 1, order))


def plain_contraction(x, kinds, weights, l_max, order, degrees):
    out = [np.zeros((*x.shape[:2], 2 * k + 1)) for k in degrees]
    for n, ch in itertools.product(range(len(x)), range(x.shape[1])):
        for k, made in zip(degrees, out, strict=True):
            for p in range(1, order + 1):
                for t, w in zip(H.symmetric_products(l_max, p, k), weights[f"{p}_{k}"][kinds[n]][:, ch], strict=True):
                    for at in np.argwhere(t):
                        made[n, ch, at[0]] += w * t[tuple(at)] * np.prod([x[n, ch, i] for i in at[1:]])
    return out


def test_contraction_matches_a_plain_loop_and_turns(spark):
    rng = np.random.default_rng(2)
    x, kinds, degrees = rng.normal(size=(4, 2, 9)), np.array([1, 0, 2, 1]), [0, 1, 2]
    w = {k: rng.normal(size=s) for k, s in H.contraction_shapes(3, 2, 2, 3, degrees).items()}
    got = H.contract(x, kinds, w, 2, 3, degrees)
    for a, b in zip(got, plain_contraction(x, kinds, w, 2, 3, degrees), strict=True):
        assert np.allclose(a, b, atol=1e-9)
    _, d = turned(2, 8)
    after = np.concatenate([x[:, :, H.degree(k)] @ d[k].T for k in range(3)], axis=2)
    for k, (a, b) in enumerate(zip(got, H.contract(after, kinds, w, 2, 3, degrees), strict=True)):
        assert np.allclose(a @ d[k].T, b, atol=1e-7)


def test_contracted_columns_are_the_contraction(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 1, 9))
    w = {k: rng.normal(size=s) for k, s in H.contraction_shapes(1, 1, 2, 3, [0, 2]).items()}
    df = spark.createDataFrame([tuple(map(float, r[0])) for r in x], ", ".join(f"x{k} double" for k in range(9)))
    for k, want in zip((0, 2), H.contract(x, np.zeros(6, int), w, 2, 3, [0, 2]), strict=True):
        weights = [[F.lit(float(v)) for v in w[f"{n}_{k}"][0, :, 0]] for n in (1, 2, 3)]
        got = np.array(df.select(*[c.alias(f"o{i}") for i, c in enumerate(H.contracted([F.col(f"x{i}") for i in range(9)], weights, 2, k))]).collect())
        assert np.allclose(got, want[:, 0], atol=1e-9)
    with pytest.raises(ValueError, match="2 products"):
        H.contracted([F.col("x0")] * 4, [[F.lit(1.0)], [F.lit(1.0)]], 1, 0)
