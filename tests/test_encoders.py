"""Encoders against plain loops over atoms and edges that share nothing with them, and under rotations."""

import itertools

import numpy as np
import pytest

from graphloom import queries
from graphloom.functions.features import random_rotation
from graphloom.operators import encoders as en
from graphloom.operators.neighbors import directed_edges, neighbor_pairs

SPECIES, CUTOFF = [1, 6, 8], 1.6
C, RADIAL = 3, 4


def graph(seed=0, n=14):
    rng = np.random.default_rng(seed)
    return rng.uniform(-1.5, 1.5, size=(n, 3)), rng.choice(SPECIES, n)


def tables(spark, pos, z):
    rows = [(g, int(i), int(k), *map(float, p)) for g, part in ((0, range(0, len(z), 2)), (5, range(1, len(z), 2))) for i in part for k, p in [(z[i], pos[i])]]
    atoms = spark.createDataFrame(rows, "graph_id long, atom_id long, z_num int, x double, y double, z double")
    return atoms, directed_edges(neighbor_pairs(atoms, CUTOFF))


def near(pos):
    """``(src, dst, vector)`` of both directions within a graph."""
    return [(i, j, pos[j] - pos[i]) for i in range(len(pos)) for j in range(len(pos)) if i != j and (i - j) % 2 == 0 and np.linalg.norm(pos[j] - pos[i]) <= CUTOFF]


# -- the plain version: its own harmonics, and couplings as integrals over the sphere


def harmonics(x, y, z):
    s3, s15 = 3**0.5, 15**0.5
    return np.array([1.0, s3 * x, s3 * y, s3 * z, s15 * x * y, s15 * y * z, 5**0.5 / 2 * (2 * z * z - x * x - y * y), s15 * x * z, s15 / 2 * (x * x - y * y)])


DEGREE = [0, 1, 1, 1, 2, 2, 2, 2, 2]


def gaunt():
    """All integrals of three harmonics, each triple of degrees scaled to squares of ``2 l3 + 1``."""
    z, weight = np.polynomial.legendre.leggauss(8)
    phi = 2 * np.pi * np.arange(15) / 15
    out = np.zeros((9, 9, 9))
    for c, w in zip(z, weight, strict=True):
        for p in phi:
            s = (1 - c * c) ** 0.5
            y = harmonics(s * np.cos(p), s * np.sin(p), c)
            out += w * np.einsum("i,j,k->ijk", y, y, y)
    out[np.abs(out) < 1e-10] = 0
    for a, b, c in itertools.product(range(3), repeat=3):
        part = np.ix_(*[[i for i in range(9) if DEGREE[i] == k] for k in (a, b, c)])
        norm = (out[part] ** 2).sum()
        if norm:
            out[part] *= ((2 * c + 1) / norm) ** 0.5
    return out


GAUNT = gaunt()


def triples(l_max):
    return [t for t in itertools.product(range(l_max + 1), repeat=3) if abs(t[0] - t[1]) <= t[2] <= t[0] + t[1] and sum(t) % 2 == 0]


def silu(x):
    return x / (1 + np.exp(-x))


def product(x, y, l_max, weight):
    """For each degree, the products of ``x[c][9]`` with ``y[9]`` by path and channel, a list of rows of nine."""
    out = {d: [] for d in range(l_max + 1)}
    for n, (a, b, c) in enumerate(triples(l_max)):
        for ch in range(C):
            row = np.zeros(9)
            for i, j, k in itertools.product(range(9), repeat=3):
                if (DEGREE[i], DEGREE[j], DEGREE[k]) == (a, b, c):
                    row[k] += GAUNT[i, j, k] * x[ch][i] * y[j]
            out[c].append(row * weight[n][ch])
    return out


def mix(rows, w, name, l_max):
    """A matrix for each degree over rows of nine."""
    out = [np.zeros(9) for _ in range(C)]
    for d in range(l_max + 1):
        for o in range(C):
            for i, row in enumerate(rows[d]):
                for k in range(9):
                    if DEGREE[k] == d:
                        out[o][k] += row[k] * w[f"{name}_{d}"][i, o]
    return out


def line(x, w, name):
    return np.array([sum(x[i] * w[name][i, o] for i in range(len(x))) + w[f"{name}_b"][o] for o in range(w[name].shape[1])])


def listed(x, l_max):
    """Component by component, the channels side by side."""
    return np.array([x[ch][k] for k in range((l_max + 1) ** 2) for ch in range(C)])


def unlisted(v):
    return [np.array([v[k * C + ch] if k * C + ch < len(v) else 0.0 for k in range(9)]) for ch in range(C)]


def edge(d, envelope):
    r = np.linalg.norm(d)
    bessel = np.array([(2 / CUTOFF) ** 0.5 * np.sin(k * np.pi * r / CUTOFF) / (r + 1e-8) for k in range(1, RADIAL + 1)])
    return bessel * envelope(r / CUTOFF), harmonics(*(d / (r + 1e-8)))


def cosine(x):
    return 0.5 * (np.cos(np.pi * x) + 1) if x < 1 else 0.0


def polynomial(x):
    return 1 - 28 * x**6 + 48 * x**7 - 21 * x**8 if x < 1 else 0.0


def plain_nodes(pos, z, w, l_max, layers, order, avg, normalized):
    kind = [SPECIES.index(k) for k in z]
    h = [line(w["embed"][k], w, "start") for k in kind]
    features = [[] for _ in z]
    for n in range(layers):
        sums = [[np.zeros(9) for _ in range(C)] for _ in z]
        for i, j, d in near(pos):
            basis, y = edge(d, cosine)
            weight = line(silu(line(silu(line(basis, w, f"radial{n}_0")), w, f"radial{n}_1")), w, f"radial{n}_2").reshape(-1, C)
            up = mix({k: unlisted(h[i]) for k in range(l_max + 1)}, w, f"up{n}", l_max)
            for ch, row in enumerate(mix(product(up, y, l_max, weight), w, f"down{n}", l_max)):
                sums[j][ch] += row / avg
        for i, t in enumerate(kind):
            m = listed(sums[i], l_max)
            basis = sum(w[f"orders{n}"][t][p] * m ** (p + 1) for p in range(order))
            made = line(basis, w, f"head{n}")
            features[i] += list(made)
            if n + 1 < layers:
                h[i] = h[i] + line(made, w, f"back{n}") @ w[f"update{n}"][t]
                if normalized:
                    h[i] = (h[i] - h[i].mean()) / (h[i].var() + 1e-5) ** 0.5 * w[f"norm{n}"] + w[f"norm{n}_b"]
    return features, [np.array([sums[i][ch][k] for ch in range(C) for k in (1, 2, 3)]) for i in range(len(z))]


def plain_edges(pos, z, w, l_max, layers, avg, deep):
    kind, edges = [SPECIES.index(k) for k in z], near(pos)
    geo = [edge(d, polynomial) for _, _, d in edges]
    cut = [polynomial(np.linalg.norm(d) / CUTOFF) for _, _, d in edges]
    out = {}
    for e, (i, j, _) in enumerate(edges):
        own = [y for (src, _, _), (_, y) in zip(edges, geo, strict=True) if src == i]
        around = sum(own) / (len(own) if avg is None else avg) ** 0.5
        x = np.concatenate([geo[e][0], w["embed"][kind[i]], w["embed"][kind[j]]])
        for k in range(3):
            x = silu(line(x, w, f"first{k}"))
        v = [t * geo[e][1] for t in line(x, w, "tensor")]
        shown = []
        for n in range(layers):
            v = [a * b for a, b in zip(v, line(x, w, f"env{n}"), strict=True)]
            v = mix(product(v, around, l_max, w[f"paths{n}"]), w, f"mix{n}", l_max)
            latent = line(np.concatenate([x, [t[0] for t in v]]), w, f"latent{n}_0")
            if deep:
                latent = line(silu(latent), w, f"latent{n}_1")
            x = x / 1.25**0.5 + 0.5 / 1.25**0.5 * latent
            v = [a * b for a, b in zip(v, line(x, w, f"out{n}"), strict=True)]
            shown += list(x * cut[e])
        out[i, j] = shown, np.array([t[k] for t in v for k in (1, 2, 3)])
    return out


@pytest.mark.parametrize("l_max,layers,order,normalized", [(1, 1, 1, False), (2, 2, 3, False), (1, 3, 2, True)])
def test_node_encoder_matches_plain_loops(spark, l_max, layers, order, normalized):
    pos, z = graph()
    kwargs = {"features": C, "radial": RADIAL, "layers": layers, "l_max": l_max, "order": order, "layer_norm": normalized, "products": "channels"}
    w = {k: v * 0.5 for k, v in en.seeded_weights(en.node_shapes(len(SPECIES), **kwargs), 3).items()}
    atoms, edges = tables(spark, pos, z)
    features, vectors = plain_nodes(pos, z, w, l_max, layers, order, 2.0, normalized)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        rows = en.node_encoder(atoms, edges, cutoff=CUTOFF, species=SPECIES, weights=en.weights_table(spark, w), avg_neighbors=2.0, **kwargs).collect()
        assert len(rows) == len(z)
        for r in rows:
            assert r.features == pytest.approx(features[r.atom_id], rel=1e-8, abs=1e-10) and r.vectors == pytest.approx(vectors[r.atom_id], rel=1e-8, abs=1e-10)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("l_max,layers,avg,deep", [(1, 1, None, False), (2, 2, 3.0, False), (2, 2, None, True)])
def test_edge_encoder_matches_plain_loops(spark, l_max, layers, avg, deep):
    pos, z = graph(1)
    kwargs = {"scalars": 4, "tensors": C, "embedding": 5, "radial": RADIAL, "layers": layers, "l_max": l_max, "latent_hidden": [6] if deep else None}
    w = en.seeded_weights(en.edge_shapes(len(SPECIES), **kwargs), 5)
    want = plain_edges(pos, z, w, l_max, layers, avg, deep)
    rows = en.edge_encoder(*tables(spark, pos, z), cutoff=CUTOFF, species=SPECIES, weights=en.weights_table(spark, w), avg_neighbors=avg, **kwargs).collect()
    assert {(r.src, r.dst) for r in rows} == want.keys() and len(rows) > 10
    for r in rows:
        assert r.features == pytest.approx(want[r.src, r.dst][0], rel=1e-8, abs=1e-10) and r.vectors == pytest.approx(want[r.src, r.dst][1], rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("encoder,kwargs", [(en.node_encoder, {"products": "coupled", "order": 3, "features": C}), (en.node_encoder, {"products": "coupled", "order": 2, "l_max": 3, "features": 2}), (en.edge_encoder, {})])
def test_scalars_stay_and_vectors_turn(spark, encoder, kwargs):
    pos, z = graph(7)
    turn = np.array(random_rotation(9))
    out = []
    for p in (pos, pos @ turn.T + [3.0, -1.0, 0.5]):
        rows = encoder(*tables(spark, p, z), cutoff=CUTOFF, species=SPECIES, radial=RADIAL, **kwargs).collect()
        out.append({tuple(r[k] for k in r.asDict() if k not in ("features", "vectors")): r for r in rows})
    assert out[0].keys() == out[1].keys()
    largest = 0.0
    for k, r in out[0].items():
        assert out[1][k].features == pytest.approx(r.features, rel=1e-6, abs=1e-8)
        turned = (np.array(r.vectors).reshape(-1, 3) @ turn.T).ravel()
        assert out[1][k].vectors == pytest.approx(turned, rel=1e-6, abs=1e-8)
        largest = max(largest, np.abs(turned).max())
    assert largest > 1e-3


def test_an_atom_with_many_sums_spans_batches(spark, monkeypatch):
    pos, z = graph()
    tables_ = tables(spark, pos, z)
    want = {r.atom_id: r.features for r in en.node_encoder(*tables_, cutoff=CUTOFF, species=SPECIES, features=C, radial=RADIAL).collect()}
    monkeypatch.setattr(en, "MEET_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = en.node_encoder(*tables_, cutoff=CUTOFF, species=SPECIES, features=C, radial=RADIAL)
        for r in got.collect():
            assert r.features == pytest.approx(want[r.atom_id], rel=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got.written_to) == 2


def test_weights_must_fit(spark):
    pos, z = graph()
    w = en.seeded_weights(en.node_shapes(len(SPECIES), features=C, radial=RADIAL))
    del w["up0_1"]
    with pytest.raises(ValueError, match="up0_1"):
        en.node_encoder(*tables(spark, pos, z), cutoff=CUTOFF, species=SPECIES, weights=en.weights_table(spark, w), features=C, radial=RADIAL)


@pytest.mark.parametrize("encoder", [en.node_encoder, en.edge_encoder])
def test_no_task_sees_a_graph_and_what_is_unknown_is_an_error(spark, encoder):
    sf = "/root/testdata/sf0.001"
    atoms, edges = queries.atoms_of(spark, sf), queries.edges_of(spark, sf)
    out = encoder(atoms, edges, cutoff=queries.CUTOFF, species=queries.ELEMENTS)
    plan = out._jdf.queryExecution().toString()
    assert "GroupsInPandas" not in plan and "Window" not in plan
    with pytest.raises(Exception, match="no species for"):
        encoder(atoms, edges, cutoff=queries.CUTOFF, species=queries.ELEMENTS[:4]).collect()
    with pytest.raises(Exception, match="no atom"):
        encoder(atoms.filter("atom_id <> 7"), edges, cutoff=queries.CUTOFF, species=queries.ELEMENTS).collect()
    with pytest.raises(Exception, match="without src"):
        encoder(atoms, edges.selectExpr("graph_id", "CASE WHEN src <> 7 THEN src END AS src", "dst", "dx", "dy", "dz", "dist"), cutoff=queries.CUTOFF, species=queries.ELEMENTS).collect()
