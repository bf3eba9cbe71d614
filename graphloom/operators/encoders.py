"""Equivariant encoders of graphs: message passing between atoms, and an encoder of edges.

Features are channels of real spherical harmonics up to any degree ``l_max``, see :mod:`graphloom.operators.harmonics`:
``(l_max + 1)^2`` numbers for each channel. Weights are rows of a table; factors such as the root of a layer's inputs
belong to them. A layer is joins and sums for each atom, with numpy on batches of rows between them; no task sees a whole
graph. Columns of the input that an encoder does not name are not sent to it. An end of an edge that is no atom, an element
without a species and a missing id are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.blocks import by_block, close, meeting, numbers, open_cells, runs
from graphloom.operators.harmonics import contract, contraction_shapes, couplings, degree, harmonic_columns, harmonics, paths
from graphloom.plans.cache import drop_written, written

#: Edges in a file at most.
EDGE_ROWS = 1 << 14
#: Rows of one atom that wait at most before they are added up.
MEET_ROWS = 1 << 14
#: Pairs that a block tries at once: what is made of its edges should stay near the processor.
BLOCK_PAIRS = 1 << 16
#: Numbers in a table of weights at most: it is collected, and sent to all tasks.
MAX_WEIGHTS = 50_000_000


# -- weights


def seeded_weights(shapes: dict[str, tuple[int, ...]], seed: int = 0) -> dict[str, np.ndarray]:
    """Reproducible random weights for inference without a trained model."""
    rng = np.random.default_rng(seed)
    return {k: rng.normal(size=s) / np.sqrt(s[-2] if len(s) > 1 else 1) for k, s in shapes.items()}


def weights_table(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    """``(name, shape array<int>, value array<double>)``, a row for each matrix."""
    shapes = pa.array([list(w.shape) for w in weights.values()], pa.list_(pa.int32()))
    return spark.createDataFrame(pa.table({"name": list(weights), "shape": shapes, "value": pa.array([w.ravel() for w in weights.values()], pa.list_(pa.float64()))}))


def weights_of(table: DataFrame, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The matrices of a table of weights; one that is missing or has another shape is an error."""
    total = table.agg(F.sum(F.size("value"))).first()[0] or 0
    if total > MAX_WEIGHTS:
        raise ValueError(f"{total} weights are too many to send to all tasks")
    rows = table.select("name", "shape", "value").toArrow()
    found = {n.as_py(): np.array(v.values).reshape(s.as_py()) for n, s, v in zip(rows["name"], rows["shape"], rows["value"], strict=True)}
    wrong = [k for k, s in shapes.items() if k not in found or found[k].shape != s]
    if wrong:
        raise ValueError(f"no weights of the right shape for {', '.join(wrong)}")
    return {k: found[k] for k in shapes}


# -- parts of both encoders


def silu(x: np.ndarray) -> np.ndarray:
    # the exponent never grows: large arguments do not overflow
    grown = np.exp(-np.abs(x))
    return x * np.where(x >= 0, 1, grown) / (1 + grown)


def cosine_envelope(r: np.ndarray, cutoff: float) -> np.ndarray:
    return np.where(r < cutoff, 0.5 * (np.cos(pi * r / cutoff) + 1), 0.0)


def polynomial_envelope(r: np.ndarray, cutoff: float, p: int) -> np.ndarray:
    x = r / cutoff
    return np.where(x < 1, 1 - x**p * ((p + 1) * (p + 2) / 2 - p * (p + 2) * x + p * (p + 1) / 2 * x * x), 0.0)


def bessel(r: np.ndarray, cutoff: float, n: int) -> np.ndarray:
    return np.sqrt(2 / cutoff) * np.sin(np.outer(r / cutoff, np.arange(1, n + 1) * pi)) / (r[:, None] + 1e-8)


def kinds_of(z: np.ndarray, species: list[int]) -> np.ndarray:
    """Places in ``species``."""
    order = np.argsort(species)
    at = order[np.minimum(np.searchsorted(species, z, sorter=order), len(species) - 1)]
    wrong = np.array(species)[at] != z
    if wrong.any():
        raise ValueError(f"no species for {np.unique(np.asarray(z)[wrong]).tolist()}")
    return at


def coupled(x: np.ndarray, y: np.ndarray, l_max: int, weight: np.ndarray) -> list[np.ndarray]:
    """Products of features ``[n, c, (l_max + 1)^2]`` with one channel of others ``[n, (l_max + 1)^2]``: for each degree
    the channels of all paths that end in it, ``[n, paths * c, 2 l + 1]``, times their weights ``[n or 1, paths, c]``."""
    out: list[list[np.ndarray]] = [[] for _ in range(l_max + 1)]
    for k, (a, b, c) in enumerate(paths(l_max)):
        turned = np.tensordot(y[:, degree(b)], couplings(l_max)[a, b, c], ([1], [1]))
        out[c].append((x[:, :, degree(a)] @ turned) * weight[:, k, :, None])
    return [np.concatenate(parts, axis=1) for parts in out]


def mixed(parts: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
    """A dense layer over the channels of each degree, ``[n, c, (l_max + 1)^2]``."""
    return np.concatenate([m.T @ p for p, m in zip(parts, w, strict=True)], axis=2)


def by_degree(x: np.ndarray, l_max: int) -> list[np.ndarray]:
    return [x[:, :, degree(k)] for k in range(l_max + 1)]


def flat(x: np.ndarray, l_max: int) -> np.ndarray:
    """Features as one list of numbers: degree by degree, in each the channels of one component side by side."""
    return np.concatenate([x[:, :, degree(k)].transpose(0, 2, 1).reshape(len(x), -1) for k in range(l_max + 1)], axis=1)


def unflat(x: np.ndarray, c: int, l_max: int) -> np.ndarray:
    """The features of :func:`flat`'s numbers."""
    return np.concatenate([x[:, c * k * k : c * (k + 1) ** 2].reshape(len(x), 2 * k + 1, c).transpose(0, 2, 1) for k in range(l_max + 1)], axis=2)


def dense(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    return x @ w[name] + w[f"{name}_b"]


def _layer(name: str, inputs: int, outputs: int) -> dict[str, tuple[int, ...]]:
    return {name: (inputs, outputs), f"{name}_b": (outputs,)}


def _network(name: str, sizes: list[int]) -> dict[str, tuple[int, ...]]:
    """Shapes of dense layers ``<name>0``, ``<name>1`` and so on, between these sizes."""
    out: dict[str, tuple[int, ...]] = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        out |= _layer(f"{name}{i}", a, b)
    return out


def _numbers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """Columns of doubles side by side."""
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)


def _rows(column: pa.Array, width: int, what: str) -> np.ndarray:
    """A column of packed doubles as rows."""
    if column.null_count:
        raise ValueError(f"{what} that is no atom")
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    x = np.ascontiguousarray(x, np.float64)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of doubles as lists."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def _known(name: str) -> Column:
    """An id that must be there."""
    return F.coalesce(F.col(name).cast("long"), F.raise_error(F.lit(f"a row without {name}")).cast("long")).alias(name)


def _near(edges: DataFrame) -> tuple[DataFrame, str]:
    """The edges, written once: they can be the result of a neighbor join, and are read more than once."""
    return written(edges.select(_known("graph_id"), _known("src"), _known("dst"), *[F.col(c).cast("double").alias(c) for c in ("dx", "dy", "dz", "dist")]), "edges", rows_a_file=EDGE_ROWS)


def _placed(atoms: DataFrame) -> DataFrame:
    """Atoms with their places."""
    return atoms.select(_known("graph_id"), _known("atom_id"), F.coalesce(F.col("z_num").cast("int"), F.lit(-1)).alias("z_num"), *[F.col(a).cast("double").alias(a) for a in "xyz"])


# -- atoms


def node_shapes(
    species: int, *, features: int = 8, radial: int = 8, layers: int = 2, l_max: int = 2, order: int = 2, products: str = "coupled", layer_norm: bool = False
) -> dict[str, tuple[int, ...]]:
    """The weights of :func:`node_encoder`."""
    c, n, size = features, len(paths(l_max)), (l_max + 1) ** 2
    into = [sum(p[2] == k for p in paths(l_max)) * c for k in range(l_max + 1)]
    out: dict[str, tuple[int, ...]] = {"embed": (species, c)} | _layer("start", c, c * size if products == "channels" else c)
    for k in range(layers):
        out |= _network(f"radial{k}_", [radial, c, c, n * c])
        for d in range(l_max + 1):
            out |= {f"up{k}_{d}": (c, c), f"down{k}_{d}": (into[d], c)}
        if products == "channels":
            out |= {f"orders{k}": (species, order, c * size)} | _layer(f"head{k}", c * size, c)
            if k + 1 < layers:
                out |= _layer(f"back{k}", c, c * size) | {f"update{k}": (species, c * size, c * size)}
                if layer_norm:
                    out |= {f"norm{k}": (c * size,), f"norm{k}_b": (c * size,)}
        else:
            out |= {f"products{k}_{name}": s for name, s in contraction_shapes(species, c, l_max, order, list(range(l_max + 1))).items()} | _layer(f"head{k}", c, c)
            if k + 1 < layers:
                out |= {f"update{k}_{d}": (species, c, c) for d in range(l_max + 1)}
    return out


def node_encoder(
    atoms: DataFrame,
    edges: DataFrame | None,
    *,
    cutoff: float,
    species: list[int],
    weights: DataFrame | None = None,
    features: int = 8,
    radial: int = 8,
    layers: int = 2,
    l_max: int = 2,
    order: int = 2,
    avg_neighbors: float = 1.0,
    products: str = "coupled",
    layer_norm: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Message passing between atoms: ``(graph_id, atom_id, features array<double>, vectors array<double>)``, ``features``
    numbers for each layer, one layer behind the other, and the vectors of the last messages, ``x, y, z`` for each channel.

    Atoms begin with their species' embedding, projected to all numbers of a feature. In a layer, the sources' features, mixed
    within each degree, are multiplied with the edges' harmonics, weighted for each path and channel by a network (two
    hidden layers) of Bessel functions times a cosine cutoff; the products are added up at the targets, over
    ``avg_neighbors``, and mixed to the message. Products of the message with itself up to ``order``, weighted by species, and
    a dense layer give the layer's features. These are projected back, multiplied by the species' own matrix and
    added to what the atom was before the layer; then the layer can be normalized.

    ``products="coupled"`` takes all symmetric products of degrees (:func:`graphloom.operators.harmonics.contract`), begins
    with scalars alone and updates each degree by itself: features stay under rotations, and vectors turn.
    ``products="channels"`` takes every number of the message for a channel of its own: powers, each with a weight. This and the
    projections to all numbers treat components of vectors as scalars, so the features change with the frame of reference.

    ``weights`` has the shapes of :func:`node_shapes`; without it, weights are drawn by ``seed``. A layer is a join of the
    edges with their sources, sums for each target in each batch of edges, and one shuffle of these sums and the atoms; all but the
    last are written. ``written_to`` on the result has the paths that can be dropped after use.

    Without ``edges``, they are those of :func:`graphloom.operators.neighbors.neighbor_pairs` for the atoms' ``x, y, z`` and the
    cutoff, both directions, and are neither written nor shuffled: in each layer, atoms meet in blocks. Weights of edges are linear in the
    network's last hidden layer, so a target adds up the products of these numbers, the harmonics and the sources' features, and is
    multiplied with the weights once."""
    if products not in ("channels", "coupled"):
        raise ValueError(f"no products named {products}")
    if products == "coupled" and layer_norm:
        raise ValueError("layers of coupled products are not normalized")
    shapes = node_shapes(len(species), features=features, radial=radial, layers=layers, l_max=l_max, order=order, products=products, layer_norm=layer_norm)
    w = seeded_weights(shapes, seed) if weights is None else weights_of(weights, shapes)
    c, size = features, (l_max + 1) ** 2
    degrees = list(range(l_max + 1))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in batches:
            made = started(kinds_of(a.column("z_num").to_numpy(zero_copy_only=False), species))
            empty = np.zeros((len(made), 0))
            yield pa.RecordBatch.from_arrays([a.column("graph_id"), a.column("atom_id"), a.column("z_num"), _packed(made), _packed(empty), _lists(empty)], names=NODE)

    def send(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        for e in batches:
            if not e.num_rows:
                continue
            x = unflat(_rows(e.column("h"), c * size, "an edge from"), c, l_max)
            r = e.column("dist").to_numpy()
            y = harmonics(_numbers(e, "dx", "dy", "dz") / (r[:, None] + 1e-8), l_max)
            basis = bessel(r, cutoff, radial) * cosine_envelope(r, cutoff)[:, None]
            hidden = silu(dense(silu(dense(basis, w, f"radial{k}_0")), w, f"radial{k}_1"))
            weight = dense(hidden, w, f"radial{k}_2").reshape(len(r), -1, c)
            x = mixed(by_degree(x, l_max), [w[f"up{k}_{d}"] for d in degrees])
            # the layer behind the sum is linear, so it can come before it
            sent = flat(mixed(coupled(x, y, l_max, weight), [w[f"down{k}_{d}"] for d in degrees]), l_max) / avg_neighbors
            ends = np.stack([e.column("graph_id").to_numpy(), e.column("dst").to_numpy()], axis=1)
            order_ = np.lexsort(ends.T[::-1])
            first = np.flatnonzero(np.r_[True, (np.diff(ends[order_], axis=0) != 0).any(1)])
            own = ends[order_][first]
            sums = np.add.reduceat(sent[order_], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), _packed(sums)], names=["graph_id", "atom_id", "sent"])

    def norm(x: np.ndarray, k: int) -> np.ndarray:
        if not layer_norm:
            return x
        centered = x - x.mean(1, keepdims=True)
        return centered / np.sqrt((centered**2).mean(1, keepdims=True) + 1e-5) * w[f"norm{k}"] + w[f"norm{k}_b"]

    def update(z: np.ndarray, h: np.ndarray, message: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What atoms are after a layer, and the layer's features."""
        kind = kinds_of(z, species)
        if products == "channels":
            orders = w[f"orders{k}"][kind]
            power, basis = message, np.zeros_like(message)
            for i in range(order):
                basis = basis + orders[:, i] * power
                power = power * message
            made = dense(basis, w, f"head{k}")
            if k + 1 == layers:
                return h, made
            back = dense(made, w, f"back{k}")
            moved = np.empty_like(back)
            for s in np.unique(kind):
                moved[kind == s] = back[kind == s] @ w[f"update{k}"][s]
            return norm(h + moved, k), made
        own = {name.removeprefix(f"products{k}_"): v for name, v in w.items() if name.startswith(f"products{k}_")}
        basis = np.concatenate(contract(unflat(message, c, l_max), kind, own, l_max, order, degrees), axis=2)
        made = dense(basis[:, :, 0], w, f"head{k}")
        if k + 1 == layers:
            return h, made
        moved = np.empty_like(basis)
        for s in np.unique(kind):
            rows = kind == s
            moved[rows] = mixed(by_degree(basis[rows], l_max), [w[f"update{k}_{d}"][s] for d in degrees])
        return h + flat(moved, l_max), made

    def meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their atom, the atom's own before the sums that were sent to it; an atom's rows may be cut by
        a batch's end, so its last rows wait for the next batch."""
        waiting: pa.Table | None = None

        def made(t: pa.Table) -> pa.RecordBatch:
            own = t.column("own").to_numpy()
            key = np.stack([t.column("graph_id").to_numpy(), t.column("atom_id").to_numpy()], axis=1)
            first = np.flatnonzero(np.r_[True, (np.diff(key, axis=0) != 0).any(1)])
            if not own[first].all() or own.sum() != len(first):
                raise ValueError("an edge to what is no atom, or two atoms of one id")
            values = _rows(t.column("h").combine_chunks(), c * size, "an edge to")
            before = values[first].copy()
            message = np.add.reduceat(np.where(own[:, None], 0.0, values), first, axis=0)
            atoms_ = t.take(pa.array(first))
            h, out = update(atoms_.column("z_num").to_numpy(), before, message, k)
            so_far = np.frombuffer(b"".join(atoms_.column("features").to_pylist()), np.float64).reshape(len(first), k * c)
            so_far = np.concatenate([so_far, out], axis=1)
            vectors = message[:, c : 4 * c].reshape(len(first), 3, c).transpose(0, 2, 1).reshape(len(first), -1) if l_max else np.zeros((len(first), 0))
            columns = [atoms_.column(n).combine_chunks() for n in ("graph_id", "atom_id", "z_num")]
            return pa.RecordBatch.from_arrays([*columns, _packed(h), _packed(so_far), _lists(vectors)], names=NODE)

        for batch in batches:
            t = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            key = np.stack([t.column("graph_id").to_numpy(), t.column("atom_id").to_numpy()], axis=1)
            same = (key == key[-1]).all(1)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield made(t.slice(0, cut))
            waiting = t.slice(cut)
            if waiting.num_rows > 2 * MEET_ROWS:  # one atom's rows alone: its sums so far as one row
                waiting = _folded(waiting, c * size)
        if waiting is not None and waiting.num_rows:
            yield made(waiting)

    class Targets:
        def __init__(self, own: pa.RecordBatch, k: int):
            self.own, self.k, self.places = own, k, numbers(own, *"xyz")
            # in the first layer, sources differ by their species alone
            self.sums = np.zeros((own.num_rows, (c + 1) * size, len(species) if k == 0 else c * size))

        def take(self, rows: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
            if self.k == 0:
                features_ = np.eye(len(species))[kinds_of(rows.column("z_num").to_numpy(), species)]
            else:
                features_ = sources(_rows(rows.column("h"), c * size, "an edge from"), self.k)
            for dst, src, d, r in close(self.places, numbers(rows, *"xyz"), cutoff, tried=BLOCK_PAIRS):
                first = runs(dst)
                y = harmonics((-d / (r + 1e-8)).T, l_max)
                basis = bessel(r, cutoff, radial) * cosine_envelope(r, cutoff)[:, None]
                hidden = silu(dense(silu(dense(basis, w, f"radial{self.k}_0")), w, f"radial{self.k}_1"))
                left = (np.concatenate([hidden, np.ones((len(r), 1))], axis=1)[:, :, None] * y[:, None, :]).reshape(len(r), -1)
                sent, cuts = features_[src], [*first.tolist(), len(r)]
                for t, lo, hi in zip(dst[first].tolist(), cuts, cuts[1:], strict=False):
                    self.sums[t] += left[lo:hi].T @ sent[lo:hi]
            return iter(())

        def end(self) -> Iterator[pa.RecordBatch]:
            for lo in range(0, self.own.num_rows, 128):
                yield self.made(self.own.slice(lo, 128), self.sums[lo : lo + 128])

        def made(self, own: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
            k, z = self.k, own.column("z_num").to_numpy()
            if k == 0:
                begun = started(kinds_of(np.array(species), species))
                sums, h = sums @ sources(begun, 0), begun[kinds_of(z, species)]
                so_far = np.zeros((len(z), 0))
            else:
                h = _rows(own.column("h"), c * size, "an edge to")
                so_far = _rows(own.column("features"), k * c, "an edge to")
            sums = sums.reshape(len(z), c + 1, size, c, size)
            weight = np.concatenate([w[f"radial{k}_2"], w[f"radial{k}_2_b"][None]]).reshape(c + 1, -1, c)
            parts: list[list[np.ndarray]] = [[] for _ in degrees]
            for p, (one, two, both) in enumerate(paths(l_max)):
                weighted = np.einsum("tqmca,qc->tmca", sums[:, :, degree(two), :, degree(one)], weight[:, p])
                parts[both].append(np.einsum("tmca,amo->tco", weighted, couplings(l_max)[one, two, both]))
            message = flat(mixed([np.concatenate(x, axis=1) for x in parts], [w[f"down{k}_{d}"] for d in degrees]), l_max) / avg_neighbors
            h, out = update(z, h, message, k)
            vectors = message[:, c : 4 * c].reshape(len(z), 3, c).transpose(0, 2, 1).reshape(len(z), -1) if l_max else np.zeros((len(z), 0))
            columns = [own.column(n) for n in ("graph_id", "atom_id", "z_num")]
            return pa.RecordBatch.from_arrays([*columns, _packed(h), _packed(np.concatenate([so_far, out], axis=1)), _lists(vectors), *[own.column(a) for a in "xyz"]], names=[*NODE, *"xyz"])

    def started(kinds: np.ndarray) -> np.ndarray:
        made = dense(w["embed"][kinds], w, "start")
        return np.concatenate([made, np.zeros((len(made), c * (size - 1)))], axis=1) if products == "coupled" else made

    def sources(h: np.ndarray, k: int) -> np.ndarray:
        """Features as edges send them, ``c`` channels of all degrees."""
        return mixed(by_degree(unflat(h, c, l_max), l_max), [w[f"up{k}_{d}"] for d in degrees]).reshape(len(h), -1)

    spark, paths_written = atoms.sparkSession, []

    def over(edges: DataFrame) -> DataFrame:
        """The same over edges that are given."""
        near, path = _near(edges)
        paths_written.append(path)
        narrow = atoms.select(_known("graph_id"), _known("atom_id"), F.coalesce(F.col("z_num").cast("int"), F.lit(-1)).alias("z_num"))
        nodes = narrow.mapInArrow(start, NODE_DDL)
        for k in range(layers):
            joined = near.join(nodes.select("graph_id", F.col("atom_id").alias("src"), "h"), ["graph_id", "src"], "left")
            sums = joined.mapInArrow(lambda b, k=k: send(b, k), "graph_id long, atom_id long, sent binary")
            empty = F.lit(None).cast("binary")
            sums = sums.select("graph_id", "atom_id", F.lit(-1).alias("z_num"), F.col("sent").alias("h"), empty.alias("features"), F.lit(False).alias("own"))
            both = nodes.select("graph_id", "atom_id", "z_num", "h", "features", F.lit(True).alias("own")).unionAll(sums)
            met = both.repartition("graph_id", "atom_id").sortWithinPartitions("graph_id", "atom_id", F.desc("own"))
            nodes = met.mapInArrow(lambda b, k=k: meet(b, k), NODE_DDL)
            if k + 1 < layers:
                nodes, path = written(nodes, "nodes")
                paths_written.append(path)
                if k:  # the layer before is not read again
                    drop_written(spark, paths_written.pop(-2))
        return nodes

    if edges is None:
        nodes, placed = None, _placed(atoms)
        for k in range(layers):
            own, around = (["atom_id"], ["x", "y", "z", "z_num"]) if k == 0 else (["atom_id", "z_num", "features"], ["x", "y", "z", "h"])
            met = meeting(placed if k == 0 else nodes, open_cells(cutoff), own, around)
            nodes = met.mapInArrow(lambda batches, k=k: by_block(batches, lambda own: Targets(own, k)), f"{NODE_DDL}, x double, y double, z double")
            if k + 1 < layers:
                nodes, path = written(nodes, "nodes")
                paths_written.append(path)
                if k:
                    drop_written(spark, paths_written.pop(-2))
    else:
        nodes = over(edges)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in batches:
            values = np.frombuffer(b"".join(a.column("features").to_pylist()), np.float64).reshape(a.num_rows, layers * c)
            yield pa.RecordBatch.from_arrays([a.column("graph_id"), a.column("atom_id"), _lists(values), a.column("vectors")], names=["graph_id", "atom_id", "features", "vectors"])

    out = nodes.mapInArrow(shown, "graph_id long, atom_id long, features array<double>, vectors array<double>")
    out.written_to = paths_written
    return out


NODE = ["graph_id", "atom_id", "z_num", "h", "features", "vectors"]
NODE_DDL = "graph_id long, atom_id long, z_num int, h binary, features binary, vectors array<double>"


def _folded(t: pa.Table, width: int) -> pa.Table:
    """An atom's own row, if it is there, and the sum of the others."""
    own = t.column("own").to_numpy()
    values = _rows(t.column("h").combine_chunks(), width, "an edge to")
    head = t.slice(0, int(own.sum()))
    rest = t.slice(int(own.sum()), 1)
    at = rest.schema.get_field_index("h")
    return pa.concat_tables([head, rest.set_column(at, rest.schema.field(at), _packed(values[~own].sum(0, keepdims=True)))])


# -- edges


def edge_shapes(
    species: int, *, scalars: int = 8, tensors: int = 8, embedding: int = 16, radial: int = 8, layers: int = 2, l_max: int = 2,
    first_hidden: list[int] | None = None, latent_hidden: list[int] | None = None,
) -> dict[str, tuple[int, ...]]:
    """The weights of :func:`edge_encoder`."""
    into = [sum(p[2] == k for p in paths(l_max)) * tensors for k in range(l_max + 1)]
    first = [scalars, scalars] if first_hidden is None else first_hidden
    out: dict[str, tuple[int, ...]] = {"embed": (species, embedding)} | _network("first", [radial + 2 * embedding, *first, scalars]) | _layer("tensor", scalars, tensors)
    for k in range(layers):
        out |= _layer(f"env{k}", scalars, tensors) | {f"paths{k}": (len(paths(l_max)), tensors)} | {f"mix{k}_{d}": (into[d], tensors) for d in range(l_max + 1)}
        out |= _network(f"latent{k}_", [scalars + tensors, *(latent_hidden or []), scalars]) | _layer(f"out{k}", scalars, tensors)
    return out


def edge_encoder(
    atoms: DataFrame,
    edges: DataFrame | None,
    *,
    cutoff: float,
    species: list[int],
    weights: DataFrame | None = None,
    scalars: int = 8,
    tensors: int = 8,
    embedding: int = 16,
    radial: int = 8,
    layers: int = 2,
    l_max: int = 2,
    exponent: int = 6,
    first_hidden: list[int] | None = None,
    latent_hidden: list[int] | None = None,
    avg_neighbors: float | None = None,
    alpha: float = 0.5,
    seed: int = 0,
) -> DataFrame:
    """An encoder of edges: ``(graph_id, src, dst, features array<double>, vectors array<double>)``, ``scalars`` invariants
    for each layer, one layer behind the other, and the vectors of the tensor track's end, ``x, y, z`` for each channel.

    An edge begins with a network of the distance (Bessel functions times a polynomial cutoff) and both species, and with
    its harmonics times a dense layer of that. In each layer the tensors, scaled by a dense layer of the invariants, are
    multiplied with the harmonics of all edges of the source, added up over the root of ``avg_neighbors`` (without it,
    of the source's own number of edges), weighted for each path and channel, and mixed within each degree. Invariants become
    ``(x + alpha network(x, scalars of the tensors)) / sqrt(1 + alpha^2)``; a dense layer of them scales the new tensors. Invariants
    are given out times the cutoff, and go on without it.

    ``weights`` has the shapes of :func:`edge_shapes`; without it, weights are drawn by ``seed``. The harmonics that are added up
    are the edges' own and the same in every layer: they are summed once for each source, partly before the one shuffle, and
    joined back with the species. All layers are then one pass over the edges. ``written_to`` on the result has the paths that can be
    dropped after use.

    Without ``edges``, they are those of :func:`graphloom.operators.neighbors.neighbor_pairs` for the atoms' ``x, y, z`` and the
    cutoff, both directions, and are neither written nor shuffled: atoms meet in blocks, once for the sums and once for the layers. What a
    layer multiplies tensors with is the same for all edges of a source, so it is one matrix for each source."""
    shapes = edge_shapes(
        len(species), scalars=scalars, tensors=tensors, embedding=embedding, radial=radial, layers=layers, l_max=l_max, first_hidden=first_hidden, latent_hidden=latent_hidden
    )
    w = seeded_weights(shapes, seed) if weights is None else weights_of(weights, shapes)
    size, degrees = (l_max + 1) ** 2, range(l_max + 1)
    y_names = [f"y{k}" for k in range(size)]
    n_first, n_latent = (sum(k.startswith(p) and not k.endswith("_b") for k in shapes) for p in ("first", "latent0_"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in batches:
            if not e.num_rows:
                continue
            ends = []
            for end in ("src", "dst"):
                if e.column(f"z_{end}").null_count:
                    raise ValueError(f"an edge's {end} is no atom")
                ends.append(w["embed"][kinds_of(e.column(f"z_{end}").to_numpy(), species)])
            r = e.column("dist").to_numpy()
            y = harmonics(_numbers(e, "dx", "dy", "dz") / (r[:, None] + 1e-8), l_max)
            around = _numbers(e, *y_names)
            around = around / np.sqrt(np.maximum(e.column("n").to_numpy(), 1)[:, None] if avg_neighbors is None else avg_neighbors)
            envelope = polynomial_envelope(r, cutoff, exponent)[:, None]
            x = np.concatenate([bessel(r, cutoff, radial) * envelope, *ends], axis=1)
            for i in range(n_first):
                x = silu(dense(x, w, f"first{i}"))
            v = dense(x, w, "tensor")[:, :, None] * y[:, None, :]
            out = []
            for k in range(layers):
                v = v * dense(x, w, f"env{k}")[:, :, None]
                v = mixed(coupled(v, around, l_max, w[f"paths{k}"][None]), [w[f"mix{k}_{d}"] for d in degrees])
                latent = np.concatenate([x, v[:, :, 0]], axis=1)
                for i in range(n_latent):
                    latent = dense(latent if i == 0 else silu(latent), w, f"latent{k}_{i}")
                x = (x + alpha * latent) / np.sqrt(1 + alpha * alpha)
                v = v * dense(x, w, f"out{k}")[:, :, None]
                out.append(x * envelope)
            vectors = v[:, :, 1:4].reshape(len(r), -1) if l_max else np.zeros((len(r), 0))
            yield pa.RecordBatch.from_arrays([e.column("graph_id"), e.column("src"), e.column("dst"), _lists(np.concatenate(out, axis=1)), _lists(vectors)], names=["graph_id", "src", "dst", "features", "vectors"])

    def products(around: np.ndarray, k: int) -> np.ndarray:
        """For each source the matrix that couples the tensors of its edges with ``around`` and mixes them."""
        out, seen = np.zeros((len(around), tensors, size, tensors, size)), [0] * (l_max + 1)
        for p, (a, b, c) in enumerate(paths(l_max)):
            turned = np.tensordot(around[:, degree(b)], couplings(l_max)[a, b, c], ([1], [1]))
            own = w[f"paths{k}"][p][:, None] * w[f"mix{k}_{c}"][seen[c] * tensors : (seen[c] + 1) * tensors]
            out[:, :, degree(a), :, degree(c)] += own[None, :, None, :, None] * turned[:, None, :, None, :]
            seen[c] += 1
        return out.reshape(len(around), tensors * size, tensors * size)

    class Sources:
        def __init__(self, own: pa.RecordBatch):
            self.graph, self.ids, self.places = own.column("graph_id")[0].as_py(), own.column("atom_id").to_numpy(), numbers(own, *"xyz")
            self.kinds = kinds_of(own.column("z_num").to_numpy(), species)
            self.sums, self.n = np.zeros((len(self.ids), size)), np.zeros(len(self.ids))

        def take(self, rows: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
            ids, kinds = rows.column("atom_id").to_numpy(), kinds_of(rows.column("z_num").to_numpy(), species)
            for src, dst, d, r in close(self.places, numbers(rows, *"xyz"), cutoff, tried=BLOCK_PAIRS):
                first = runs(src)
                y = harmonics((d / (r + 1e-8)).T, l_max)
                if part == 1:
                    self.sums[src[first]] += np.add.reduceat(y, first, axis=0)
                    self.n[src[first]] += np.diff(np.r_[first, len(src)])
                    continue
                yield self.encoded(src, first, ids[dst], kinds[dst], r, y)

        def encoded(self, src: np.ndarray, first: np.ndarray, dst: np.ndarray, kinds: np.ndarray, r: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            at, cuts = src[first], [*first.tolist(), len(src)]
            around = self.sums[at] / np.sqrt(np.maximum(self.n[at], 1)[:, None] if avg_neighbors is None else avg_neighbors)
            envelope = polynomial_envelope(r, cutoff, exponent)[:, None]
            x = np.concatenate([bessel(r, cutoff, radial) * envelope, w["embed"][self.kinds[src]], w["embed"][kinds]], axis=1)
            for i in range(n_first):
                x = silu(dense(x, w, f"first{i}"))
            v = dense(x, w, "tensor")[:, :, None] * y[:, None, :]
            out = []
            for k in range(layers):
                v = (v * dense(x, w, f"env{k}")[:, :, None]).reshape(len(r), -1)
                made = np.empty_like(v)
                for m, lo, hi in zip(products(around, k), cuts, cuts[1:], strict=False):
                    np.matmul(v[lo:hi], m, out=made[lo:hi])
                v = made.reshape(len(r), tensors, size)
                latent = np.concatenate([x, v[:, :, 0]], axis=1)
                for i in range(n_latent):
                    latent = dense(latent if i == 0 else silu(latent), w, f"latent{k}_{i}")
                x = (x + alpha * latent) / np.sqrt(1 + alpha * alpha)
                v = v * dense(x, w, f"out{k}")[:, :, None]
                out.append(x * envelope)
            vectors = v[:, :, 1:4].reshape(len(r), -1) if l_max else np.zeros((len(r), 0))
            ends = [pa.array(np.full(len(r), self.graph)), pa.array(self.ids[src]), pa.array(dst)]
            return pa.RecordBatch.from_arrays([*ends, _lists(np.concatenate(out, axis=1)), _lists(vectors)], names=["graph_id", "src", "dst", "features", "vectors"])

        def end(self) -> Iterator[pa.RecordBatch]:
            return iter(())

    ddl = "graph_id long, src long, dst long, features array<double>, vectors array<double>"
    if edges is None:
        met = meeting(_placed(atoms), open_cells(cutoff), [], ["atom_id", "x", "y", "z", "z_num"], passes=2)
        out = met.mapInArrow(lambda batches: by_block(batches, Sources), ddl)
        out.written_to = []
        return out
    near, path = _near(edges)
    unit = [F.col(f"d{a}") / (F.col("dist") + 1e-8) for a in "xyz"]
    summed = near.groupBy("graph_id", "src").agg(*[F.sum(h).alias(n) for n, h in zip(y_names, harmonic_columns(*unit, l_max), strict=True)], F.count("*").alias("n"))
    kinds = atoms.select(_known("graph_id"), _known("atom_id"), F.coalesce(F.col("z_num").cast("int"), F.lit(-1)).alias("z_num"))
    # what a source's edges need: its species, and the sums
    sources = kinds.withColumnsRenamed({"atom_id": "src", "z_num": "z_src"}).join(summed, ["graph_id", "src"])
    targets = kinds.withColumnsRenamed({"atom_id": "dst", "z_num": "z_dst"})
    met = near.join(sources, ["graph_id", "src"], "left").join(targets, ["graph_id", "dst"], "left")
    out = met.mapInArrow(encode, ddl)
    out.written_to = [path]
    return out
