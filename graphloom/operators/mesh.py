"""Particle-mesh Ewald sums: energies, forces and stress of the part in wave space.

Charges are spread to a mesh by splines and summed by point. The mesh of a graph is transformed one axis after the other, in
grouped passes over slabs and bars of :data:`BLOCK` points' width, so that no task holds more than ``grid * BLOCK^2`` of its
points; a mesh of up to :data:`WHOLE` points a side is one group. Both ways give the same numbers. Potentials go back the
same way, are cut into blocks with the points that splines of a block's atoms reach beyond it, and meet the atoms, which come
packed by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points a side up to which a mesh is transformed at once; the width of slabs and bars beyond that, and of blocks of potentials.
WHOLE, BLOCK, TILE = 32, 16, 8
#: Atoms of a block that are packed in one row at most.
PACKED_ATOMS = 4096

Box = tuple[float, float, float] | list[list[float]]


def cell_of(box: Box) -> np.ndarray:
    """Three edge lengths, or the three vectors of a cell as rows, as a matrix."""
    cell = np.array(box, float)
    return np.diag(cell) if cell.ndim == 1 else cell


def spline_weights(frac: np.ndarray, order: int) -> np.ndarray:
    """Cardinal B-spline weights ``[n, order]`` at fractional offsets, by the usual recursion on the order."""
    w = np.zeros((len(frac), order))
    w[:, 0], w[:, 1] = 1 - frac, frac
    for p in range(3, order + 1):
        k = np.arange(p - 1, -1, -1)
        left = np.where(k > 0, w[:, np.maximum(k - 1, 0)], 0.0)
        right = np.where(k < p - 1, w[:, k], 0.0)
        w[:, k] = ((frac[:, None] + (p - 1 - k)) * left + (k + 1 - frac[:, None]) * right) / (p - 1)
    return w


def spline_slopes(frac: np.ndarray, order: int) -> np.ndarray:
    """Derivatives of :func:`spline_weights`: differences of the splines of one order less (three and more)."""
    low = np.pad(spline_weights(frac, order - 1), ((0, 0), (1, 1)))
    return low[:, :-1] - low[:, 1:]


class Mesh:
    """A cell, its mesh and the weights of its waves."""

    def __init__(self, box: Box, alpha: float, grid: int, order: int, coulomb: float) -> None:
        if order < 3 or grid < order or (grid > WHOLE and grid < TILE + order):
            raise ValueError("splines of order three and more, on a mesh of at least as many points")
        cell = cell_of(box)
        self.inverse, self.volume = np.linalg.inv(cell), abs(float(np.linalg.det(cell)))
        self.alpha, self.grid, self.order, self.coulomb = alpha, grid, order, coulomb
        self.whole, self.block, self.tile = grid <= WHOLE, BLOCK, TILE
        self.half = grid // 2 + 1  # a real mesh has as many waves along its last axis
        phase = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(grid, 1 / grid), np.arange(order)) / grid)
        self.modulus = np.abs(phase @ spline_weights(np.zeros(1), order)[0]) ** 2
        self.modulus[self.modulus < 1e-7] = np.inf

    def places(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first point of each atom's splines, and the offsets from there."""
        u = (xyz @ self.inverse % 1.0) * self.grid
        base = np.floor(u).astype(np.int64)
        return base % self.grid, u - base

    def influence(self, ky: np.ndarray, kz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the waves ``[all kx, ky, kz]``, their vectors, and the squares of these (infinite for no wave)."""
        m = np.fft.fftfreq(self.grid, 1 / self.grid)
        waves = np.stack(np.meshgrid(m, m[ky], kz.astype(float), indexing="ij"), axis=-1) @ self.inverse.T
        k2 = (waves * waves).sum(-1)
        k2[k2 == 0] = np.inf
        shape = self.coulomb * np.exp(-(np.pi**2) * np.where(np.isinf(k2), 0, k2) / self.alpha**2) / (np.pi * self.volume * k2)
        return shape / (self.modulus[:, None, None] * self.modulus[ky][None, :, None] * self.modulus[kz][None, None, :]), waves, k2

    def energy(self, f: np.ndarray, ky: np.ndarray, kz: np.ndarray) -> list[float]:
        """Energy and virial (xx, yy, zz, xy, xz, yz: its slopes under strain) of transformed charges ``[all kx, ky, kz]``."""
        shape, waves, k2 = self.influence(ky, kz)
        twice = np.where((kz == 0) | (2 * kz == self.grid), 1.0, 2.0)
        part = 0.5 * shape * np.abs(f) ** 2 * twice
        total = float(part.sum())
        pull = part * 2 * (1 / k2 + (np.pi / self.alpha) ** 2)
        return [total] + [float((pull * waves[..., a] * waves[..., b]).sum()) - (total if a == b else 0.0) for a, b in AXES]


AXES = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
SUMS = ["energy", "xx", "yy", "zz", "xy", "xz", "yz"]
SUMS_DDL = "graph_id long, " + ", ".join(f"{n} double" for n in SUMS)


def _spread(atoms: DataFrame, mesh: Mesh) -> DataFrame:
    """``(graph_id, cell, q)``: charges by mesh point."""
    grid, order = mesh.grid, mesh.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in batches:
            for start in range(0, a.num_rows, PACKED_ATOMS):
                some = a.slice(start, PACKED_ATOMS)
                base, frac = mesh.places(np.stack([some.column(c).to_numpy() for c in "xyz"], axis=1))
                w = [spline_weights(frac[:, k], order) for k in range(3)]
                at = [(base[:, k, None] + np.arange(order)) % grid for k in range(3)]
                point = (at[0][:, :, None, None] * grid + at[1][:, None, :, None]) * grid + at[2][:, None, None, :]
                values = some.column("q").to_numpy()[:, None, None, None] * w[0][:, :, None, None] * w[1][:, None, :, None] * w[2][:, None, None, :]
                graphs, which = np.unique(some.column("graph_id").to_numpy(), return_inverse=True)
                key = (which[:, None] * grid**3 + point.reshape(len(which), -1)).ravel()
                own, back = np.unique(key, return_inverse=True)
                sums = np.bincount(back, values.ravel(), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(graphs[own // grid**3]), pa.array(own % grid**3), pa.array(sums)], names=["graph_id", "cell", "q"])

    narrow = atoms.select(_known("graph_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "q")])
    return narrow.mapInArrow(run, "graph_id long, cell long, q double").groupBy("graph_id", "cell").agg(F.sum("q").alias("q"))


def _known(name: str):
    return F.coalesce(F.col(name).cast("long"), F.raise_error(F.lit(f"a row without {name}")).cast("long")).alias(name)


#: A part of a mesh on its way: where it belongs (``a``, ``b``), which part it is there, and its numbers.
PIECE_DDL = "graph_id long, a int, b int, part int, data binary"
PIECE = pa.schema([("graph_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _pieces(graph: int, rows: list[tuple[int, int, int, np.ndarray]]) -> pa.Table:
    columns = list(zip(*[(graph, a, b, part, np.ascontiguousarray(x).tobytes()) for a, b, part, x in rows], strict=True))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def _blocks(n: int, width: int) -> list[np.ndarray]:
    return [np.arange(k, min(k + width, n)) for k in range(0, n, width)]


def _joined(t: pa.Table, axis: int, shape: tuple[int, ...], dtype=np.complex128) -> np.ndarray:
    """The pieces of a group, in order of their parts, along ``axis``; -1 in ``shape`` is what a piece has there."""
    rows = sorted(zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(data, dtype).reshape(shape) for _, data in rows], axis=axis)


def _transformed(charges: DataFrame, mesh: Mesh) -> DataFrame:
    """Pieces ``(graph_id, a=ky block, b=kz block, part=x)``: transformed along z and y, for bars along x."""
    grid, half = mesh.grid, mesh.half
    y_blocks, k_blocks, j_blocks = (_blocks(n, mesh.block) for n in (grid, half, grid))

    def along_z(t: pa.Table) -> pa.Table:
        graph, x, yb = (t.column(n)[0].as_py() for n in ("graph_id", "x", "yb"))
        slab = np.zeros((len(y_blocks[yb]), grid))
        cell = t.column("cell").to_numpy()
        slab[cell // grid % grid - y_blocks[yb][0], cell % grid] = t.column("q").to_numpy()
        f = np.fft.rfft(slab, axis=1)
        return _pieces(graph, [(x, kb, yb, f[:, k]) for kb, k in enumerate(k_blocks)])

    def along_y(t: pa.Table) -> pa.Table:
        graph, x, kb = (t.column(n)[0].as_py() for n in ("graph_id", "a", "b"))
        n = len(k_blocks[kb])
        own = np.zeros((grid, n), complex)
        for part, data in zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True):
            own[y_blocks[part]] = np.frombuffer(data, complex).reshape(-1, n)  # rows of y without a charge have no piece
        f = np.fft.fft(own, axis=0)
        return _pieces(graph, [(jb, kb, x, f[j]) for jb, j in enumerate(j_blocks)])

    placed = charges.withColumns({"x": F.expr(f"int(cell div {grid * grid})"), "yb": F.expr(f"int(cell div {grid} % {grid} div {mesh.block})")})
    return placed.groupBy("graph_id", "x", "yb").applyInArrow(along_z, PIECE_DDL).groupBy("graph_id", "a", "b").applyInArrow(along_y, PIECE_DDL)


def _bar(t: pa.Table, mesh: Mesh) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """A group of :func:`_transformed`, transformed along x: the graph, both blocks, numbers and places of waves."""
    graph, jb, kb = (t.column(n)[0].as_py() for n in ("graph_id", "a", "b"))
    ky, kz = _blocks(mesh.grid, mesh.block)[jb], _blocks(mesh.half, mesh.block)[kb]
    own = np.zeros((mesh.grid, len(ky), len(kz)), complex)
    for part, data in zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True):
        own[part] = np.frombuffer(data, complex).reshape(len(ky), len(kz))
    return graph, jb, kb, np.fft.fft(own, axis=0), ky, kz


def _filled(t: pa.Table, grid: int) -> np.ndarray:
    whole = np.zeros(grid**3)
    whole[t.column("cell").to_numpy()] = t.column("q").to_numpy()
    return whole.reshape(grid, grid, grid)


def _sums(charges: DataFrame, mesh: Mesh) -> DataFrame:
    """Energy and virial by graph."""

    def row(graph: int, values: list[float]) -> pa.Table:
        return pa.table({"graph_id": pa.array([graph], pa.int64()), **{n: [v] for n, v in zip(SUMS, values, strict=True)}})

    def whole(t: pa.Table) -> pa.Table:
        every = np.arange(mesh.grid)
        return row(t.column("graph_id")[0].as_py(), mesh.energy(np.fft.rfftn(_filled(t, mesh.grid)), every, every[: mesh.half]))

    def bar(t: pa.Table) -> pa.Table:
        graph, _, _, f, ky, kz = _bar(t, mesh)
        return row(graph, mesh.energy(f, ky, kz))

    if mesh.whole:
        return charges.groupBy("graph_id").applyInArrow(whole, SUMS_DDL)
    parts = _transformed(charges, mesh).groupBy("graph_id", "a", "b").applyInArrow(bar, SUMS_DDL)
    return parts.groupBy("graph_id").agg(*[F.sum(n).alias(n) for n in SUMS])


def ewald_reciprocal(atoms: DataFrame, *, box: Box, alpha: float, grid: int = 16, order: int = 5, coulomb: float = 1.0) -> DataFrame:
    """Reciprocal part of a particle-mesh Ewald sum ``(graph_id, energy)`` in a box of three edges, or a cell of three
    vectors. No self-energy or net-charge term."""
    mesh = Mesh(box, alpha, grid, order, coulomb)
    return _sums(_spread(atoms, mesh), mesh).select("graph_id", "energy")


def ewald_reciprocal_stress(atoms: DataFrame, *, box: Box, alpha: float, grid: int = 16, order: int = 5, coulomb: float = 1.0) -> DataFrame:
    """``(graph_id, xx, yy, zz, xy, xz, yz)``: the same energy's slopes under a strain of cell and atoms, over the volume."""
    mesh = Mesh(box, alpha, grid, order, coulomb)
    return _sums(_spread(atoms, mesh), mesh).select("graph_id", *[(F.col(n) / mesh.volume).alias(n) for n in SUMS[1:]])


TILE_DDL = "graph_id long, tile long, lx int, ly binary, data binary"
TILE_SCHEMA = pa.schema([("graph_id", pa.int64()), ("tile", pa.int64()), ("lx", pa.int32()), ("ly", pa.binary()), ("data", pa.binary())])


def _potentials(charges: DataFrame, mesh: Mesh) -> DataFrame:
    """``(graph_id, tile, pieces)``: the energy's slopes by each point's charge, cut into tiles. A piece has the rows ``ly`` of
    the plane ``lx`` of its tile, counted from the tile's first point; tiles overlap by an order less one."""
    grid, half, reach = mesh.grid, mesh.half, mesh.tile + mesh.order - 1
    y_blocks, k_blocks = _blocks(grid, mesh.block), _blocks(half, mesh.block)
    scale = float(grid) ** 3

    def whole(t: pa.Table) -> pa.Table:
        every = np.arange(grid)
        shape, _, _ = mesh.influence(every, every[:half])
        phi = np.fft.irfftn(shape * np.fft.rfftn(_filled(t, grid)), s=(grid,) * 3, axes=(0, 1, 2)) * scale
        rows = [(t.column("graph_id")[0].as_py(), 0, x, every.astype(np.int32).tobytes(), phi[x].tobytes()) for x in range(grid)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TILE_SCHEMA, strict=True)], schema=TILE_SCHEMA)

    def back_x(t: pa.Table) -> pa.Table:
        graph, jb, kb, f, ky, kz = _bar(t, mesh)
        g = np.fft.ifft(f * mesh.influence(ky, kz)[0], axis=0)
        return _pieces(graph, [(x, kb, jb, g[x]) for x in range(grid)])

    def back_y(t: pa.Table) -> pa.Table:
        graph, x, kb = (t.column(n)[0].as_py() for n in ("graph_id", "a", "b"))
        g = np.fft.ifft(_joined(t, 0, (-1, len(k_blocks[kb]))), axis=0)
        return _pieces(graph, [(x, yb, kb, g[y]) for yb, y in enumerate(y_blocks)])

    def back_z(t: pa.Table) -> pa.Table:
        graph, x, yb = (t.column(n)[0].as_py() for n in ("graph_id", "a", "b"))
        y = y_blocks[yb]
        phi = np.fft.irfft(_joined(t, 1, (len(y), -1)), n=grid, axis=1) * scale
        n = -(-grid // mesh.tile)
        rows = []
        for tx in range(n):
            lx = (x - tx * mesh.tile) % grid
            if lx < reach:
                for ty in range(n):
                    ly = (y - ty * mesh.tile) % grid
                    inside = ly < reach
                    if inside.any():
                        for tz in range(n):
                            z = (tz * mesh.tile + np.arange(reach)) % grid
                            rows.append((graph, (tx * n + ty) * n + tz, lx, ly[inside].astype(np.int32).tobytes(), phi[inside][:, z].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TILE_SCHEMA, strict=True)], schema=TILE_SCHEMA)

    if mesh.whole:
        tiles = charges.groupBy("graph_id").applyInArrow(whole, TILE_DDL)
    else:
        bars = _transformed(charges, mesh).groupBy("graph_id", "a", "b").applyInArrow(back_x, PIECE_DDL)
        tiles = bars.groupBy("graph_id", "a", "b").applyInArrow(back_y, PIECE_DDL).groupBy("graph_id", "a", "b").applyInArrow(back_z, TILE_DDL)
    return tiles.groupBy("graph_id", "tile").agg(F.collect_list(F.struct("lx", "ly", "data")).alias("pieces"))  # a tile has a fixed size


def ewald_reciprocal_forces(atoms: DataFrame, *, box: Box, alpha: float, grid: int = 16, order: int = 5, coulomb: float = 1.0) -> DataFrame:
    """``(graph_id, atom_id, fx, fy, fz)``: forces of :func:`ewald_reciprocal`'s energy, the slopes of each atom's splines times the
    mesh's potentials. Atoms are ordered by tile, whatever their number in one, and packed before they meet the potentials."""
    mesh = Mesh(box, alpha, grid, order, coulomb)
    side = grid if mesh.whole else mesh.tile + order - 1
    n_tiles = -(-grid // mesh.tile)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in batches:
            base, _ = mesh.places(np.stack([a.column(c).to_numpy() for c in "xyz"], axis=1))
            at = base // mesh.tile
            tile = np.zeros(a.num_rows, np.int64) if mesh.whole else (at[:, 0] * n_tiles + at[:, 1]) * n_tiles + at[:, 2]
            yield pa.RecordBatch.from_arrays([*a.columns, pa.array(tile)], names=[*a.schema.names, "tile"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in batches:
            if not a.num_rows:
                continue
            key = np.stack([a.column("graph_id").to_numpy(), a.column("tile").to_numpy()], axis=1)
            cut = np.r_[0, np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1, len(key)]
            ids = a.column("atom_id").to_numpy()
            values = np.stack([a.column(c).to_numpy() for c in "xyzq"], axis=1)
            spans = [(s, min(s + PACKED_ATOMS, e)) for b, e in zip(cut, cut[1:], strict=False) for s in range(b, e, PACKED_ATOMS)]
            rows = [(int(key[s, 0]), int(key[s, 1]), ids[s:e].tobytes(), values[s:e].tobytes()) for s, e in spans]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["graph_id", "tile", "ids", "values"])

    def pushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, tile, ids, values, pieces in zip(*(batch.column(n).to_pylist() for n in ("graph_id", "tile", "ids", "values", "pieces")), strict=True):
                if pieces is None:
                    raise ValueError(f"no potentials for graph {graph}")
                phi = np.zeros((side, side, side))
                for p in pieces:
                    phi[p["lx"], np.frombuffer(p["ly"], np.int32)] = np.frombuffer(p["data"]).reshape(-1, side)
                own = np.frombuffer(values).reshape(-1, 4)
                base, frac = mesh.places(own[:, :3])
                if not mesh.whole:
                    first = [t * mesh.tile for t in (tile // n_tiles**2, tile // n_tiles % n_tiles, tile % n_tiles)]
                    at = [(base[:, k] - first[k])[:, None] + np.arange(order) for k in range(3)]
                else:
                    at = [(base[:, k, None] + np.arange(order)) % grid for k in range(3)]
                w, s = ([f(frac[:, k], order) for k in range(3)] for f in (spline_weights, spline_slopes))
                near = phi[at[0][:, :, None, None], at[1][:, None, :, None], at[2][:, None, None, :]]
                by_axis = [np.einsum("nijk,ni,nj,nk->n", near, *[s[k] if k == axis else w[k] for k in range(3)], optimize=True) for axis in range(3)]
                force = -grid * own[:, 3:] * (np.stack(by_axis, axis=1) @ mesh.inverse.T)
                keys = np.frombuffer(ids, np.int64)
                columns = [pa.array(np.full(len(keys), graph)), pa.array(keys), *(pa.array(force[:, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["graph_id", "atom_id", "fx", "fy", "fz"])

    narrow = atoms.select(_known("graph_id"), _known("atom_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "q")])
    ddl = "graph_id long, atom_id long, x double, y double, z double, q double, tile long"
    ordered = narrow.mapInArrow(tiled, ddl).repartitionByRange("graph_id", "tile", "atom_id").sortWithinPartitions("graph_id", "tile")
    rows = ordered.mapInArrow(packed, "graph_id long, tile long, ids binary, values binary")
    met = rows.join(_potentials(_spread(atoms, mesh), mesh), ["graph_id", "tile"], "left")
    return met.mapInArrow(pushed, "graph_id long, atom_id long, fx double, fy double, fz double")
