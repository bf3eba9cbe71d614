"""Neighbor lists: distance joins within graphs, open or periodic."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.blocks import by_block, close, meeting, numbers

#: Atoms of a periodic bin that a block owns, about.
PERIODIC_ROWS = 1 << 8

def literal(x: float) -> str:
    """A double as SQL writes it. Long expressions here are SQL text: a driver builds them in one step each."""
    return f"{float(x)!r}D"


def _within(d2: str, cutoff: float, inclusive: bool) -> str:
    return f"{d2} > 0 AND {d2} {'<=' if inclusive else '<'} {literal(cutoff * cutoff)}"


#: Displacement and squared distance of two atoms side by side.
APART = {a: f"({a}i - {a}j)" for a in "xyz"}
SQUARED = " + ".join(f"{d} * {d}" for d in APART.values())


def _left(*more: str) -> list[str]:
    return ["graph_id", "atom_id AS i", "x AS xi", "y AS yi", "z AS zi", *more]


def _right(*more: str) -> list[str]:
    return ["graph_id AS g2", "atom_id AS j", "x AS xj", "y AS yj", "z AS zj", *more]


#: A cell and those around it that come after it in order: each two neighboring cells meet once.
FORWARD = [(0, 0, 0), *(step for step in product((-1, 0, 1), repeat=3) if step > (0, 0, 0))]


def neighbor_pairs(atoms: DataFrame, cutoff: float, *, inclusive: bool = True, carry: list[str] = ()) -> DataFrame:
    """Half list ``(graph_id, i, j, dx, dy, dz, dist)`` with ``i > j``, ``d = pos[i] - pos[j]`` and
    ``0 < dist <= cutoff``; never cut short. Columns of the atoms to ``carry`` follow as ``<name>_i`` and ``<name>_j``: what pairs
    need of their ends comes with them, so that they need not be joined with the atoms again.

    Space is binned into cells as wide as the cutoff and the join's key is the cell, so a graph that holds
    most of all atoms is spread over as many keys as it has cells. An atom is sent to its own cell and to the half
    of the cells around it that come later; two atoms of different cells meet there whichever has the larger id."""
    width = literal(cutoff)
    around = ", ".join(f"struct({', '.join(map(str, step))})" for step in FORWARD)
    sent = atoms.selectExpr(*_left(*[f"floor({a} / {width}) AS c{a}" for a in "xyz"], *[f"{c} AS _{c}" for c in carry], f"inline(array({around})) AS (sx, sy, sz)"))
    sent = sent.selectExpr("graph_id", "i", "xi", "yi", "zi", "sx = 0 AND sy = 0 AND sz = 0 AS here", *[f"c{a} + s{a} AS n{a}" for a in "xyz"], *[f"_{c}" for c in carry])
    own = atoms.selectExpr(*_right(*[f"floor({a} / {width}) AS b{a}" for a in "xyz"], *[f"{c} AS _{c}2" for c in carry]))
    once = "CASE WHEN here THEN i > j ELSE i <> j END"
    met = sent.join(own, F.expr(f"graph_id = g2 AND nx = bx AND ny = by AND nz = bz AND {once} AND {_within(f'({SQUARED})', cutoff, inclusive)}"))
    ways = [f"CASE WHEN i > j THEN {d} ELSE -{d} END AS d{a}" for a, d in APART.items()]
    ends = [f"CASE WHEN i {turn} j THEN _{c} ELSE _{c}2 END AS {c}_{end}" for c in carry for end, turn in (("i", ">"), ("j", "<"))]
    return met.selectExpr("graph_id", "greatest(i, j) AS i", "least(i, j) AS j", *ways, f"sqrt({SQUARED}) AS dist", *ends)


def neighbor_pairs_simple(atoms: DataFrame, cutoff: float, *, inclusive: bool = True) -> DataFrame:
    """The same list by one equi-join on the graph, for sets of small graphs."""
    on = F.expr(f"graph_id = g2 AND i > j AND {_within(f'({SQUARED})', cutoff, inclusive)}")
    met = atoms.selectExpr(*_left()).join(atoms.selectExpr(*_right()), on)
    return met.selectExpr("graph_id", "i", "j", *[f"{d} AS d{a}" for a, d in APART.items()], f"sqrt({SQUARED}) AS dist")


def minimum_image(dx: Column, dy: Column, dz: Column, cell: list[list[float]]) -> tuple[Column, Column, Column]:
    """Displacements reduced along z, then y, then x, of a cell with rows ``(ax,0,0) (bx,by,0) (cx,cy,cz)``."""
    for k in (2, 1, 0):
        n = F.rint((dx, dy, dz)[k] / F.lit(cell[k][k]))
        dx, dy, dz = dx - n * cell[k][0], dy - n * cell[k][1], dz - n * cell[k][2]
    return dx, dy, dz


def neighbor_pairs_periodic(atoms: DataFrame, cutoff: float, cell: list[list[float]], *, inclusive: bool = True) -> DataFrame:
    """Half list under the minimum image convention; exact for cutoffs up to half the cell's width.

    Fractional coordinates along each axis are binned, modulo the number of bins, into bins at least as wide as
    the cutoff, and neighboring bins are joined, those at the ends of an axis with each other. An axis with room for
    fewer than three bins is not binned. The atoms of a bin are dealt to blocks of few, which meet all atoms of the bins
    around them, so that a graph is many tasks' work even where no axis is binned."""
    (ax, _, _), (bx, by, _), (cx, cy, cz) = cell
    # the distance between a cell's opposite faces, for lower triangular rows
    heights = [
        abs(ax * by * cz) / math.sqrt((by * cz) ** 2 + (bx * cz) ** 2 + (bx * cy - by * cx) ** 2),
        abs(by * cz) / math.hypot(cz, cy),
        abs(cz),
    ]
    # a little wider than the cutoff, so that rounding cannot put neighbors two bins apart
    bins = [n if (n := int(h / (cutoff * (1 + 1e-9)))) >= 3 else 1 for h in heights]
    w = F.col("z") / cz
    v = (F.col("y") - w * cy) / by
    u = (F.col("x") - v * bx - w * cx) / ax
    binned = [F.coalesce(F.pmod(F.floor(f * n), F.lit(n)), F.lit(0)).cast("long") for f, n in zip((u, v, w), bins, strict=True)]

    class Pairs:
        def __init__(self, own: pa.RecordBatch):
            self.graph, self.ids, self.places = own.column("graph_id")[0].as_py(), own.column("atom_id").to_numpy(), numbers(own, *"xyz")

        def take(self, rows: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
            ids = rows.column("atom_id").to_numpy()
            larger = lambda own: self.ids[own, None] > ids[None, :]
            for i, j, d, r in close(self.places, numbers(rows, *"xyz"), cutoff, inclusive=inclusive, image=image, also=larger):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(i), self.graph), self.ids[i], ids[j], *-d, r)], names=["graph_id", "i", "j", "dx", "dy", "dz", "dist"])

        def end(self) -> Iterator[pa.RecordBatch]:
            return iter(())

    def image(*d: np.ndarray) -> list[np.ndarray]:
        d = list(d)
        for k in (2, 1, 0):
            n = np.rint(d[k] / cell[k][k])
            d = [x - n * c if c else x for x, c in zip(d, cell[k], strict=True)]
        return d

    known = atoms.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("atom_id").cast("long").alias("atom_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]).filter("atom_id IS NOT NULL")
    met = meeting(known, binned, [], ["atom_id", "x", "y", "z"], bins=bins, own_rows=PERIODIC_ROWS)
    return met.mapInArrow(lambda batches: by_block(batches, Pairs), "graph_id long, i long, j long, dx double, dy double, dz double, dist double")


def directed_edges(pairs: DataFrame) -> DataFrame:
    """Both directions ``(graph_id, src, dst, dx, dy, dz, dist)`` of a half list, ``d = pos[dst] - pos[src]``, in one
    pass over it."""

    ways = ", ".join(f"named_struct('src', {a}, 'dst', {b}, 'dx', {s}dx, 'dy', {s}dy, 'dz', {s}dz, 'dist', dist)" for a, b, s in (("i", "j", "-"), ("j", "i", "")))
    return pairs.selectExpr("graph_id", f"inline(array({ways}))")


def neighbor_graph(atoms: DataFrame, cutoff: float, max_neighbors: int | None = None) -> DataFrame:
    """Directed edges shorter than the cutoff. Of an atom with more than ``max_neighbors`` of them, the nearest stay;
    other atoms keep all."""
    edges = directed_edges(neighbor_pairs(atoms, cutoff, inclusive=False))
    return edges if max_neighbors is None else nearest_edges(edges, max_neighbors).drop("rank")


def pair_capacity(pairs: DataFrame, max_pairs: int) -> DataFrame:
    """``(graph_id, num_pairs, over)``: the pairs of each graph, and whether a list of ``max_pairs`` would be too short.
    Lists here are never cut."""
    return pairs.groupBy("graph_id").agg(F.count("*").alias("num_pairs")).withColumn("over", F.col("num_pairs") > max_pairs)


def nearest_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest neighbors of each source atom, ties to the smaller ``dst``."""
    order = W.partitionBy("graph_id", "src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def without_pairs(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """A half list without the pairs of ``excluded(graph_id, i, j)``, in either order."""
    both = excluded.select("graph_id", F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"))
    return pairs.join(both, ["graph_id", "i", "j"], "left_anti")


def with_ends(edges: DataFrame, atoms: DataFrame, *columns: str, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges with atom columns of their ends, as ``<column>_src`` and ``<column>_dst``; an end that is no atom is an error
    when the row is read."""
    for end in ends:
        own = atoms.select(F.col("graph_id"), F.col("atom_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        edges = known_join(edges, own, ["graph_id", end], "an edge whose end is no atom")
    return edges


def known_join(rows: DataFrame, table: DataFrame, keys: list[str], otherwise: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``, its columns behind theirs. A row without a match is an error when it is
    read, never dropped: each column of ``table`` and the last key check for it."""
    more = [c for c in table.columns if c not in keys]
    joined = rows.join(table.withColumn("_known", F.lit(True)), keys, "left")
    # the error is raised where a column is read, so that no column's use is without the check
    wrong = F.raise_error(F.concat(F.lit(f"{otherwise}: "), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])))
    checked = {c: F.when(F.col("_known"), F.col(c)).otherwise(wrong.cast(joined.schema[c].dataType)).alias(c) for c in [keys[-1], *more]}
    order = [*keys, *[c for c in rows.columns if c not in keys], *more]
    return joined.select(*[checked.get(c, F.col(c)) for c in order])


def lookup(atoms: DataFrame, table: DataFrame, key: str = "z_num") -> DataFrame:
    """Element parameters by key; an element that the table lacks is an error when the row is read."""
    known = table.withColumn("_known", F.lit(True))
    joined = atoms.join(known, key, "left")
    checked = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no parameters for "), F.col(key).cast("string"))).cast(atoms.schema[key].dataType))
    return joined.withColumn(key, checked).drop("_known")
