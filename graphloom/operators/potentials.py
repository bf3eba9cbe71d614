"""Energies, forces and stresses of pairs and of bonded terms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import physics as ph
from graphloom.operators.neighbors import known_join


def mix_pairs(
    pairs: DataFrame,
    params: DataFrame,
    *,
    geometric: list[str] = (),
    arithmetic: list[str] = (),
    carry: list[str] = (),
    custom: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """Pairs with mixed parameters of both atoms; ``carry`` keeps ``<name>_i`` and ``<name>_j``; ``custom`` maps
    names to rules of one's own. Parameters that the pairs carry already (see
    :func:`graphloom.operators.neighbors.neighbor_pairs`) are not joined again."""
    rules = {n: ph.geometric for n in geometric} | {n: ph.arithmetic for n in arithmetic} | (custom or {})
    names = [*rules, *carry]
    for end in ("i", "j"):
        missing = [n for n in names if f"{n}_{end}" not in pairs.columns]
        if missing:
            own = params.selectExpr("graph_id", f"atom_id AS {end}", *[f"{n} AS {n}_{end}" for n in missing])
            pairs = known_join(pairs, own, ["graph_id", end], "a pair whose end is no atom")
    kept = ["graph_id", "i", "j", "dx", "dy", "dz", "dist"]
    mixed = [f(F.col(f"{n}_i"), F.col(f"{n}_j")).alias(n) for n, f in rules.items()]
    return pairs.select(*kept, *mixed, *[f"{n}_{e}" for n in carry for e in ("i", "j")])


def compose(pairs: DataFrame, terms: dict[str, Column], bidirectional: bool = False) -> DataFrame:
    """Every term and their total by graph, in one pass over the pairs; halved for lists of both directions."""
    scale = 0.5 if bidirectional else 1.0
    rows = pairs.select("graph_id", *[(e * scale).alias(k) for k, e in terms.items()])
    total = sum((F.col(k) for k in terms), F.lit(0.0))
    return rows.withColumn("total", total).groupBy("graph_id").agg(*[F.sum(k).alias(k) for k in [*terms, "total"]])


@dataclass(frozen=True)
class PairPotential:
    """A pair term as expressions of the distance and of mixed parameters: its energy and the slope of that."""

    name: str
    energy: Callable[[], Column]
    slope: Callable[[], Column]
    mixing: dict[str, list[str]]

    def mixed(self, pairs: DataFrame, params: DataFrame) -> DataFrame:
        return mix_pairs(pairs, params, **self.mixing)

    def calc_energy(self, pairs: DataFrame, params: DataFrame) -> float:
        """The energy of all pairs together."""
        return float(pair_energy(self.mixed(pairs, params), self.energy(), by_graph=False).first().energy)

    def calc_forces(self, pairs: DataFrame, params: DataFrame) -> DataFrame:
        """``-dE/dpos`` of each atom of ``params``."""
        return forces(self.mixed(pairs, params), self.slope(), params)


def _columns(f: Callable[..., Column], *names: str) -> Callable[[], Column]:
    return lambda: f(*map(F.col, names))


def potential(name: str) -> PairPotential:
    """One of the named pair terms."""
    terms = {
        "lennard_jones": (ph.lennard_jones, ph.lennard_jones_slope, ("dist", "eps", "sigma")),
        "repulsion": (ph.repulsion, ph.repulsion_slope, ("dist", "eps", "lam", "r_star")),
        "dispersion": (ph.dispersion, ph.dispersion_slope, ("dist", "c6", "r_star")),
        "charge_transfer": (ph.charge_transfer, ph.charge_transfer_slope, ("dist", "eps", "lam", "r_star")),
    }
    energy, slope, names = terms[name]
    return PairPotential(name, _columns(energy, *names), _columns(slope, *names), MIXINGS[name])


#: The parameters that each named pair term mixes, and how.
MIXINGS = {
    "repulsion": {"geometric": ["eps"], "arithmetic": ["lam", "r_star"]},
    "dispersion": {"geometric": ["c6"], "arithmetic": ["r_star"]},
    "charge_transfer": {"geometric": ["eps"], "arithmetic": ["lam", "r_star"]},
    "lennard_jones": {"geometric": ["eps"], "arithmetic": ["sigma"]},
}


def mix_for(term: str, pairs: DataFrame, params: DataFrame) -> DataFrame:
    """Pairs with the mixed parameters of a named term."""
    return mix_pairs(pairs, params, **MIXINGS[term])


def pair_energy(pairs: DataFrame, energy: Column, *, by_graph: bool = True, bidirectional: bool = False, scale: float = 1.0) -> DataFrame:
    """A term's energy by graph, or of all pairs together; halved for lists of both directions, and scaled."""
    total = F.coalesce(F.sum(energy), F.lit(0.0)) * (scale * (0.5 if bidirectional else 1.0))
    grouped = pairs.groupBy("graph_id") if by_graph else pairs.groupBy()
    return grouped.agg(total.alias("energy"))


def compose_forces(pairs: DataFrame, terms: dict[str, tuple[Column, Column]], atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Energies of all terms ``name -> (energy, slope)`` with their total, by graph, and the forces ``-dE/dpos`` of the
    total, by atom: the slopes are added up before anything is summed. Where ``pairs`` has no displacements, they are
    taken from the atoms' positions."""
    if not terms:
        raise ValueError("no terms to compose")
    if "dist" not in pairs.columns:
        pairs = placed_pairs(pairs, atoms)
    total = sum((slope for _, slope in terms.values()), F.lit(0.0))
    return compose(pairs, {k: e for k, (e, _) in terms.items()}), forces(pairs, total, atoms)


def placed_pairs(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Pairs with ``d = pos[i] - pos[j]`` and ``dist`` from the atoms' positions."""
    for end in ("i", "j"):
        own = atoms.select("graph_id", F.col("atom_id").alias(end), *[F.col(a).alias(f"{a}_{end}") for a in "xyz"])
        pairs = known_join(pairs, own, ["graph_id", end], "a pair whose end is no atom")
    d = {f"d{a}": F.col(f"{a}_i") - F.col(f"{a}_j") for a in "xyz"}
    return pairs.withColumns(d).withColumn("dist", ph.norm((F.col("dx"), F.col("dy"), F.col("dz")))).drop(*[f"{a}_{e}" for a in "xyz" for e in "ij"])


def forces(pairs: DataFrame, slope: Column, atoms: DataFrame) -> DataFrame:
    """``(graph_id, atom_id, fx, fy, fz)`` of a half list with ``d = pos[i] - pos[j]`` and ``slope = dE/dr``; atoms
    without a pair have none."""
    s = -slope / F.greatest("dist", F.lit(ph.R_MIN))
    rows = pairs.select("graph_id", "i", "j", s.alias("s"), "dx", "dy", "dz")
    # both ends of a pair in one pass
    ends = ", ".join(f"named_struct('atom_id', {end}, 'fx', {s} * dx, 'fy', {s} * dy, 'fz', {s} * dz)" for end, s in (("i", "s"), ("j", "-s")))
    both = rows.selectExpr("graph_id", f"inline(array({ends}))")
    summed = both.groupBy("graph_id", "atom_id").agg(*[F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"])
    out = atoms.select("graph_id", "atom_id").join(summed, ["graph_id", "atom_id"], "left")
    return out.select("graph_id", "atom_id", *[F.coalesce(f"f{a}", F.lit(0.0)).alias(f"f{a}") for a in "xyz"])


def stress(pairs: DataFrame, slope: Column, volume: float) -> DataFrame:
    """``1/V sum dE/dr d_a d_b / r`` by graph."""
    s = slope / F.greatest("dist", F.lit(ph.R_MIN))
    parts = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    return pairs.groupBy("graph_id").agg(*[(F.sum(s * F.col(f"d{a}") * F.col(f"d{b}")) / volume).alias(a + b) for a, b in parts])


def _bonded_rows(atoms: DataFrame, topology: DataFrame, kinds: DataFrame, n: int) -> DataFrame:
    rows = topology
    for k in range(1, n + 1):
        own = atoms.select("graph_id", F.col("atom_id").alias(f"a{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
        rows = known_join(rows, own, ["graph_id", f"a{k}"], "a term whose atom is not there")
    return known_join(rows, kinds, ["kind"], "a term of an unknown kind")


def _between(a: int, b: int) -> tuple[Column, ...]:
    return tuple(F.col(f"{c}{b}") - F.col(f"{c}{a}") for c in "xyz")


#: Atoms, value and gradients of each kind of bonded term.
BONDED = {
    "bond": (2, lambda: ph.norm(_between(1, 2)), lambda: ph.distance_gradient(_between(1, 2))),
    "angle": (3, lambda: ph.angle(_between(2, 1), _between(2, 3)), lambda: ph.angle_gradient(_between(2, 1), _between(2, 3))),
    "dihedral": (
        4,
        lambda: ph.dihedral(_between(1, 2), _between(2, 3), _between(3, 4)),
        lambda: ph.dihedral_gradient(_between(1, 2), _between(2, 3), _between(3, 4)),
    ),
}


def bonded_energy(atoms: DataFrame, topology: DataFrame, kinds: DataFrame, what: str) -> DataFrame:
    """Harmonic energy by graph of a topology ``(graph_id, a1, a2[, a3[, a4]], kind)`` with parameters
    ``kinds(kind, k, x0)``; a graph without a term has no row."""
    n, value, _ = BONDED[what]
    terms = _bonded_rows(atoms, topology, kinds, n).withColumn("value", value())
    return terms.groupBy("graph_id").agg(F.sum(ph.harmonic(F.col("value"), F.col("k"), F.col("x0"))).alias("energy"))


def bonded_forces(atoms: DataFrame, topology: DataFrame, kinds: DataFrame, what: str) -> DataFrame:
    """``(graph_id, atom_id, fx, fy, fz)`` of the same terms; atoms in no term have none."""
    n, value, gradients = BONDED[what]
    rows = _bonded_rows(atoms, topology, kinds, n).withColumn("slope", F.col("k") * (value() - F.col("x0")))
    ends = [F.struct(F.col(f"a{k}").alias("atom_id"), *[(-F.col("slope") * c).alias(f"f{a}") for a, c in zip("xyz", g, strict=True)]) for k, g in enumerate(gradients(), 1)]
    summed = rows.select("graph_id", F.inline(F.array(*ends))).groupBy("graph_id", "atom_id").agg(*[F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"])
    out = atoms.select("graph_id", "atom_id").join(summed, ["graph_id", "atom_id"], "left")
    return out.select("graph_id", "atom_id", *[F.coalesce(f"f{a}", F.lit(0.0)).alias(f"f{a}") for a in "xyz"])


def bonded_stress(atoms: DataFrame, topology: DataFrame, kinds: DataFrame, what: str, volume: float) -> DataFrame:
    """``(graph_id, xx, yy, zz, xy, xz, yz)``: slopes of the same energy under a strain of the atoms, over the volume; the
    gradients of a term add up to nothing, so its first atom can be the origin."""
    n, value, gradients = BONDED[what]
    rows = _bonded_rows(atoms, topology, kinds, n).withColumn("slope", F.col("k") * (value() - F.col("x0")))
    arms = [(_between(1, k), g) for k, g in enumerate(gradients(), 1) if k > 1]
    axes = [(a, b) for a in range(3) for b in range(a, 3)]
    parts = {"xyz"[a] + "xyz"[b]: sum((g[a] * arm[b] for arm, g in arms), F.lit(0.0)) * F.col("slope") / volume for a, b in axes}
    return rows.groupBy("graph_id").agg(*[F.sum(parts[n]).alias(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")])


def conserve_charge(atoms: DataFrame, charge: str, total: Column) -> DataFrame:
    """Charges shifted evenly so that each graph's sum is ``total``. Sums are made before the shuffle and joined
    back, so a graph with most of the atoms is no hot group."""
    sums = atoms.groupBy(F.col("graph_id").alias("_graph")).agg(F.sum(charge).alias("_sum"), F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    joined = atoms.join(sums, F.col("graph_id").eqNullSafe(F.col("_graph")))
    return joined.withColumn(charge, F.col(charge) - (F.col("_sum") - total) / F.col("_n")).drop("_graph", "_sum", "_n")


def volume_scaling(atoms: DataFrame, ratio: str) -> DataFrame:
    """Free-atom parameters scaled by a volume ratio: C6 by its square, polarizability by itself, radius by its
    cube root."""
    v = F.col(ratio)
    return atoms.withColumns({"c6": F.col("c6_free") * v * v, "alpha": F.col("alpha_free") * v, "r_star": F.col("r_free") * F.pow(v, F.lit(1 / 3))})
