"""Molecule files: XYZ records with properties, frames of extended XYZ, NPZ trajectories."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from graphloom.operators.collate import sample
from graphloom.plans.cache import written

#: The symbols of the elements, in the order of their atomic numbers from 1.
ELEMENTS = """
H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru
Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At
Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og
"""
SYMBOLS = {symbol: z for z, symbol in enumerate(ELEMENTS.split(), 1)}

#: The graph targets on a record's second line, after two leading tokens.
TARGETS = ["A", "B", "C", "mu", "alpha", "homo", "lumo", "gap", "r2", "zpve", "U0", "U", "H", "G", "Cv"]


def number(c):
    """A number that may write its exponent as ``*^``."""
    return F.replace(c, F.lit("*^"), F.lit("E")).cast("double")


def atomic_number(symbol):
    """The number of an element's symbol; another text is an error when it is read."""
    at = F.array_position(F.array(*map(F.lit, SYMBOLS)), symbol)
    return F.when(symbol.isNull() | (at > 0), at).otherwise(F.raise_error(F.concat(F.lit("no element "), symbol)).cast("bigint")).cast("int")


def parse_xyz(records: DataFrame, text: str = "value", targets: list[str] | None = None) -> DataFrame:
    """Atoms of whole-file records: line 0 the number of atoms, line 1 the properties (a tag, an id, then the
    targets), then ``symbol x y z``. Columns ``graph_id, atom_id, z_num, x, y, z, targets``."""
    wanted = TARGETS if targets is None else targets
    unknown = set(wanted) - set(TARGETS)
    if unknown:
        raise ValueError(f"unknown targets: {sorted(unknown)}")
    lines = F.split(text, "\n")
    n = F.trim(F.get(lines, F.lit(0))).cast("int")
    rows = records.select(F.split(F.get(lines, F.lit(1)), r"\s+").alias("props"), F.slice(lines, F.lit(3), n).alias("rows"))
    props = F.struct(*[number(F.get("props", F.lit(2 + TARGETS.index(t)))).alias(t) for t in wanted]).alias("targets")
    atoms = rows.select(F.get("props", F.lit(1)).cast("long").alias("graph_id"), props, F.posexplode("rows").alias("atom_id", "row"))
    parts = F.split(F.trim("row"), r"\s+")
    return atoms.select(
        "graph_id",
        F.col("atom_id").cast("long").alias("atom_id"),
        atomic_number(F.get(parts, F.lit(0))).alias("z_num"),
        *[number(F.get(parts, F.lit(k))).alias(a) for k, a in enumerate("xyz", 1)],
        "targets",
    )


def extract_archive(archive: str, folder: str) -> int:
    """Extract the XYZ files of a tar archive (compressed or not) once, so that Spark can read them in parallel; the
    number of files. An archive that was extracted before is left as it is."""
    done = Path(folder) / "_EXTRACTED"
    if done.exists():
        return int(done.read_text())
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    with tarfile.open(archive, "r|*") as f:
        for member in f:
            if member.isfile() and member.name.endswith(".xyz"):
                (Path(folder) / Path(member.name).name).write_bytes(f.extractfile(member).read())
                n += 1
    done.write_text(str(n))
    return n


def select_records(records: DataFrame, name: str, excluded: DataFrame | None = None, total: int | None = None, seed: int = 42) -> DataFrame:
    """Records ``(id, name, ...)`` without the excluded ids; of more than ``total``, a seeded sample; in order of name."""
    kept = records if excluded is None else records.join(excluded, "id", "left_anti")
    return (kept if total is None else sample(kept, "id", total, seed)).orderBy(name, "id")


def read_xyz(spark: SparkSession, path: str, targets: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Atoms of a folder of extracted XYZ files, without the graphs in ``excluded(id)``."""
    atoms = parse_xyz(spark.read.text(path, wholetext=True), "value", targets)
    return atoms if excluded is None else atoms.join(excluded.withColumnRenamed("id", "graph_id"), "graph_id", "left_anti")


def exclusion_ids(files: DataFrame, text: str = "value", header: int = 9, trailer: int = 1) -> DataFrame:
    """Ids at the start of the lines of whole-file rows, without header and trailer."""
    # a line break at the end begins no line
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    body = F.slice(lines, F.lit(header + 1), F.greatest(F.size(lines) - (header + trailer), F.lit(0)))
    return files.select(F.explode(body).alias("line")).select(F.get(F.split(F.trim("line"), r"\s+"), F.lit(0)).cast("long").alias("id"))


def archived_records(spark: SparkSession, path: str, suffix: str = ".xyz") -> DataFrame:
    """``(name, value)``: the text members of tar archives (compressed or not) that Spark can read, sorted by no name; an archive is a
    task, and nothing passes through the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                names, values = [], []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as f:
                    for member in f:
                        if member.isfile() and member.name.endswith(suffix):
                            names.append(member.name)
                            values.append(f.extractfile(member).read().decode())
                        if len(names) == RECORDS:
                            yield pd.DataFrame({"name": names, "value": values})
                            names, values = [], []
                yield pd.DataFrame({"name": names, "value": values})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, value string")


#: Records in a batch at most; splits of text files, of which a row each is sent to all tasks.
RECORDS, MAX_SPLITS = 1024, 1 << 20

FRAMES_DDL = "file string, frame long, atom_id long, z_num int, x double, y double, z double, fx double, fy double, fz double, energy double"


def _energy(comment: str) -> float | None:
    found = [t.partition("=")[2] for t in comment.split() if t.startswith("energy=")]
    return float(found[0]) if found else None


def read_extended_xyz(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frames of ``symbol x y z fx fy fz`` rows with ``energy=`` on the comment line, from files of any size that Spark can read:
    ``(file, frame, atom_id, z_num, x, y, z, fx, fy, fz, energy)``, frames numbered within their file.

    A file is read in the splits of Spark's text reader, by two passes. The first counts each split's lines and frames, and keeps what
    it knows of its last frame; a line that is a number alone begins a frame, since a comment without an energy is an error.
    Added up over the splits of a file, that tells the second pass at which line and in which frame a split begins. Its atoms
    need no shuffle. A frame with too few or too many rows, in whichever splits, is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def starts(values: list[str]) -> list[int]:
        return [i for i, v in enumerate(values) if v.strip().isdigit()]

    def split_runs(part: pd.DataFrame) -> Iterator[tuple[str, int, pd.DataFrame]]:
        """The stretches of a batch that lie in one split."""
        change = np.flatnonzero((part["block"].diff().fillna(0) != 0) | (part["file"] != part["file"].shift(fill_value=part["file"].iloc[0]))) if len(part) else []
        for a, b in zip([0, *change], [*change, len(part)], strict=True):
            if b > a:
                yield part["file"].iloc[a], int(part["block"].iloc[a]), part.iloc[a:b]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None
        for part in parts:
            for file, block, own in split_runs(part):
                if now is None or (now["file"], now["block"]) != (file, block):
                    if now is not None:
                        yield pd.DataFrame([now])
                    now = {"file": file, "block": block, "lines": 0, "frames": 0, "last": -1, "size": -1, "energy": None, "first_energy": _energy(own["value"].iloc[0])}
                values = own["value"].tolist()
                if now["last"] >= 0 and now["last"] + 1 == now["lines"]:
                    now["energy"] = _energy(values[0])
                found = starts(values)
                if found:
                    k = found[-1]
                    now |= {"frames": now["frames"] + len(found), "last": now["lines"] + k, "size": int(values[k]), "energy": _energy(values[k + 1]) if k + 1 < len(values) else None}
                now["lines"] += len(values)
        if now is not None:
            yield pd.DataFrame([now])

    counted = lines.mapInPandas(count, "file string, block long, lines long, frames long, last long, size long, energy double, first_energy double")
    counted, index_path = written(counted, "splits")
    file = W.partitionBy("file").orderBy("block")  # a row for each split
    before = file.rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumns({"at": F.coalesce(F.sum("lines").over(before), F.lit(0)), "frame": F.coalesce(F.sum("frames").over(before), F.lit(0)), "next_energy": F.lead("first_energy").over(file)})
    known = F.when(F.col("last") >= 0, F.struct((F.col("at") + F.col("last")).alias("start"), "size", F.coalesce("energy", "next_energy").alias("energy")))
    placed = placed.withColumn("open", F.last(known, ignorenulls=True).over(before)).withColumn("is_last", F.lead("block").over(file).isNull())
    placed = placed.select("file", "block", "at", "frame", "open", "next_energy", "is_last", F.col("lines").alias("split_lines"))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = frame = start = size = left = 0
        energy: float | None = None
        now = None
        for part in parts:
            for file, block, own in split_runs(part):
                head = own.iloc[0]
                if now != (file, block):
                    now, at, frame, left = (file, block), int(head["at"]), int(head["frame"]) - 1, int(head["split_lines"])
                    start, size, energy = (head["open"]["start"], head["open"]["size"], head["open"]["energy"]) if head["open"] is not None else (-1, -2, None)
                values = own["value"].tolist()
                made: list[tuple] = []
                for k, line in enumerate(values):
                    place = at + k
                    if line.strip().isdigit():
                        if place != start + size + 2 and place:
                            raise ValueError(f"{file}: frame {frame} has other rows than it says")
                        start, size, frame = place, int(line), frame + 1
                        energy = None
                    elif start < 0 or place > start + size + 1:
                        raise ValueError(f"{file}: line {place} is in no frame")
                    elif place == start + 1:
                        energy = _energy(line)
                    else:
                        symbol, *rest = line.split()
                        made.append((file, frame, place - start - 2, SYMBOLS[symbol], *map(float, rest[:6]), energy))
                    if place == start + 1 and energy is None:
                        raise ValueError(f"{file}: frame {frame} has no energy")
                at, left = at + len(values), left - len(values)
                if left == 0 and head["is_last"] and at != start + size + 2:
                    raise ValueError(f"{file}: frame {frame} has other rows than it says")
                if made:
                    yield pd.DataFrame(made, columns=[c.split()[0] for c in FRAMES_DDL.split(", ")])

    n_splits = spark.read.parquet(index_path).count()
    if n_splits > MAX_SPLITS:
        raise ValueError(f"{n_splits} splits: read with larger ones (spark.sql.files.maxPartitionBytes)")
    # a row for each split, sent to the lines, which stay in order where they are
    out = lines.join(F.broadcast(placed), ["file", "block"]).select("value", "file", "block", "at", "frame", "open", "is_last", "split_lines").mapInPandas(parse, FRAMES_DDL)
    out.written_to = [index_path]
    return out


class _Files(DataSource):
    """Options ``paths``: files, separated by commas, that every worker can open; URIs are opened by Arrow's file systems."""

    def paths(self) -> list[str]:
        found = self.options.get("paths") or self.options.get("path")
        if not found:
            raise FileNotFoundError("no files given, and nothing is downloaded")
        return found.split(",")

    def schema(self) -> str:
        return FRAMES_DDL


class ExtendedXyz(_Files):
    """``spark.read.format("extxyz")``: the frames of :func:`read_extended_xyz` for a few small files; a file is one partition."""

    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ExtendedXyzReader(self.paths())


class _ExtendedXyzReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as f:
            frame = 0
            while (line := f.readline()).strip():
                n, energy = int(line), _energy(f.readline())
                if energy is None:
                    raise ValueError(f"{partition.value}: frame {frame} has no energy")
                for k in range(n):
                    symbol, *values = f.readline().split()
                    yield (partition.value, frame, k, SYMBOLS[symbol], *map(float, values[:6]), energy)
                frame += 1


class NpzFrames(_Files):
    """``spark.read.format("npz_frames")``: arrays ``nuclear_charges, coords, energies, forces`` of one molecule; a
    partition for each range of ``frames_per_partition`` frames. Members that are not compressed are read by their offsets, a
    partition's own frames alone; a partition of a compressed one unpacks what comes before its frames too."""

    KEYS = ("nuclear_charges", "coords", "energies", "forces")

    @classmethod
    def name(cls) -> str:
        return "npz_frames"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpzReader(self.paths(), int(self.options.get("frames_per_partition", "1000")))


def _opened(path: str):
    """A file for random access, wherever Arrow finds it."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Member:
    """An array in an NPZ file, of which rows are read without the others."""

    def __init__(self, f, archive: zipfile.ZipFile, name: str) -> None:
        info = archive.getinfo(f"{name}.npy")
        self.file, self.archive, self.info = f, archive, info
        with archive.open(info) as m:
            version = np.lib.format.read_magic(m)
            self.shape, fortran, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
            self.head = m.tell()
        if fortran or self.dtype.hasobject:
            raise ValueError(f"{name} is no plain array")
        self.width = int(np.prod(self.shape[1:])) * self.dtype.itemsize

    def rows(self, a: int, b: int) -> np.ndarray:
        size = (b - a) * self.width
        if self.info.compress_type == zipfile.ZIP_STORED:
            self.file.seek(self.info.header_offset + 26)
            name, extra = struct.unpack("<HH", self.file.read(4))
            self.file.seek(self.info.header_offset + 30 + name + extra + self.head + a * self.width)
            raw = self.file.read(size)
        else:
            with self.archive.open(self.info) as m:
                m.seek(self.head + a * self.width)
                raw = m.read(size)
        return np.frombuffer(raw, self.dtype).reshape(b - a, *self.shape[1:])


class _NpzReader(DataSourceReader):
    def __init__(self, paths: list[str], step: int) -> None:
        self.paths, self.step = paths, step

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            with _opened(p) as f, zipfile.ZipFile(f) as archive:
                missing = [k for k in NpzFrames.KEYS if f"{k}.npy" not in archive.namelist()]
                if missing:
                    raise KeyError("missing: " + ", ".join(missing))
                n = _Member(f, archive, "energies").shape[0]
            out += [InputPartition((p, a, min(n, a + self.step))) for a in range(0, n, self.step)]
        return out

    def read(self, partition: InputPartition):
        path, first, last = partition.value
        with _opened(path) as f, zipfile.ZipFile(f) as archive:
            members = {k: _Member(f, archive, k) for k in NpzFrames.KEYS}
            z = members["nuclear_charges"].rows(0, members["nuclear_charges"].shape[0]).astype(np.int32)
            step = max(1, (1 << 16) // max(1, len(z)))
            for a in range(first, last, step):
                b = min(last, a + step)
                xyz, force = (members[k].rows(a, b).reshape(-1, 3).astype(float) for k in ("coords", "forces"))
                energy, frames = members["energies"].rows(a, b).reshape(-1).astype(float), np.arange(a, b)
                columns = [np.repeat(frames, len(z)), np.tile(np.arange(len(z)), b - a), np.tile(z, b - a), *xyz.T, *force.T, np.repeat(energy, len(z))]
                names = [c.split()[0] for c in FRAMES_DDL.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0])), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExtendedXyz)
    spark.dataSource.register(NpzFrames)


def mock_molecules(spark: SparkSession, n: int, low: int = 3, high: int = 12, seed: int = 7) -> DataFrame:
    """Reproducible synthetic atoms, between ``low`` and ``high`` per graph."""
    size = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low + 1)) + low).cast("int")
    graphs = spark.range(n).select(F.col("id").alias("graph_id"), size.alias("n"))
    atoms = graphs.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("atom_id"))

    def uniform(k: int):
        return F.pmod(F.xxhash64("graph_id", "atom_id", F.lit(seed + k)), F.lit(1_000_000)) / 1_000_000

    kinds = F.array(*[F.lit(z) for z in (1, 6, 7, 8, 9)])
    return atoms.select(
        "graph_id", F.col("atom_id").cast("long").alias("atom_id"), F.get(kinds, (uniform(4) * 5).cast("int")).alias("z_num"),
        *[(uniform(k) * 4).alias(a) for k, a in enumerate("xyz", 1)],
    )
