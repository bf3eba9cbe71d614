"""Readers whose files are many tasks: the rows are those of one."""

import io
import tarfile

import numpy as np
import pytest

from graphloom.sources import molecules as M


def frames(path, n, seed=1):
    rng, text, want = np.random.default_rng(seed), [], []
    for f in range(n):
        size = int(rng.integers(1, 9))
        text += [f" {size} ", f"Lattice=none energy={f * 0.5 - 3} pbc=F"]
        for k in range(size):
            symbol, values = ["H", "C", "Og"][int(rng.integers(3))], rng.normal(size=6).round(5).tolist()
            text.append(" ".join([symbol, *map(str, values)]))
            want.append((f, k, M.SYMBOLS[symbol], *values, f * 0.5 - 3))
    path.write_text("\n".join(text) + "\n")
    return want


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.unset(c)


def test_extended_xyz_in_splits(spark, tmp_path, small_splits):
    want = {f"{k}.xyz": frames(tmp_path / f"{k}.xyz", n, k) for k, n in ((1, 40), (2, 1), (3, 25))}
    out = M.read_extended_xyz(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {name: sorted(tuple(r)[1:] for r in out.collect() if r.file.endswith(name)) for name in want}
    assert got == {name: sorted(rows) for name, rows in want.items()}
    one = spark.read.format("extxyz").option("paths", str(tmp_path / "1.xyz"))
    M.register(spark)
    assert sorted(tuple(r)[1:] for r in one.load().collect()) == got["1.xyz"]


@pytest.mark.parametrize("text,message", [("2\nenergy=1\nH 0 0 0 0 0 0\n1\nenergy=2\nH 0 0 0 0 0 0\n", "other rows"), ("1\nenergy=1\nH 0 0 0 0 0 0\nH 0 0 0 0 0 0\n", "in no frame"), ("1\nplain\nH 0 0 0 0 0 0\n", "no energy"), ("2\nenergy=1\nH 0 0 0 0 0 0\n", "other rows"), ("H 0 0 0 0 0 0\n", "in no frame")])
@pytest.mark.parametrize("small", [True, False])
def test_wrong_frames_are_errors(spark, tmp_path, text, message, small, request):
    if small:
        request.getfixturevalue("small_splits")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    (tmp_path / "a.xyz").write_text(text)
    with pytest.raises(Exception, match=message):
        M.read_extended_xyz(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_reads_its_own_frames(spark, tmp_path, save):
    rng = np.random.default_rng(3)
    xyz, force, energy = rng.normal(size=(23, 4, 3)), rng.normal(size=(23, 4, 3)).astype(np.float32), rng.normal(size=(23, 1))
    save(tmp_path / "m.npz", nuclear_charges=np.array([8, 1, 1, 6], np.uint8), coords=xyz, energies=energy, forces=force, other=np.arange(3))
    M.register(spark)
    for path in (str(tmp_path / "m.npz"), f"file://{tmp_path}/m.npz"):
        df = spark.read.format("npz_frames").option("paths", path).option("frames_per_partition", "5").load()
        assert df.rdd.getNumPartitions() == 5
        rows = df.orderBy("frame", "atom_id").collect()
        assert np.allclose([(r.x, r.y, r.z) for r in rows], xyz.reshape(-1, 3)) and np.allclose([(r.fx, r.fy, r.fz) for r in rows], force.reshape(-1, 3))
        assert np.allclose([r.energy for r in rows], np.repeat(energy.ravel(), 4)) and [r.z_num for r in rows[:4]] == [8, 1, 1, 6]
    np.savez(tmp_path / "n.npz", coords=xyz)
    with pytest.raises(Exception, match="missing: nuclear_charges, energies, forces"):
        spark.read.format("npz_frames").option("paths", str(tmp_path / "n.npz")).load().count()


def test_archives_are_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "RECORDS", 2)
    header = "gdb {} " + " ".join(["1.0"] * 15)
    for k in range(3):
        with tarfile.open(tmp_path / f"{k}.tar.bz2", "w:bz2") as f:
            for i in range(k * 10, k * 10 + 3):
                raw = f"1\n{header.format(i)}\nO 0.0 0.0 {i}.5 0.1\n0".encode()
                for name, data in ((f"set/{i}.xyz", raw), (f"set/{i}.txt", b"no")):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    f.addfile(info, io.BytesIO(data))
    records = M.archived_records(spark, f"{tmp_path}/*.tar.bz2")
    assert sorted(r.name for r in records.collect()) == sorted(f"set/{k * 10 + i}.xyz" for k in range(3) for i in range(3))
    assert {r.graph_id: r.z for r in M.parse_xyz(records, targets=["U0"]).collect()} == {k * 10 + i: k * 10 + i + 0.5 for k in range(3) for i in range(3)}
