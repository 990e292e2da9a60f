import json

import numpy as np
import pytest

from trajix.__main__ import COMMANDS, main
from trajix.sources import structures, trajectories


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    s, rng = structures.Structure(), np.random.default_rng(0)
    for r, residue in enumerate(["ALA", "GLY", "SER"]):
        for k, (name, z) in enumerate([("N", 7), ("CA", 6), ("C", 6), ("O", 8), ("CB", 6), ("OG", 8)]):
            s.add(name, z, (r,), residue, r + 1, "A", (3.8 * r + k * 0.9, (k % 3) * 1.1, (k % 2) * 1.3))
    (folder / "top.pdb").write_text(structures.write_pdb(s))
    base = np.array(s.coords)
    frames = [trajectories.Frame(k, k, [40.0, 0, 0, 0, 40.0, 0, 0, 0, 40.0], base + rng.normal(size=base.shape) * 0.1) for k in range(4)]
    (folder / "run.xtc").write_bytes(b"".join(map(trajectories.Xtc.write, frames)))
    return folder


@pytest.mark.parametrize("command", [c for c in COMMANDS if c != "convert"])
def test_commands(spark, files, tmp_path, command):
    more = {"distances": ["--pairs", "0-1"], "angles": ["--triplets", "0-1-2"], "dihedrals": ["--quartets", "0-1-2-3"], "rdf": ["--sel1", "CA", "--sel2", "name O"], "pca": ["--select", "CA"]}
    kind = "csv" if command == "rg" else "json"
    main([command, str(files / "run.xtc"), "--top", f"file://{files}/top.pdb", "--out", f"file://{tmp_path}/o", "--format", kind, *more.get(command, [])], spark)
    lines = [line for p in (tmp_path / "o").glob("part-*") for line in p.read_text().splitlines()]
    assert lines or command == "hbonds"
    if kind == "json":
        [json.loads(line) for line in lines]


def test_rows_on_the_screen(spark, files, capsys):
    more = [str(files / "run.xtc"), "--top", f"file://{files}/top.pdb"]
    main(["rg", *more], spark)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "frame\tvalue" and [line.split("\t")[0] for line in lines[1:]] == list("0123")
    main(["summary", *more], spark)
    shown = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    assert ["counts", "atoms", "18"] in shown and ["box", "kind", "orthorhombic"] in shown and ["element", "C", "9"] in shown and ["counts", "frames", "4"] in shown
    main(["contacts", *more, "--cutoff", "8"], spark)
    shown = capsys.readouterr().out.splitlines()
    assert len(shown) == 5 and json.loads(shown[1].split("\t")[1])["contacts"][0]["residue_i"] == 0


def test_convert_and_errors(spark, files, tmp_path):
    main(["convert", str(files / "run.xtc"), "--out", str(tmp_path / "o.trr")], spark)
    [path] = (tmp_path / "o.trr").glob("part-*.trr")
    assert trajectories.read_trajectory(spark, str(path)).count() == 4
    main(["rg", str(tmp_path / "o.trr"), "--top", f"file://{files}/top.pdb", "--out", f"file://{tmp_path}/rg"], spark)  # the folder itself
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "rg").glob("part-*")) == 4
    with pytest.raises(ValueError):
        main(["distances", str(files / "run.xtc"), "--top", f"file://{files}/top.pdb"], spark)
    with pytest.raises(structures.StructureError):
        main(["rg", str(files / "run.xtc")], spark)
