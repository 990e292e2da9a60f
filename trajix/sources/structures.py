"""Structure files: PDB, GRO, mmCIF and PRMTOP, read into topologies and frames and written from them, many at once.

Spark reads the files, and tasks parse them: a row per structure has arrays by atom, residue, chain and
bond, and tables of those are its explosions, keyed by structure. Writing goes the other way: a task writes
a file for each of its frames.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.elements import BY_SYMBOL, SYMBOLS, element_of
from trajix.model import ATOMS, BONDS, CHAINS, FRAMES, RESIDUES, Topology
from trajix.sources.frame_codecs import system_of

MOST_BYTES = 512 << 20
#: Files, and their bytes, whose rows a task hands over together; partitions of Spark's that one task reads.
STEP_FILES, STEP_BYTES, STEP_PARTS = 256, 4 << 20, 16
# Residues that are ions, and two-letter elements that their atoms may name.
ION_RESIDUES = """
FE FE2 ZN ZN2 MG MN CO NI CU CU1 NA NA+ CL CL- CA CA2 LI LI+ BR BR- AL K K+ RB
SOD CLA POT CAL MG2 CES BAR LIT MG+
""".split()
ION_ELEMENTS = "FE ZN MG MN CO NI CU NA CL CA LI BR AL SI".split()



class StructureError(ValueError):
    pass


@dataclass
class Structure:
    """Rows of a structure file; ``coords`` are x, y, z of each atom, none for a topology alone."""

    atoms: list[tuple] = field(default_factory=list)  # name, element, residue_index, charge, mass
    residues: list[tuple] = field(default_factory=list)  # name, resid, chain_index
    chains: list[str] = field(default_factory=list)
    bonds: list[tuple[int, int]] = field(default_factory=list)
    coords: list[tuple[float, float, float]] = field(default_factory=list)
    box: list[float] | None = None
    time: float = 0.0
    last: tuple | None = None

    def add(self, name: str, element: int, residue: tuple, residue_name: str, resid: int, chain: str, xyz=None, charge=None, mass=None) -> None:
        """Add an atom; ``residue`` changes where a residue does, and a chain with its name."""
        if not self.chains or chain[:4] != self.chains[-1]:
            self.chains.append(chain[:4])
            self.last = None
        if residue != self.last:
            self.residues.append((residue_name[:5], resid, len(self.chains) - 1))
            self.last = residue
        self.atoms.append((name[:4], element, len(self.residues) - 1, charge, mass))
        if xyz is not None:
            self.coords.append(xyz)

    def topology(self, spark: SparkSession) -> Topology:
        return Topology(
            spark.createDataFrame([(i, *a) for i, a in enumerate(self.atoms)], ATOMS),
            spark.createDataFrame([(i, *r) for i, r in enumerate(self.residues)], RESIDUES),
            spark.createDataFrame(list(enumerate(self.chains)), CHAINS),
            spark.createDataFrame(self.bonds, BONDS),
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        axes = [list(a) for a in zip(*self.coords)] if self.coords else [[], [], []]
        return spark.createDataFrame([("", 0, float(self.time), 0, self.box, *axes)], FRAMES)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _int(text: str) -> int:
    return int(text) if re.fullmatch(r"[+-]?\d+", text.strip()) else 0


def read_pdb(text: str) -> Structure:
    """ATOM and HETATM rows of the first model, CONECT bonds; blank alternates and the file's first letter stay."""
    out, alternate, serials, edges, done = Structure(), None, {}, set(), False
    for line in text.splitlines():
        kind = line[:6].strip()
        if kind == "ENDMDL":
            done = True
        elif kind in ("ATOM", "HETATM") and not done:
            xyz = tuple(_number(line[a : a + 8]) for a in (30, 38, 46))
            if len(line) < 54 or None in xyz:
                continue
            letter = line[16]
            if letter != " ":
                alternate = alternate or letter
                if letter != alternate:
                    continue
            raw = line[12:16]
            symbol = line[76:78].strip() if len(line) >= 78 else ""
            guess = raw[1] if raw[0] in " 0123456789" else raw[0]
            chain, number = line[21].strip(), _int(line[22:26])
            serials[_int(line[6:11])] = len(out.atoms)
            out.add(raw.strip(), element_of(symbol or guess), (chain, number, line[26]), line[17:20].strip(), number, chain, xyz)
        elif kind == "CONECT":
            ends = [_int(line[a : a + 5]) for a in range(6, min(len(line.rstrip()), 31), 5)]
            edges.update((ends[0], e) for e in ends[1:] if ends[0] < e)
    if not out.atoms:
        raise StructureError("NoAtomsFound")
    out.bonds = sorted({(serials[i], serials[j]) for i, j in edges if i in serials and j in serials})
    return out


def write_pdb(s: Structure) -> str:
    lines = []
    for i, ((name, element, r, *_), (x, y, z)) in enumerate(zip(s.atoms, s.coords)):
        residue, resid, chain = s.residues[r]
        symbol = SYMBOLS[element]
        shown = f" {name:<3}" if len(symbol) <= 1 and len(name) <= 3 else f"{name:<4}"
        lines.append(
            f"ATOM  {(i + 1) % 100000:>5} {shown[:4]} {residue[:3]:>3} {(s.chains[chain] or ' ')[0]}{resid % 10000:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{0.0:6.2f}          {symbol.upper() if element else '':>2}"
        )
    return "\n".join([*lines, "END", ""])


def _gro_element(name: str, residue: str) -> int:
    if len(name) > 1 and name[0].isdigit():
        return element_of(name[1])
    letters = re.match(r"[A-Za-z]*", name)[0].upper()
    if residue.upper() in ION_RESIDUES and letters in ION_ELEMENTS:
        return BY_SYMBOL[letters]
    return element_of(name[:1])


def read_gro(text: str) -> Structure:
    """One unnamed chain; lengths in nm, of any width, found from the first atom's decimal points."""
    lines = text.splitlines()
    if len(lines) < 3 or not lines[1].strip().isdigit():
        raise StructureError("InvalidFormat")
    out, n = Structure(), int(lines[1])
    time = re.search(r"(?:^| )t= *(\S+)", lines[0])
    out.time = (_number(time[1]) if time else None) or 0.0
    if n and (len(lines) < 2 + n or not (dots := [m.start() for m in re.finditer(r"\.", lines[2]) if m.start() >= 20])[1:]):
        raise StructureError("InvalidFormat")
    width = dots[1] - dots[0] if n else 8
    for line in lines[2 : 2 + n]:
        xyz = tuple(_number(line[20 + k * width : 20 + (k + 1) * width]) for k in range(3))
        if len(line) < 20 + 3 * width or None in xyz:
            raise StructureError("InvalidFormat")
        number, residue, name = _int(line[:5]), line[5:10].strip(), line[10:15].strip()
        out.add(name, _gro_element(name, residue), (number, residue), residue, number, "", tuple(10 * v for v in xyz))
    box = [_number(v) for v in (lines[2 + n].split() if len(lines) > 2 + n else [])][:9]
    if len(box) in (3, 9) and None not in box:
        v = [10 * b for b in box] + [0.0] * (9 - len(box))
        out.box = [v[0], v[3], v[4], v[5], v[1], v[6], v[7], v[8], v[2]]
    return out


def write_gro(s: Structure, title: str = "") -> str:
    lines = [f"{title} t= {s.time:g}".strip(), f"{len(s.atoms):>5}"]
    for i, ((name, _, r, *_), xyz) in enumerate(zip(s.atoms, s.coords)):
        residue, resid, _ = s.residues[r]
        lines.append(f"{max(resid, 0) % 100000:>5}{residue:<5}{name:>5}{(i + 1) % 100000:>5}" + "".join(f"{v / 10:8.3f}" for v in xyz))
    b = [v / 10 for v in s.box or [0.0] * 9]
    shown = [b[0], b[4], b[8]] + ([b[1], b[2], b[3], b[5], b[6], b[7]] if any(abs(v) > 1e-9 for k, v in enumerate(b) if k % 4) else [])
    return "\n".join([*lines, "".join(f"{v:10.5f}" for v in shown), ""])


CIF_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<text>(?:(?<=\n)|\A);(?:.*?)\n;(?=\s|\Z))|(?P<single>'(?:[^'\n]|'(?=\S))*')|(?P<double>"(?:[^"\n]|"(?=\S))*")|(?P<word>[^\s]+)""", re.S)

#: Whole lines of nothing but values without quotes, 1,000 at a time.
CIF_PLAIN = re.compile(r"""(?:[^'"#;_\n]*\n){1,1000}""")


def cif_tokens(text: str):
    """(kind, value) of a CIF: kinds tag, loop, data, save, value; "." and "?" are null values."""
    at = 0
    while at < len(text):
        if (at == 0 or text[at - 1] == "\n") and (plain := CIF_PLAIN.match(text, at)):
            at = plain.end()
            for w in plain[0].split():
                yield "value", None if w in (".", "?") else w
            continue
        m = CIF_TOKEN.match(text, at)
        at, kind = m.end(), m.lastgroup
        if kind == "word":
            w, low = m["word"], m["word"].lower()
            if w[0] == "_":
                yield "tag", w
            elif low == "loop_":
                yield "loop", w
            elif low.startswith(("data_", "save_")):
                yield low[:4], w[5:]
            else:
                yield "value", None if w in (".", "?") else w
        elif kind == "text":
            yield "value", m["text"][1:-2]
        elif kind:
            yield "value", m[kind][1:-1]


def read_mmcif(text: str) -> Structure:
    """The first _atom_site loop: its first model, blank alternates and the first letter; label_ names go before auth_ ones."""
    tags, values, where = [], [], 0
    for kind, value in cif_tokens(text):
        if where == 2 and kind != "value":
            break
        if kind == "loop" and where < 2:
            tags, where = [], 1
        elif kind == "tag" and where == 1:
            tags.append(value.lower())
        elif kind == "value" and where and tags and tags[0].startswith("_atom_site."):
            where = 2
            values.append(value)
        elif where == 1:
            where = 0
    at = {t.removeprefix("_atom_site."): k for k, t in enumerate(tags)}
    if not values or not {"cartn_x", "cartn_y", "cartn_z"} <= at.keys():
        raise StructureError("NoAtomsFound")
    rows = [values[k : k + len(tags)] for k in range(0, len(values) - len(tags) + 1, len(tags))]

    def place(*names: str) -> int:
        return next((at[n] for n in names if n in at), -1)

    def cell(row: list, k: int) -> str:
        return row[k] or "" if k >= 0 else ""

    number_at, letter_at, axes = place("pdbx_pdb_model_num"), place("label_alt_id"), [at[f"cartn_{c}"] for c in "xyz"]
    name_at, chain_at, resid_at = (place(f"label_{n}", f"auth_{n}") for n in ("atom_id", "asym_id", "seq_id"))
    symbol_at, residue_at = place("type_symbol"), place("label_comp_id", "auth_comp_id")
    out, model, alternate, lost = Structure(), None, None, 0
    for row in rows:
        number = cell(row, number_at)
        model = number if model is None else model
        letter = cell(row, letter_at)
        alternate = alternate or letter or None
        if number != model or (letter and letter != alternate):
            continue
        xyz = tuple(_number(cell(row, k).split("(")[0]) for k in axes)
        if None in xyz:
            lost += 1
            continue
        name, chain, resid = cell(row, name_at), cell(row, chain_at), _int(cell(row, resid_at))
        out.add(name, element_of(cell(row, symbol_at) or name[:1]), (chain, resid), cell(row, residue_at), resid, chain, xyz)
    if not out.atoms or 10 * lost > len(rows):
        raise StructureError("unreadable coordinates")
    return out


def read_prmtop(text: str) -> Structure:
    """A topology alone; charges in electrons, masses of the force field."""
    sections: dict[str, list[str]] = {}
    for block in re.split(r"(?m)^%FLAG\s+", text)[1:]:
        head, _, body = block.partition("\n")
        shape = re.search(r"%FORMAT\((\d+)[aAIEFief](\d+)", body)
        if head.strip() == "CTITLE":
            raise StructureError("ChamberNotSupported")
        width = int(shape[2]) if shape else 20
        rows = [r for r in body.splitlines() if not r.startswith("%")]
        sections[head.strip()] = [r[k : k + width] for r in rows for k in range(0, len(r.rstrip("\r")), width)]
    try:
        points = [int(v) for v in sections["POINTERS"] if v.strip()]
        n, names, labels = points[0], [v.strip() for v in sections["ATOM_NAME"]], [v.strip() for v in sections["RESIDUE_LABEL"]]
        starts = [int(v) - 1 for v in sections["RESIDUE_POINTER"] if v.strip()]
    except (KeyError, ValueError, IndexError) as e:
        raise StructureError("InvalidFormat") from e
    charges = [float(v) / 18.2223 for v in sections.get("CHARGE", []) if v.strip()]
    masses = [float(v) for v in sections.get("MASS", []) if v.strip()]
    numbers = [int(v) for v in sections.get("ATOMIC_NUMBER", []) if v.strip()]
    out, residue = Structure(), -1
    for i in range(n):
        while residue + 1 < len(starts) and starts[residue + 1] <= i:
            residue += 1
        name = names[i]
        if i < len(numbers):
            element = numbers[i] if 0 <= numbers[i] <= 118 else 0
        else:
            element = BY_SYMBOL[name[:2].upper()] if name[:2].upper() in ("CL", "NA", "MG", "ZN") else element_of(name[:1])
        out.add(name, element, (residue,), labels[residue], residue + 1, "", None, charges[i] if charges else None, masses[i] if masses else None)
    for flag in ("BONDS_INC_HYDROGEN", "BONDS_WITHOUT_HYDROGEN"):
        ends = [int(v) for v in sections.get(flag, []) if v.strip()]
        out.bonds += [(a // 3, b // 3) for a, b in zip(ends[::3], ends[1::3])]
    return out


def write_mmcif(s: Structure) -> str:
    """One _atom_site loop of model 1, with label_ names; names with blanks or quotes are quoted."""

    def quoted(text: str) -> str:
        if not text:
            return "."
        plain = re.fullmatch(r"[^\s'\"#_$\[\];?.]\S*", text) and not text.lower().startswith(("data_", "loop_", "save_"))
        return text if plain else f'"{text}"' if '"' not in text else f"'{text}'"

    names = "group_PDB id type_symbol label_atom_id label_comp_id label_asym_id label_seq_id Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num".split()
    lines = ["data_made", "loop_", *[f"_atom_site.{n}" for n in names]]
    for i, ((name, element, r, *_), (x, y, z)) in enumerate(zip(s.atoms, s.coords), 1):
        residue, resid, chain = s.residues[r]
        shown = [SYMBOLS[element] if element else "?", quoted(name), quoted(residue), quoted(s.chains[chain])]
        lines.append(f"ATOM {i} {' '.join(shown)} {resid} {x:.6f} {y:.6f} {z:.6f} 1")
    return "\n".join([*lines, "#", ""])


def write_prmtop(s: Structure) -> str:
    """The sections of a topology that ``read_prmtop`` knows; charges and masses where all atoms have them."""

    def section(flag: str, shape: str, cells: list[str], a_line: int) -> str:
        rows = ["".join(cells[k : k + a_line]) for k in range(0, len(cells), a_line)] or [""]
        return "\n".join([f"%FLAG {flag}", f"%FORMAT({shape})", *rows])

    starts = [next(i for i, a in enumerate(s.atoms) if a[2] == r) + 1 for r in range(len(s.residues))]
    ints = lambda values: [f"{v:>8}" for v in values]
    parts = [
        "%VERSION  VERSION_STAMP = V0001.000  DATE = 01/01/00  00:00:00",
        section("POINTERS", "10I8", ints([len(s.atoms), *[0] * 10, len(s.residues), *[0] * 19]), 10),
        section("ATOM_NAME", "20a4", [f"{a[0][:4]:<4}" for a in s.atoms], 20),
        section("ATOMIC_NUMBER", "10I8", ints(a[1] for a in s.atoms), 10),
        section("RESIDUE_LABEL", "20a4", [f"{r[0][:4]:<4}" for r in s.residues], 20),
        section("RESIDUE_POINTER", "10I8", ints(starts), 10),
        section("BONDS_WITHOUT_HYDROGEN", "10I8", ints(v for i, j in s.bonds for v in (3 * i, 3 * j, 1)), 10),
    ]
    for flag, k, scale in (("CHARGE", 3, 18.2223), ("MASS", 4, 1.0)):
        if s.atoms and all(a[k] is not None for a in s.atoms):
            parts.append(section(flag, "5E16.8", [f"{a[k] * scale:16.8E}" for a in s.atoms], 5))
    return "\n".join([*parts, ""])


READERS = {"pdb": read_pdb, "gro": read_gro, "cif": read_mmcif, "mmcif": read_mmcif, "prmtop": read_prmtop, "parm7": read_prmtop, "top": read_prmtop}
WRITERS = {"pdb": write_pdb, "gro": write_gro, "cif": write_mmcif, "mmcif": write_mmcif, "prmtop": write_prmtop}


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


#: Columns of a row of structures: arrays by atom, residue, chain and bond.
BY_ATOM = {"name": pa.string(), "element": pa.int32(), "residue_index": pa.int32(), "charge": pa.float64(), "explicit_mass": pa.float64()}
BY_RESIDUE = {"residue_name": pa.string(), "resid": pa.int32(), "chain_index": pa.int32()}
BY_BOND = {"atom_i": pa.int32(), "atom_j": pa.int32()}
ARRAYS = {**BY_ATOM, **BY_RESIDUE, "chain_name": pa.string(), **BY_BOND, **{c: pa.float64() for c in "xyz"}}
SHOWN = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double"}
ROW = "structure string, problem string, time double, box array<double>, " + ", ".join(f"{c} array<{SHOWN[t]}>" for c, t in ARRAYS.items())


@dataclass(frozen=True)
class Structures:
    """Structures by name. ``table`` has a row for each, in the columns of ROW; ``problem`` says why a file could not be
    read, and such a row has no atoms."""

    table: DataFrame

    def _exploded(self, index: str, names: dict[str, str]) -> DataFrame:
        """A row for each element of some arrays, renamed."""
        rows = self.table.select("structure", F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for c, n in names.items()])).alias(index, "r"))
        return rows.select("structure", index, *[F.col(f"r.{n}").alias(n) for n in names.values()])

    def atoms(self) -> DataFrame:
        """structure, and the columns of a topology's atoms."""
        return self._exploded("atom_index", {c: c for c in BY_ATOM})

    def residues(self) -> DataFrame:
        return self._exploded("residue_index", {"residue_name": "name", "resid": "resid", "chain_index": "chain_index"})

    def chains(self) -> DataFrame:
        return self.table.select("structure", F.posexplode("chain_name").alias("chain_index", "name"))

    def bonds(self) -> DataFrame:
        return self._exploded("bond", {c: c for c in BY_BOND}).drop("bond")

    def frames(self) -> DataFrame:
        """A wide frame of each structure that has coordinates: traj is its name, frame 0."""
        rows = self.table.where(F.size("x") > 0)
        return rows.select(F.col("structure").alias("traj"), F.lit(0).cast("bigint").alias("frame"), "time", F.lit(0).alias("step"), "box", *"xyz")

    def named_atoms(self) -> DataFrame:
        """structure, the columns of atoms, those of their residues, and x, y, z where the structure has them; no row moves."""
        at = lambda c: F.get(F.col(c), F.col("r.residue_index")).alias(c)
        rows = self.table.select("structure", *BY_RESIDUE, F.posexplode(F.arrays_zip(*BY_ATOM, *"xyz")).alias("atom_index", "r"))
        return rows.select("structure", "atom_index", *[F.col(f"r.{c}").alias(c) for c in (*BY_ATOM, *"xyz")], *[at(c) for c in BY_RESIDUE])

    def validate(self) -> DataFrame:
        """structure, problem, id: a row for each reference of an array to what the structure lacks."""

        def lost(column: str, of: str, problem: str) -> Column:
            outside = F.filter(F.array_distinct(column), lambda v: (v < 0) | (v >= F.size(of)))
            return F.transform(outside, lambda v: F.struct(F.lit(problem).alias("problem"), v.cast("bigint").alias("id")))

        found = F.concat(
            lost("residue_index", "resid", "atom without residue"),
            lost("chain_index", "chain_name", "residue without chain"),
            lost("atom_i", "name", "bond without atom"),
            lost("atom_j", "name", "bond without atom"),
        )
        return self.table.select("structure", F.inline(found))

    def topology(self, structure: str | None = None) -> Topology:
        """The topology of one structure, or of the only one."""
        own = self if structure is None else Structures(self.table.where(F.col("structure") == structure))
        return Topology(*[t.drop("structure") for t in (own.atoms(), own.residues(), own.chains(), own.bonds())])


def _row(name: str, s: Structure, problem: str | None = None) -> dict:
    atoms, residues = list(zip(*s.atoms)) or [[]] * 5, list(zip(*s.residues)) or [[]] * 3
    bonds, axes = list(zip(*s.bonds)) or [[]] * 2, list(zip(*s.coords)) or [[]] * 3
    values = [*atoms, *residues, s.chains, *bonds, *axes]
    return {"structure": name, "problem": problem, "time": float(s.time), "box": s.box, **dict(zip(ARRAYS, values))}


def read_structures(spark: SparkSession, path: str, kind: str | None = None) -> Structures:
    """Structures of the files that Spark finds at a path: a file, a folder with all that it holds, or a pattern.

    The kind goes by each file's extension where none is given. A structure is named by its file's path;
    ``name_of`` gives the name in it. A file that can't be read, is of no known kind or is larger than MOST_BYTES
    gives a row with its problem and without atoms.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64()), *[pa.list_(t) for t in ARRAYS.values()]]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(rows[0], types)], names=list(rows[0]))

        rows, size = [], 0
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"]):
                own = kind or extension(file)
                try:
                    if own not in READERS:
                        raise StructureError(f"unknown format: {own}")
                    if not content.is_valid:
                        raise StructureError(f"larger than {MOST_BYTES} bytes")
                    size += len(content.as_buffer())
                    row = _row(file, READERS[own](content.as_py().decode("utf-8", "replace")))
                except (ValueError, IndexError, KeyError) as e:
                    row = _row(file, Structure(), str(e) or type(e).__name__)
                rows.append(row)
                if len(rows) == STEP_FILES or size >= STEP_BYTES:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= MOST_BYTES).select("path", "content")
    large = files.where(F.col("length") > MOST_BYTES).select("path", F.lit(None).cast("binary").alias("content"))
    # Spark packs files as if each had 4 MB at least: some 30 small ones to a task, whose start takes longer than they do
    parts = 2 * files.select("path").rdd.getNumPartitions()
    fewer = max(3 * spark.sparkContext.defaultParallelism, parts // STEP_PARTS)
    return Structures(small.unionAll(large).coalesce(fewer).mapInArrow(parsed, ROW))


def name_of(file: str) -> str:
    """A file's name without its folder and extension, as ``write_structures`` was given it."""
    return unquote(file.rstrip("/").rpartition("/")[2].rpartition(".")[0])


def write_structures(frames: DataFrame, topology: Topology, path: str, kind: str, name: Column | None = None) -> int:
    """Write each frame with a topology as a structure file of its own, ``path``/NAME.kind; the number of files.

    NAME is the frame's number, behind its traj and a dash where frames name one, unless given as a column; two frames
    of one name leave one file. An array ``charge`` of a frame stands for the topology's charges. Tasks write under hidden
    names and rename, so a task that runs again leaves the same files. The topology, one system's, goes along with the tasks.
    """
    if kind not in WRITERS:
        raise StructureError(f"no writer for {kind}")
    own = structure_of(topology, None)
    known = set(frames.columns)
    if name is None:
        name = F.concat_ws("-", *[F.col(c).cast("string") for c in ("traj", "frame") if c in known])
    extra = [c for c in ("box", "time", "charge") if c in known]

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner, _ = system_of(path)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                s = replace(own, coords=list(zip(r["x"], r["y"], r["z"])), box=r.get("box"), time=r.get("time") or 0.0)
                if len(s.coords) != len(s.atoms):
                    raise StructureError("InvalidAtomCount")
                if r.get("charge"):
                    s.atoms = [(*a[:3], c, a[4]) for a, c in zip(s.atoms, r["charge"])]
                hidden = f"{inner}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write(WRITERS[kind](s).encode())
                system.move(hidden, f"{inner}/{quote(r['structure'], safe=' ')}.{kind}")
            yield pa.RecordBatch.from_arrays([batch["structure"]], names=["structure"])

    return frames.select(name.alias("structure"), *"xyz", *extra).mapInArrow(files, "structure string").count()


def read_structure(spark: SparkSession, path: str) -> Structure:
    """One structure file, parsed by a task; the driver gets its arrays."""
    if extension(path) not in READERS:
        raise StructureError(f"unknown format: {path}")
    row = read_structures(spark, path, extension(path)).table.first()
    if row is None or row["problem"]:
        raise StructureError(f"{path}: {row['problem'] if row else 'no such file'}")
    out = Structure(time=row["time"], box=row["box"], chains=list(row["chain_name"]))
    out.atoms, out.residues = list(zip(*[row[c] for c in BY_ATOM])), list(zip(*[row[c] for c in BY_RESIDUE]))
    out.bonds, out.coords = list(zip(row["atom_i"], row["atom_j"])), list(zip(*[row[c] for c in "xyz"]))
    return out


def structure_of(topology: Topology, frame) -> Structure:
    """Rows of a topology and of one frame (a Row with x, y, z and perhaps box and time) or none, for the writers."""
    out = Structure()
    atoms = topology.atoms.orderBy("atom_index").collect()
    out.atoms = [(a["name"], a["element"], a["residue_index"], a["charge"], a["explicit_mass"]) for a in atoms]
    out.residues = [(r["name"], r["resid"], r["chain_index"]) for r in topology.residues.orderBy("residue_index").collect()]
    out.chains = [c["name"] for c in topology.chains.orderBy("chain_index").collect()]
    out.bonds = [(b["atom_i"], b["atom_j"]) for b in topology.bonds.orderBy("atom_i", "atom_j").collect()]
    if frame is not None:
        out.coords = list(zip(frame["x"], frame["y"], frame["z"]))
        known = frame.asDict()
        out.box, out.time = known.get("box"), known.get("time") or 0.0
    return out


def write_structure(spark: SparkSession, s: Structure, path: str) -> None:
    """Write one frame as a text file set at ``path``, in one ordered part."""
    kind = extension(path)
    if kind not in WRITERS:
        raise StructureError(f"no writer for {path}")
    spark.createDataFrame([(WRITERS[kind](s).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
