"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from trajix.elements import BIOLOGICAL, MASSES, RADII, SYMBOLS
from trajix.operators import geometry
from trajix.operators.selection import parse_tuples
from trajix.plans import queries as q
from trajix.plans import sample
from trajix.plans.sample import BONDED, BOX, MAIN, SIDE, SKEWED

ORACLE_SQL: dict[str, str] = {}


def r(e: str, name: str | None = None) -> str:
    return f"round({e}, 6) + 0.0" + (f" AS {name}" if name else "")


def values(rows, columns: str) -> str:
    cell = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in rows)}) AS v({columns}))"


def atoms_of(side: bool = False) -> str:
    own = SIDE if side else MAIN
    rows = [(i, n, z, res, sample.RESIDUE_NAMES[res], 0 if side else sample.chain_of(res), MASSES[z], RADII[z]) for i, n, z, res in own]
    return values(rows, "atom_index, name, element, residue_index, residue_name, chain_index, mass, radius")


COORDS = f"""c AS MATERIALIZED (
  SELECT vec_id AS frame, CAST(k AS INTEGER) AS atom_index, 20.0::DOUBLE * CAST(embedding[3 * k + 1] AS DOUBLE) AS x,
         20.0::DOUBLE * CAST(embedding[3 * k + 2] AS DOUBLE) AS y, 20.0::DOUBLE * CAST(embedding[3 * k + 3] AS DOUBLE) AS z
  FROM embeddings, range({sample.N_ATOMS}) t(k)
)"""
WITH = f"WITH {COORDS}, a AS {atoms_of()}"
XYZ = ", ".join(r(f"c.{c}", c) for c in "xyz")
D2 = "((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"

for name, test in {
    "backbone": f"name IN ('N', 'CA', 'C', 'O') AND residue_name <> 'HOH'", "protein": "residue_name <> 'HOH'", "water": "residue_name = 'HOH'", "name": "name = 'CA'",
    "index": "(atom_index IN (0, 20) OR atom_index BETWEEN 5 AND 9)", "element": "element = 8",
}.items():
    ORACLE_SQL[f"select_{name}"] = f"{WITH} SELECT frame, c.atom_index, {XYZ}, name, residue_name FROM c JOIN a USING (atom_index) WHERE {test}"

_elements = values([(z, SYMBOLS[z], RADII[z], SYMBOLS[z] in BIOLOGICAL) for z in range(119)], "z, symbol, vdw_radius, is_biological")
_each_frame = lambda sql: f"SELECT * FROM (SELECT vec_id AS frame FROM embeddings), ({sql})"
ORACLE_SQL["element_masses"] = _each_frame(f"WITH a AS {atoms_of()} SELECT atom_index, element, mass, symbol, vdw_radius, is_biological FROM a JOIN {_elements} ON z = element")
ORACLE_SQL["topology_summary"] = _each_frame(f"WITH a AS {atoms_of()} SELECT chain_index, count(DISTINCT residue_index) AS n_residues, count(*) AS n_atoms, min(residue_index) AS first_residue, max(residue_index) AS last_residue FROM a GROUP BY 1")
ORACLE_SQL["topology_composition"] = _each_frame(f"WITH a AS {atoms_of()} SELECT element, count(*) AS n_atoms FROM a GROUP BY 1")
ORACLE_SQL["topology_problems"] = "SELECT vec_id AS frame, 'bond without atom' AS problem, vec_id % 40 AS id FROM embeddings WHERE vec_id % 40 > 20"
ORACLE_SQL["topology_faults"] = """SELECT DISTINCT vec_id AS frame, problem, CAST(id AS BIGINT) AS id FROM embeddings,
  (SELECT 'atom without residue' AS problem, r AS own, 5 AS n FROM range(5) t(r) UNION ALL SELECT 'residue without chain', c, 2 FROM range(2) t(c)),
  LATERAL (SELECT own + vec_id % 4 AS id) WHERE id >= n"""
ORACLE_SQL["trajectory_info"] = f"SELECT count(*) AS n_frames, {r('min(vec_id) * 0.5::DOUBLE', 'first_time')}, {r('max(vec_id) * 0.5::DOUBLE', 'last_time')} FROM embeddings"


def _tuple_sql(spec: str, arity: int, name: str, value: str) -> str:
    rows = values([(n, *t) for n, t in enumerate(parse_tuples(spec, arity))], "n, " + ", ".join(f"i{k}" for k in range(arity)))
    joins = " ".join(f"JOIN c AS p{k} ON p{k}.atom_index = t.i{k}" + (f" AND p{k}.frame = p0.frame" if k else "") for k in range(arity))
    return f"WITH {COORDS} SELECT p0.frame, n AS {name}, {r(value, 'value')} FROM {rows} t {joins}"


def _minus(a: str, b: str) -> list[str]:
    return [f"({a}.{c} - {b}.{c})" for c in "xyz"]


def _dot(u, v) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"


def _cross(u, v) -> list[str]:
    return [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]


def _dihedral(p=("p0", "p1", "p2", "p3")) -> str:
    b1, b2, b3 = (_minus(p[k + 1], p[k]) for k in range(3))
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    return f"atan2({_dot(_cross(b2, n1), n2)} / nullif(sqrt({_dot(b2, b2)}), 0), {_dot(n1, n2)})"


ORACLE_SQL["distances"] = _tuple_sql(q.PAIRS, 2, "pair", f"sqrt({_dot(_minus('p0', 'p1'), _minus('p0', 'p1'))})")
_u, _v = _minus("p0", "p1"), _minus("p2", "p1")
ORACLE_SQL["angles"] = _tuple_sql(q.TRIPLETS, 3, '"tuple"', f"acos(greatest(-1, least(1, {_dot(_u, _v)} / nullif(sqrt({_dot(_u, _u)}) * sqrt({_dot(_v, _v)}), 0))))")
ORACLE_SQL["dihedrals"] = _tuple_sql(q.QUARTETS, 4, '"tuple"', _dihedral())


def _torsion_sql(kind) -> str:
    """Atoms of a torsion from the topology, then the value per frame; residues without one stay."""
    side = kind in geometry.CHI
    if side:
        names = sorted({n for p in geometry.CHI[kind] for n in p.split()})
        col = lambda n: f'"{n}"'
        found = [f"CASE WHEN {' AND '.join(col(n) + ' IS NOT NULL' for n in p.split())} THEN [{', '.join(map(col, p.split()))}] END" for p in geometry.CHI[kind]]
        quartet = f"coalesce({', '.join(found)})"
    else:
        names = ["N", "CA", "C"]
        near = lambda n, s: f'"{n}"' if s == 0 else f"CASE WHEN {'lag' if s < 0 else 'lead'}(chain_index) OVER w = chain_index THEN {'lag' if s < 0 else 'lead'}(\"{n}\") OVER w END"
        steps = {"phi": [("C", -1), ("N", 0), ("CA", 0), ("C", 0)], "psi": [("N", 0), ("CA", 0), ("C", 0), ("N", 1)], "omega": [("CA", 0), ("C", 0), ("N", 1), ("CA", 1)]}[kind]
        quartet = f"[{', '.join(near(*s) for s in steps)}]"
    picked = ", ".join(f"min(atom_index) FILTER (name = '{n}') AS \"{n}\"" for n in names)
    return f"""WITH {COORDS}, a AS {atoms_of(side)}, g AS (SELECT residue_index, chain_index, {picked} FROM a GROUP BY 1, 2),
      t AS (SELECT residue_index, {quartet} AS i FROM g {'' if side else 'WINDOW w AS (ORDER BY residue_index)'}), f AS (SELECT DISTINCT frame FROM c)
      SELECT f.frame, residue_index, {r(_dihedral(), 'value')} FROM f CROSS JOIN t
      {' '.join(f'LEFT JOIN c AS p{k} ON p{k}.frame = f.frame AND p{k}.atom_index = t.i[{k + 1}]' for k in range(4))}"""


for _kind in ("phi", "psi", "omega"):
    ORACLE_SQL[_kind] = _torsion_sql(_kind)
for _level in geometry.CHI:
    ORACLE_SQL[f"chi{_level}"] = _torsion_sql(_level)

_mean = lambda c: f"sum(mass * {c}) / sum(mass)"
ORACLE_SQL["center_of_mass"] = f"{WITH} SELECT frame, {', '.join(r(_mean(c), f'c{c}') for c in 'xyz')} FROM c JOIN a USING (atom_index) GROUP BY frame"
_ids = lambda l: f"({', '.join(map(str, l))})"
ORACLE_SQL["center_of_geometry"] = f"{WITH} SELECT frame, {', '.join(r(f'avg({c})', f'c{c}') for c in 'xyz')} FROM c WHERE atom_index IN {_ids(q.BACKBONE)} GROUP BY frame"
_about = f"{WITH}, m AS (SELECT frame, {', '.join(f'{_mean(c)} AS m{c}' for c in 'xyz')} FROM c JOIN a USING (atom_index) GROUP BY frame), d AS (SELECT frame, mass, {', '.join(f'{c} - m{c} AS {c}' for c in 'xyz')} FROM c JOIN a USING (atom_index) JOIN m USING (frame))"
_rg = f"{_about}, g AS (SELECT frame, sqrt(sum(mass * (x*x + y*y + z*z)) / sum(mass)) AS value FROM d GROUP BY frame)"
ORACLE_SQL["rg"] = f"{_rg} SELECT frame, {r('value', 'value')} FROM g"
ORACLE_SQL["metric_summary"] = f"{_rg} SELECT count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM g"
_tensor = "sum(mass*(y*y+z*z)) AS ixx, sum(mass*(x*x+z*z)) AS iyy, sum(mass*(x*x+y*y)) AS izz, -sum(mass*x*y) AS ixy, -sum(mass*x*z) AS ixz, -sum(mass*y*z) AS iyz"
_inertia = f"{_about}, i AS (SELECT frame, {_tensor} FROM d GROUP BY frame)"
ORACLE_SQL["inertia"] = f"{_inertia} SELECT frame, {', '.join(r(f'i{p}', f'i{p}') for p in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))} FROM i"
ORACLE_SQL["principal_moments"] = f"""{_inertia}, k AS (SELECT frame, ixx + iyy + izz AS p1, ixx*iyy + ixx*izz + iyy*izz - ixy*ixy - ixz*ixz - iyz*iyz AS p2,
  ixx*(iyy*izz - iyz*iyz) - ixy*(ixy*izz - iyz*ixz) + ixz*(ixy*iyz - iyy*ixz) AS p3 FROM i),
  s AS (SELECT frame, p1/3 AS mid, sqrt(greatest(0, p1*p1/3 - p2) / 3) AS rad, 2*p1*p1*p1/27 - p1*p2/3 + p3 AS b FROM k),
  e AS (SELECT frame, list_sort([mid + 2*rad*cos((acos(greatest(-1, least(1, b / (2*rad*rad*rad)))) + 2*pi()*n)/3) FOR n IN [0, 1, 2]]) AS l FROM s)
  SELECT frame, {', '.join(r(f'l[{n}]', f'i{n}') for n in (1, 2, 3))} FROM e"""


def _rmsd_sql(atoms: list[int], name: str = "value") -> str:
    sums = ", ".join(f"sum(({p} - m{p}) * ({s} - n{s})) AS s{p}{s[1]}" for p in "xyz" for s in ("rx", "ry", "rz"))
    s = lambda i, j: f"s{'xyz'[i]}{'xyz'[j]}"
    m = lambda i, j: "(" + " + ".join(f"{s(k, i)} * {s(k, j)}" for k in range(3)) + ")"
    trace = "(" + " + ".join(m(i, i) for i in range(3)) + ")"
    square = "(" + " + ".join(f"{m(i, j)} * {m(i, j)}" for i in range(3) for j in range(3)) + ")"
    det = f"({s(0,0)}*({s(1,1)}*{s(2,2)} - {s(1,2)}*{s(2,1)}) - {s(0,1)}*({s(1,0)}*{s(2,2)} - {s(1,2)}*{s(2,0)}) + {s(0,2)}*({s(1,0)}*{s(2,1)} - {s(1,1)}*{s(2,0)}))"
    step = "l - coalesce((((l*l + c2)*l + c1)*l + c0) / nullif((4*l*l + 2*c2)*l + c1, 0), 0)"
    return f"""o AS (SELECT * FROM c WHERE atom_index IN {_ids(atoms)}), ref AS (SELECT atom_index, x AS rx, y AS ry, z AS rz FROM o WHERE frame = 0),
  mm AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM o GROUP BY frame), rm AS (SELECT avg(rx) AS nrx, avg(ry) AS nry, avg(rz) AS nrz FROM ref),
  ss AS (SELECT frame, count(*) AS n, sum((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS g, sum((rx-nrx)*(rx-nrx) + (ry-nry)*(ry-nry) + (rz-nrz)*(rz-nrz)) AS h, {sums}
         FROM o JOIN ref USING (atom_index) JOIN mm USING (frame) CROSS JOIN rm GROUP BY frame),
  pp AS (SELECT frame, n, (g + h) / 2 AS e, -2 * {trace} AS c2, -8 * {det} AS c1, 2 * {square} - {trace} * {trace} AS c0 FROM ss),
  ll AS (SELECT frame, n, e, list_reduce(list_prepend(e, [CAST(0 AS DOUBLE) FOR z IN range(50)]), lambda l, y: {step}) AS l FROM pp),
  rmsds AS (SELECT frame, sqrt(greatest(0, 2 * (e - l) / n)) AS {name} FROM ll)"""


_all = list(range(sample.N_ATOMS))
ORACLE_SQL["rmsd"] = f"WITH {COORDS}, {_rmsd_sql(_all)} SELECT frame, {r('value', 'value')} FROM rmsds"
ORACLE_SQL["rmsd_backbone"] = f"WITH {COORDS}, {_rmsd_sql(q.BACKBONE)} SELECT frame, {r('value', 'value')} FROM rmsds"
ORACLE_SQL["superpose"] = ORACLE_SQL["rmsd"]


def _superpose_sql(atoms: list[int]) -> str:
    """The rotation's quaternion: cofactors of the first row of the quaternion matrix less its largest eigenvalue."""
    key = ["sxx + syy + szz", "syz - szy", "szx - sxz", "sxy - syx", "sxx - syy - szz", "sxy + syx", "szx + sxz", "syy - sxx - szz", "syz + szy", "szz - sxx - syy"]
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    matrix = ", ".join(f"{e}{' - l' if i == j else ''} AS m{i}{j}" for (i, j), e in zip(upper, key))
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    det = lambda c: f"({m(1, c[0])}*({m(2, c[1])}*{m(3, c[2])} - {m(2, c[2])}*{m(3, c[1])}) - {m(1, c[1])}*({m(2, c[0])}*{m(3, c[2])} - {m(2, c[2])}*{m(3, c[0])}) + {m(1, c[2])}*({m(2, c[0])}*{m(3, c[1])} - {m(2, c[1])}*{m(3, c[0])}))"
    signs = ["", "-", "", "-"]
    quaternion = ", ".join(f"{signs[k]}{det([c for c in range(4) if c != k])} AS q{k}" for k in range(4))
    turn = [["q0*q0+q1*q1-q2*q2-q3*q3", "2*(q1*q2-q0*q3)", "2*(q1*q3+q0*q2)"], ["2*(q1*q2+q0*q3)", "q0*q0-q1*q1+q2*q2-q3*q3", "2*(q2*q3-q0*q1)"], ["2*(q1*q3-q0*q2)", "2*(q2*q3+q0*q1)", "q0*q0-q1*q1-q2*q2+q3*q3"]]
    to = ", ".join(r(f"nr{c} + ({' + '.join(f'({t}) * (c.{d} - m{d})' for t, d in zip(row, 'xyz'))}) / (q0*q0+q1*q1+q2*q2+q3*q3)", c) for c, row in zip("xyz", turn))
    return f"""WITH {COORDS}, {_rmsd_sql(atoms)}, kk AS (SELECT frame, {matrix} FROM ss JOIN ll USING (frame)), qq AS (SELECT frame, {quaternion} FROM kk)
  SELECT c.frame, c.atom_index, {to} FROM c JOIN qq USING (frame) JOIN mm USING (frame) CROSS JOIN rm"""


ORACLE_SQL["superpose_coordinates"] = _superpose_sql(q.BACKBONE)


def _native_sql(kept: str) -> str:
    return f"""WITH {COORDS}, np AS (SELECT p.atom_index AS i, q.atom_index AS j, sqrt({D2}) AS r0 FROM c p JOIN c q USING (frame) WHERE frame = 0 AND p.atom_index IN {_ids(q.BACKBONE)} AND {D2} <= 20.25)
  SELECT p.frame, {r(f'avg({kept})', 'value')} FROM np JOIN c p ON p.atom_index = i JOIN c q ON q.atom_index = j AND q.frame = p.frame GROUP BY p.frame"""


ORACLE_SQL["native_q"] = _native_sql(f"CASE WHEN sqrt({D2}) <= 4.5 THEN 1.0::DOUBLE ELSE 0.0 END")
ORACLE_SQL["native_q_soft"] = _native_sql(f"1 / (1 + exp(2.0::DOUBLE * (sqrt({D2}) - 1.5::DOUBLE * r0)))")
ORACLE_SQL["rmsf"] = f"WITH {COORDS} SELECT atom_index, {r('sqrt(var_pop(x) + var_pop(y) + var_pop(z))', 'value')} FROM c GROUP BY 1"
ORACLE_SQL["msd"] = f"""WITH {COORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY atom_index ORDER BY frame) AS t FROM c WHERE atom_index IN {_ids(q.BACKBONE)})
  SELECT q.t - p.t AS lag, {r(f'avg({D2})', 'value')} FROM o p JOIN o q ON p.atom_index = q.atom_index AND q.t >= p.t GROUP BY 1"""
ORACLE_SQL["msd_all"] = ORACLE_SQL["msd"].replace(f" WHERE atom_index IN {_ids(q.BACKBONE)}", "")
_labelled = f"WITH {COORDS}, l AS (SELECT vec_id AS frame, 'label ' || label AS traj FROM embeddings)"
ORACLE_SQL["rmsf_by_traj"] = f"{_labelled} SELECT traj, atom_index, {r('sqrt(var_pop(x) + var_pop(y) + var_pop(z))', 'value')} FROM c JOIN l USING (frame) GROUP BY 1, 2"
ORACLE_SQL["msd_by_traj"] = f"""{_labelled}, o AS (SELECT *, row_number() OVER (PARTITION BY traj, atom_index ORDER BY frame) AS t FROM c JOIN l USING (frame))
  SELECT p.traj, q.t - p.t AS lag, {r(f'avg({D2})', 'value')} FROM o p JOIN o q ON p.traj = q.traj AND p.atom_index = q.atom_index AND q.t >= p.t GROUP BY 1, 2"""
ORACLE_SQL["covariance"] = f"""WITH {COORDS}, o AS (SELECT frame, CAST(list_position({q.PROTEIN}, atom_index) - 1 AS INTEGER) AS k, x, y, z FROM c WHERE atom_index IN {_ids(q.PROTEIN)}),
  u AS (SELECT frame, 3 * k + s AS d, [x, y, z][s + 1] AS v FROM o, range(3) t(s))
  SELECT CAST(p.d AS INTEGER) AS i, CAST(q.d AS INTEGER) AS j, {r('covar_samp(p.v, q.v)', 'value')} FROM u p JOIN u q ON p.frame = q.frame AND p.d <= q.d GROUP BY 1, 2"""
_w = q.R_MAX / q.BINS
_rdf = f"""WITH {COORDS}, n AS (SELECT p.frame, CAST(floor(sqrt({D2}) / {_w!r}::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM c p JOIN c q ON p.frame = q.frame
  WHERE p.atom_index IN {_ids(q.BACKBONE)} AND q.atom_index IN {_ids(q.PROTEIN)} AND {D2} < {q.R_MAX ** 2} GROUP BY 1, 2), f AS (SELECT DISTINCT frame FROM c),
  g AS (SELECT f.frame, CAST(b AS INTEGER) AS bin, (b + 0.5) * {_w!r}::DOUBLE AS r, coalesce(n, 0) / ({len(q.PROTEIN)} / {q.VOLUME}::DOUBLE * {len(q.BACKBONE)} * 4 / 3 * pi() * (pow((b + 1) * {_w!r}::DOUBLE, 3) - pow(b * {_w!r}::DOUBLE, 3))) AS g_r
        FROM f CROSS JOIN range({q.BINS}) t(b) LEFT JOIN n ON n.frame = f.frame AND n.bin = b)"""
ORACLE_SQL["rdf"] = f"{_rdf} SELECT frame, bin, {r('r', 'r')}, {r('g_r', 'g_r')} FROM g"
ORACLE_SQL["rdf_average"] = f"{_rdf} SELECT bin, {r('min(r)', 'r')}, {r('avg(g_r)', 'g_r')} FROM g GROUP BY bin"
_diag = [f"({SKEWED[i]}::DOUBLE + vec_id * 0.01::DOUBLE)" for i in (0, 4, 8)]
_box_of = lambda k: f"({SKEWED[k]}::DOUBLE + frame * 0.01::DOUBLE)"
ORACLE_SQL["rdf_by_frame"] = f"{_rdf} SELECT frame, bin, {r('r', 'r')}, {r(f'g_r * {_box_of(0)} * {_box_of(4)} * {_box_of(8)} / {q.VOLUME}::DOUBLE', 'g_r')} FROM g"
ORACLE_SQL["box_volume"] = f"SELECT vec_id AS frame, {r('abs(' + ' * '.join(_diag) + ')', 'volume')} FROM embeddings"
_hb = f"""{WITH}, b AS {values(sample.BONDED, 'i, j')}, dh AS (SELECT i AS donor, j AS hydrogen FROM (SELECT i, j FROM b UNION SELECT j, i FROM b) e
    JOIN a d ON d.atom_index = i JOIN a h ON h.atom_index = j WHERE d.element IN (7, 8) AND h.element = 1),
  hb AS (SELECT p.frame, donor, hydrogen, q.atom_index AS acceptor, sqrt({D2}) AS distance,
    degrees(acos(greatest(-1, least(1, ((d.x-p.x)*(q.x-p.x) + (d.y-p.y)*(q.y-p.y) + (d.z-p.z)*(q.z-p.z)) / (sqrt((d.x-p.x)*(d.x-p.x) + (d.y-p.y)*(d.y-p.y) + (d.z-p.z)*(d.z-p.z)) * sqrt({D2})))))) AS angle
    FROM dh JOIN c p ON p.atom_index = hydrogen JOIN c d ON d.atom_index = donor AND d.frame = p.frame JOIN c q ON q.frame = p.frame JOIN a k ON k.atom_index = q.atom_index
    WHERE k.element IN (7, 8, 16) AND q.atom_index NOT IN (donor, hydrogen) AND {D2} <= {{}})"""
_hbonds = _hb.format(q.HBOND**2)
ORACLE_SQL["hbonds"] = f"{_hbonds} SELECT frame, donor, hydrogen, acceptor, {r('distance', 'distance')}, {r('angle', 'angle')} FROM hb WHERE angle >= 90"
ORACLE_SQL["hbond_counts"] = f"{_hbonds} SELECT f.frame, count(hb.frame) AS n_hbonds FROM (SELECT DISTINCT frame FROM c) f LEFT JOIN hb ON hb.frame = f.frame AND angle >= 90 GROUP BY 1"
ORACLE_SQL["dh_inference"] = f"""{WITH}, n AS (SELECT p.frame, p.atom_index AS hydrogen, q.atom_index AS donor, row_number() OVER (PARTITION BY p.frame, p.atom_index ORDER BY {D2}, q.atom_index) AS k
  FROM c p JOIN a h ON h.atom_index = p.atom_index AND h.element = 1 JOIN c q ON q.frame = p.frame JOIN a d ON d.atom_index = q.atom_index AND d.element IN (7, 8) WHERE {D2} < {q.CUTOFF ** 2})
  SELECT frame, donor, hydrogen FROM n WHERE k = 1"""


def _contacts_sql(test: str, cutoff: float = q.CONTACT) -> str:
    return f"""{WITH}, o AS (SELECT frame, residue_index, x, y, z FROM c JOIN a USING (atom_index) WHERE {test}),
  k AS (SELECT p.frame, p.residue_index AS residue_i, q.residue_index AS residue_j, sqrt(min({D2})) AS distance FROM o p JOIN o q ON p.frame = q.frame AND p.residue_index < q.residue_index
        GROUP BY 1, 2, 3 HAVING sqrt(min({D2})) < {cutoff})"""


for _scheme, _test in {"closest": "TRUE", "ca": "name = 'CA'", "closest_heavy": "element <> 1"}.items():
    ORACLE_SQL[f"contacts_{_scheme}"] = f"{_contacts_sql(_test)} SELECT frame, residue_i, residue_j, {r('distance', 'distance')} FROM k"
ORACLE_SQL["contact_frequency"] = f"{_contacts_sql('TRUE')} SELECT residue_i, residue_j, {r('count(*) / (SELECT count(*) FROM embeddings)', 'frequency')} FROM k GROUP BY 1, 2"
_near = lambda test: f"{WITH} SELECT p.frame, p.atom_index AS i, q.atom_index AS j, {r(f'sqrt({D2})', 'd')} FROM c p JOIN c q ON p.frame = q.frame AND p.atom_index < q.atom_index JOIN a s ON s.atom_index = p.atom_index JOIN a t ON t.atom_index = q.atom_index WHERE {test}"
ORACLE_SQL["neighbor_pairs"] = _near(f"{D2} < {q.CUTOFF ** 2}")
ORACLE_SQL["neighbor_pairs_by_cells"] = ORACLE_SQL["neighbor_pairs"]
ORACLE_SQL["neighbor_lists"] = f"""{WITH} SELECT p.frame, p.atom_index AS i, CAST(row_number() OVER (PARTITION BY p.frame, p.atom_index ORDER BY sqrt({D2}), q.atom_index) - 1 AS INTEGER) AS place,
  q.atom_index AS j, {r(f'sqrt({D2})', 'd')} FROM c p JOIN c q ON p.frame = q.frame AND p.atom_index <> q.atom_index JOIN a s ON s.atom_index = p.atom_index JOIN a t ON t.atom_index = q.atom_index
  WHERE p.atom_index IN {_ids(q.BACKBONE)} AND q.atom_index IN {_ids(q.PROTEIN)} AND sqrt({D2}) < s.radius + 1.1 * t.radius + 0.4"""
ORACLE_SQL["neighbor_pairs_by_radius"] = _near(f"sqrt({D2}) < s.radius + t.radius + 0.4")


def _turned(point: dict[str, str], box: list[float], how: str) -> tuple[str, dict[str, str]]:
    """Nested selects that take whole box vectors off, c first."""
    sql, names = "", point
    for row in (2, 1, 0):
        n = f"{how}({'xyz'[row]} / {box[4 * row]}::DOUBLE)"
        sql = f"SELECT * REPLACE ({', '.join(f'{c} - {n} * {box[3 * row + i]}::DOUBLE AS {c}' for i, c in enumerate('xyz') if box[3 * row + i])}) FROM ({sql or point['from']})"
    return sql, names


for _shape, _box in {"ortho": BOX, "triclinic": SKEWED}.items():
    _sql, _ = _turned({"from": "SELECT frame, atom_index, 7 * x AS x, 7 * y AS y, 7 * z AS z FROM c"}, _box, "floor")
    ORACLE_SQL[f"wrap_{_shape}"] = f"WITH {COORDS} SELECT frame, atom_index, {', '.join(r(c, c) for c in 'xyz')} FROM ({_sql})"
    _pairs = values([(n, *t) for n, t in enumerate(parse_tuples(q.PAIRS, 2))], "n, i, j")
    _delta = f"SELECT p.frame, n AS pair, {', '.join(f'7 * q.{c} - 7 * p.{c} AS {c}' for c in 'xyz')} FROM {_pairs} t JOIN c p ON p.atom_index = i JOIN c q ON q.atom_index = j AND q.frame = p.frame"
    _sql, _ = _turned({"from": _delta}, _box, "round")
    ORACLE_SQL[f"min_image_{_shape}"] = f"WITH {COORDS} SELECT frame, pair, {r('sqrt(x*x + y*y + z*z)', 'value')} FROM ({_sql})"

_bond_rows = values(sample.BONDED, "i, j")
_grow = lambda c, a: f"d{c} - round(d{c} / {a}) * {a}"
_edges = f"SELECT frame, i, j, {', '.join(f'q.{c} - p.{c} AS d{c}' for c in 'xyz')} FROM bonds b JOIN c p ON p.atom_index = b.i JOIN c q USING (frame) WHERE q.atom_index = b.j"


def _whole_sql(steps: str) -> str:
    """The sample's molecules grow along bonds from atoms that no bond leads to; each atom has one smaller neighbour at most."""
    return f"""WITH RECURSIVE {COORDS}, bonds AS {_bond_rows}, e AS ({_edges}), s AS ({steps}),
  w AS (SELECT frame, atom_index, x, y, z FROM c WHERE atom_index NOT IN (SELECT j FROM bonds)
        UNION ALL SELECT w.frame, s.j, w.x + s.dx, w.y + s.dy, w.z + s.dz FROM w JOIN s ON s.frame = w.frame AND s.i = w.atom_index)
  SELECT frame, CAST(atom_index AS INTEGER) AS atom_index, {', '.join(r(c, c) for c in 'xyz')} FROM w"""


ORACLE_SQL["make_whole"] = _whole_sql(f"SELECT frame, i, j, {', '.join(f'{_grow(c, 6)} AS d{c}' for c in 'xyz')} FROM e")


def _turned_by_frame(source: str, how: str, scale: float = 1.0, names: str = "xyz") -> str:
    """As _turned, with the skewed box that grows from frame to frame."""
    sql = source
    for row in (2, 1, 0):
        side = lambda k: f"({SKEWED[k]}::DOUBLE + frame * {0.01 if k % 4 == 0 else 0.0}::DOUBLE) * {scale}::DOUBLE"
        n = f"{how}({names[row]} / ({side(4 * row)}))"
        sql = f"SELECT * REPLACE ({', '.join(f'{c} - {n} * ({side(3 * row + i)}) AS {c}' for i, c in enumerate(names) if SKEWED[3 * row + i])}) FROM ({sql})"
    return sql


ORACLE_SQL["wrap_by_frame"] = f"WITH {COORDS} SELECT frame, atom_index, {', '.join(r(c, c) for c in 'xyz')} FROM ({_turned_by_frame('SELECT frame, atom_index, 7 * x AS x, 7 * y AS y, 7 * z AS z FROM c', 'floor')})"
ORACLE_SQL["min_image_by_frame"] = f"WITH {COORDS} SELECT frame, pair, {r('sqrt(x*x + y*y + z*z)', 'value')} FROM ({_turned_by_frame(_delta, 'round')})"
_turned_edges = _turned_by_frame("SELECT frame, i, j, dx AS x, dy AS y, dz AS z FROM e", "round", 0.4)
ORACLE_SQL["make_whole_by_frame"] = _whole_sql(f"SELECT frame, i, j, x AS dx, y AS dy, z AS dz FROM ({_turned_edges})")

# 100 points of a golden spiral: heights in equal steps, turned by the golden angle from one to the next
_points = "(SELECT k, sqrt(1 - h * h) * cos(turn) AS sx, sqrt(1 - h * h) * sin(turn) AS sy, h AS sz FROM (SELECT k, 1 - (2 * k + 1) / 100.0::DOUBLE AS h, k * pi() * (3 - sqrt(5.0::DOUBLE)) AS turn FROM range(100) t(k)))"
_sasa = f"""{WITH}, o AS (SELECT frame, atom_index, x, y, z, radius + 1.4::DOUBLE AS r FROM c JOIN a USING (atom_index)), s AS {_points},
  w AS (SELECT p.frame, p.atom_index, p.r, p.x + p.r * sx AS x, p.y + p.r * sy AS y, p.z + p.r * sz AS z FROM o p CROSS JOIN s),
  e AS (SELECT w.frame, w.atom_index, w.r, count(*) FILTER (NOT EXISTS (SELECT 1 FROM o q WHERE q.frame = w.frame AND q.atom_index <> w.atom_index
        AND (w.x - q.x) * (w.x - q.x) + (w.y - q.y) * (w.y - q.y) + (w.z - q.z) * (w.z - q.z) < q.r * q.r)) AS free FROM w GROUP BY 1, 2, 3)"""
ORACLE_SQL["sasa_atoms"] = f"{_sasa} SELECT frame, atom_index, {r('free / 100 * 4 * pi() * r * r', 'area')} FROM e"
ORACLE_SQL["sasa_residues"] = f"{_sasa} SELECT frame, residue_index, {r('sum(free / 100 * 4 * pi() * e.r * e.r)', 'area')} FROM e JOIN a USING (atom_index) GROUP BY 1, 2"
ORACLE_SQL["sasa_total"] = f"{_sasa} SELECT frame, {r('sum(free / 100 * 4 * pi() * r * r)', 'area')} FROM e GROUP BY 1"

_bb = f"""{WITH}, g AS (SELECT frame, residue_index AS r, chain_index, residue_name = 'PRO' AS pro, {', '.join(f"max({c}) FILTER (name = '{n}') AS {k}{c}" for k, n in {'n': 'N', 'a': 'CA', 'c': 'C', 'o': 'O'}.items() for c in 'xyz')}
    FROM c JOIN a USING (atom_index) GROUP BY ALL),
  l AS (SELECT *, {', '.join(f'lag({p}{c}) OVER w AS l{p}{c}' for p in 'co' for c in 'xyz')}, lag(chain_index) OVER w AS lchain FROM g WINDOW w AS (PARTITION BY frame ORDER BY r)),
  hh AS (SELECT *, coalesce(lchain = chain_index AND sqrt((lcx-nx)*(lcx-nx) + (lcy-ny)*(lcy-ny) + (lcz-nz)*(lcz-nz)) <= 2.5, FALSE) AND NOT pro AS has,
    sqrt((lox-lcx)*(lox-lcx) + (loy-lcy)*(loy-lcy) + (loz-lcz)*(loz-lcz)) AS co FROM l),
  bb AS (SELECT *, {', '.join(f'CASE WHEN has THEN n{c} - (lo{c} - lc{c}) / co ELSE 0 END AS h{c}' for c in 'xyz')} FROM hh),
  ee AS (SELECT d.frame, d.r AS donor, k.r AS acceptor, d.pro, {', '.join(f'sqrt({" + ".join(f"(d.{u}{c} - k.{v}{c}) * (d.{u}{c} - k.{v}{c})" for c in "xyz")}) AS {u}{v}' for u, v in ('ho', 'hc', 'nc', 'no'))}
    FROM bb d JOIN bb k ON d.frame = k.frame AND abs(d.r - k.r) >= 2 WHERE (d.ax-k.ax)*(d.ax-k.ax) + (d.ay-k.ay)*(d.ay-k.ay) + (d.az-k.az)*(d.az-k.az) < 81),
  en AS (SELECT frame, donor, acceptor, CASE WHEN pro THEN 0 WHEN least(ho, hc, nc, no) < 0.5 THEN -9.9::DOUBLE
    ELSE greatest(-9.9::DOUBLE, round(-27.888::DOUBLE / ho - -27.888::DOUBLE / hc + -27.888::DOUBLE / nc - -27.888::DOUBLE / no, 3)) END AS energy FROM ee)"""
ORACLE_SQL["dssp_energy"] = f"{_bb} SELECT frame, donor, acceptor, {r('energy', 'energy')} FROM en"
ORACLE_SQL["dssp_best2"] = f"{_bb} SELECT * FROM (SELECT frame, donor, acceptor, {r('energy', 'energy')}, CAST(row_number() OVER (PARTITION BY frame, donor ORDER BY energy, acceptor) AS INTEGER) AS rank FROM en WHERE energy < 0) WHERE rank <= 2"
_rama = lambda k: ORACLE_SQL[k].replace(r(_dihedral(), "value"), f"{_dihedral()} AS value")
ORACLE_SQL["ramachandran_hist"] = f"""SELECT phi_bin, psi_bin, count(*) AS n FROM (SELECT {', '.join(f"least(119, CAST(floor((degrees({k}.value) + 180) / 3) AS INTEGER)) AS {k}_bin" for k in ('phi', 'psi'))}
  FROM ({_rama('phi')}) phi JOIN ({_rama('psi')}) psi USING (frame, residue_index) WHERE phi.value IS NOT NULL AND psi.value IS NOT NULL) GROUP BY 1, 2"""
_a_hb, _a_ct = _hb.format(6.25).removeprefix(WITH), _contacts_sql("element <> 1", 4.5).removeprefix(WITH)
ORACLE_SQL["analyze_all"] = f"""{_about}, g AS (SELECT frame, sqrt(sum(mass * (x*x + y*y + z*z)) / sum(mass)) AS rg FROM d GROUP BY frame), {_rmsd_sql(_all, 'rmsd')}{_a_hb}{_a_ct.replace(', o AS', ', oc AS').replace('FROM o p JOIN o q', 'FROM oc p JOIN oc q').replace(' k AS (', ' kc AS (')}
  SELECT frame, {r('rmsd', 'rmsd')}, {r('rg', 'rg')}, {', '.join(r(f'm{c}', f'c{c}') for c in 'xyz').replace('mx', 'm.mx').replace('my', 'm.my').replace('mz', 'm.mz')},
    (SELECT count(*) FROM hb WHERE hb.frame = m.frame AND angle >= 120) AS n_hbonds, (SELECT count(*) FROM kc WHERE kc.frame = m.frame) AS n_contacts
  FROM m JOIN g USING (frame) JOIN rmsds USING (frame)"""
ORACLE_SQL["analyze_all_frames"] = f"SELECT f.*, s.area AS sasa FROM ({ORACLE_SQL['analyze_all']}) f JOIN ({ORACLE_SQL['sasa_total']}) s USING (frame)"
ORACLE_SQL["analyze_all_atoms"] = ORACLE_SQL["rmsf"]
ORACLE_SQL["lineitem_center"] = f"SELECT l_orderkey, {r('sum(l_quantity * l_extendedprice) / sum(l_quantity)', 'center')}, round(stddev_pop(l_extendedprice), 3) + 0.0 AS spread, count(*) AS n FROM lineitem GROUP BY 1"


def _read_sql(kept, kept_box) -> str:
    """The sample as a format keeps it: ``kept`` says how a coordinate comes back, ``kept_box`` how a side of the box does."""
    side = [kept_box(f"({SKEWED[4 * k]}::DOUBLE + frame * 0.01::DOUBLE)") for k in range(3)]
    return f"WITH {COORDS} SELECT frame, atom_index, {', '.join(r(kept(c), c) for c in 'xyz')}, {', '.join(r(s, f'box_{c}') for s, c in zip(side, 'abc'))} FROM c"


_float_nm = lambda c: f"CAST(CAST({c} / 10 AS FLOAT) AS DOUBLE) * 10"
_float = lambda c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
_xtc = lambda c: f"CAST(CAST(round_even({c} / 10 * 1000, 0) AS FLOAT) * CAST(0.001 AS FLOAT) AS DOUBLE) * 10"
_whole = lambda c: c
ORACLE_SQL["read_xtc"] = _read_sql(_xtc, _float_nm)
_trr = lambda c: f"CAST(CAST({c} / 10 AS FLOAT) * CAST(10 AS FLOAT) AS DOUBLE)"
ORACLE_SQL["read_trr"] = _read_sql(_trr, _trr)
ORACLE_SQL["read_netcdf"] = _read_sql(_float, _whole)
ORACLE_SQL["read_dcd"] = _read_sql(_float, _whole)
_label = "(SELECT vec_id AS frame, 'label ' || label AS traj FROM embeddings)"
ORACLE_SQL["append_xtc"] = f"""WITH {COORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY frame % 2, frame) - 1 AS k FROM {_label} l)
  SELECT traj, k AS frame, atom_index, {', '.join(r(_xtc(c), c) for c in 'xyz')} FROM c JOIN n USING (frame)"""
_sections = {"": 1, "v": -0.1, "f": 3.0}
ORACLE_SQL["read_trr_sections"] = f"WITH {COORDS} SELECT frame, atom_index, {', '.join(r(f'{c} * {m}::DOUBLE', s + c) for s, m in _sections.items() for c in 'xyz')} FROM c"
ORACLE_SQL["trajectory_times"] = f"""SELECT traj, count(*) AS n_frames, min(frame) * 0.5::DOUBLE AS first_time, max(frame) * 0.5::DOUBLE AS last_time FROM {_label} l GROUP BY traj"""
_files = lambda shown: f"{WITH} SELECT frame, atom_index, name, element, residue_index, residue_name, residue_index + 1 AS resid, {shown} FROM c JOIN a USING (atom_index)"
ORACLE_SQL["read_pdb"] = _files(", ".join(r(f"round({c}, 3)", c) for c in "xyz"))
ORACLE_SQL["read_gro"] = _files(", ".join(r(f"round({c} / 10, 3) * 10", c) for c in "xyz"))
ORACLE_SQL["read_mmcif"] = _files(", ".join(r(c, c) for c in "xyz"))
ORACLE_SQL["read_prmtop"] = _files(r("CAST(printf('%.8e', x * 18.2223::DOUBLE) AS DOUBLE) / 18.2223::DOUBLE", "charge"))
_bonds = ", ".join(f"({i}, {j})" for i, j in BONDED)
ORACLE_SQL["structure_bonds"] = f"SELECT * FROM (SELECT vec_id AS frame FROM embeddings), (VALUES {_bonds}) b(atom_i, atom_j)"
ORACLE_SQL["sql_rmsd"], ORACLE_SQL["sql_rg"], ORACLE_SQL["sql_neighbors"] = ORACLE_SQL["rmsd"], ORACLE_SQL["rg"], ORACLE_SQL["neighbor_pairs"]
_pairs = ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(parse_tuples(q.PAIRS, 2)))
ORACLE_SQL["sql_distances"] = f"SELECT frame, i, j, value AS distance FROM ({ORACLE_SQL['distances']}) JOIN (VALUES {_pairs}) v(pair, i, j) USING (pair)"


_FIRST, _LAST = _bb.split(",\n  l AS", 1)


def _chain_sql() -> tuple[str, dict[str, str]]:
    """Residues (frame, residue, r in order) with segments by windows: a break begins a new segment. Angles need all of their residues in one."""
    cosine = lambda u, v: f"{_dot(u, v)} / nullif(sqrt({_dot(u, u)}) * sqrt({_dot(v, v)}), 0)"
    turned = f"acos(greatest(-1, least(1, {cosine(_minus('a', 'pa2'), _minus('na2', 'a'))})))"
    angles = {
        "phi": ("ps = seg", f"degrees({_dihedral(('pc', 'n', 'a', 'c'))})"), "psi": ("ns = seg", f"degrees({_dihedral(('n', 'a', 'c', 'nn'))})"),
        "omega": ("ns = seg", f"degrees({_dihedral(('a', 'c', 'nn', 'na'))})"), "kappa": ("ps2 = ns2", f"degrees({turned})"),
        "alpha": ("ps = ns2", f"degrees({_dihedral(('pa', 'a', 'na', 'na2'))})"), "tco": ("ps = seg", cosine(_minus("c", "o"), _minus("pc", "po"))),
    }
    gap = _minus("pc", "n")
    plan = f"""
  q AS (SELECT frame, residue, r, chain_index, {', '.join(f"struct_pack({', '.join(f'{c} := {p}{c}' for c in 'xyz')}) AS {p}" for p in 'naco')} FROM g),
  k AS (SELECT *, lag(c) OVER w AS pc, lag(o) OVER w AS po, lead(n) OVER w AS nn, lead(a) OVER w AS na, lag(a) OVER w AS pa, lag(a, 2) OVER w AS pa2, lead(a, 2) OVER w AS na2, lag(chain_index) OVER w AS pchain
    FROM q WINDOW w AS (PARTITION BY frame ORDER BY r)),
  b AS (SELECT *, sum(CASE WHEN pchain <> chain_index OR sqrt({_dot(gap, gap)}) > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY r) AS seg FROM k),
  s AS (SELECT *, lag(seg) OVER w AS ps, lag(seg, 2) OVER w AS ps2, lead(seg) OVER w AS ns, lead(seg, 2) OVER w AS ns2 FROM b WINDOW w AS (PARTITION BY frame ORDER BY r)),
  ang AS MATERIALIZED (SELECT frame, residue, r, chain_index, seg, ps = ns AS inner_, {', '.join(f'CASE WHEN {test} THEN {value} END AS {name}' for name, (test, value) in angles.items())} FROM s)"""
    return plan, angles


_CHAIN, _ANGLES = _chain_sql()
_shown_angles = ", ".join(r(name, name) for name in _ANGLES)
_complete = _FIRST[_FIRST.index(", g AS") :].replace("residue_index AS r", "residue_index AS residue") + ""
_complete = f"{_complete[:-1]} HAVING count(*) FILTER (name IN ('N', 'CA', 'C', 'O')) = 4)"
_complete = f"{_complete.replace(', g AS (', ', g AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY residue) - 1 AS r FROM (')})"
ORACLE_SQL["dssp_geometry"] = f"{WITH}{_complete},{_CHAIN} SELECT frame, residue AS residue_index, {_shown_angles} FROM ang"


def _codes_sql(head: str, over_alpha: bool = True) -> str:
    """A frame's codes from coordinates: bridges by semi-joins on shifted indices, ladders as islands on diagonals, a recursion
    that joins ladders across bulges in their order, one that spreads the least ladder over a sheet, and helices, turns and
    stretches by starts and the residues they cover. ``head`` has the tables c and a."""
    bond = lambda d, a: f"(frame, {d}, {a}) IN (SELECT frame, d, a FROM h)"
    near = "cur.par = b.par AND cur.si = b.si AND cur.sj = b.sj AND b.i0 - cur.i1 < 6 AND NOT (cur.i1 >= b.i0 AND cur.i0 <= b.i1)"
    gap = "(CASE WHEN cur.par THEN b.j0 - cur.j1 ELSE cur.j0 - b.j1 END)"
    both = """{'par': cur.par, 'i0': cur.i0, 'i1': b.i1, 'j0': CASE WHEN cur.par THEN cur.j0 ELSE b.j0 END, 'j1': CASE WHEN cur.par THEN b.j1 ELSE cur.j1 END,
      'si': cur.si, 'sj': cur.sj, 'n': cur.n + b.n, 'own': list_concat(cur.own, b.own)}"""
    covered = lambda d, which: f"SELECT DISTINCT frame, i + k AS r FROM {which}, range({d}) t(k)"
    free = lambda d, over, codes: f"SELECT two.frame, two.i FROM two JOIN {codes} x ON x.frame = two.frame AND x.r BETWEEN i AND i + {d - 1} WHERE d = {d} GROUP BY ALL HAVING bool_and(code IN ({over}))"
    return f"""WITH RECURSIVE {head}{_complete},
  l AS{_LAST},{_CHAIN},
  h AS MATERIALIZED (SELECT frame, donor AS d, acceptor AS a FROM (SELECT *, row_number() OVER (PARTITION BY frame, donor ORDER BY energy, acceptor) AS rank FROM en WHERE energy < 0) WHERE rank <= 2 AND energy < -0.5),
  pr AS (SELECT ee.frame, donor AS i, acceptor AS j, p.seg AS si, q.seg AS sj, p.chain_index FROM ee JOIN ang p ON p.frame = ee.frame AND p.r = donor JOIN ang q ON q.frame = ee.frame AND q.r = acceptor
    WHERE donor < acceptor AND p.inner_ AND q.inner_),
  br AS MATERIALIZED (SELECT * FROM (SELECT *, ({bond('i + 1', 'j')} AND {bond('j', 'i - 1')}) OR ({bond('j + 1', 'i')} AND {bond('i', 'j - 1')}) AS par,
    ({bond('i + 1', 'j - 1')} AND {bond('j + 1', 'i - 1')}) OR ({bond('j', 'i')} AND {bond('i', 'j')}) AS opposed FROM pr) WHERE par OR opposed),
  la AS (SELECT frame, par, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(si) AS si, min(sj) AS sj, arg_min(chain_index, i) AS chain, count(*) AS n, list_concat(list(i), list(j)) AS own
    FROM (SELECT *, CASE WHEN par THEN j - i ELSE j + i END AS diagonal, i - row_number() OVER (PARTITION BY frame, par, CASE WHEN par THEN j - i ELSE j + i END ORDER BY i) AS run FROM br) GROUP BY frame, par, diagonal, run),
  op AS (SELECT frame, list({{'par': par, 'i0': i0, 'i1': i1, 'j0': j0, 'j1': j1, 'si': si, 'sj': sj, 'n': n, 'own': own}} ORDER BY chain, i0, n DESC, j0) AS all_ FROM la GROUP BY frame),
  mg AS (SELECT frame, all_[1:0] AS done, all_[1] AS cur, all_[1:0] AS kept, all_[2:] AS rest FROM op
    UNION ALL SELECT frame, CASE WHEN len(rest) = 0 THEN list_append(done, cur) ELSE done END,
      CASE WHEN len(rest) = 0 THEN kept[1] WHEN joined THEN {both} ELSE cur END,
      CASE WHEN len(rest) = 0 THEN kept[1:0] WHEN joined THEN kept ELSE list_append(kept, b) END,
      CASE WHEN len(rest) = 0 THEN kept[2:] ELSE rest[2:] END
    FROM (SELECT *, {near} AND ({gap} BETWEEN 0 AND 2 OR ({gap} BETWEEN 0 AND 5 AND b.i0 - cur.i1 BETWEEN 1 AND 2)) AS joined FROM (SELECT *, rest[1] AS b FROM mg WHERE len(rest) + len(kept) > 0))),
  lad AS MATERIALIZED (SELECT frame, k AS x, all_[k].i0 AS i0, all_[k].i1 AS i1, all_[k].j0 AS j0, all_[k].j1 AS j1, all_[k].n AS n, all_[k].own AS own
    FROM (SELECT frame, all_, unnest(range(1, len(all_) + 1)) AS k FROM (SELECT frame, list_append(done, cur) AS all_ FROM mg WHERE len(rest) + len(kept) = 0))),
  touch AS (SELECT p.frame, p.x, q.x AS y FROM lad p JOIN lad q ON p.frame = q.frame AND list_has_any(p.own, q.own)),
  spread AS (SELECT frame, x, x AS y FROM lad UNION SELECT s.frame, s.x, t.y FROM spread s JOIN touch t ON t.frame = s.frame AND t.x = s.y),
  sh AS (SELECT frame, x, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS sheet FROM (SELECT frame, x, min(y) AS root FROM spread GROUP BY ALL)),
  cov AS (SELECT frame, x, n, unnest(list_concat(range(i0, i1 + 1), range(j0, j1 + 1))) AS r FROM lad),
  beta AS (SELECT frame, r, CASE WHEN max(n) > 1 THEN 'E' ELSE 'B' END AS code, arg_max(sheet, x) AS sheet FROM cov JOIN sh USING (frame, x) GROUP BY ALL),
  isl AS (SELECT *, min(r) OVER (PARTITION BY frame, sheet, run) AS first_ FROM (SELECT *, r - row_number() OVER (PARTITION BY frame, sheet ORDER BY r) AS run FROM beta)),
  c0 AS (SELECT ang.frame, ang.r, coalesce(code, ' ') AS code, coalesce(sheet, 0) AS sheet, coalesce(strand, 0) AS strand, ang.kappa FROM ang
    LEFT JOIN (SELECT *, dense_rank() OVER (PARTITION BY frame ORDER BY sheet, first_) AS strand FROM isl) z USING (frame, r)),
  st AS MATERIALIZED (SELECT h.frame, d - a AS d, a AS i FROM h JOIN ang p ON p.frame = h.frame AND p.r = a JOIN ang q ON q.frame = h.frame AND q.r = d AND q.seg = p.seg WHERE d - a IN (3, 4, 5)),
  two AS MATERIALIZED (SELECT st.* FROM st WHERE (frame, d, i - 1) IN (SELECT frame, d, i FROM st)),
  c1 AS (SELECT * REPLACE (CASE WHEN (frame, r) IN ({covered(4, '(SELECT * FROM two WHERE d = 4)')}) THEN 'H' ELSE code END AS code) FROM c0),
  c2 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN (frame, r) IN ({covered(3, '(' + free(3, "' '", 'c1') + ')')}) THEN 'G' ELSE code END AS code) FROM c1),
  c3 AS (SELECT * REPLACE (CASE WHEN (frame, r) IN ({covered(5, '(' + free(5, "' ', 'H'" if over_alpha else "' '", 'c2') + ')')}) THEN 'I' ELSE code END AS code) FROM c2),
  c4 AS (SELECT * REPLACE (CASE WHEN code <> ' ' OR r = 0 OR r = max(r) OVER (PARTITION BY frame) THEN code
    WHEN (frame, r) IN (SELECT frame, i + k FROM st, range(1, 5) t(k) WHERE k < d) THEN 'T' WHEN kappa > 70 THEN 'S' ELSE ' ' END AS code) FROM c3),
  pp AS (SELECT frame, r, count(*) FILTER (abs(phi + 75) <= 29 AND abs(psi - 145) <= 29) OVER w = 3 AND r > 0 AND count(*) OVER v >= 2 AS starts FROM ang
    WINDOW w AS (PARTITION BY frame ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), v AS (PARTITION BY frame ORDER BY r ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING)),
  c5 AS (SELECT * REPLACE (CASE WHEN code = ' ' AND (frame, r) IN (SELECT frame, r + k FROM pp, range(3) t(k) WHERE starts) THEN 'P' ELSE code END AS code) FROM c4)
  SELECT frame, residue AS residue_index, code, CAST(sheet AS INTEGER) AS sheet, CAST(strand AS INTEGER) AS strand, {_shown_angles} FROM ang JOIN (SELECT frame, r, code, sheet, strand FROM c5) z USING (frame, r)"""


_shaken = values(list(enumerate(sample.SHAKEN)), "k, scale")
_moved = ", ".join(f"f.{c} + scale * CAST(embedding[(7 * atom_index + {21 * i}) % 64 + 1] AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))
_atoms = values([tuple(a) for a in sample.FOLDED], "atom_index, name, element, residue_index, residue_name, chain_index, x, y, z")
_folded = f"a AS {_atoms}, c AS MATERIALIZED (SELECT vec_id AS frame, atom_index, {_moved} FROM embeddings JOIN {_shaken} w ON k = vec_id % 4 CROSS JOIN a f)"
_folded = _folded.replace("a AS ", "f AS ", 1).replace("CROSS JOIN a f", "CROSS JOIN f") + ", a AS (SELECT * EXCLUDE (x, y, z) FROM f)"
_strings = "SELECT frame, string_agg(code, '' ORDER BY residue_index) AS codes FROM ({}) GROUP BY frame"
ORACLE_SQL["dssp"] = _codes_sql(WITH.removeprefix("WITH "))
ORACLE_SQL["dssp_timeline"] = _strings.format(ORACLE_SQL["dssp"])
ORACLE_SQL["dssp_folded"] = _codes_sql(_folded)
ORACLE_SQL["dssp_folded_alpha_first"] = f"SELECT frame, residue_index, code, sheet, strand FROM ({_codes_sql(_folded, False)})"
ORACLE_SQL["dssp_folded_timeline"] = _strings.format(ORACLE_SQL["dssp_folded"])
ORACLE_SQL["dssp_folded_every_residue"] = f"""SELECT frame, residue_index, coalesce(code, ' ') AS code FROM (SELECT vec_id AS frame, residue_index FROM embeddings, (SELECT DISTINCT residue_index FROM {_atoms}))
  LEFT JOIN ({ORACLE_SQL['dssp_folded']}) USING (frame, residue_index)"""
ORACLE_SQL["dssp_folded_content"] = f"SELECT residue_index, code, count(*) AS n FROM ({ORACLE_SQL['dssp_folded']}) GROUP BY 1, 2"
