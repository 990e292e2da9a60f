"""The registered queries of the trajectory operators, over the sample trajectory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.elements import MASSES, RADII, elements
from trajix.functions import tables
from trajix.model import Topology, to_long
from trajix.operators import derived, dssp, frame_sums, geometry, over_time, pbc, sasa, selection, spatial, superposition
from trajix.plans import sample
from trajix.sources import structures, trajectories
from trajix.sources.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAIRS, TRIPLETS, QUARTETS = "0-1,0-20,3-17,8-12", "0-1-2,4-10-20,7-8-9", "0-1-2-3,2-4-5-6,1-9-14-20"
WEIGHTS = [MASSES[a[2]] for a in sample.MAIN]
CUTOFF, CONTACT, HBOND = 3.0, 4.0, 4.5
VOLUME, R_MAX, BINS = 3375.0, 12.0, 24
PROTEIN = [a[0] for a in sample.MAIN if sample.RESIDUE_NAMES[a[3]] in selection.AMINO_ACIDS]
BACKBONE = [a[0] for a in sample.MAIN if a[0] in PROTEIN and a[1] in selection.BACKBONE]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without negative zeros."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        return f

    return add


def _select(expression):
    return lambda spark, sf_dir: to_long(sample.frames(spark, sf_dir)).join(selection.select(sample.topology(spark).table(), expression).select("atom_index", "name", "residue_name"), "atom_index")


for _name, _expression in {"backbone": "backbone", "protein": "protein", "water": "water", "name": "name CA", "index": "index 0,5-9,20"}.items():
    query(f"select_{_name}")(_select(_expression))
query("select_element")(lambda spark, sf_dir: _select(selection.by_element(8))(spark, sf_dir))


@query()
def trajectory_info(spark, sf_dir):
    return derived.trajectory_info(sample.frames(spark, sf_dir).withColumn("time", F.col("frame") * 0.5))


@query()
def distances(spark, sf_dir):
    return geometry.distances(sample.frames(spark, sf_dir), selection.parse_tuples(PAIRS, 2))


@query()
def angles(spark, sf_dir):
    return geometry.angles(sample.frames(spark, sf_dir), selection.parse_tuples(TRIPLETS, 3))


@query()
def dihedrals(spark, sf_dir):
    return geometry.dihedrals(sample.frames(spark, sf_dir), selection.parse_tuples(QUARTETS, 4))


def _torsions(kind):
    return lambda spark, sf_dir: geometry.torsions(sample.frames(spark, sf_dir), sample.topology(spark, side=kind in geometry.CHI).table(), kind)


for _kind in ("phi", "psi", "omega"):
    query(_kind)(_torsions(_kind))
for _level in geometry.CHI:
    query(f"chi{_level}")(_torsions(_level))


@query()
def center_of_mass(spark, sf_dir):
    return frame_sums.center(sample.frames(spark, sf_dir), WEIGHTS)


@query()
def center_of_geometry(spark, sf_dir):
    return frame_sums.center(sample.frames(spark, sf_dir), atoms=BACKBONE)


@query()
def rg(spark, sf_dir):
    return frame_sums.radius_of_gyration(sample.frames(spark, sf_dir), WEIGHTS)


@query()
def inertia(spark, sf_dir):
    return frame_sums.inertia(sample.frames(spark, sf_dir), WEIGHTS)


@query()
def principal_moments(spark, sf_dir):
    return frame_sums.principal_moments(frame_sums.inertia(sample.frames(spark, sf_dir), WEIGHTS))


def _rmsd(atoms):
    def run(spark, sf_dir):
        frames = sample.frames(spark, sf_dir)
        return superposition.rmsd(frames, superposition.reference_of(frames, 0), atoms)

    return run


query("rmsd")(_rmsd(None))
query("rmsd_backbone")(_rmsd(BACKBONE))


@query()
def superpose(spark, sf_dir):
    frames = sample.frames(spark, sf_dir)
    return superposition.superpose(frames, superposition.reference_of(frames, 0)).select("frame", F.col("rmsd").alias("value"))


@query()
def superpose_coordinates(spark, sf_dir):
    frames = sample.frames(spark, sf_dir)
    return to_long(superposition.superpose(frames, superposition.reference_of(frames, 0), BACKBONE))


def _native(**how):
    def run(spark, sf_dir):
        frames = sample.frames(spark, sf_dir)
        return spatial.native_contacts(frames, superposition.reference_of(frames, 0), BACKBONE, list(range(sample.N_ATOMS)), 4.5, **how)

    return run


query("native_q")(_native())
query("native_q_soft")(_native(beta=2.0, scale=1.5))


@query()
def rmsf(spark, sf_dir):
    return over_time.rmsf(sample.frames(spark, sf_dir))


@query()
def msd(spark, sf_dir):
    return over_time.msd(sample.frames(spark, sf_dir), BACKBONE)


@query()
def msd_all(spark, sf_dir):
    return over_time.msd(sample.frames(spark, sf_dir))


@query()
def msd_by_traj(spark, sf_dir):
    """Each label of the embeddings is a trajectory of its own."""
    return over_time.msd(sample.trajectories(spark, sf_dir))


@query()
def rmsf_by_traj(spark, sf_dir):
    return over_time.rmsf(sample.trajectories(spark, sf_dir))


@query()
def covariance(spark, sf_dir):
    return over_time.covariance(sample.frames(spark, sf_dir), PROTEIN)


@query()
def pca_variance(spark, sf_dir):
    return over_time.pca(sample.frames(spark, sf_dir), PROTEIN, 10)[0]


@query()
def pca_loadings(spark, sf_dir):
    return over_time.pca(sample.frames(spark, sf_dir), PROTEIN, 10)[1]


@query()
def pca_projections(spark, sf_dir):
    """The squares, as a component's sign is free."""
    frames = sample.frames(spark, sf_dir)
    found = over_time.projections(frames, over_time.pca(frames, PROTEIN, 3)[1], PROTEIN)
    return found.select("frame", "component", (F.col("value") * F.col("value")).alias("square"))


@query()
def rdf_by_frame(spark, sf_dir):
    return spatial.rdf(sample.boxed(spark, sf_dir), BACKBONE, PROTEIN, None, 0.0, R_MAX, BINS)


@query()
def wrap_by_frame(spark, sf_dir):
    long = to_long(sample.boxed(spark, sf_dir), keep=("box",)).withColumns({c: F.col(c) * 7 for c in "xyz"})
    return pbc.wrap(long).drop("box")


@query()
def min_image_by_frame(spark, sf_dir):
    far = sample.boxed(spark, sf_dir).withColumns({c: F.transform(c, lambda v: v * 7) for c in "xyz"})
    return pbc.image_distances(far, selection.parse_tuples(PAIRS, 2))


@query()
def make_whole_by_frame(spark, sf_dir):
    small = sample.boxed(spark, sf_dir).withColumn("box", F.transform("box", lambda v: v * 0.4))
    return to_long(pbc.make_whole(small, sample.BONDED, sample.N_ATOMS))


@query()
def rdf(spark, sf_dir):
    return spatial.rdf(sample.frames(spark, sf_dir), BACKBONE, PROTEIN, VOLUME, 0.0, R_MAX, BINS)


@query()
def rdf_average(spark, sf_dir):
    return spatial.rdf_average(sample.frames(spark, sf_dir), BACKBONE, PROTEIN, VOLUME, 0.0, R_MAX, BINS)


@query()
def box_volume(spark, sf_dir):
    return spatial.box_volume(sample.boxed(spark, sf_dir))


@query()
def hbonds(spark, sf_dir):
    return spatial.hydrogen_bonds(sample.frames(spark, sf_dir), sample.topology(spark), HBOND, 90.0)


@query()
def hbond_counts(spark, sf_dir):
    return spatial.hydrogen_bond_counts(sample.frames(spark, sf_dir), sample.topology(spark), HBOND, 90.0)


@query()
def dh_inference(spark, sf_dir):
    return spatial.infer_donor_hydrogens(sample.frames(spark, sf_dir), sample.topology(spark), CUTOFF)


def _contacts(scheme):
    return lambda spark, sf_dir: spatial.contacts(sample.frames(spark, sf_dir), sample.topology(spark).table(), scheme, CONTACT)


for _scheme in ("closest", "ca", "closest_heavy"):
    query(f"contacts_{_scheme}")(_contacts(_scheme))


@query()
def contact_frequency(spark, sf_dir):
    return derived.contact_frequency(sample.frames(spark, sf_dir), _contacts("closest")(spark, sf_dir))


@query()
def neighbor_pairs(spark, sf_dir):
    return spatial.neighbours(sample.frames(spark, sf_dir), CUTOFF)


@query()
def neighbor_pairs_by_cells(spark, sf_dir):
    """The same pairs of atoms that are rows already."""
    long = to_long(sample.frames(spark, sf_dir))
    found = spatial.near_pairs(long, long, CUTOFF, True, when=F.col("atom_index") < F.col("atom_index_b"))
    return found.select("frame", F.col("atom_index").alias("i"), F.col("atom_index_b").alias("j"), "d")


@query()
def neighbor_lists(spark, sf_dir):
    """The backbone's neighbours among the protein's atoms, in compressed rows that are opened again: a row per atom and place."""
    radius = {a[0]: RADII[a[2]] for a in sample.MAIN}
    found = spatial.neighbour_lists(sample.frames(spark, sf_dir), {i: radius[i] for i in BACKBONE}, {i: 1.1 * radius[i] for i in PROTEIN}, 0.2)
    each = found.select("frame", "offsets", "members", "distances", F.posexplode("atoms").alias("k", "i"))
    own = each.select("frame", "i", "members", "distances", F.explode(F.sequence(F.get("offsets", F.col("k")), F.get("offsets", F.col("k") + 1))).alias("m"), F.get("offsets", F.col("k") + 1).alias("end"), F.get("offsets", F.col("k")).alias("begin"))
    return own.where("m < end").select("frame", "i", (F.col("m") - F.col("begin")).alias("place"), F.get("members", F.col("m")).alias("j"), F.get("distances", F.col("m")).alias("d"))


@query()
def neighbor_pairs_by_radius(spark, sf_dir):
    return spatial.neighbours_by_radius(sample.frames(spark, sf_dir), [RADII[a[2]] for a in sample.MAIN], 0.2)


def _wrapped(box):
    return lambda spark, sf_dir: pbc.wrap(to_long(sample.frames(spark, sf_dir)).withColumns({c: F.col(c) * 7 for c in "xyz"}), box)


def _imaged(box):
    def run(spark, sf_dir):
        far = sample.frames(spark, sf_dir).withColumns({c: F.transform(c, lambda v: v * 7) for c in "xyz"})
        return pbc.image_distances(far, selection.parse_tuples(PAIRS, 2), box)

    return run


for _shape, _box in {"ortho": sample.BOX, "triclinic": sample.SKEWED}.items():
    query(f"wrap_{_shape}")(_wrapped(_box))
    query(f"min_image_{_shape}")(_imaged(_box))


@query()
def make_whole(spark, sf_dir):
    return to_long(pbc.make_whole(sample.frames(spark, sf_dir), sample.BONDED, sample.N_ATOMS, [6.0, 0.0, 0.0, 0.0, 6.0, 0.0, 0.0, 0.0, 6.0]))


@query()
def sasa_atoms(spark, sf_dir):
    return sasa.sasa(sample.frames(spark, sf_dir), [RADII[a[2]] for a in sample.MAIN])


@query()
def sasa_total(spark, sf_dir):
    return sasa.total_by_frame(sample.frames(spark, sf_dir), [RADII[a[2]] for a in sample.MAIN])


@query()
def sasa_residues(spark, sf_dir):
    return derived.residue_areas(sasa_atoms(spark, sf_dir), sample.topology(spark).table())


def _bonding(spark, sf_dir):
    return dssp.bonding(sample.frames(spark, sf_dir), dssp.complete_residues(sample.topology(spark).table()))


@query()
def dssp_energy(spark, sf_dir):
    return dssp.energies(_bonding(spark, sf_dir))


@query()
def dssp_best2(spark, sf_dir):
    return dssp.best_two(_bonding(spark, sf_dir))


@query()
def dssp_geometry(spark, sf_dir):
    """Angles in whole and broken stretches of the chain; kappa, alpha and tco included."""
    return dssp_codes(spark, sf_dir).select("frame", "residue_index", *dssp.ANGLES)


@query("dssp")
def dssp_codes(spark, sf_dir):
    return dssp.dssp(sample.frames(spark, sf_dir), sample.topology(spark).table())


@query()
def dssp_timeline(spark, sf_dir):
    """All frames: a stride is the caller's choice."""
    return dssp.dssp_strings(dssp_codes(spark, sf_dir))


def _folded_codes(spark, sf_dir, **how):
    return dssp.dssp(sample.folded_frames(spark, sf_dir), sample.folded_topology(spark).table(), **how)


@query()
def dssp_folded(spark, sf_dir):
    """Helices, sheets, turns, bends and polyproline stretches of the folded chains."""
    return _folded_codes(spark, sf_dir)


@query()
def dssp_folded_alpha_first(spark, sf_dir):
    """Pi helices leave alpha helices as they are."""
    return _folded_codes(spark, sf_dir, prefer_pi=False).select("frame", "residue_index", "code", "sheet", "strand")


@query()
def dssp_folded_timeline(spark, sf_dir):
    return dssp.dssp_strings(_folded_codes(spark, sf_dir))


@query()
def dssp_folded_every_residue(spark, sf_dir):
    """Residues that lack atoms are blank."""
    return dssp.every_residue(_folded_codes(spark, sf_dir), sample.folded_topology(spark).table())


@query()
def dssp_folded_content(spark, sf_dir):
    """How often each residue has each code, over all frames."""
    return _folded_codes(spark, sf_dir).groupBy("residue_index", "code").agg(F.count("*").alias("n"))


@query()
def ramachandran_hist(spark, sf_dir):
    return derived.ramachandran(_torsions("phi")(spark, sf_dir), _torsions("psi")(spark, sf_dir))


@query()
def metric_summary(spark, sf_dir):
    return derived.metric_summary(rg(spark, sf_dir))


@query()
def analyze_all(spark, sf_dir):
    """The columns of its SQL, which has no surface areas; the whole analysis is in the next two queries."""
    return derived.analyze_all(sample.frames(spark, sf_dir), sample.topology(spark), with_sasa=False)


@query()
def analyze_all_frames(spark, sf_dir):
    return derived.analyze_all(sample.frames(spark, sf_dir), sample.topology(spark))


@query()
def analyze_all_atoms(spark, sf_dir):
    return derived.rmsf_of_all(sample.frames(spark, sf_dir))


@query()
def lineitem_center(spark, sf_dir):
    """Weighted centers and spread of rows grouped by order: the same sums at another shape."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m, x = F.col("l_quantity"), F.col("l_extendedprice")
    return rows.groupBy("l_orderkey").agg((F.sum(m * x) / F.sum(m)).alias("center"), F.round(F.stddev_pop(x), 3).alias("spread"), F.count("*").alias("n"))


def _written(frames, path, kind, **how):
    by = [c for c in ("traj", "frame") if c in frames.columns]
    trajectories.write_trajectory(frames.repartitionByRange(*by).sortWithinPartitions(*by), path, kind, **how)


def _read_back(kind):
    """The whole trajectory written by tasks as files of a kind, and read from there."""

    def run(spark, sf_dir):
        path = shared_path(spark, f".{kind}")
        _written(sample.boxed(spark, sf_dir), path, kind)
        found = to_long(trajectories.read_trajectory(spark, path).drop("traj"), keep=("box",))
        sides = [F.get("box", F.lit(4 * k)).alias(f"box_{c}") for k, c in enumerate("abc")]
        return found.select("frame", "atom_index", *"xyz", *sides)

    return run


for _name, _kind in {"xtc": "xtc", "trr": "trr", "netcdf": "nc", "dcd": "dcd"}.items():
    query(f"read_{_name}")(_read_back(_kind))


@query()
def append_xtc(spark, sf_dir):
    """A trajectory for each label, the frames of even number written first and the odd ones behind them."""
    path = shared_path(spark, ".xtc")
    for rest in (0, 1):
        _written(sample.trajectories(spark, sf_dir).where(F.col("frame") % 2 == rest), path, "xtc")
    return to_long(trajectories.read_trajectory(spark, path))


@query()
def read_trr_sections(spark, sf_dir):
    """Positions, velocities and forces in eight bytes each."""
    path, made = shared_path(spark, ".trr"), {"v": -0.1, "f": 3.0}
    times = lambda m: lambda x: x * m
    more = {f"{s}{c}": F.transform(c, times(m)) for s, m in made.items() for c in "xyz"}
    _written(sample.frames(spark, sf_dir).withColumns(more), path, "trr", double=True)
    found = trajectories.read_trajectory(spark, path, sections=("velocities", "forces"))
    names = [*"xyz", *more]
    rows = found.select("frame", F.posexplode(F.arrays_zip(*names)).alias("atom_index", "r"))
    return rows.select("frame", "atom_index", *[F.col(f"r.{c}").alias(c) for c in names])


@query()
def trajectory_times(spark, sf_dir):
    """From the headers of files alone."""
    path = shared_path(spark, ".trr")
    _written(sample.trajectories(spark, sf_dir).withColumn("time", F.col("frame") * 0.5), path, "trr")
    return trajectories.trajectory_times(spark, path)


def _frame_of(column):
    """The frame's number in the path of its structure file."""
    return F.regexp_extract(column, r"([0-9-]+)\.[a-z]+$", 1).cast("bigint")


def _structures_back(kind):
    """Every frame written with the sample's topology as a structure file, and all files read; charges are the frame's x."""

    def run(spark, sf_dir):
        path = shared_path(spark, f"-{kind}")
        frames = sample.frames(spark, sf_dir).withColumn("charge", F.col("x"))
        structures.write_structures(frames, sample.topology(spark), path, kind)
        rows = structures.read_structures(spark, path, kind).named_atoms().withColumn("frame", _frame_of("structure"))
        return rows.select("frame", "atom_index", "name", "element", "residue_index", "residue_name", "resid", *(["charge"] if kind == "prmtop" else "xyz"))

    return run


for _name, _kind in {"pdb": "pdb", "gro": "gro", "mmcif": "cif", "prmtop": "prmtop"}.items():
    query(f"read_{_name}")(_structures_back(_kind))


def _sample_files(spark, sf_dir):
    """The sample's frames as PDB files, all read."""
    path = shared_path(spark, "-pdb")
    structures.write_structures(sample.frames(spark, sf_dir), sample.topology(spark), path, "pdb")
    return structures.read_structures(spark, path, "pdb")


@query()
def structure_bonds(spark, sf_dir):
    """A PRMTOP file for each frame keeps the bonds."""
    path = shared_path(spark, "-prmtop")
    structures.write_structures(sample.frames(spark, sf_dir), sample.topology(spark), path, "prmtop")
    return structures.read_structures(spark, path, "prmtop").bonds().select(_frame_of("structure").alias("frame"), "atom_i", "atom_j")


@query()
def element_masses(spark, sf_dir):
    """Masses and radii of the atoms of every structure file."""
    atoms = _sample_files(spark, sf_dir).atoms().select(_frame_of("structure").alias("frame"), "atom_index", "element")
    return atoms.join(elements(spark).select(F.col("z").alias("element"), "symbol", "mass", "vdw_radius", "is_biological"), "element")


@query()
def topology_summary(spark, sf_dir):
    """First and last residue and atom count of each chain of every structure file."""
    return derived.chain_summaries(_sample_files(spark, sf_dir)).withColumn("frame", _frame_of("structure")).drop("structure")


@query()
def topology_composition(spark, sf_dir):
    """Atoms by element of every structure file."""
    return derived.compositions(_sample_files(spark, sf_dir)).withColumn("frame", _frame_of("structure")).drop("structure")


@query()
def topology_problems(spark, sf_dir):
    """A bond more in each file's structure, by the frame's number: it may refer to nothing."""
    found = _sample_files(spark, sf_dir)
    end = (_frame_of("structure") % 40).cast("int")
    bonded = structures.Structures(found.table.withColumns({"atom_i": F.array_append("atom_i", end), "atom_j": F.array_append("atom_j", F.lit(3))}))
    return bonded.validate().withColumn("frame", _frame_of("structure")).drop("structure")


@query()
def topology_faults(spark, sf_dir):
    """Residues and chains moved on by the frame's number."""
    by = (_frame_of("structure") % 4).cast("int")
    on = lambda c: F.transform(c, lambda v: v + by)
    moved = structures.Structures(_sample_files(spark, sf_dir).table.withColumns({c: on(c) for c in ("residue_index", "chain_index")}))
    return moved.validate().withColumn("frame", _frame_of("structure")).drop("structure")


def _by_sql(call: str, columns: str):
    """A table function's rows over the sample's frames as one trajectory."""

    def run(spark, sf_dir):
        tables.register(spark)
        frames = sample.frames(spark, sf_dir).select(F.lit("a").alias("traj"), "frame", *"xyz")
        return spark.sql(f"SELECT {columns} FROM {call}", frames=frames)

    return run


query("sql_rmsd")(_by_sql("frame_rmsd(TABLE(SELECT * FROM {frames}) PARTITION BY traj ORDER BY frame)", "frame, value"))
query("sql_rg")(_by_sql(f"frame_gyration(TABLE(SELECT * FROM {{frames}}), array({', '.join(f'{w}D' for w in WEIGHTS)}))", "frame, value"))
query("sql_distances")(_by_sql(f"frame_distances(TABLE(SELECT * FROM {{frames}}), '{PAIRS}')", "frame, i, j, distance"))
query("sql_neighbors")(_by_sql(f"frame_neighbours(TABLE(SELECT * FROM {{frames}}), {CUTOFF}D)", "frame, i, j, distance AS d"))
