"""Quality rules over corpora of specifications and records: every problem is a row.

Problems carry ``sample_id, location, message``; no rule stops at the first one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packstat.functions.shapes import SHAPES
from packstat.operators.spatial import attach, box
from packstat.schema import FORMAT_SUFFIX, TYPE_CODES, TYPE_DIMS, VERSION

PHASE = ["sample_id", "phase"]

# fixed values: the sets of descriptors that describe a type
ACCEPTED = {
    "Matrix": [
        [],
    ],
    "Disk": [
        ["r", "n"],
        ["r", "vf"],
        ["n", "vf"],
        ["area", "vf"],
        ["area", "n"],
    ],
    "Square": [
        ["side", "n"],
        ["area", "n"],
        ["side", "vf"],
        ["area", "vf"],
        ["n", "vf"],
    ],
    "Ellipse": [
        ["major_axis", "minor_axis", "angle", "n"],
        ["major_axis", "minor_axis", "angle", "vf"],
        ["major_axis", "angle", "n", "vf"],
        ["minor_axis", "angle", "n", "vf"],
        ["ratio", "angle", "n", "vf"],
        ["major_axis", "ratio", "angle", "vf"],
        ["major_axis", "ratio", "angle", "n"],
    ],
    "Sphere": [
        ["r", "n"],
        ["r", "vf"],
        ["n", "vf"],
        ["volume", "vf"],
        ["volume", "n"],
    ],
    "Ellipsoid": [
        ["axis_1", "axis_2", "axis_3", "rot_axis_comp_x", "rot_axis_comp_y", "rot_axis_comp_z", "angle", "n"],
        ["axis_1", "axis_2", "axis_3", "rot_axis_comp_x", "rot_axis_comp_y", "rot_axis_comp_z", "angle", "vf"],
        ["axis_1", "ratio_12", "ratio_13", "rot_axis_comp_x", "rot_axis_comp_y", "rot_axis_comp_z", "angle", "vf"],
        ["vf", "n", "ratio_12", "ratio_13", "rot_axis_comp_x", "rot_axis_comp_y", "rot_axis_comp_z", "angle"],
        ["vf", "semi_axis_1", "ratio_321", "p_3", "phi_z"],
        ["vf", "semi_axis_1", "ratio_32", "ratio_21", "p_3", "phi_z"],
        ["vf", "axis_2", "ratio_32", "ratio_21", "p_3", "phi_z"],
        ["vf", "axis_1", "ratio_321", "p_3", "phi_z"],
        ["vf", "axis_1", "axis_2", "axis_3", "p_3", "phi_z"],
    ],
    "CylindricalFiber": [
        ["r", "n", "direction"],
        ["r", "vf", "direction"],
        ["n", "vf", "direction"],
        ["area", "vf", "direction"],
        ["area", "n", "direction"],
    ],
    "Cylinder": [
        ["r_cyl", "length", "n", "azimuth_angle", "polar_angle"],
        ["r_cyl", "length", "vf", "azimuth_angle", "polar_angle"],
        ["r_cyl", "ratio", "n", "azimuth_angle", "polar_angle"],
        ["ratio", "length", "vf", "azimuth_angle", "polar_angle"],
        ["n", "length", "vf", "azimuth_angle", "polar_angle"],
    ],
}
# fixed values: distributions and the tolerance on the sum of probabilities
DISTRIBUTIONS = ("fixed", "specified", "normal", "lognormal", "uniform", "vonmises", "discrete")
PROBABILITY_TOL = 1e-8
MAX_PARTICLES = 100_000


def problem(location: Column, message: Column) -> list[Column]:
    return [F.col("sample_id"), location.alias("location"), message.alias("message")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def type_table(spark: SparkSession) -> DataFrame:
    """The eight phase types with code and dimensions."""
    rows = [(name, code, TYPE_DIMS.get(name)) for name, code in TYPE_CODES.items()]
    return spark.createDataFrame(rows, "type string, type_code int, type_dim int")


def packing(particles: DataFrame, phases: DataFrame) -> DataFrame:
    """Particles without those of inner phases, which are not part of the arrangement."""
    outer = phases.where("NOT inner_phase").select(*PHASE)
    return particles.join(outer, PHASE, "left_semi")


def phase_problems(samples: DataFrame, phases: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Rules on the phases of a sample taken together, and with its box."""
    facts = phases.groupBy("sample_id").agg(
        F.sum((F.col("type") == "Matrix").cast("long")).alias("_matrices"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("type") == "Matrix", F.col("phase")))), ", ").alias("_names"),
        F.min_by("phase", F.when(F.col("type") == "CylindricalFiber", F.col("phase_order"))).alias("_fibre"))
    matrix = facts.where("_matrices <> 1").select(*problem(F.lit(""), F.when(
        F.col("_matrices") == 0, "no phase is the matrix").otherwise(
        F.concat(F.lit("more than one phase is the matrix: "), F.col("_names")))))
    dims = F.create_map(*[F.lit(x) for pair in TYPE_DIMS.items() for x in pair])
    solid = attach(phases.where("type <> 'Matrix'"), samples.select("sample_id", "dim")).withColumn(
        "_dim", F.element_at(dims, F.col("type")))
    where = F.concat_ws(".", "phase", F.lit("type"))
    wrong_dim = solid.where(F.col("_dim") != F.col("dim")).select(*problem(where, F.format_string(
        "%s has %d dimensions in a box of %d", "type", "_dim", "dim")))
    mixed = attach(solid, facts.select("sample_id", "_fibre")).where(
        "_fibre IS NOT NULL AND type <> 'CylindricalFiber'").select(
        *problem(where, F.concat(F.lit("fibres stand alone, and there are some: phase "), F.col("_fibre"))))
    targets = phases.select("sample_id", F.col("phase").alias("outer_phase"), F.col("type").alias("_outer_type"))
    nested = solid.where("outer_phase IS NOT NULL").join(targets, ["sample_id", "outer_phase"], "left")
    outer = nested.where((F.col("outer_phase") == F.col("phase")) | (F.coalesce("_outer_type", F.lit("Matrix")) == "Matrix")).select(
        *problem(F.concat_ws(".", "phase", F.lit("inside")), F.concat(
            F.lit("outer phase "), F.col("outer_phase"), F.lit(" is not another phase of particles"))))
    fibres = phases.where("type = 'CylindricalFiber'").select(*PHASE)
    runs = descriptors.where("name = 'direction'").join(fibres, PHASE, "left_semi").groupBy("sample_id").agg(
        F.count_distinct(F.when(F.col("distribution") == "fixed", F.col("params")["value"])).alias("_n"),
        F.bool_or(F.col("distribution") != "fixed").alias("_varies"))
    direction = runs.where("_n > 1 OR _varies").select(*problem(
        F.lit(""), F.lit("the fibres of a sample run in one fixed direction")))
    return _union([matrix, wrong_dim, mixed, outer, direction])


def accepted_sets(spark: SparkSession) -> DataFrame:
    rows = [(kind, " ".join(sorted(names))) for kind, sets in ACCEPTED.items() for names in sets]
    return spark.createDataFrame(rows, "type string, given string")


def parameters(spark: SparkSession) -> DataFrame:
    """Every (type, descriptor) there is, from the accepted sets."""
    rows = sorted({(kind, name) for kind, sets in ACCEPTED.items() for names in sets for name in names}
                  | {(kind, name) for kind in ACCEPTED if kind != "Matrix" for name in ("n", "vf")})
    return spark.createDataFrame(rows, "type string, name string")


def description_problems(phases: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Rules on the descriptors of one phase: the set given, fixed and whole numbers, specified counts."""
    spark = phases.sparkSession
    given = descriptors.groupBy(*PHASE).agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("given"))
    described = phases.select(*PHASE, "type").join(given, PHASE, "left").withColumn("given", F.coalesce("given", F.lit("")))
    bad_set = described.join(F.broadcast(accepted_sets(spark)), ["type", "given"], "left_anti").select(
        *problem(F.col("phase"), F.concat(F.lit("not a description of a "), F.col("type"), F.lit(": "),
                                          F.when(F.col("given") == "", "nothing given").otherwise(F.col("given")))))
    rows = descriptors.join(phases.select(*PHASE, "type"), PHASE)
    where = F.concat_ws(".", "phase", "name")
    unknown = rows.join(F.broadcast(parameters(spark)), ["type", "name"], "left_anti").select(
        *problem(where, F.concat(F.lit("a "), F.col("type"), F.lit(" has no such descriptor"))))
    not_fixed = rows.where("name IN ('n', 'vf') AND distribution <> 'fixed'").select(
        *problem(where, F.lit("takes one fixed number")))
    value = F.col("params")["value"]
    not_whole = rows.where("name IN ('n', 'direction') AND distribution = 'fixed'").where(value != F.floor(value)).select(
        *problem(where, F.lit("takes a whole number")))
    number = rows.where("name = 'n' AND distribution = 'fixed'").select(*PHASE, value.alias("_n"))
    short = rows.where("distribution = 'specified'").join(number, PHASE).where(F.size("values") != F.col("_n")).select(
        *problem(F.concat_ws(".", "phase", "name", F.lit("values")), F.format_string(
            "%d values for %d particles", F.size("values"), F.col("_n").cast("long"))))
    return _union([bad_set, unknown, not_fixed, not_whole, short])


def _bounds() -> dict[tuple[str, ...], Column]:
    """Bounds of a value in its box: sizes against the shortest side, ratios, counts, fractions."""
    v, short = F.col("_v"), F.col("_short")
    positive = v > 0
    return {
        ("n",): (v > 0) & (v == F.floor(v)), ("vf",): positive & (v < 1),
        ("r", "r_cyl", "side", "semi_axis_1"): positive & (v < short / 4),
        ("major_axis", "minor_axis", "length", "axis_1", "axis_2", "axis_3"): positive & (v < short / 2),
        ("ratio_12", "ratio_13"): v >= 1, ("ratio_21", "ratio_32", "ratio_321"): positive & (v <= 1),
        ("direction",): v.isin(0.0, 1.0, 2.0),
        ("volume",): positive & (v < 4.0 / 3.0 * F.pi() * F.pow(short / 4, 3)),
    }


def bound_problems(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Values outside their bounds: ``values`` holds sample_id, phase, type, name, value."""
    flat = [F.col(b) for b in box(3) if b in samples.columns]
    rows = attach(values.withColumnRenamed("value", "_v"), samples.select("sample_id", F.least(*flat).alias("_short")))
    name, v, short = F.col("name"), F.col("_v"), F.col("_short")
    inside = F.when(name == "ratio", F.when(F.col("type") == "Ellipse", v >= 1).otherwise(v > 0))
    inside = inside.when(name == "area", (v > 0) & (v < F.when(F.col("type") == "Square", F.pow(short / 4, 2))
                                                    .otherwise(F.pi() * F.pow(short / 4, 2))))
    for names, test in _bounds().items():
        inside = inside.when(name.isin(*names), test)
    return rows.where(~inside.otherwise(F.lit(True))).select(
        *problem(F.concat_ws(".", "phase", "name"), F.format_string("%.6g is out of bounds for a side of %.6g", v, short)))


def distribution_problems(descriptors: DataFrame) -> DataFrame:
    """Rules on the parameters of a distribution."""
    p = lambda n: F.col("params")[n]
    kind, where = F.col("distribution"), F.concat_ws(".", "phase", "name")
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    discrete, vm = kind == "discrete", kind == "vonmises"
    rules = [
        ((kind == "normal") & (p("sigma") < 0), "sigma is negative"),
        ((kind == "lognormal") & ((p("mean") <= 0) | (p("sigma") <= 0)), "mean and sigma are above zero"),
        ((kind == "uniform") & (p("low") > p("high")), "low is above high"),
        (vm & ((p("kappa") <= 0) | (p("scale") <= 0)), "kappa and scale are above zero"),
        (discrete & (F.size("values") != F.size("probabilities")), "one probability per value"),
        (discrete & (F.size("values") == F.size("probabilities")) & (F.abs(total - 1) > PROBABILITY_TOL),
         "probabilities do not add up to one"),
        (kind.isin("specified", "discrete") & (F.size("values") < 1), "no values"),
        (~kind.isin(*DISTRIBUTIONS), "unknown distribution"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules]),
                     lambda m: m.isNotNull())
    return descriptors.select("sample_id", where.alias("location"), F.explode(found).alias("message"))


def record_problems(documents: DataFrame, particles: DataFrame, phases: DataFrame) -> DataFrame:
    """Rules on the records of documents: format, version, shapes, centres, references."""
    name, version = F.col("format"), F.col("version")
    header = documents.where(F.coalesce(~name.endswith(FORMAT_SUFFIX), F.lit(True))).select(
        *problem(F.lit("format"), F.concat(F.lit("not a microstructure document: "), F.coalesce(name, F.lit("none")))))
    release = documents.where(F.coalesce(version != VERSION, F.lit(True))).select(
        *problem(F.lit("version"), F.concat(F.lit("unknown version "), F.coalesce(version.cast("string"), F.lit("none")))))
    where = F.concat(F.lit("particles."), F.col("particle_id").cast("string"))
    shape = particles.where(F.coalesce(~F.col("shape").isin(*SHAPES), F.lit(True))).select(
        *problem(where, F.concat(F.lit("unknown shape "), F.coalesce("shape", F.lit("none")))))
    coords = sum((F.col(c).isNotNull().cast("int") for c in ("cy", "cz")), F.col("cx").isNotNull().cast("int"))
    flat = F.create_map(*[F.lit(x) for s in SHAPES.values() for x in (s.name, s.dim)])
    arity = particles.withColumn("_c", coords).withColumn("_d", F.element_at(flat, F.col("shape"))).where("_c <> _d").select(
        *problem(where, F.format_string("%d coordinates for a %s", "_c", "shape")))
    lost = particles.join(phases.select(*PHASE), PHASE, "left_anti").select(
        *problem(where, F.concat(F.lit("no phase "), F.col("phase"))))
    ids = particles.select("sample_id", F.col("particle_id").alias("parent_id"))
    orphan = particles.where("parent_id IS NOT NULL").join(ids, ["sample_id", "parent_id"], "left_anti").select(
        *problem(where, F.concat(F.lit("no parent "), F.col("parent_id").cast("string"))))
    return _union([header, release, shape, arity, lost, orphan])


def spec_problems(samples: DataFrame, phases: DataFrame, descriptors: DataFrame, runs: DataFrame,
                  fractions: DataFrame | None = None) -> DataFrame:
    """Rules across sections: grid directions, specified values with sequential adsorption, fractions, counts.

    ``runs`` holds sample_id, method and n_grid (directions of the grid); ``fractions`` the
    realised vf and n per phase.
    """
    grid = attach(runs, samples.select("sample_id", "dim")).where("n_grid IS NOT NULL AND n_grid <> dim").select(
        *problem(F.lit("meshes"), F.format_string("a grid of %d directions in a box of %d", "n_grid", "dim")))
    adsorbed = runs.where("method = 'random_sequential_adsorption'").select("sample_id")
    drawn = phases.where("NOT inner_phase AND type <> 'Matrix'").select(*PHASE)
    specified = (descriptors.where("distribution = 'specified'").join(drawn, PHASE, "left_semi")
                 .join(adsorbed, "sample_id", "left_semi").select(
        *problem(F.concat_ws(".", "phase", "name"), F.lit("is given particle by particle, but every try draws anew"))))
    parts = [grid, specified]
    if fractions is not None:
        known = attach(fractions, phases.select(*PHASE, "inner_phase", "outer_phase"), PHASE)
        over = known.where("NOT inner_phase").groupBy("sample_id").agg(F.sum("vf").alias("_vf")).where("_vf > 1").select(
            *problem(F.lit(""), F.format_string("the volume fraction is over one: %.4f", "_vf")))
        outer = fractions.select("sample_id", F.col("phase").alias("outer_phase"), F.col("vf").alias("_outer"))
        inner = known.where("inner_phase").join(outer, ["sample_id", "outer_phase"]).where(F.col("vf") > F.col("_outer")).select(
            *problem(F.col("phase"), F.format_string("fills %.4f inside a phase of %.4f", "vf", "_outer")))
        many = fractions.where(F.col("n") > MAX_PARTICLES).select(
            *problem(F.col("phase"), F.concat(F.lit("too many particles: "), F.col("n").cast("string"))))
        parts += [over, inner, many]
    return _union(parts)


def mesh_size_warnings(particles: DataFrame, requests: DataFrame) -> DataFrame:
    """Element size per sample, and a warning where the request no longer controls the mesh.

    ``requests`` holds sample_id, mesh_size and elements_per_particle, either of them null.
    """
    from packstat.functions.shapes import by_shape

    least = particles.groupBy("sample_id").agg(F.min(by_shape(particles, lambda s, c: s.radius_insc(c))).alias("_r"))
    size, epp, r = F.col("mesh_size"), F.col("elements_per_particle"), F.col("_r")
    out = F.when(epp.isNotNull(), F.least(size, 2 * r / epp)).otherwise(size)
    warning = F.when(epp.isNotNull(), F.format_string("element size %.4g across a smallest particle of %.4g", out, 2 * r)).when(
        size > r, F.format_string("mesh size %.4g is above the smallest particle radius %.4g", size, r))
    return attach(requests, least).select("sample_id", out.alias("mesh_size"), warning.alias("warning"))


def corpus_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added, removed and changed between two tables with the same columns."""
    values = [c for c in before.columns if c not in keys]
    left = before.select(*keys, F.struct(*values).alias("_before"))
    right = after.select(*keys, F.struct(*values).alias("_after"))
    both = left.join(right, keys, "full_outer")
    change = (F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed")
              .when(~F.col("_before").eqNullSafe(F.col("_after")), "changed"))
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")
