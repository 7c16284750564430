"""Periodic spatial joins on (sample, level, cell), neighbour and overlap operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.functions.ordered import number_rows, running
from packstat.functions.periodic import axes, grid_index, min_image, norm, wrap
from packstat.functions.shapes import by_shape, cols_of, dot, framed, present
from packstat.session import checkpoint, unfolded

CELL_LOAD = 1 << 14
#: Least particles of a crowd.
CROWD = 32
SLACK = 1 + 1e-9


def box(dim: int) -> list[str]:
    return [f"l{a}" for a in axes(dim)]


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str] = ("sample_id",), how: str = "inner") -> DataFrame:
    """Equi-join of per-key facts. Without a hint: the facts are broadcast when Spark finds
    them small, and a hot key on the large side is split by the adaptive skew join."""
    return df.join(lookup, list(keys), how)


def attach_box(df: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    missing = [b for b in box(dim) if b not in df.columns]
    return attach(df, samples.select("sample_id", *missing)) if missing else df


def _levels(sized: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Per sample: the box, the largest reach and the number of rows to be looked up."""
    facts = sized.groupBy("sample_id").agg(F.max("_reach").alias("_rmax"), F.count(F.lit(1)).alias("_rows"))
    # a joined table counts as large as the product of its sides, so the rows themselves would pass for the smaller side
    return checkpoint(attach(samples.select("sample_id", *box(dim)), facts))


def _n_cells(length: Column, level: Column) -> Column:
    """Cells along a side at a level: their side is at least twice the level's largest reach."""
    cells = F.try_divide(length * F.pow(F.lit(2.0), level), 2 * SLACK * F.col("_rmax"))
    return F.coalesce(F.greatest(F.lit(1.0), F.floor(F.least(cells, F.lit(2.0 ** 40)))), F.lit(1.0)).cast("long")


def _level_of(reach: Column) -> Column:
    """Level 0 holds the largest reach; each level below holds reaches half as large."""
    ratio = F.when(reach > 0, F.col("_rmax") / reach).otherwise(F.lit(2.0 ** 40))
    return F.least(F.floor(F.log2(ratio) + 1e-12), F.lit(40)).cast("int")


def _salts(dim: int, level: Column) -> Column:
    """Parts a cell is split into, from the rows the sample would put into one cell."""
    cells = None
    for b in box(dim):
        n = _n_cells(F.col(b), level)
        cells = n if cells is None else cells * n
    return F.greatest(F.lit(1), F.ceil(F.col("_rows") / (cells * CELL_LOAD))).cast("int")


def _cell_names(dim: int) -> list[str]:
    return [f"_cell_{a}" for a in axes(dim)]


def _in_own_cells(rows: DataFrame, dim: int, levels: Column, id_col: str, at: Sequence[str]) -> DataFrame:
    """One copy per level of a row, in the cell that holds it and one salt."""
    out = rows.withColumn("_level", F.explode(levels))
    for a, x, b in zip(axes(dim), at, box(dim)):
        n = _n_cells(F.col(b), F.col("_level"))
        out = out.withColumn(f"_cell_{a}", grid_index(wrap(F.col(x), F.col(b)), F.col(b), n))
    return out.withColumn("_salt", F.pmod(F.xxhash64(id_col), _salts(dim, F.col("_level"))).cast("int"))


def _in_near_cells(rows: DataFrame, dim: int, at: Sequence[str]) -> DataFrame:
    """A row in the (up to 3^dim) cells around it at its own level, in every salt.

    Boxes less than three cells wide repeat cells; each is kept once.
    """
    out = rows
    for a, x, b in zip(axes(dim), at, box(dim)):
        n = _n_cells(F.col(b), F.col("_level"))
        own = grid_index(wrap(F.col(x), F.col(b)), F.col(b), n)
        near = F.array_distinct(F.array(*[F.pmod(own + k, n).cast("long") for k in (-1, 0, 1)]))
        out = out.withColumn(f"_cell_{a}", F.explode(near))
    return out.withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(dim, F.col("_level")) - 1)))


def _prefixed(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def offsets(dim: int, a: str = "a_", b: str = "b_", at_a: str = "c", at_b: str = "c") -> list[Column]:
    """Minimum-image vector from the ``a`` side to the ``b`` side of a pair."""
    return [min_image(F.col(f"{b}{at_b}{x}") - F.col(f"{a}{at_a}{x}"), F.col(f"l{x}")) for x in axes(dim)]


def near_pairs(particles: DataFrame, samples: DataFrame, dim: int, reach: Column, keep: Sequence[str]) -> DataFrame:
    """Unordered pairs nearer than the sum of their reaches: columns ``a_*``, ``b_*``, ``dx..``, ``d``.

    A row with a large reach looks in the wide cells of its level, where every row with a
    smaller reach is listed too, so a few large particles do not widen the cells of all.
    """
    keep = list(dict.fromkeys(["particle_id", *[f"c{a}" for a in axes(dim)], *keep]))
    sized = particles.select("sample_id", *keep, reach.alias("_reach"))
    facts = _levels(sized, samples, dim)
    placed = attach(sized, facts).withColumn("_own", _level_of(F.col("_reach")))
    at = [f"c{a}" for a in axes(dim)]
    listed = _in_own_cells(placed, dim, F.sequence(F.lit(0), F.col("_own")), "particle_id", at)
    looking = _in_near_cells(placed.withColumn("_level", F.col("_own")), dim, at)
    key = ["sample_id", "_level", "_salt", *_cell_names(dim)]
    left = _prefixed(looking.drop("_rmax", "_rows", "_own"), "a_", [*key, *box(dim)])
    right = _prefixed(listed.drop("_rmax", "_rows", *box(dim)), "b_", key)
    # equal levels meet twice, once from either side
    once = (F.col("b__own") > F.col("_level")) | (F.col("a_particle_id") < F.col("b_particle_id"))
    near = left.join(unfolded(right), key).where(once).drop("_level", "_salt", "a__own", "b__own", *_cell_names(dim))
    near = near.select("*", *[x.alias(f"d{a}") for a, x in zip(axes(dim), offsets(dim))])
    near = near.withColumn("d", norm([F.col(f"d{a}") for a in axes(dim)]))
    near = near.where(F.col("d") < F.col("a__reach") + F.col("b__reach"))
    # the lower id comes first; only kept pairs are turned round
    flip = F.col("a_particle_id") > F.col("b_particle_id")
    turned = [F.when(flip, F.col("b_" + c)).otherwise(F.col("a_" + c)).alias("a_" + c) for c in keep]
    turned += [F.when(flip, F.col("a_" + c)).otherwise(F.col("b_" + c)).alias("b_" + c) for c in keep]
    return near.select("sample_id", *box(dim), *turned,
                       *[F.when(flip, -F.col(f"d{a}")).otherwise(F.col(f"d{a}")).alias(f"d{a}") for a in axes(dim)], "d")


def near_points(points: DataFrame, particles: DataFrame, samples: DataFrame, dim: int,
                reach: Column, keep: Sequence[str], point_cols: Sequence[str] = ("point_id",)) -> DataFrame:
    """Point-particle pairs whose distance may be within the particle's reach.

    Points are listed once per level in use; particles look around, in every salt of a cell.
    """
    at = [f"c{a}" for a in axes(dim)]
    keep = list(dict.fromkeys(["particle_id", *at, *keep]))
    sized = particles.select("sample_id", *keep, (reach / 2).alias("_reach"))
    sides = sized.groupBy("sample_id").agg(F.max("_reach").alias("_rmax"))
    load = points.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_rows"))
    facts = checkpoint(attach(attach(samples.select("sample_id", *box(dim)), sides), load))
    placed = attach(sized, facts).withColumn("_level", _level_of(F.col("_reach")))
    used = placed.groupBy("sample_id").agg(F.array_sort(F.collect_set("_level")).alias("_used"))
    listed = _in_own_cells(attach(points.select("sample_id", *point_cols, *axes(dim)), checkpoint(attach(facts, used))),
                           dim, F.col("_used"), point_cols[0], list(axes(dim)))
    looking = _in_near_cells(placed, dim, at)
    key = ["sample_id", "_level", "_salt", *_cell_names(dim)]
    return (listed.drop("_rmax", "_rows", "_used")
            .join(unfolded(looking.drop("_rmax", "_rows", "_reach", *box(dim))), key)
            .drop("_level", "_salt", *_cell_names(dim)))


# --- neighbours and overlaps ------------------------------------------------------------


def radius(particles: DataFrame, dim: int | None = None, prefix: str = "") -> Column:
    return by_shape(particles, lambda s, c: s.radius(c), prefix, dim)


def neighbor_candidates(particles: DataFrame, samples: DataFrame, dim: int, factor: float = 1.0) -> DataFrame:
    """Pairs whose circumscribed disks (balls), grown by ``factor``, overlap periodically."""
    pairs = near_pairs(particles, samples, dim, radius(particles) * factor, [])
    return pairs.select("sample_id", F.col("a_particle_id").alias("i"), F.col("b_particle_id").alias("j"), "d")


def surrounding_cells(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Cell of each particle on the grid of the largest radius, and the distinct cells around."""
    sized = particles.select("sample_id", "particle_id", *[f"c{a}" for a in axes(dim)], radius(particles).alias("_reach"))
    placed = attach(sized, _levels(sized, samples, dim)).withColumn("_level", F.lit(0))
    at = [f"c{a}" for a in axes(dim)]
    for a, x, b in zip(axes(dim), at, box(dim)):
        placed = placed.withColumn(f"i{a}", grid_index(wrap(F.col(x), F.col(b)), F.col(b), _n_cells(F.col(b), F.lit(0))))
    near = _in_near_cells(placed.withColumn("_rows", F.lit(1)), dim, at)
    return near.select("sample_id", "particle_id", *[f"i{a}" for a in axes(dim)],
                       *[F.col(f"_cell_{a}").alias(f"near_{a}") for a in axes(dim)])


def _unit(dim: int) -> list[Column]:
    """Direction from i to j; coincident centres take the first axis, so results repeat."""
    return [F.when(F.col("d") > 0, F.col(f"d{a}") / F.col("d")).otherwise(1.0 if a == "x" else 0.0)
            for a in axes(dim)]


def _ball(name: Column) -> Column:
    return name.isin("Disk", "Sphere", "CylindricalFiber")


def _sphere_cylinder(pairs: DataFrame) -> Column | None:
    """Three zones along the axis: beside the barrel, over a cap, over a rim."""
    if not {"a_r", "a_r_cyl"} <= set(pairs.columns):
        return None

    def test(ball: str, tube: str, sign: int) -> Column:
        c = cols_of(pairs, tube)
        axis = c.frame(3)[0]
        v = [sign * F.col(f"d{a}") for a in axes(3)]
        along = F.abs(dot(v, axis))
        away = F.sqrt(F.greatest(dot(v, v) - along * along, F.lit(0.0)))
        r, over = F.col(ball + "r"), along - c.length / 2
        rim = F.sqrt(over * over + F.pow(away - c.r_cyl, 2))
        return (F.when(over <= 0, away < r + c.r_cyl)
                .when(away <= c.r_cyl, over < r).otherwise(rim < r))

    return (F.when((F.col("a_shape") == "Sphere") & (F.col("b_shape") == "Cylinder"), test("a_", "b_", -1))
            .when((F.col("a_shape") == "Cylinder") & (F.col("b_shape") == "Sphere"), test("b_", "a_", 1)))


def widths_along(pairs: DataFrame, dim: int, u: list[Column]) -> Column:
    """h_A(u) + h_B(-u): how far apart the centres must be along ``u`` to separate the bodies."""
    a = by_shape(pairs, lambda s, c: s.width(c, u), "a_", dim)
    b = by_shape(pairs, lambda s, c: s.width(c, u), "b_", dim)
    return a + b


def overlaps(particles: DataFrame, samples: DataFrame, dim: int, method: str = "closed",
             inside: bool = True) -> DataFrame:
    """Overlapping pairs ``(i, j, length, ux, uy, uz)``.

    ``closed``: pairs of disks, spheres, fibres or squares by their closed forms, all others as ``exact``.
    ``approx``: any convex pair, separated along the line of centres.
    ``exact``: any convex pair, least separation over all directions (Arrow batches).
    ``inside=False`` leaves out a ball wholly inside another.
    """
    particles = framed(particles, dim)
    names = [c for c in particles.columns if c not in ("sample_id", "particle_id", *box(3))]
    pairs = near_pairs(particles, samples, dim, radius(particles, dim), names)
    u = _unit(dim)
    if method == "exact":
        from packstat.operators.convex import separate

        return separate(pairs, dim)
    if method == "approx":
        depth = widths_along(pairs, dim, u) - F.col("d")
        pairs = pairs.withColumn("length", depth).where("length > 0")
        return _as_overlaps(pairs, dim, u)
    depth, direction, handled = None, u, F.lit(False)
    both_balls = _ball(F.col("a_shape")) & _ball(F.col("b_shape"))
    if "a_r" in pairs.columns:
        ball = F.greatest(F.col("a_r") + F.col("b_r") - F.col("d"), F.lit(0.0))
        if not inside:
            ball = F.when(F.col("d") > F.abs(F.col("a_r") - F.col("b_r")), ball).otherwise(0.0)
        depth, handled = F.when(both_balls, ball), both_balls
    if "a_side" in pairs.columns:
        both = (F.col("a_shape") == "Square") & (F.col("b_shape") == "Square")
        half = (F.col("a_side") + F.col("b_side")) / 2
        over = [half - F.abs(F.col("dx")), half - F.abs(F.col("dy"))]
        square = F.greatest(F.least(*over), F.lit(0.0))
        depth = F.when(both, square) if depth is None else depth.when(both, square)
        handled = handled | both
        signs = [F.when(F.col(f"d{a}") < 0, -1.0).otherwise(1.0) for a in "xy"]
        first = over[0] <= over[1]
        direction = [F.when(both, F.when(first, signs[0]).otherwise(0.0)).otherwise(u[0]),
                     F.when(both, F.when(first, 0.0).otherwise(signs[1])).otherwise(u[1])]
    kinds = {s.name for s in present(particles, dim=dim)}
    closed = None if depth is None else _as_overlaps(pairs.withColumn("length", depth).where("length > 0"), dim, direction)
    if closed is not None and (kinds <= {"Disk", "Sphere", "CylindricalFiber"} or kinds == {"Square"}):
        return closed
    from packstat.operators.convex import separate

    other = separate(pairs.where(~handled), dim)
    return other if closed is None else closed.unionByName(other)


def _as_overlaps(pairs: DataFrame, dim: int, u: list[Column]) -> DataFrame:
    return pairs.select("sample_id", F.col("a_particle_id").alias("i"), F.col("b_particle_id").alias("j"),
                        "length", *[x.alias(f"u{a}") for a, x in zip(axes(dim), u)])


def sphere_cylinder_contacts(particles: DataFrame, samples: DataFrame) -> DataFrame:
    """Sphere-cylinder pairs that intersect."""
    particles = framed(particles, 3)
    names = [c for c in particles.columns if c not in ("sample_id", "particle_id", *box(3))]
    pairs = near_pairs(particles, samples, 3, radius(particles, 3), names)
    return (pairs.where(F.coalesce(_sphere_cylinder(pairs), F.lit(False)))
            .select("sample_id", F.col("a_particle_id").alias("i"), F.col("b_particle_id").alias("j")))


def overlap_sizes(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Shared area or volume of overlapping pairs: disks, squares and spheres in closed form, other 2D pairs by strips.

    Volumes of other 3D pairs are for ``overlap_volume_mc``; they are not listed here.
    """
    kinds = {s.name for s in present(particles, dim=dim)}
    strips = dim == 2 and not (kinds <= {"Disk", "CylindricalFiber"} or kinds == {"Square"})
    names = [c for c in particles.columns if c not in ("sample_id", "particle_id", *box(3))] if strips else [
        c for c in ("shape", "r", "side") if c in particles.columns]
    pairs = near_pairs(particles, samples, dim, radius(particles, dim), names)
    size = None
    if "r" in names:
        r, s, d = F.col("a_r"), F.col("b_r"), F.col("d")
        small = F.least(r, s)
        unit = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
        if dim == 2:
            lens = (r * r * F.acos(unit((d * d + r * r - s * s) / (2 * d * r)))
                    + s * s * F.acos(unit((d * d + s * s - r * r) / (2 * d * s)))
                    - 0.5 * F.sqrt(F.greatest((-d + r + s) * (d + r - s) * (d - r + s) * (d + r + s), F.lit(0.0))))
            whole = F.pi() * small * small
        else:
            lens = (F.pi() * F.pow(r + s - d, 2)
                    * (d * d + 2 * d * s - 3 * s * s + 2 * d * r + 6 * r * s - 3 * r * r) / (12 * d))
            whole = 4.0 / 3.0 * F.pi() * small * small * small
        both = _ball(F.col("a_shape")) & _ball(F.col("b_shape"))
        size = F.when(both, F.when(d <= F.abs(r - s), whole).when(d < r + s, lens).otherwise(0.0))
    if "side" in names:
        half = (F.col("a_side") + F.col("b_side")) / 2
        least = F.least(F.col("a_side"), F.col("b_side"))
        over = [F.greatest(F.least(half - F.abs(F.col(f"d{a}")), least), F.lit(0.0)) for a in "xy"]
        both = (F.col("a_shape") == "Square") & (F.col("b_shape") == "Square")
        area = over[0] * over[1]
        size = F.when(both, area) if size is None else size.when(both, area)
    ids = [F.col("sample_id"), F.col("a_particle_id").alias("i"), F.col("b_particle_id").alias("j")]
    size = F.lit(None).cast("double") if size is None else size
    closed = pairs.select(*ids, size.alias("size")).where("size > 0")
    if not strips:
        return closed
    from packstat.operators.convex import overlap_areas

    same = F.col("a_shape") == F.col("b_shape")
    balls = _ball(F.col("a_shape")) & _ball(F.col("b_shape"))
    other = overlap_areas(pairs.where(~(balls | same & (F.col("a_shape") == "Square"))))
    return closed.unionByName(other)


def both_ways(pairs: DataFrame, dim: int) -> DataFrame:
    """Each overlap seen from i and from j, the direction turned round for j."""
    u = [f"u{a}" for a in axes(dim)]
    sides = F.array(
        F.struct(F.col("i").alias("particle_id"), F.col("j").alias("other_id"), *[F.col(x) for x in u]),
        F.struct(F.col("j").alias("particle_id"), F.col("i").alias("other_id"), *[(-F.col(x)).alias(x) for x in u]))
    return pairs.select("sample_id", "length", F.explode(sides).alias("_s")).select("sample_id", "length", "_s.*")


def overlap_totals(pairs: DataFrame, dim: int) -> DataFrame:
    """Per particle: overlap, coordination number and net force (minus the sum of length * u)."""
    forces = [(-F.sum(F.col("length") * F.col(f"u{a}"))).alias(f"f{a}") for a in axes(dim)]
    return both_ways(pairs, dim).groupBy("sample_id", "particle_id").agg(
        F.sum("length").alias("overlap"), F.count(F.lit(1)).alias("coordination"), *forces)


def overlap_summary(particles: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """Per sample: total overlap, mean coordination number, relative energy (sum of |F|^2)."""
    per = overlap_totals(pairs, dim)
    energy = None
    for a in axes(dim):
        term = F.col(f"f{a}") * F.col(f"f{a}")
        energy = term if energy is None else energy + term
    sums = per.groupBy("sample_id").agg((F.sum("overlap") / 2).alias("total_overlap"),
                                        F.sum("coordination").alias("_z"), F.sum(energy).alias("energy"))
    counts = particles.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    return attach(counts, sums, how="left").select(
        "sample_id", "n", F.coalesce("total_overlap", F.lit(0.0)).alias("total_overlap"),
        (F.coalesce("_z", F.lit(0)) / F.col("n")).alias("mean_coordination"),
        F.coalesce("energy", F.lit(0.0)).alias("energy"))


# --- neighbour lists over time ----------------------------------------------------------


def verlet_neighbors(particles: DataFrame, samples: DataFrame, dim: int, factor: float = 1.1) -> DataFrame:
    """Neighbour list of the particles dilated to ``factor`` times their radius."""
    return neighbor_candidates(particles, samples, dim, factor).select("sample_id", "i", "j")


def left_neighborhood(previous: DataFrame, now: DataFrame, samples: DataFrame, dim: int,
                      factor: float = 1.1) -> DataFrame:
    """Particles that moved further than ``(factor - 1) * radius`` since the list was made."""
    at = [f"c{a}" for a in axes(dim)]
    old = previous.select("sample_id", "particle_id", *[F.col(x).alias("_" + x) for x in at])
    both = attach_box(now.join(unfolded(old), ["sample_id", "particle_id"]), samples, dim)
    moved = norm([min_image(F.col(x) - F.col("_" + x), F.col(b)) for x, b in zip(at, box(dim))])
    return (both.withColumn("moved", moved).where(F.col("moved") > (factor - 1) * radius(now))
            .select("sample_id", "particle_id", "moved"))


def refresh_neighbors(pairs: DataFrame, leavers: DataFrame, now: DataFrame, samples: DataFrame, dim: int,
                      factor: float = 1.1) -> DataFrame:
    """Pairs of leavers found anew, the pairs of the others kept."""
    gone = leavers.select("sample_id", "particle_id")
    kept = (pairs.join(unfolded(gone.withColumnRenamed("particle_id", "i")), ["sample_id", "i"], "left_anti")
            .join(unfolded(gone.withColumnRenamed("particle_id", "j")), ["sample_id", "j"], "left_anti"))
    at = [f"c{a}" for a in axes(dim)]
    probes = now.join(unfolded(gone), ["sample_id", "particle_id"], "left_semi").select(
        "sample_id", F.col("particle_id").alias("point_id"), *[F.col(x).alias(x[1:]) for x in at],
        (radius(now) * factor).alias("_r"))
    # a leaver is a point that must see every particle whose dilated disk reaches its own
    widest = attach(now.withColumn("_own", radius(now) * factor),
                    checkpoint(probes.groupBy("sample_id").agg(F.max("_r").alias("_rp"))))
    near = near_points(probes, widest, samples, dim, F.col("_own") + F.col("_rp"), ["_own"], ["point_id", "_r"])
    d = norm([min_image(F.col(f"c{a}") - F.col(a), F.col(f"l{a}")) for a in axes(dim)])
    found = (near.where(F.col("point_id") != F.col("particle_id")).where(d < F.col("_r") + F.col("_own"))
             .select("sample_id", F.least("point_id", "particle_id").alias("i"),
                     F.greatest("point_id", "particle_id").alias("j")).distinct())
    return kept.select("sample_id", "i", "j").unionByName(found)


# --- points in particles ----------------------------------------------------------------


def points_in_particles(points: DataFrame, particles: DataFrame, samples: DataFrame, dim: int,
                        point_cols: Sequence[str] = ("point_id",)) -> DataFrame:
    """(point, particle) rows for every particle a point lies in."""
    return _hits(points, particles, samples, dim, point_cols).select("sample_id", *point_cols, "particle_id")


def points_inside(points: DataFrame, particles: DataFrame, samples: DataFrame, dim: int,
                  point_cols: Sequence[str] = ("point_id",)) -> DataFrame:
    """The points that lie in the particle phase, once each, with their coordinates."""
    return _hits(points, particles, samples, dim, point_cols).select("sample_id", *point_cols, *axes(dim)).distinct()


def _hits(points: DataFrame, particles: DataFrame, samples: DataFrame, dim: int, point_cols: Sequence[str]) -> DataFrame:
    particles = framed(particles, dim)
    names = [c for c in particles.columns if c not in ("sample_id", "particle_id", *box(3))]
    near = near_points(points, particles, samples, dim, radius(particles, dim) * (1 + 1e-5), names, point_cols)
    d = [min_image(F.col(a) - F.col(f"c{a}"), F.col(f"l{a}")) for a in axes(dim)]
    inside = by_shape(near, lambda s, c: s.contains(c, d), dim=dim)
    return near.where(inside)


def point_flags(points: DataFrame, particles: DataFrame, samples: DataFrame, dim: int,
                keys: Sequence[str] = ("sample_id", "point_id")) -> DataFrame:
    """Every point with whether it lies in the particle phase."""
    hits = (points_in_particles(points, particles, samples, dim, [k for k in keys if k != "sample_id"])
            .select(*keys).distinct().withColumn("inside", F.lit(True)))
    return points.join(hits, list(keys), "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


# --- nearest neighbours -----------------------------------------------------------------


def z_order(rows: DataFrame, dim: int) -> DataFrame:
    """``_code``: place on a curve through the box on which near points are mostly near, the bits of the coordinates in turn."""
    bits = 60 // dim
    cells = {f"_q{a}": grid_index(wrap(F.col(f"c{a}"), F.col(f"l{a}")), F.col(f"l{a}"), F.lit(1 << bits)) for a in axes(dim)}
    code = F.lit(0).cast("long")
    for bit in range(bits):
        for place, cell in enumerate(cells):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(F.col(cell), bit).bitwiseAND(F.lit(1).cast("long")), bit * dim + place))
    return rows.withColumns(cells).withColumn("_code", code).drop(*cells)


def crowds(particles: DataFrame, samples: DataFrame, dim: int, least: int) -> DataFrame:
    """Particles with ``_crowd``: stretches of ``least`` to ``2 * least`` particles of a curve through the box (fewer in a smaller sample).

    They are as small as the particles are dense, so they serve as an index where some
    places hold a thousand times as many particles as others.
    """
    n = particles.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    facts = attach(samples.select("sample_id", *box(dim)), n)
    placed = z_order(attach(particles.select("sample_id", "particle_id", *[f"c{a}" for a in axes(dim)]), facts), dim)
    numbered = number_rows(placed, ["sample_id"], ["_code", "particle_id"], "_pos")
    last = F.greatest(F.floor(F.col("_n") / least) - 1, F.lit(0))
    return numbered.withColumn("_crowd", F.least(F.floor(F.col("_pos") / least), last).cast("long")).drop("_code", "_pos")


def local_reach(particles: DataFrame, samples: DataFrame, dim: int, k: int = 1) -> DataFrame:
    """Particles with ``_ring``: no less than the distance to the k-th nearest other, and about as much.

    The k-th nearest of the same crowd bounds the k-th nearest of all. Rings much below what is
    usual in the crowd are widened to half of that, so few grids serve all rings.
    """
    at = [f"c{a}" for a in axes(dim)]
    rows = checkpoint(crowds(particles, samples, dim, max(CROWD, 4 * (k + 1))))
    others = rows.select("sample_id", "_crowd", F.col("particle_id").alias("_other"), *[F.col(c).alias(f"_{c}") for c in at])
    d = norm([min_image(F.col(f"_c{a}") - F.col(f"c{a}"), F.col(f"l{a}")) for a in axes(dim)])
    pairs = rows.join(others, ["sample_id", "_crowd"]).where("particle_id <> _other").select("sample_id", "_crowd", "particle_id", d.alias("_d"))
    kth = F.min("_d") if k == 1 else F.get(F.sort_array(F.collect_list("_d")), F.lit(k - 1))
    bound = pairs.groupBy("sample_id", "_crowd", "particle_id").agg(kth.alias("_kth"))
    usual = bound.groupBy("sample_id", "_crowd").agg(F.exp(F.avg(F.log(F.greatest("_kth", F.lit(1e-300))))).alias("_usual"))
    far = norm([F.col(b) / 2 for b in box(dim)])
    wide = bound.join(usual, ["sample_id", "_crowd"]).select("sample_id", "particle_id", F.greatest("_kth", F.col("_usual") / 2).alias("_wide"), "_kth")
    ring = F.when(F.col("_kth").isNull(), far).otherwise(F.col("_wide")) * SLACK
    return rows.join(wide, ["sample_id", "particle_id"], "left").select("sample_id", "particle_id", *at, *box(dim), "_n", ring.alias("_ring"))


def nearest(particles: DataFrame, samples: DataFrame, dim: int, k: int = 1) -> DataFrame:
    """The k nearest others of each particle by minimum image: ``other_id``, ``d``, ``rank``.

    A particle looks as far as its k-th nearest in a crowd of neighbours, so it meets few more than k whatever the density
    around it, and one look is enough.
    """
    at = [f"c{a}" for a in axes(dim)]
    looking = checkpoint(local_reach(particles, samples, dim, k).where("_n > 1"))
    points = looking.select("sample_id", F.col("particle_id").alias("_other"), *[F.col(c).alias(c[1:]) for c in at])
    near = near_points(points, looking.drop(*box(dim), "_n"), samples, dim, F.col("_ring"), ["_ring"], ["_other"])
    d = norm([min_image(F.col(a) - F.col(f"c{a}"), F.col(f"l{a}")) for a in axes(dim)])
    close = (near.where("particle_id <> _other").select("sample_id", F.col("particle_id").alias("point_id"), F.col("_other").alias("particle_id"), d.alias("d"), "_ring")
             .where("d <= _ring"))
    return _k_least(close, k).select("sample_id", F.col("point_id").alias("particle_id"), F.col("particle_id").alias("other_id"), "d", "rank")


def _k_least(close: DataFrame, k: int) -> DataFrame:
    """The k least rows per point; k = 1 is a plain aggregate, combined before the shuffle."""
    if k == 1:
        best = F.min(F.struct("d", "particle_id")).alias("_b")
        return (close.groupBy("sample_id", "point_id").agg(best)
                .select("sample_id", "point_id", "_b.particle_id", "_b.d", F.lit(1).cast("long").alias("rank")))
    from pyspark.sql import Window

    order = Window.partitionBy("sample_id", "point_id").orderBy("d", "particle_id")
    return (close.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
            .select("sample_id", "point_id", "particle_id", "d", "rank"))


def nearest_neighbor(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Distance to the nearest other particle over the mean radius; infinite for a lone one."""
    best = nearest(particles, samples, dim).select("sample_id", "particle_id", "other_id", "d")
    mean = particles.groupBy("sample_id").agg(F.avg(radius(particles)).alias("_mean"))
    return (attach(particles.select("sample_id", "particle_id"), mean)
            .join(best, ["sample_id", "particle_id"], "left")
            .select("sample_id", "particle_id", "other_id",
                    F.coalesce(F.try_divide("d", "_mean"), F.lit(float("inf"))).alias("nn")))


# --- images, nesting, arrival -----------------------------------------------------------


def periodic_images(particles: DataFrame, samples: DataFrame, dim: int, reach: Column | None = None) -> DataFrame:
    """Copies shifted by whole boxes whose circumscribed ball reaches the box (all without ``reach``)."""
    out = attach_box(particles, samples, dim)
    for a in axes(dim):
        out = out.withColumn(f"image_{a}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    for a in axes(dim):
        out = out.withColumn(f"c{a}", F.col(f"c{a}") + F.col(f"image_{a}") * F.col(f"l{a}"))
    if reach is None:
        return out
    gaps = [F.greatest(-F.col(f"c{a}"), F.col(f"c{a}") - F.col(f"l{a}"), F.lit(0.0)) for a in axes(dim)]
    return out.where(norm(gaps) <= reach)


def inside_outer(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Children against their parent: wholly inside, and the share of the parent they fill.

    Balls in balls by their radii, all other pairs by the room left in every direction.
    """
    kinds = {s.name for s in present(particles, dim=dim)}
    whole = framed(particles, dim)
    names = [c for c in whole.columns if c not in ("sample_id", "particle_id", "parent_id", *box(3))]
    sized = whole.select("sample_id", "particle_id", "parent_id", *names, by_shape(whole, lambda s, c: s.volume(c), dim=dim).alias("_v"))
    parents = _prefixed(sized.drop("parent_id"), "a_", ["sample_id"]).withColumnRenamed("a_particle_id", "parent_id")
    children = _prefixed(sized.where("parent_id IS NOT NULL"), "b_", ["sample_id"]).withColumnRenamed("b_parent_id", "parent_id")
    both = attach_box(children.join(parents, ["sample_id", "parent_id"]), samples, dim)
    both = both.withColumns({f"d{a}": min_image(F.col(f"b_c{a}") - F.col(f"a_c{a}"), F.col(f"l{a}")) for a in axes(dim)})
    if kinds <= {"Disk", "Sphere", "CylindricalFiber"}:
        both = both.withColumn("_room", F.col("a_r") - F.col("b_r") - norm([F.col(f"d{a}") for a in axes(dim)]))
    else:
        from packstat.operators.convex import contained

        both = contained(both, dim)
    filled = both.groupBy("sample_id", "parent_id").agg(
        F.try_divide(F.sum("b__v"), F.first("a__v")).alias("fill"), F.count(F.lit(1)).alias("children"),
        F.sum((F.col("_room") >= -1e-12).cast("long")).alias("whole"))
    return filled


def nested_remainder(particles: DataFrame, dim: int) -> DataFrame:
    """Children in the order of their ids against what their parent has left: the fill rule of nesting.

    A child ``fits`` when it is smaller than half of what the children of its phase before it leave of the parent; a parent is
    filled anew by every phase. All children before it count, whether they fit or not. Volumes are shares of the parent's
    (``own``, ``left``); a parent without volume has null shares and takes none, children without a parent row give nothing.
    Parents of any number of children are summed up in blocks of ids.
    """
    sized = particles.select("sample_id", "particle_id", "parent_id", "phase",
                             by_shape(particles, lambda s, c: s.volume(c), dim=dim).alias("_v"))
    parents = sized.select("sample_id", F.col("particle_id").alias("parent_id"), F.col("_v").alias("_whole"))
    children = sized.where("parent_id IS NOT NULL").join(parents, ["sample_id", "parent_id"])
    shares = children.withColumn("own", F.try_divide("_v", "_whole"))
    filled = running(shares, ["sample_id", "parent_id", "phase"], "particle_id", {"_filled": F.col("own")}, sparse=True)
    left = 1 - (F.col("_filled") - F.col("own"))
    return filled.select("sample_id", "parent_id", "phase", "particle_id", "own", left.alias("left"),
                         F.coalesce(F.col("own") < left / 2, F.lit(False)).alias("fits"))
