"""Derived geometry columns of particle tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.functions.periodic import axes, wrap
from packstat.functions.shapes import by_shape, by_shape_vector, cols_of, framed, present
from packstat.operators.spatial import attach, attach_box, box, radius
from packstat.schema import PARTICLE_SIZES

LENGTHS = tuple(n for n in PARTICLE_SIZES if n not in
                ("angle", "rot_x", "rot_y", "rot_z", "azimuth_angle", "polar_angle")) + ("delta", "inflation")


def wrapped(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Centres brought into the box."""
    out = attach_box(particles, samples, dim)
    return out.select(*[wrap(F.col(c), F.col("l" + c[1])).alias(c) if c in [f"c{a}" for a in axes(dim)] else F.col(c)
                        for c in particles.columns])


def unit_scale(dim: int) -> Column:
    """Factor that brings the shortest side of the box to one."""
    return 1 / F.least(*[F.col(b) for b in box(dim)])


def scaled(particles: DataFrame, samples: DataFrame, dim: int, factor: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Particles and samples with every length multiplied; angles and axes untouched."""
    factor = unit_scale(dim) if factor is None else factor
    by = samples.select("sample_id", factor.alias("_f"))
    grown = [c for c in particles.columns if c in LENGTHS or c in [f"c{a}" for a in axes(dim)]]
    p = attach(particles, by).select(*[(F.col(c) * F.col("_f")).alias(c) if c in grown else F.col(c)
                                       for c in particles.columns])
    s = samples.withColumn("_f", factor).select(
        *[(F.col(c) * F.col("_f")).alias(c) if c in box(dim) else F.col(c) for c in samples.columns])
    return p, s


def resolve_sizes(spec: DataFrame) -> DataFrame:
    """Sizes from whichever descriptors a phase gives (null = not given).

    ``spec`` holds ``shape``, the box and any of n, vf, r, area, volume, side, major_axis,
    minor_axis, ratio, length, r_cyl. The order of the cases is the order of precedence.
    """
    have = set(spec.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    flat, solid = c("lx") * c("ly"), c("lx") * c("ly") * c("lz")
    over = F.try_divide  # a descriptor given as zero resolves to nothing, and fails its bound
    share2, share3 = over(c("vf") * flat, c("n")), over(c("vf") * solid, c("n"))
    r_disk = F.coalesce(c("r"), F.sqrt(c("area") / F.pi()), F.sqrt(share2 / F.pi()))
    r_sphere = F.coalesce(c("r"), F.cbrt(3 * c("volume") / (4 * F.pi())), F.cbrt(3 * share3 / (4 * F.pi())))
    side = F.coalesce(c("side"), F.sqrt(c("area")), F.sqrt(share2))
    # area of an ellipse with full axes M, m: pi * M * m / 4
    rest = 4 * share2 / F.pi()
    major = F.coalesce(c("major_axis"), over(rest, c("minor_axis")), F.sqrt(rest * c("ratio")))
    minor = F.coalesce(c("minor_axis"), over(c("major_axis"), c("ratio")), over(rest, c("major_axis")), F.sqrt(over(rest, c("ratio"))))
    # cylinder, where ratio = length / radius: a length with a fraction and a number comes first
    by_share = c("length").isNotNull() & c("vf").isNotNull() & c("n").isNotNull()
    r_cyl = (F.when(by_share, F.sqrt(over(share3, F.pi() * c("length"))))
             .otherwise(F.coalesce(over(c("length"), c("ratio")), c("r_cyl"))))
    length = F.coalesce(c("length"), c("r_cyl") * c("ratio"))
    # ellipsoid: three axes, or one with its ratios (12, 13; 321; 32 and 21), or the volume share
    by_ratio = c("ratio_12").isNotNull() & c("ratio_13").isNotNull()
    first = 2 * c("semi_axis_1")
    axis_1 = F.coalesce(c("axis_1"), first, over(c("axis_2"), c("ratio_21")),
                        F.when(by_ratio, F.cbrt(share3 * c("ratio_12") * c("ratio_13") * 6 / F.pi())))
    axis_2 = F.coalesce(c("axis_2"), over(axis_1, c("ratio_12")), axis_1 * c("ratio_321"), axis_1 * c("ratio_21"))
    axis_3 = F.coalesce(c("axis_3"), over(axis_1, c("ratio_13")), axis_1 * c("ratio_321"), axis_2 * c("ratio_32"))
    is_ = lambda s: F.col("shape") == s
    drop = [n for n in ("r", "side", "major_axis", "minor_axis", "r_cyl", "length", "axis_1", "axis_2", "axis_3") if n in have]
    return spec.select(
        *[n for n in spec.columns if n not in drop],
        F.when(is_("Disk"), r_disk).when(is_("Sphere"), r_sphere).alias("r"),
        F.when(is_("Square"), side).alias("side"),
        F.when(is_("Ellipse"), F.greatest(major, minor)).alias("major_axis"),
        F.when(is_("Ellipse"), F.least(major, minor)).alias("minor_axis"),
        F.when(is_("Cylinder"), r_cyl).alias("r_cyl"), F.when(is_("Cylinder"), length).alias("length"),
        *[F.when(is_("Ellipsoid"), F.abs(a)).alias(f"axis_{k + 1}") for k, a in enumerate((axis_1, axis_2, axis_3))])


def angles_to_axis(p_3: Column, phi_z: Column) -> tuple[Column, Column, Column, Column]:
    """Rotation axis (not normalised) and angle of a tilt ``p_3`` about y, then ``phi_z`` about z."""
    cp, sp, cz, sz = F.cos(p_3), F.sin(p_3), F.cos(phi_z), F.sin(phi_z)
    # product of the two rotations, entry by entry: R = Rz(phi_z) * Ry(p_3)
    trace = cz * cp + cz + cp
    return sz * sp, -cz * sp - sp, sz * cp + sz, F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def with_volume(particles: DataFrame, dim: int) -> DataFrame:
    """``volume`` (dilation included), ``real_volume`` (without), ``volume_circ``."""
    rad = radius(particles)
    circ = F.pi() * rad * rad if dim == 2 else 4.0 / 3.0 * F.pi() * rad * rad * rad
    return particles.select("*", by_shape(particles, lambda s, c: s.volume(c)).alias("volume"),
                            by_shape(particles, lambda s, c: s.real_volume(c)).alias("real_volume"),
                            circ.alias("volume_circ"))


def with_radii(particles: DataFrame) -> DataFrame:
    """Circumscribed ``radius``, inscribed ``radius_insc``, and the ``eccentricity`` of ellipses."""
    ecc = F.lit(None).cast("double")
    if "major_axis" in particles.columns:
        ecc = F.sqrt(1 - F.try_divide(F.col("minor_axis") * F.col("minor_axis"), F.col("major_axis") * F.col("major_axis")))
    return particles.select("*", radius(particles).alias("radius"),
                            by_shape(particles, lambda s, c: s.radius_insc(c)).alias("radius_insc"),
                            ecc.alias("eccentricity"))


def with_extents(particles: DataFrame, dim: int) -> DataFrame:
    """Lower and upper extreme along each axis."""
    out, names = [], particles.columns
    particles = framed(particles, dim)
    for k, a in enumerate(axes(dim)):
        unit = [F.lit(1.0 if j == k else 0.0) for j in range(dim)]
        reach = by_shape(particles, lambda s, c, unit=unit: s.width(c, unit), dim=dim)
        out += [(F.col(f"c{a}") - reach).alias(f"lo_{a}"), (F.col(f"c{a}") + reach).alias(f"hi_{a}")]
    return particles.select(*names, *out)


def support(particles: DataFrame, u: list[Column]) -> DataFrame:
    """Furthest point of each particle in a direction: ``sx, sy(, sz)``."""
    dim, names = len(u), particles.columns
    particles = framed(particles, dim)
    far = by_shape_vector(particles, lambda s, c: s.furthest(c, u), dim, dim=dim)
    return particles.select(*names, *[(F.col(f"c{a}") + x).alias(f"s{a}") for a, x in zip(axes(dim), far)])


def with_inflation(rows: DataFrame, big: Column, small: Column, delta: Column, name: str) -> DataFrame:
    """Amount added to both semi-axes a >= b so that the ellipse holds its offset by delta.

    Root of 2s t^3 + 4ab t^2 - 2s d^2 t - s^2 d^2 = 0 with s = a + b: the positive one for a
    dilation, the negative one nearest zero for a contraction (null when there is none).
    The steps are columns of their own, so that each is computed once.
    """
    s, d = F.col("_s"), F.col("_d")
    p2, p, q = F.col("_p2"), F.col("_p"), F.col("_q")
    # t^3 + p2 t^2 + p1 t + p0 with t = y - p2/3 becomes y^3 + p y + q
    out = rows.withColumn("_s", big + small).withColumn("_d", delta).withColumn("_p2", 2 * big * small / s)
    p1, p0 = -d * d, -s * d * d / 2
    out = out.withColumn("_p", p1 - p2 * p2 / 3).withColumn("_q", 2 * p2 * p2 * p2 / 27 - p2 * p1 / 3 + p0)
    out = out.withColumn("_disc", q * q / 4 + p * p * p / 27)
    out = out.withColumn("_size", 2 * F.sqrt(F.greatest(-p / 3, F.lit(0.0))))
    turn = F.acos(F.least(F.greatest(3 * q / (p * F.col("_size")), F.lit(-1.0)), F.lit(1.0))) / 3
    out = out.withColumn("_turn", turn)
    for k in range(3):
        out = out.withColumn(f"_t{k}", F.col("_size") * F.cos(F.col("_turn") - 2 * F.pi() * k / 3) - p2 / 3)
    root = F.sqrt(F.greatest(F.col("_disc"), F.lit(0.0)))
    out = out.withColumn("_one", F.cbrt(-q / 2 + root) + F.cbrt(-q / 2 - root) - p2 / 3)
    three = [F.col(f"_t{k}") for k in range(3)]
    below = F.greatest(*[F.when(t < 0, t) for t in three])
    single = F.col("_disc") > 0
    root_of = (F.when(d == 0, F.lit(0.0))
               .when(d > 0, F.when(single, F.col("_one")).otherwise(F.greatest(*three)))
               .otherwise(F.when(single, F.when(F.col("_one") < 0, F.col("_one"))).otherwise(below)))
    return out.withColumn(name, root_of).drop("_s", "_d", "_p2", "_p", "_q", "_disc", "_size", "_turn",
                                              "_t0", "_t1", "_t2", "_one")


def dilate(particles: DataFrame, distance: Column | float) -> DataFrame:
    """Every particle grown by a distance (shrunk by a negative one).

    Axes of ellipses and ellipsoids are first brought back to their undilated length, so a
    dilation undone gives the particle back. Particles too slender come out with null axes.
    """
    c = cols_of(particles)
    distance = distance if isinstance(distance, Column) else F.lit(float(distance))
    total = c.delta + distance
    known = {s.name: s for s in present(particles)}
    shape = F.col("shape")
    out = particles.withColumn("_total", total).withColumn("_by", distance).withColumn("_was", c.inflation)
    cases: dict[str, list[tuple[str, Column]]] = {}
    for s in known.values():
        for column, times in s.grown.items():
            cases.setdefault(column, []).append((s.name, F.col(column) + times * F.col("_by")))
    added = F.lit(0.0)
    for name in ("Ellipse", "Ellipsoid"):
        if name not in known:
            continue
        t = f"_add_{name}"
        for column in known[name].sizes:
            out = out.withColumn("_bare_" + column, F.col(column) / 2 - F.col("_was"))
        bare = [F.col("_bare_" + column) for column in known[name].sizes]
        out = with_inflation(out, F.greatest(*bare), F.least(*bare), F.col("_total"), t)
        added = F.when(shape == name, F.col(t)).otherwise(added)
        for column in known[name].sizes:
            cases.setdefault(column, []).append((name, 2 * (F.col("_bare_" + column) + F.col(t))))
    grown = {}
    for column, whens in cases.items():
        case = F
        for name, value in whens:
            case = case.when(shape == name, value)
        grown[column] = case
    keep = [x for x in particles.columns if x not in ("delta", "inflation")]
    return out.select(*[grown[x].alias(x) if x in grown else F.col(x) for x in keep],
                      F.col("_total").alias("delta"), added.alias("inflation"))


def contract(particles: DataFrame, distance: Column | float) -> DataFrame:
    return dilate(particles, -distance if isinstance(distance, Column) else F.lit(-float(distance)))


def contraction_problems(contracted: DataFrame) -> DataFrame:
    """Particles a contraction left without a size."""
    return contracted.where(radius(contracted).isNull()).select(
        "sample_id", "particle_id", F.lit("too slender to be contracted").alias("message"))


def with_erosion(particles: DataFrame) -> DataFrame:
    """Critical erosion thickness; cylinders have none (null)."""
    return particles.select("*", by_shape(
        particles, lambda s, c: s.erosion(c) if s.erosion else None).alias("erosion"))


def surface_points(particles: DataFrame, n: int, erosion: Column | None = None) -> DataFrame:
    """n points on each 2D particle (n x n on each 3D one), moved inwards by ``erosion``.

    Rows of a particle carry ``k`` (and ``theta_k`` in 3D); spheres repeat their poles.
    """
    names = {s.name for s in present(particles)}
    e = F.lit(0.0) if erosion is None else erosion
    c = cols_of(particles)
    shape = F.col("shape")
    if names & {"Sphere", "Ellipsoid"}:
        return _surface_points_3d(particles, n, e, c, names)
    p = particles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    k = F.col("k").cast("double")
    theta = 2 * F.pi() * k / n
    x = y = None

    def add(case: Column | None, name: str, value: Column) -> Column:
        return F.when(shape == name, value) if case is None else case.when(shape == name, value)

    for ball in ("Disk", "CylindricalFiber"):
        if ball in names:
            x, y = add(x, ball, (c.r - e) * F.cos(theta)), add(y, ball, (c.r - e) * F.sin(theta))
    if "Ellipse" in names:
        a, b = c.major_axis / 2, c.minor_axis / 2
        nx, ny = b * F.cos(theta), a * F.sin(theta)
        size = F.sqrt(nx * nx + ny * ny)
        lx, ly = a * F.cos(theta) - e * nx / size, b * F.sin(theta) - e * ny / size
        cos, sin = F.cos(c.angle), F.sin(c.angle)
        x, y = add(x, "Ellipse", cos * lx - sin * ly), add(y, "Ellipse", sin * lx + cos * ly)
    if "Square" in names:
        per = [n // 4 + (1 if i < n % 4 else 0) for i in range(4)]
        starts = [sum(per[:i]) for i in range(4)]
        half = c.side / 2 - e
        # fixed values: corners of the unit square, counter-clockwise from the bottom left
        corners = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
        sx = sy = None
        for i in range(4):
            if per[i] == 0:
                continue
            t = (k - starts[i]) / per[i]
            on = (F.col("k") >= starts[i]) & (F.col("k") < starts[i] + per[i])
            (x0, y0), (x1, y1) = corners[i], corners[(i + 1) % 4]
            vx, vy = half * (x0 + t * (x1 - x0)), half * (y0 + t * (y1 - y0))
            sx, sy = (F.when(on, vx), F.when(on, vy)) if sx is None else (sx.when(on, vx), sy.when(on, vy))
        x, y = add(x, "Square", sx), add(y, "Square", sy)
    extra = [b for b in box(2) if b in particles.columns]
    return p.select("sample_id", "particle_id", "k", (F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y"), *extra)


def _surface_points_3d(particles: DataFrame, n: int, e: Column, c, names: set[str]) -> DataFrame:
    p = (particles.withColumn("theta_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
         .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    shape, t, k = F.col("shape"), F.col("theta_k").cast("double"), F.col("k").cast("double")
    phi = 2 * F.pi() * k / n
    parts: list[Column | None] = [None, None, None]

    def add(name: str, vector: list[Column]) -> None:
        for i, v in enumerate(vector):
            parts[i] = F.when(shape == name, v) if parts[i] is None else parts[i].when(shape == name, v)

    if "Sphere" in names:
        theta, r = F.pi() * t / max(n - 1, 1), c.r - e
        add("Sphere", [r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)])
    if "Ellipsoid" in names:
        first = F.pi() / (n + 1)
        theta = first + (F.pi() - first) * t / n
        semi = [c.axis_1 / 2, c.axis_2 / 2, c.axis_3 / 2]
        on = [semi[0] * F.sin(theta) * F.cos(phi), semi[1] * F.sin(theta) * F.sin(phi), semi[2] * F.cos(theta)]
        normal = [x / (a * a) for x, a in zip(on, semi)]
        size = F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2])
        local = [x - e * g / size for x, g in zip(on, normal)]
        frame = {s.name: s for s in present(particles)}["Ellipsoid"].rotation(c)
        add("Ellipsoid", [sum(frame[i][j] * local[i] for i in range(3)) for j in range(3)])
    extra = [b for b in box(3) if b in particles.columns]
    return p.select("sample_id", "particle_id", "theta_k", "k",
                    *[(F.col(f"c{a}") + v).alias(a) for a, v in zip(axes(3), parts)], *extra).where("x IS NOT NULL")


def with_mass(particles: DataFrame, option: str = "radius") -> DataFrame:
    if option not in ("volume", "radius", "unit"):
        raise ValueError("mass is taken from volume, radius or unit")
    mass = {"volume": lambda: by_shape(particles, lambda s, c: s.volume(c)),
            "radius": lambda: radius(particles), "unit": lambda: F.lit(1.0)}[option]()
    return particles.select("*", mass.alias("mass"))


def across_axes(fibers: DataFrame, samples: DataFrame) -> DataFrame:
    """The plane a fibre lives in: its box sides ``lu, lv`` and its length along the axis."""
    out = attach_box(fibers, samples, 3)
    d = F.col("direction")
    return out.select(*fibers.columns, F.when(d == 0, F.col("ly")).otherwise(F.col("lx")).alias("lu"),
                      F.when(d == 2, F.col("ly")).otherwise(F.col("lz")).alias("lv"),
                      F.when(d == 0, F.col("lx")).when(d == 1, F.col("ly")).otherwise(F.col("lz")).alias("fiber_length"))


def as_disks(fibers: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fibres as disks of the across plane: 2D particles, and 2D samples of that plane."""
    plane = across_axes(fibers, samples)
    flat = plane.select(F.concat_ws("/", F.col("sample_id").cast("string"), "direction").alias("sample_id"),
                        "particle_id", "phase", F.lit("Disk").alias("shape"), "cx", "cy", "r", "lu", "lv")
    boxes = flat.groupBy("sample_id").agg(F.first("lu").alias("lx"), F.first("lv").alias("ly"))
    return flat.drop("lu", "lv"), boxes


def run_records_to_units(run_steps: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Overlaps of a run made in a unit box, in the units of its sample."""
    scale = unit_scale(dim)
    return (attach(run_steps, samples.select("sample_id", scale.alias("_f")))
            .withColumn("total_overlap", F.col("total_overlap") / F.col("_f")).drop("_f"))


def paths_to_units(paths: DataFrame, samples: DataFrame, dim: int, offset: list[Column] | None = None) -> DataFrame:
    """Positions of a run made in a unit box: times the shortest side, less the offset, wrapped."""
    out = attach_box(paths, samples, dim)
    short = F.least(*[F.col(b) for b in box(dim)])
    moved = [F.col(a) * short - (offset[k] if offset else F.lit(0.0)) for k, a in enumerate(axes(dim))]
    new = {a: wrap(x, F.col(f"l{a}")) for a, x in zip(axes(dim), moved)}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in paths.columns])


def crossing(dim: int) -> Column:
    """Whether the extremes of a particle leave the box."""
    out = F.lit(False)
    for a in axes(dim):
        out = out | (F.col(f"lo_{a}") < 0) | (F.col(f"hi_{a}") > F.col(f"l{a}"))
    return out


def interior_particles(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Particles with every extreme inside the box."""
    flat = with_extents(attach_box(particles, samples, dim), dim)
    return flat.where(~crossing(dim)).select(*particles.columns)


def crossing_particles(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    flat = with_extents(attach_box(particles, samples, dim), dim)
    return flat.where(crossing(dim)).select(*particles.columns)


def shrunk_box(particles: DataFrame, dim: int) -> DataFrame:
    """Extremes of the particles of a sample: the origin and sides of the box around them."""
    flat = with_extents(particles, dim)
    return flat.groupBy("sample_id").agg(
        *[F.min(f"lo_{a}").alias(f"o{a}") for a in axes(dim)],
        *[(F.max(f"hi_{a}") - F.min(f"lo_{a}")).alias(f"l{a}") for a in axes(dim)])


def on_boundary(points: DataFrame, dim: int, tol: float = 1e-8) -> DataFrame:
    """Point-particle rows (offsets ``dx..`` from the centre) whose point lies on the boundary."""
    d = [F.col(f"d{a}") for a in axes(dim)]
    return points.where(by_shape(points, lambda s, c: s.boundary(c, d, tol) if s.boundary else None, dim=dim))
