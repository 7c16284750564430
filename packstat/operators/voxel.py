"""Voxel tables: stamping particles on grids, phase fractions, exact two-point statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.functions.periodic import axes, min_image
from packstat.functions.shapes import by_shape, framed
from packstat.operators.geometry import across_axes, with_extents
from packstat.operators.spatial import attach, box
from packstat.session import spread


def voxel_center(index: Column, spacing: Column) -> Column:
    return (index + 0.5) * spacing


def grid_cells_of(grids: DataFrame, dim: int, names: Sequence[str] | None = None, plus: int = 0) -> DataFrame:
    """Every index tuple of each grid (``nx, ny(, nz)``), unfolded an axis at a time.

    After the first axis the rows are spread out, so one huge grid is unfolded by many tasks; they are few and short
    by then, so a plain ``repartition`` would be merged into one task for all grids again.
    """
    names = list(names or [f"i{a}" for a in axes(dim)])
    out = grids.select("sample_id", *[f"n{a}" for a in axes(dim)])
    for k, (a, name) in enumerate(zip(axes(dim), names)):
        last = (F.col(f"n{a}") - 1 + plus).cast("long")
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
        if k == 0:
            out = spread(out, "sample_id", name)
    return out.select("sample_id", *names)


def stamp(particles: DataFrame, samples: DataFrame, grids: DataFrame, dim: int) -> DataFrame:
    """(voxel, particle) rows for every voxel whose centre lies in a particle.

    The index is wrapped back into the box, the coordinate is not, as a particle may reach out.
    """
    whole = framed(particles, dim)
    facts = attach(samples.select("sample_id", *box(dim)), grids.select("sample_id", *[f"n{a}" for a in axes(dim)]))
    out = attach(with_extents(whole, dim), facts)
    for k, a in enumerate(axes(dim)):
        spacing = F.col(f"l{a}") / F.col(f"n{a}")
        lo, hi = F.floor(F.col(f"lo_{a}") / spacing), F.floor(F.col(f"hi_{a}") / spacing)
        out = out.withColumn(f"_i{a}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
        if k == 0:
            out = spread(out, "sample_id", "particle_id", f"_i{a}")
    centre = {a: voxel_center(F.col(f"_i{a}"), F.col(f"l{a}") / F.col(f"n{a}")) for a in axes(dim)}
    d = [min_image(centre[a] - F.col(f"c{a}"), F.col(f"l{a}")) for a in axes(dim)]
    inside = by_shape(whole, lambda s, c: s.contains(c, d), dim=dim)
    return out.where(inside).select(
        "sample_id", "particle_id", "phase",
        *[F.pmod(F.col(f"_i{a}"), F.col(f"n{a}")).cast("long").alias(f"i{a}") for a in axes(dim)])


def voxelize(particles: DataFrame, samples: DataFrame, grids: DataFrame, dim: int) -> DataFrame:
    """Phase of every voxel: of the last particle in list order that holds its centre, else the matrix.

    The matrix enters as a particle before all others, so one aggregate settles every voxel.
    """
    at = [f"i{a}" for a in axes(dim)]
    marks = stamp(particles, samples, grids, dim).select("sample_id", *at, F.col("particle_id").alias("_by"), "phase")
    ground = attach(grid_cells_of(grids, dim), samples.select("sample_id", F.col("matrix_phase").alias("phase")))
    ground = ground.select("sample_id", *at, F.lit(-1).cast("long").alias("_by"), "phase")
    return ground.unionByName(marks).groupBy("sample_id", *at).agg(F.max_by("phase", "_by").alias("phase"))


def voxelize_fibers(fibers: DataFrame, samples: DataFrame, grids: DataFrame) -> DataFrame:
    """Voxels of fibres: the disk is stamped on the plane across, every layer along takes it."""
    plane = across_axes(fibers, samples)
    d = F.col("direction")

    def pick(prefix: str, which: str) -> Column:
        u = F.when(d == 0, F.col(f"{prefix}y")).otherwise(F.col(f"{prefix}x"))
        v = F.when(d == 2, F.col(f"{prefix}y")).otherwise(F.col(f"{prefix}z"))
        w = F.when(d == 0, F.col(f"{prefix}x")).when(d == 1, F.col(f"{prefix}y")).otherwise(F.col(f"{prefix}z"))
        return {"u": u, "v": v, "w": w}[which]

    sized = attach(plane, grids.select("sample_id", "nx", "ny", "nz"))
    sized = sized.select("sample_id", "particle_id", "phase", "direction", "cx", "cy", "r", "lu", "lv",
                         *[pick("n", k).cast("long").alias(f"n{k}") for k in "uvw"])
    su, sv = F.col("lu") / F.col("nu"), F.col("lv") / F.col("nv")
    out = spread(sized, "sample_id", "particle_id")
    for name, c, s in (("_u", "cx", su), ("_v", "cy", sv)):
        lo, hi = F.floor((F.col(c) - F.col("r")) / s), F.floor((F.col(c) + F.col("r")) / s)
        out = out.withColumn(name, F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    dx, dy = min_image(voxel_center(F.col("_u"), su) - F.col("cx"), F.col("lu")), \
        min_image(voxel_center(F.col("_v"), sv) - F.col("cy"), F.col("lv"))
    layer = (out.where(F.sqrt(dx * dx + dy * dy) <= F.col("r"))
             .withColumn("_u", F.pmod("_u", "nu")).withColumn("_v", F.pmod("_v", "nv"))
             .groupBy("sample_id", "direction", "_u", "_v")
             .agg(F.max(F.struct("particle_id", "phase", "nw")).alias("_b")))
    stacked = layer.withColumn("_w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b.nw") - 1)))
    place = {"ix": F.when(d == 0, F.col("_w")).otherwise(F.col("_u")),
             "iy": F.when(d == 0, F.col("_u")).when(d == 1, F.col("_w")).otherwise(F.col("_v")),
             "iz": F.when(d == 2, F.col("_w")).otherwise(F.col("_v"))}
    marks = stacked.select("sample_id", *[v.cast("long").alias(k) for k, v in place.items()],
                           F.col("_b.particle_id").alias("_by"), F.col("_b.phase").alias("phase"))
    ground = attach(grid_cells_of(grids, 3), samples.select("sample_id", F.col("matrix_phase").alias("phase")))
    ground = ground.select("sample_id", "ix", "iy", "iz", F.lit(-1).cast("long").alias("_by"), "phase")
    return ground.unionByName(marks).groupBy("sample_id", "ix", "iy", "iz").agg(F.max_by("phase", "_by").alias("phase"))


def voxel_phase_fractions(voxels: DataFrame) -> DataFrame:
    """Share of the voxels per (sample, phase), and per phase over the corpus (sample null)."""
    counts = voxels.groupBy("sample_id", "phase").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(counts.groupBy("phase").agg(F.sum("n").alias("n"))
                                .withColumn("sample_id", F.lit(None).cast(counts.schema["sample_id"].dataType)))
    totals = counts.groupBy("sample_id").agg(F.sum("n").alias("_t")).withColumnRenamed("sample_id", "_s")
    return (counts.join(totals, F.col("sample_id").eqNullSafe(F.col("_s")))
            .select("sample_id", "phase", "n", (F.col("n") / F.col("_t")).alias("fraction")))


def two_point_voxels(voxels: DataFrame, grids: DataFrame, dim: int, shifts: Sequence[Sequence[int]],
                     matrix_phase: str) -> DataFrame:
    """Exact two-point probability on the grid: both a voxel and its shifted, wrapped partner are particle."""
    at = [f"i{a}" for a in axes(dim)]
    solid = voxels.where(F.col("phase") != matrix_phase).select("sample_id", *at)
    sizes = grids.select("sample_id", *[f"n{a}" for a in axes(dim)])
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("shift"),
                               *[F.lit(int(s)).alias(f"s{a}") for a, s in zip(axes(dim), shift)])
                      for k, shift in enumerate(shifts)])
    moved = attach(solid, sizes).withColumn("_s", F.explode(steps)).select(
        "sample_id", "_s.shift", *[F.pmod(F.col(f"i{a}") + F.col(f"_s.s{a}"), F.col(f"n{a}")).cast("long").alias(f"i{a}")
                                   for a in axes(dim)])
    hits = moved.join(solid, ["sample_id", *at], "left_semi").groupBy("sample_id", "shift").agg(
        F.count(F.lit(1)).alias("hits"))
    total = None
    for a in axes(dim):
        total = F.col(f"n{a}") if total is None else total * F.col(f"n{a}")
    grid = sizes.select("sample_id", total.alias("_t")).withColumn("_s", F.explode(steps)).select(
        "sample_id", "_t", "_s.shift")
    return grid.join(hits, ["sample_id", "shift"], "left").select(
        "sample_id", "shift", (F.coalesce("hits", F.lit(0)) / F.col("_t")).alias("s2"))


def phase_volume_check(fractions: DataFrame, particles: DataFrame, samples: DataFrame, dim: int,
                       tolerance: float = 0.01) -> DataFrame:
    """Phase volume of the grid against the particles' less what lies inside them; off by over 1 % is flagged."""
    volume = by_shape(particles, lambda s, c: s.volume(c), dim=dim)
    sized = particles.select("sample_id", "particle_id", "phase", volume.alias("_v"), *(
        ["parent_id"] if "parent_id" in particles.columns else []))
    if "parent_id" in sized.columns:
        inner = (sized.where("parent_id IS NOT NULL").groupBy("sample_id", F.col("parent_id").alias("particle_id"))
                 .agg(F.sum("_v").alias("_in")))
        sized = sized.join(inner, ["sample_id", "particle_id"], "left").withColumn(
            "_v", F.col("_v") - F.coalesce("_in", F.lit(0.0)))
    whole = None
    for b in box(dim):
        whole = F.col(b) if whole is None else whole * F.col(b)
    expected = attach(sized.groupBy("sample_id", "phase").agg(F.sum("_v").alias("_v")),
                      samples.select("sample_id", whole.alias("_box"))).select(
        "sample_id", "phase", (F.col("_v") / F.col("_box")).alias("expected"))
    got = fractions.where("sample_id IS NOT NULL").select("sample_id", "phase", F.col("fraction").alias("kept"))
    return expected.join(got, ["sample_id", "phase"], "left").select(
        "sample_id", "phase", "expected", F.coalesce("kept", F.lit(0.0)).alias("kept"),
        (F.abs(F.coalesce("kept", F.lit(0.0)) - F.col("expected")) > tolerance * F.col("expected")).alias("warn"))
