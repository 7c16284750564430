"""Spatial statistics: fractions, Ripley's K, two-point correlation, histograms, chi-squared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstat.functions.hashing import uniform
from packstat.functions.ordered import number_rows, running
from packstat.functions.periodic import axes, wrap
from packstat.functions.shapes import by_shape
from packstat.operators.geometry import interior_particles, shrunk_box, with_volume
from packstat.operators.spatial import attach, attach_box, box, near_pairs, points_inside, radius
from packstat.session import checkpoint


def volume_fractions(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Share of the box per phase and per sample (phase null), counts, real and circumscribed."""
    whole = None
    for b in box(dim):
        whole = F.col(b) if whole is None else whole * F.col(b)
    sums = (with_volume(particles, dim).rollup("sample_id", "phase")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("_v"), F.sum("real_volume").alias("_rv"),
                 F.sum("volume_circ").alias("_cv"), F.grouping_id().alias("_g")).where("_g < 3"))
    return attach(sums, samples.select("sample_id", whole.alias("_box"))).select(
        "sample_id", "phase", "n", (F.col("_v") / F.col("_box")).alias("vf"),
        (F.col("_rv") / F.col("_box")).alias("real_vf"), (F.col("_cv") / F.col("_box")).alias("circ_vf"))


def microstructure_info(particles: DataFrame, samples: DataFrame, descriptors: DataFrame, dim: int) -> DataFrame:
    """Achieved against specified fraction and number per phase."""
    got = volume_fractions(particles, samples, dim).where("phase IS NOT NULL")
    asked = descriptors.where("name IN ('n', 'vf') AND distribution = 'fixed'").groupBy("sample_id", "phase").agg(
        F.max(F.when(F.col("name") == "n", F.col("params")["value"])).alias("n_specified"),
        F.max(F.when(F.col("name") == "vf", F.col("params")["value"])).alias("vf_specified"))
    return got.join(asked, ["sample_id", "phase"], "left").select(
        "sample_id", "phase", "n", "n_specified", "vf", "real_vf", "vf_specified")


def radius_summary(particles: DataFrame) -> DataFrame:
    """Per sample: global erosion thickness, largest, mean, harmonic mean and least inscribed radius."""
    rad = radius(particles)
    return particles.groupBy("sample_id").agg(
        F.min(by_shape(particles, lambda s, c: s.erosion(c) if s.erosion else None)).alias("erosion"),
        F.max(rad).alias("max_radius"), F.avg(rad).alias("mean_radius"),
        (F.count(F.lit(1)) / F.sum(1 / rad)).alias("harmonic_radius"),
        F.min(by_shape(particles, lambda s, c: s.radius_insc(c))).alias("min_radius_insc"))


def descriptor_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                   F.stddev_pop(value).alias("sigma"))


def extreme_particles(particles: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k largest (smallest) particles of each sample by radius, ranked.

    A first cut per (sample, salt) keeps the rows that can still be among the k.
    """
    rad = radius(particles)
    order = [F.col("radius").desc() if largest else F.col("radius").asc(), F.col("particle_id").asc()]
    rows = particles.select("sample_id", "particle_id", rad.alias("radius"),
                            F.pmod(F.xxhash64("particle_id"), F.lit(64)).alias("_salt"))
    part = Window.partitionBy("sample_id", "_salt").orderBy(*order)
    whole = Window.partitionBy("sample_id").orderBy(*order)
    return (rows.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= k)
            .withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= k)
            .select("sample_id", "rank", "particle_id", "radius"))


# --- Ripley's K -------------------------------------------------------------------------


def corner_area(reach: Column, width: Column, height: Column) -> Column:
    """Area of a disk at the origin inside the corner [0, width] x [0, height].

    A corner the disk covers is filled whole. Otherwise the two sides cut disjoint half segments
    off the quarter disk.
    """
    def half_segment(side: Column) -> Column:
        chord = F.sqrt(F.greatest(reach * reach - side * side, F.lit(0.0)))
        return F.when(side < reach, (reach * reach * F.acos(side / reach) - side * chord) / 2).otherwise(0.0)

    quarter = F.pi() * reach * reach / 4
    return (F.when(width * width + height * height <= reach * reach, width * height)
            .otherwise(quarter - half_segment(width) - half_segment(height)))


def disk_share(x: Column, y: Column, radius_: Column, lx: Column, ly: Column) -> Column:
    """Share of the disk around (x, y) that lies in the box; most disks lie in it whole."""
    whole = radius_ <= F.least(x, lx - x, y, ly - y)
    corners = F.array(*[F.struct(w.alias("w"), h.alias("h")) for w in (x, lx - x) for h in (y, ly - y)])
    inside = F.aggregate(corners, F.lit(0.0), lambda total, c: total + corner_area(radius_, c["w"], c["h"]))
    return F.when(whole | (radius_ <= 0), F.lit(1.0)).otherwise(inside / (F.pi() * radius_ * radius_))


def ripley_k(particles: DataFrame, samples: DataFrame, max_radius: int = 10, n_points: int = 20) -> DataFrame:
    """Ripley's K of the interior particles at ``max_radius * n_points`` radii: ``t``, ``r``, ``k``.

    Pairs are found to the largest radius only, put into the first radius index above their
    distance, summed per index, and summed up along the indices.
    """
    inner = interior_particles(particles, samples, 2)
    small = shrunk_box(inner, 2).withColumnRenamed("lx", "_lx").withColumnRenamed("ly", "_ly")
    facts = inner.groupBy("sample_id").agg(F.avg(radius(inner)).alias("_rad"), F.count(F.lit(1)).alias("_n"))
    facts = attach(small, facts)
    moved = attach(inner.select("sample_id", "particle_id", "cx", "cy"), facts).select(
        "sample_id", "particle_id", (F.col("cx") - F.col("ox")).alias("cx"), (F.col("cy") - F.col("oy")).alias("cy"),
        "_rad")
    # separations do not wrap here: a box wider by the reach keeps the far side out of reach
    steps = max_radius * n_points
    reach = F.col("_rad") * max_radius
    wide = facts.select("sample_id", (F.col("_lx") + reach + F.col("_rad")).alias("lx"),
                        (F.col("_ly") + reach + F.col("_rad")).alias("ly"))
    pairs = near_pairs(moved, wide, 2, reach / 2, ["_rad"])
    both = F.array(F.struct(F.col("a_cx").alias("x"), F.col("a_cy").alias("y")),
                   F.struct(F.col("b_cx").alias("x"), F.col("b_cy").alias("y")))
    seen = attach(pairs.select("sample_id", "d", F.col("a__rad").alias("_rad"), F.explode(both).alias("_c")),
                  facts.select("sample_id", "_lx", "_ly", "_n"))
    share = disk_share(F.col("_c.x"), F.col("_c.y"), F.col("d"), F.col("_lx"), F.col("_ly"))
    seen = seen.withColumn("_share", share)
    weight = 1 / F.when(F.col("_share") > 0, F.col("_share")).otherwise(1.0) / F.col("_n")
    # least index t with d < rad * t / n_points, corrected for rounding of the division
    seen = seen.withColumn("_guess", F.floor(F.col("d") / F.col("_rad") * n_points).cast("long"))
    guess = F.col("_guess")
    at = lambda t: F.col("_rad") * (t * (1.0 / n_points))
    index = (F.when(F.col("d") < at(guess), guess).when(F.col("d") < at(guess + 1), guess + 1).otherwise(guess + 2))
    binned = (seen.select("sample_id", index.alias("t"), weight.alias("_w")).where(F.col("t") < steps)
              .groupBy("sample_id", "t").agg(F.sum("_w").alias("_w")))
    grid = facts.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    total = F.sum(F.coalesce("_w", F.lit(0.0))).over(
        Window.partitionBy("sample_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return (grid.join(binned, ["sample_id", "t"], "left")
            .select("sample_id", "t", at(F.col("t")).alias("r"),
                    (total * (F.col("_lx") * F.col("_ly")) / F.col("_n")).alias("k")))


# --- two-point correlation --------------------------------------------------------------


def random_points(samples: DataFrame, n: int, dim: int, seed: int = 0) -> DataFrame:
    """n points per sample, uniform in its box, from hashes of (seed, sample, point)."""
    rows = samples.withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.select("sample_id", "point_id", *[
        (uniform(seed, "sample_id", "point_id", F.lit(a)) * F.col(f"l{a}")).alias(a) for a in axes(dim)])


def random_directions_2d(rows: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """A unit vector ``ux, uy`` per row from a hash of its keys."""
    angle = 2 * F.pi() * uniform(seed, F.lit("direction"), *keys)
    return rows.withColumn("_a", angle).withColumn("ux", F.cos("_a")).withColumn("uy", F.sin("_a")).drop("_a")


def two_point(particles: DataFrame, samples: DataFrame, points: DataFrame, dim: int, separations: Sequence[float],
              direction: Sequence[float] | None = None, angle: Column | None = None, seed: int = 0) -> DataFrame:
    """Share of points whose own and shifted position both lie in a particle, per separation.

    ``separations`` are in mean radii. Shifts go along ``direction``, or (2D) along the
    ``angle`` column of (point_id, sep) - hashed directions unless one is given. The first
    points are looked up once; only those inside are shifted and looked up again.
    """
    if direction is None and dim != 2:
        raise ValueError("three dimensions need a direction")
    mean = particles.groupBy("sample_id").agg(F.avg(radius(particles, dim)).alias("_mean"))
    n_first = points.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_points"))
    first = points_inside(points, particles, samples, dim)
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("sep"), F.lit(float(s)).alias("ratio"))
                      for k, s in enumerate(separations)])
    shifted = attach_box(attach(first.withColumn("_s", F.explode(steps)).select("*", "_s.sep", "_s.ratio"), mean),
                         samples, dim)
    if direction is not None:
        size = sum(x * x for x in direction) ** 0.5
        u = [F.lit(float(x) / size) for x in direction]
    else:
        turn = 2 * F.pi() * uniform(seed, F.lit("direction"), "sample_id", "point_id", "sep") if angle is None else angle
        u = [F.cos(turn), F.sin(turn)]
    moved = [wrap(F.col(a) + F.col("ratio") * F.col("_mean") * x, F.col(f"l{a}")).alias(a) for a, x in zip(axes(dim), u)]
    second = shifted.select("sample_id", "point_id", "sep", *moved)
    both = points_inside(second, particles, samples, dim, ["point_id", "sep"])
    hits = both.groupBy("sample_id", "sep").agg(F.count(F.lit(1)).alias("hits"))
    grid = n_first.withColumn("_s", F.explode(steps)).select("sample_id", "n_points", "_s.sep", "_s.ratio")
    return grid.join(hits, ["sample_id", "sep"], "left").select(
        "sample_id", "sep", F.col("ratio").alias("r_over_R"),
        (F.coalesce("hits", F.lit(0)) / F.col("n_points")).alias("s2"))


def is_particle_pixel(value: Column, channels: Column) -> Column:
    """A single-channel pixel is particle at 255, a multi-channel one where its first channel is 0."""
    return F.when(channels == 1, value == 255).otherwise(value == 0)


def lookup_image(points: DataFrame, pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Value of the pixel under each (wrapped) point: ``images`` holds width, height, lx, ly."""
    placed = points.join(images.select("image_id", "width", "height", "lx", "ly"), "image_id")
    px = F.least(F.floor(wrap(F.col("x"), F.col("lx")) / F.col("lx") * F.col("width")), F.col("width") - 1)
    py = F.least(F.floor(wrap(F.col("y"), F.col("ly")) / F.col("ly") * F.col("height")), F.col("height") - 1)
    return (placed.withColumn("px", px.cast("long")).withColumn("py", py.cast("long"))
            .drop("width", "height", "lx", "ly")
            .join(pixels.select("image_id", "px", "py", "value"), ["image_id", "px", "py"]))


def two_point_image(points: DataFrame, pixels: DataFrame, images: DataFrame, separations: Sequence[float],
                    average_radius: float, angle: Column, particle: Column) -> DataFrame:
    """Two-point correlation on section images; ``particle`` is a predicate on ``value``."""
    n = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_points"))
    first = lookup_image(points, pixels, images).where(particle).select("image_id", "point_id", "x", "y")
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("sep"), F.lit(s * average_radius).alias("_len"))
                      for k, s in enumerate(separations)])
    moved = first.withColumn("_s", F.explode(steps)).select(
        "image_id", "point_id", "x", "y", "_s.sep", "_s._len").select(
        "image_id", "point_id", "sep", (F.col("x") + F.col("_len") * F.cos(angle)).alias("x"),
        (F.col("y") + F.col("_len") * F.sin(angle)).alias("y"))
    hits = lookup_image(moved, pixels, images).groupBy("image_id", "sep").agg(
        F.sum(particle.cast("long")).alias("hits"))
    grid = n.withColumn("_s", F.explode(steps)).select("image_id", "n_points", "_s.sep")
    return grid.join(hits, ["image_id", "sep"], "left").select(
        "image_id", "sep", (F.coalesce("hits", F.lit(0)) / F.col("n_points")).alias("s2"))


# --- histograms and tests ---------------------------------------------------------------


QUANTILE_BINS = 1 << 12
QUANTILE_ROUNDS = 2


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """``quantiles``: the exact quantiles of each key, linear between neighbouring values; nulls are left out.

    A histogram of each key finds the bin of every wanted rank, the next one refines that bin. What the last bins hold is
    counted by value and numbered by a range-partitioned sort, so a key of any size and values of any spread need no task of
    their own. Work and tables between rounds grow with keys and ranks only.
    """
    own = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    rows = df.where(F.col(value).isNotNull()).select(
        *([F.col(k).alias(o) for k, o in zip(keys, own)] or [F.lit(0).alias("_k0")]), F.col(value).cast("double").alias("_v"))
    facts = checkpoint(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in at for f in (F.floor, F.ceil)]))
    state = facts.select(*own, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    same = [F.col(f"r.{o}").eqNullSafe(F.col(f"s.{o}")) for o in own]

    def held(state: DataFrame) -> DataFrame:
        """Values between the bounds of a rank that is still open."""
        open_ = state.where("_lo < _hi")
        return rows.alias("r").join(open_.alias("s"), [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))]).select(
            *[F.col(f"s.{o}") for o in own], "_rank", "_lo", "_hi", "_below", "_v")

    spot = [*own, "_rank"]
    columns = [*spot, "_lo", "_hi", "_below"]
    for _ in range(QUANTILE_ROUNDS):
        # halves, because the width of all doubles is none
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = held(state).groupBy(*spot, "_below", F.least(F.floor(share * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # at most QUANTILE_BINS rows a window
        upto = Window.partitionBy(*spot).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("_end", F.col("_below") + F.sum("_c").over(upto))
        found = bins.where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c"))).withColumn(
            "_below", F.col("_end") - F.col("_c"))
        state = checkpoint(state.where("_lo >= _hi").select(*columns).unionByName(found.select(*columns)))
    counted = held(state).groupBy(*spot, "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    sums = running(number_rows(counted, spot, ["_v"], "_i"), spot, "_i", {"_sum": F.col("_c")})
    end = F.col("_below") + F.col("_sum")
    last = sums.where((F.col("_rank") < end) & (F.col("_rank") >= end - F.col("_c"))).select(*spot, "_v")
    picked = state.where("_lo >= _hi").select(*spot, F.col("_lo").alias("_v")).unionByName(last)
    # a few ranks per key
    lists = picked.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
    value_at = lambda f, p: F.element_at("_m", f(place(p)).cast("long"))
    part = lambda p: place(p) - F.floor(place(p))
    q = [F.when(part(p) == 0, value_at(F.floor, p)).otherwise(value_at(F.floor, p) * (1 - part(p)) + value_at(F.ceil, p) * part(p))
         for p in at]
    out = facts.select(*own, "_n").alias("r").join(lists.alias("s"), same)
    return out.select(*[F.col(f"r.{o}").alias(k) for k, o in zip(keys, own)], F.array(*q).alias("quantiles"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int | str = 10,
              range_: tuple[float, float] | None = None) -> DataFrame:
    """Counts per equal bin, the last one closed on the right; empty bins are rows too.

    ``auto`` takes the more of Sturges' and Freedman-Diaconis' number of bins. Values that
    agree to 1e-9 get one bin of five per cent either side.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if range_ is not None:
        rows = rows.where(F.col("_v").between(*range_))
    stats = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n")]
    facts = rows.groupBy(*keys).agg(*stats)
    if bins == "auto":
        quarters = quantiles(rows, keys, "_v", [0.25, 0.75]).withColumnRenamed("quantiles", "_q")
        facts = facts.join(quarters, keys) if keys else facts.join(quarters)
    lo, hi = F.col("_lo"), F.col("_hi")
    if range_ is not None:
        facts = facts.withColumn("_lo", F.lit(float(range_[0]))).withColumn("_hi", F.lit(float(range_[1])))
        facts = facts.withColumn("_bins", F.lit(int(bins)).cast("long"))
    else:
        same = F.abs(hi - lo) <= 1e-9 * F.abs(hi)
        if bins == "auto":
            sturges = (hi - lo) / (F.log2(F.col("_n")) + 1)
            fd = 2 * (F.col("_q")[1] - F.col("_q")[0]) / F.cbrt(F.col("_n"))
            step = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
            count = F.ceil((hi - lo) / step).cast("long")
        else:
            count = F.lit(int(bins)).cast("long")
        half = F.when(hi != 0, 0.05 * F.abs(hi)).otherwise(0.5)
        facts = facts.select(*keys, F.when(same, lo - half).otherwise(lo).alias("_lo"),
                             F.when(same, hi + half).otherwise(hi).alias("_hi"),
                             F.when(same, F.lit(1).cast("long")).otherwise(count).alias("_bins"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    placed = rows.join(facts, keys) if keys else rows.join(facts)
    index = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")).cast("long"),
                    F.col("_bins") - 1)
    counts = placed.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    grid = facts.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("_c", F.lit(0)).alias("n"))


def chi_squared(values: DataFrame, key: str, value: str, n_bins: int = 20) -> DataFrame:
    """Homogeneity of samples on (0, 1]: the statistic and the number of used cells.

    A value of 0 is in no bin, and the denominator counts every value, binned or not.
    """
    b = F.ceil(F.col(value) * n_bins).cast("long")
    # bins are right-closed: (k/20, (k+1)/20]; the products decide at the edges
    b = F.when(F.col(value) > b * 1.0 / n_bins, b + 1).when(F.col(value) <= (b - 1) * 1.0 / n_bins, b - 1).otherwise(b)
    cells = values.groupBy(F.col(key).alias("_k"), b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    size = cells.agg(F.sum("_c").alias("_size"))
    valid = cells.where(F.col("_b").between(1, n_bins))
    rows = valid.groupBy("_k").agg(F.sum("_c").alias("_row"))
    cols = valid.groupBy("_b").agg(F.sum("_c").alias("_col"))
    # every used row meets every used bin: a cell may be empty
    bins = F.sequence(F.lit(1).cast("long"), F.lit(n_bins).cast("long"))
    grid = (rows.withColumn("_b", F.explode(bins)).join(cols, "_b").join(valid, ["_k", "_b"], "left")
            .withColumn("_size", size.scalar()))
    e = F.col("_row") * F.col("_col") / F.col("_size")
    o = F.coalesce("_c", F.lit(0))
    return grid.agg(F.sum((o - e) * (o - e) / e).alias("chi"), F.count(F.lit(1)).alias("used"))


def nn_summary(nn: DataFrame) -> DataFrame:
    return nn.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("nn").alias("mean"),
                                       F.min("nn").alias("least"), F.max("nn").alias("largest"))


