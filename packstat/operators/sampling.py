"""Seeded population sampling, placement, points inside particles, thinning by arrival."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.functions.hashing import normal, uniform
from packstat.functions.ordered import number_rows
from packstat.functions.periodic import axes
from packstat.functions.shapes import by_shape, by_shape_vector, cols_of, framed
from packstat.operators.geometry import dilate
from packstat.operators.spatial import attach, box, near_pairs, overlaps, radius
from packstat.operators.telemetry import fill_to_fraction, step_grid
from packstat.session import checkpoint, spread, unfolded

PHASE = ["sample_id", "phase"]


# --- drawing descriptors ----------------------------------------------------------------


def _von_mises(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best and Fisher's rejection with uniforms hashed from the row, all rows of a batch at once."""

    def stream(state: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = state + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 9007199254740992.0

    for batch in batches:
        kappa = batch["_kappa"].to_numpy(float)
        state = batch["_key"].to_numpy("<i8").view("<u8")
        tau = 1 + np.sqrt(1 + 4 * kappa ** 2)
        rho = (tau - np.sqrt(2 * tau)) / (2 * kappa)
        s = (1 + rho ** 2) / (2 * rho)
        angle = np.full(len(batch), np.nan)
        k = 1
        while np.isnan(angle).any():
            z = np.cos(np.pi * stream(state, k))
            w = (1 + s * z) / (s + z)
            y = kappa * (s - w)
            u = np.maximum(stream(state, k + 1), 1e-300)
            good = np.isnan(angle) & ((y * (2 - y) - u > 0) | (np.log(y / u) + 1 - y >= 0))
            sign = np.where(stream(state, k + 2) < 0.5, -1.0, 1.0)
            angle[good] = (sign * np.arccos(np.clip(w, -1, 1)))[good]
            k += 3
        yield batch.assign(_vm=angle)


def draw(rows: DataFrame, descriptors: DataFrame, seed: int = 0, u: Callable[[], Column] | None = None) -> DataFrame:
    """One value per (row, descriptor): ``rows`` holds sample_id, phase and the draw number ``k`` from 1.

    ``u`` replaces the hashed uniforms (with a column of the row) for checks. The mean of a
    lognormal is its scale, that is its median; a specified descriptor gives its k-th value to
    the k-th row and null past its end (see ``short_problems``).
    """
    p = lambda name: F.col("params")[name]
    keys = ["sample_id", "phase", "name", "k"]
    flat = u() if u else uniform(seed, *keys)
    bell = normal(seed, *keys)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    sums = F.transform(F.sequence(F.lit(1), F.size("probabilities")), lambda n: F.aggregate(
        F.slice("probabilities", 1, n), F.lit(0.0), lambda a, b: a + b))
    below = F.size(F.filter(sums, lambda c: c <= flat * total))
    at = F.least(below, F.size("values") - 1)
    kind = F.col("distribution")
    value = (F.when(kind == "fixed", p("value"))
             .when(kind == "specified", F.get(F.col("values"), (F.col("k") - 1).cast("int")))
             .when(kind == "uniform", p("low") + flat * (p("high") - p("low")))
             .when(kind == "normal", p("mean") + p("sigma") * bell)
             .when(kind == "lognormal", p("mean") * F.exp(p("sigma") * bell))
             .when(kind == "discrete", F.get(F.col("values"), at)))
    both = attach(rows, unfolded(descriptors), PHASE)
    plain = both.where(kind != "vonmises").select(*rows.columns, "name", value.alias("value"))
    turned = both.where(kind == "vonmises").select(
        *rows.columns, "name", p("kappa").alias("_kappa"), p("loc").alias("_loc"), p("scale").alias("_scale"),
        F.xxhash64(F.lit(seed), *keys).alias("_key"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turned.schema) + ", _vm double"
    angle = F.col("_loc") + F.col("_scale") * F.col("_vm") + F.pi()
    wrapped = angle - 2 * F.pi() * F.floor(angle / (2 * F.pi())) - F.pi()
    return plain.unionByName(turned.mapInPandas(_von_mises, schema).select(*rows.columns, "name", wrapped.alias("value")))


def short_problems(drawn: DataFrame) -> DataFrame:
    """Rows a specified descriptor had no value for."""
    return drawn.where("value IS NULL").groupBy("sample_id", "phase", "name").agg(
        F.count(F.lit(1)).alias("n_missing"))


def wide(drawn: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drawn values as one row per particle."""
    keys = [c for c in drawn.columns if c not in ("name", "value")]
    return drawn.groupBy(*keys).pivot("name", list(names)).agg(F.first("value"))


def sample_seeds(samples: DataFrame, seed: int) -> DataFrame:
    """Seed of each sample: the batch's seed plus the sample's index."""
    return samples.withColumn("seed", F.lit(seed) + F.col("sample_id").cast("long"))


def populate(phases: DataFrame, descriptors: DataFrame, samples: DataFrame, names: Sequence[str],
             volume: Column, seed: int = 0, max_particles: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Particles of every phase, and the phases that cannot be filled.

    A phase with a number n gets n rows. One with only a volume fraction draws until its
    running volume reaches it: phases not yet full draw four times as many, the same draws
    first. ``volume`` is an expression over the drawn descriptors. A phase whose volume no
    longer grows with more draws is a problem, and so is one that ``max_particles``, if given, do not fill.
    """
    value = F.col("params")["value"]
    asked = descriptors.where("name IN ('n', 'vf') AND distribution = 'fixed'").groupBy(*PHASE).agg(
        F.max(F.when(F.col("name") == "n", value)).cast("long").alias("_n"),
        F.max(F.when(F.col("name") == "vf", value)).alias("_vf"))
    sizes = descriptors.where("name NOT IN ('n', 'vf')")
    wanted = phases.select(*PHASE).join(asked, PHASE)
    counted = step_grid(wanted.where("_n IS NOT NULL").select(*PHASE, "_n"), "_n", start=1, name="k")
    done = wide(draw(counted, sizes, seed), names)
    whole = samples.select("sample_id", (F.col("lx") * F.col("ly") * F.coalesce("lz", F.lit(1.0))).alias("_box"))
    waiting = checkpoint(attach(wanted.where("_n IS NULL AND _vf IS NOT NULL"), whole).select(
        *PHASE, (F.col("_vf") * F.col("_box")).alias("_target"), F.lit(0.0).alias("_before")))
    n = 256
    problems = waiting.limit(0).select(*PHASE, F.lit("").alias("message"))
    while not waiting.isEmpty():
        n = min(n, max_particles or n)
        rows = step_grid(waiting.withColumn("_n", F.lit(n).cast("long")), "_n", start=1, name="k")
        drawn = checkpoint(wide(draw(rows, sizes, seed), names).withColumn("_v", volume))
        sums = waiting.join(drawn.groupBy(*PHASE).agg(F.sum("_v").alias("_sum")), PHASE, "left")
        sums = checkpoint(sums.withColumn("_sum", F.coalesce("_sum", F.lit(0.0))))
        full = sums.where("_sum >= _target")
        kept = fill_to_fraction(drawn.join(full.select(*PHASE), PHASE, "left_semi"), PHASE, "k", "_v", F.col("_target"))
        done = done.unionByName(kept.drop("_v", "_target", "_before"))
        stuck = F.col("_sum") <= F.col("_before")
        if n == max_particles:
            stuck = F.lit(True)
        problems = problems.unionByName(sums.where("_sum < _target").where(stuck).select(
            *PHASE, F.lit(f"{n} particles do not reach the volume fraction").alias("message")))
        waiting = checkpoint(sums.where("_sum < _target").where(~stuck).select(*PHASE, "_target", F.col("_sum").alias("_before")))
        n *= 4
    return done, problems


# --- placement --------------------------------------------------------------------------


def place_random(particles: DataFrame, samples: DataFrame, dim: int, seed: int = 0,
                 u: Sequence[Column] | None = None) -> DataFrame:
    """Centres uniform in the box."""
    draws = u or [uniform(seed, "sample_id", "particle_id", F.lit(a)) for a in axes(dim)]
    return attach(particles, samples.select("sample_id", *box(dim))).select(
        *[c for c in particles.columns if c not in [f"c{a}" for a in axes(dim)]],
        *[(x * F.col(f"l{a}")).alias(f"c{a}") for a, x in zip(axes(dim), draws)])


def place_grid(particles: DataFrame, samples: DataFrame, dim: int, seed: int = 0, shuffle: Column | None = None) -> DataFrame:
    """Centres in the cells of the smallest cubic grid with room for all, the cells shuffled.

    Particles meet cells by number: the particles' in order, the cells' in order of a hash.
    """
    n = particles.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    root = F.ceil(F.round(F.pow(F.col("_n"), 1.0 / dim), 9)).cast("long")
    facts = attach(n.select("sample_id", root.alias("_side")), samples.select("sample_id", *box(dim)))
    last = F.lit(1).cast("long")
    for _ in range(dim):
        last = last * F.col("_side")
    cells = step_grid(facts.select("sample_id", (last - 1).alias("_last")), "_last", name="_cell")
    key = shuffle if shuffle is not None else F.xxhash64(F.lit(seed), F.col("sample_id"), F.col("_cell"))
    order = number_rows(cells.withColumn("_key", key), ["sample_id"], ["_key", "_cell"], "_place").select(
        "sample_id", "_place", "_cell")
    listed = number_rows(particles, ["sample_id"], ["particle_id"], "_place")
    placed = attach(listed.join(order, ["sample_id", "_place"]), facts)
    centres, rest = {}, F.col("_cell")
    for a in reversed(axes(dim)):
        centres[a] = (rest % F.col("_side") + 0.5) * (F.col(f"l{a}") / F.col("_side"))
        rest = F.floor(rest / F.col("_side")).cast("long")
    keep = [c for c in particles.columns if c not in [f"c{a}" for a in axes(dim)]]
    return placed.select(*keep, *[centres[a].alias(f"c{a}") for a in axes(dim)])


def place_bcc(samples: DataFrame) -> DataFrame:
    """The 128 sites of a body-centred lattice, four cells to the first side: corners, then centres, by layer."""
    return _lattice(samples, 128, 16)


def place_fcc(samples: DataFrame) -> DataFrame:
    """The 256 sites of a face-centred lattice, two sets of 16 to each of its eight layers."""
    return _lattice(samples, 256, 32)


def _lattice(samples: DataFrame, n: int, per_layer: int) -> DataFrame:
    rows = samples.select("sample_id", (F.col("lx") / 4).alias("_step"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("particle_id"))
    k = F.col("particle_id")
    layer, inside = F.floor(k / per_layer), k % per_layer
    second, site = inside >= 16, inside % 16
    row, column, odd = F.floor(site / 4), site % 4, layer % 2 == 1
    if n == 128:
        x, y = row + F.when(odd, 0.5).otherwise(0.0), column + F.when(odd, 0.5).otherwise(0.0)
    else:
        # even layers: corners, then sites moved by (3/2, 1/2); odd layers: moved by (1/2, 0), then (0, 1/2)
        x = F.when(odd, F.when(second, row).otherwise(row + 0.5)).otherwise(F.when(second, row + 1.5).otherwise(row))
        y = F.when(odd, F.when(second, column + 0.5).otherwise(column)).otherwise(F.when(second, column + 0.5).otherwise(column))
    return rows.select("sample_id", "particle_id", (x * F.col("_step")).alias("cx"), (y * F.col("_step")).alias("cy"),
                       (layer * 0.5 * F.col("_step")).alias("cz"))


# --- points inside particles ------------------------------------------------------------


def random_points_inside(particles: DataFrame, n: int, dim: int, seed: int = 0) -> DataFrame:
    """n points uniform in each particle: ``k`` and coordinates (not wrapped)."""
    # all columns of the points are worked out where they are unfolded: small files would leave that to one task
    rows = spread(framed(particles, dim), "sample_id", "particle_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = ["sample_id", "particle_id", "k"]
    g = [normal(seed, *key, F.lit(f"g{j}")) for j in range(dim)]
    for j, x in enumerate(g):
        rows = rows.withColumn(f"_g{j}", x)
    size = None
    for j in range(dim):
        term = F.col(f"_g{j}") * F.col(f"_g{j}")
        size = term if size is None else size + term
    rows = rows.withColumn("_rho", F.pow(uniform(seed, *key, F.lit("rho")), 1.0 / dim) / F.sqrt(size))
    rows = rows.withColumn("_a", uniform(seed, *key, F.lit("a")) - 0.5).withColumn("_b", uniform(seed, *key, F.lit("b")) - 0.5)
    ball = [F.col("_rho") * F.col(f"_g{j}") for j in range(dim)]

    def local(shape, c) -> list[Column]:
        if shape.name in ("Disk", "Sphere", "CylindricalFiber"):
            return [c.r * x for x in ball]
        if shape.name == "Square":
            return [c.side * F.col("_a"), c.side * F.col("_b")]
        if shape.name == "Cylinder":
            flat = F.sqrt(F.col("_b") + 0.5) * c.r_cyl / F.sqrt(F.col("_g0") * F.col("_g0") + F.col("_g1") * F.col("_g1"))
            return [c.length * F.col("_a"), flat * F.col("_g0"), flat * F.col("_g1")]
        semi = [F.col(name) / 2 for name in shape.sizes]
        return [a * x for a, x in zip(semi, ball)]

    def placed(shape, c) -> list[Column]:
        frame, v = shape.rotation(c), local(shape, c)
        return [sum((frame[i][j] * v[i] for i in range(1, dim)), frame[0][j] * v[0]) for j in range(dim)]

    at = by_shape_vector(rows, placed, dim, dim=dim)
    return rows.select("sample_id", "particle_id", "k",
                       *[(F.col(f"c{a}") + x).alias(a) for a, x in zip(axes(dim), at)])


def polar_points_inside(ellipses: DataFrame, n_rings: int, n_angles: int) -> DataFrame:
    """Regular polar sample of an ellipse: rings of equal step in the radius, equal angles on each."""
    c = cols_of(ellipses)
    rows = (ellipses.withColumn("ring", F.explode(F.sequence(F.lit(1), F.lit(n_rings))))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_angles - 1)))))
    rho, t = F.col("ring") / n_rings, 2 * F.pi() * F.col("k") / n_angles
    x, y = c.major_axis / 2 * rho * F.cos(t), c.minor_axis / 2 * rho * F.sin(t)
    return rows.select("sample_id", "particle_id", "ring", "k",
                       (F.col("cx") + F.cos(c.angle) * x - F.sin(c.angle) * y).alias("x"),
                       (F.col("cy") + F.sin(c.angle) * x + F.cos(c.angle) * y).alias("y"))


def overlap_volume_mc(particles: DataFrame, samples: DataFrame, dim: int, n: int = 1000, seed: int = 0,
                      tolerance: float | None = None, max_rounds: int | None = None) -> DataFrame:
    """Shared volume of near pairs by points thrown into the first: ``size``, ``error``, ``n_points``.

    The error is twice the standard deviation of the mean. With a tolerance, pairs whose
    error is above it throw four times as many points until none is left; with ``max_rounds``
    the last round's pairs come out whatever their error.
    """
    whole = framed(particles, dim)
    names = [c for c in whole.columns if c not in ("sample_id", "particle_id", *box(3))]
    pairs = near_pairs(whole, samples, dim, radius(whole, dim), names)
    active, found = checkpoint(pairs) if tolerance is not None else pairs, None
    for round_ in itertools.count():
        many = n * 4 ** round_
        first = active.select("sample_id", "a_particle_id", "b_particle_id", *[f"d{a}" for a in axes(dim)],
                              *[F.col(f"a_{c}").alias(c) for c in names], *[f"b_{c}" for c in names])
        # the points are thrown around the origin of the first particle; d leads to the second
        thrown = random_points_inside(
            first.select("sample_id", F.struct("a_particle_id", "b_particle_id").alias("particle_id"),
                         *[c for c in names if c not in [f"c{a}" for a in axes(dim)]],
                         *[F.lit(0.0).alias(f"c{a}") for a in axes(dim)]), many, dim, seed)
        volume_a = by_shape(active, lambda s, c: s.volume(c), "a_", dim)
        second = active.select("sample_id", F.struct("a_particle_id", "b_particle_id").alias("particle_id"),
                               volume_a.alias("_va"), *[f"d{a}" for a in axes(dim)],
                               *[F.col(f"b_{c}").alias(c) for c in names if not c.startswith("c") or c not in ("cx", "cy", "cz")],
                               *[F.lit(0.0).alias(f"c{a}") for a in axes(dim)])
        # the points were dealt by pair before they were thrown and stay where they are
        both = thrown.join(unfolded(second), ["sample_id", "particle_id"])
        v = [F.col(a) - F.col(f"d{a}") for a in axes(dim)]
        inside = by_shape(second, lambda s, c: s.contains(c, v), dim=dim).cast("double")
        out = both.groupBy("sample_id", "particle_id").agg(
            (F.avg(inside) * F.first("_va")).alias("size"),
            (2 * F.stddev_pop(inside) / F.sqrt(F.count(F.lit(1))) * F.first("_va")).alias("error"),
            F.count(F.lit(1)).alias("n_points"))
        out = out.select("sample_id", F.col("particle_id.a_particle_id").alias("i"),
                         F.col("particle_id.b_particle_id").alias("j"), "size", "error", "n_points")
        if tolerance is None:
            return out
        out = checkpoint(out)
        final = max_rounds is not None and round_ == max_rounds - 1
        good = out if final else out.where(F.col("error") <= tolerance)
        found = good if found is None else found.unionByName(good)
        if final:
            break
        again = out.where(F.col("error") > tolerance).select("sample_id", F.col("i").alias("a_particle_id"),
                                                            F.col("j").alias("b_particle_id"))
        active = checkpoint(active.join(again, ["sample_id", "a_particle_id", "b_particle_id"], "left_semi"))
        if active.isEmpty():
            break
    return found


# --- thinning by arrival ----------------------------------------------------------------


def _reject(conflicts: DataFrame) -> DataFrame:
    """Arrivals that overlap an earlier accepted one, from (earlier i, later j) conflicts.

    Each round settles what it can: an arrival nothing earlier conflicts with is accepted and
    everything it conflicts with rejected. Rounds are as many as the longest chain.
    """
    left, rejected = checkpoint(conflicts.select("sample_id", "i", "j")), None
    while not left.isEmpty():
        later = left.select("sample_id", F.col("j").alias("i")).distinct()
        accepted = left.select("sample_id", "i").distinct().join(unfolded(later), ["sample_id", "i"], "left_anti")
        out = checkpoint(left.join(unfolded(accepted), ["sample_id", "i"], "left_semi").select("sample_id", "j").distinct())
        rejected = out if rejected is None else rejected.unionByName(out)
        gone = out.select("sample_id", F.col("j").alias("i"))
        left = checkpoint(left.join(unfolded(accepted), ["sample_id", "i"], "left_anti")
                          .join(unfolded(gone), ["sample_id", "i"], "left_anti").join(unfolded(out), ["sample_id", "j"], "left_anti"))
    return rejected if rejected is not None else conflicts.select("sample_id", "j").limit(0)


def thin_by_arrival(candidates: DataFrame, samples: DataFrame, dim: int, targets: DataFrame | None = None,
                    min_distance: float = 0.0, method: str = "closed") -> DataFrame:
    """Random sequential adsorption on given candidates: ``particle_id`` is the order of arrival.

    A candidate stays when it overlaps no earlier one that stays. With ``targets`` (phase,
    phase_order, n, vf) the phases come in order and each ends when it has its number or its
    real volume fraction; what a phase keeps blocks the later ones. Particles are kept
    ``min_distance`` apart by growing each by half of it.
    """
    grown = dilate(candidates, min_distance / 2) if min_distance else candidates
    pairs = overlaps(grown, samples, dim, method).select("sample_id", "i", "j")
    if targets is None:
        gone = _reject(pairs).select("sample_id", F.col("j").alias("particle_id"))
        return candidates.join(unfolded(gone), ["sample_id", "particle_id"], "left_anti")
    volume = by_shape(candidates, lambda s, c: s.real_volume(c), dim=dim)
    whole = None
    for b in box(dim):
        whole = F.col(b) if whole is None else whole * F.col(b)
    pairs = checkpoint(pairs)
    # the orders of the phases are few: as many as a run specification lists
    orders = [row[0] for row in targets.select("phase_order").distinct().orderBy("phase_order").collect()]
    listed = checkpoint(attach(attach(candidates, checkpoint(targets), [c for c in PHASE if c in targets.columns]),
                               samples.select("sample_id", whole.alias("_box"))).withColumn("_v", volume))
    kept = None
    for order in orders:
        turn = listed.where(F.col("phase_order") == order)
        ids = lambda name, df: unfolded(df.select("sample_id", F.col("particle_id").alias(name)))
        if kept is not None:
            blocked = (pairs.join(ids("i", kept), ["sample_id", "i"], "left_semi").select("sample_id", F.col("j").alias("particle_id"))
                       .unionByName(pairs.join(ids("j", kept), ["sample_id", "j"], "left_semi")
                                    .select("sample_id", F.col("i").alias("particle_id"))))
            turn = turn.join(unfolded(blocked), ["sample_id", "particle_id"], "left_anti")
        own = pairs.join(ids("i", turn), ["sample_id", "i"], "left_semi").join(ids("j", turn), ["sample_id", "j"], "left_semi")
        gone = _reject(own).select("sample_id", F.col("j").alias("particle_id"))
        stay = turn.join(unfolded(gone), ["sample_id", "particle_id"], "left_anti")
        ranked = number_rows(stay, ["sample_id"], ["particle_id"], "_k")
        full = fill_to_fraction(ranked, ["sample_id"], "_k", "_v", F.coalesce(F.col("vf"), F.lit(float("inf"))) * F.col("_box"))
        now = checkpoint(full.where(F.col("_k") < F.coalesce(F.col("n"), F.lit(2 ** 62))))
        kept = now if kept is None else kept.unionByName(now)
    return kept.select(*candidates.columns) if kept is not None else candidates.limit(0)

