"""Analytics of run histories: every window is over a bounded block of steps (see ordered.py)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.functions.ordered import BLOCK, number_rows, over_halo, running, running_max
from packstat.functions.periodic import axes, min_image
from packstat.operators.geometry import with_extents
from packstat.operators.spatial import attach, attach_box

RUN = ["sample_id"]

# fixed values: legality margin, stagnation length and threshold (per cent), ratio of a step that only grows
LEGAL_MARGIN = 1e-12
STAGNATION_STEPS = 500
STAGNATION_PERCENT = 1e-2
ONLY_GROWTH = 1e12


def step_grid(bounds: DataFrame, last: str, start: int = 0, name: str = "step") -> DataFrame:
    """All steps ``start..last`` of each row, unfolded block by block so that no array is long."""
    first = F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / BLOCK).cast("long"))
    lo = F.greatest(F.col("_b") * BLOCK, F.lit(start))
    hi = F.least(F.col("_b") * BLOCK + BLOCK - 1, F.col(last))
    inner = F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return (bounds.where(F.col(last) >= start).withColumn("_b", F.explode(first))
            .withColumn(name, F.explode(inner)).drop("_b", last))


# --- overlap ratio and equilibrium criteria ---------------------------------------------


def overlap_ratio(pair_overlaps: DataFrame) -> DataFrame:
    """Growth over decay of the pair overlaps per step, absent overlaps counting as zero.

    Every record is met by the one before it through an aggregate on (pair, step): the value
    enters its own step and leaves the next, so no pair history is ordered or densified.
    """
    moves = F.array(F.struct(F.col("step"), F.col("overlap").alias("v")),
                    F.struct((F.col("step") + 1).alias("step"), (-F.col("overlap")).alias("v")))
    changes = (pair_overlaps.select("sample_id", "i", "j", F.explode(moves).alias("_m"))
               .groupBy("sample_id", "i", "j", F.col("_m.step").alias("step")).agg(F.sum("_m.v").alias("_c")))
    sums = changes.groupBy("sample_id", "step").agg(
        F.sum(F.when(F.col("_c") > 0, F.col("_c")).otherwise(0.0)).alias("grown"),
        F.sum(F.when(F.col("_c") < 0, -F.col("_c")).otherwise(0.0)).alias("shrunk"))
    last = pair_overlaps.groupBy("sample_id").agg(F.max("step").alias("_last"))
    grid = step_grid(last, "_last", start=1)
    ratio = (F.when(F.col("shrunk") > 0, F.col("grown") / F.col("shrunk"))
             .when(F.col("grown") > 0, F.lit(ONLY_GROWTH)).otherwise(1.0))
    return grid.join(sums, ["sample_id", "step"], "left").select(
        "sample_id", "step", F.coalesce("grown", F.lit(0.0)).alias("grown"),
        F.coalesce("shrunk", F.lit(0.0)).alias("shrunk"), ratio.alias("ratio"))


def ratio_crossings(ratio: DataFrame, k: int = 2, keys: Sequence[str] = RUN) -> DataFrame:
    """Steps whose ratio crosses one, their running number, and the event at every k-th."""
    prev = over_halo(ratio.select(*keys, "step", "ratio"), keys, "step",
                     {"_prev": lambda w: F.lag("ratio").over(w)}, before=1)
    crossed = prev.withColumn("crossing", F.coalesce((F.col("ratio") - 1) * (F.col("_prev") - 1) <= 0, F.lit(False)))
    counted = running(crossed.drop("_prev"), keys, "step", {"n_crossings": F.col("crossing").cast("long")})
    return counted.withColumn("event", F.col("crossing") & (F.col("n_crossings") % k == 0))


def last_change(run_steps: DataFrame, temp_changes: DataFrame) -> DataFrame:
    """Adds the latest temperature change before each step (null where there is none)."""
    marked = run_steps.join(temp_changes.select("sample_id", "step").distinct().withColumn("_hit", F.lit(True)),
                            ["sample_id", "step"], "left")
    return running_max(marked, RUN, "step", {"last_change": F.when(F.col("_hit"), F.col("step"))},
                       inclusive=False).drop("_hit")


def equilibrium_rolling(run_steps: DataFrame, temp_changes: DataFrame, window: int) -> DataFrame:
    """Overlap above what it was ``window`` steps ago, once more than that many since a change.

    Compares two values and not two averages, as the criterion of that name does.
    """
    steps = over_halo(run_steps.select("sample_id", "step", "total_overlap"), RUN, "step",
                      {"_then": lambda w: F.lag("total_overlap", window).over(w)}, before=window)
    out = last_change(steps, temp_changes)
    return out.select("sample_id", "step", F.coalesce(
        (F.col("total_overlap") > F.col("_then")) & (F.col("step") - F.col("last_change") > window),
        F.lit(False)).alias("equilibrium"))


#: Gaps looked at together, at first, when the next missed test of a run is sought.
SCAN = 1 << 10
NO_STEP = 1 << 62


def _long_falls(run_steps: DataFrame, m: int) -> DataFrame:
    """Stretches (u, v) between rises of more than ceil(m/2) steps, from before the first rise to after the last.

    Only in these can a test of the self-lengthening criterion fail, as its window never gets shorter. The stretch after the last
    rise of a run carries the last step of the run.
    """
    rises = over_halo(run_steps.select("sample_id", "step", "total_overlap"), RUN, "step",
                      {"_prev": lambda w: F.lag("total_overlap").over(w)}, before=1)
    up = rises.select("sample_id", "step", (F.col("total_overlap") > F.col("_prev")).alias("_up"))
    between = (running_max(up.where("_up"), RUN, "step", {"u": F.col("step")}, inclusive=False)
               .select("sample_id", F.coalesce("u", F.lit(-NO_STEP)).alias("u"), F.col("step").alias("v")))
    after = up.groupBy("sample_id").agg(F.coalesce(F.max(F.when(F.col("_up"), F.col("step"))), F.lit(-NO_STEP)).alias("u"),
                                        F.max("step").alias("last_step"))
    return (between.where(F.col("v") - F.col("u") > (m + 1) // 2).withColumn("last_step", F.lit(None).cast("long"))
            .unionByName(after.withColumn("v", F.lit(NO_STEP))))


def equilibrium_original(run_steps: DataFrame, m: int) -> DataFrame:
    """Events of the criterion whose waiting time lengthens itself.

    Past ``next_change`` (first m) an event is any rise of the overlap in the last ceil(m/2)
    steps; m then grows by the overshoot and the next test waits m steps.

    While no test fails, events follow at every m + 1 steps, and m can only change in a long fall, at whose end the next event
    lies. So the rises are found in blocks, what passes to the sequential part is a row per long fall (``_long_falls``), read as
    a stream in the order of the run and never held, and what it returns is a row per change of m, of which a run of n steps has
    at most sqrt(2 n). The events between are unfolded from those rows in blocks. Steps are consecutive per run; a missing
    overlap is no rise.
    """
    key_type = run_steps.schema["sample_id"].dataType.simpleString()
    scan = SCAN

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, wait, begin, due = None, m, m + 1, m + 1  # ``due``: the next test; ``begin``: the first event of its stretch
        for batch in batches:
            rows: list[tuple] = []
            ids, us, vs = batch["sample_id"].to_numpy(), batch["u"].to_numpy("int64"), batch["v"].to_numpy("int64")
            ends = batch["last_step"].fillna(-1).to_numpy("int64")
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for first, stop in zip(cuts, cuts[1:]):
                if first == stop:
                    continue
                if key is None or ids[first] != key:
                    key, wait, begin, due = ids[first], m, m + 1, m + 1
                at, look = first, scan
                while at < stop:
                    u, v = us[at:min(at + look, stop)], vs[at:min(at + look, stop)]
                    fails = u + (wait + 1) // 2  # tests from here up to v fail
                    tests = due + -(-np.maximum(fails - due, 0) // (wait + 1)) * (wait + 1)
                    missed = np.flatnonzero((fails < v) & (tests < v))
                    if not len(missed):
                        at, look = at + len(u), look * 2
                        continue
                    k = int(missed[0])
                    test, rise = int(tests[k]), int(v[k])
                    at, look = at + k + 1, scan
                    if rise == NO_STEP:
                        test = min(test, due + max(int(ends[at - 1]) + 1 - due + wait, 0) // (wait + 1) * (wait + 1))
                    if test > begin:
                        rows.append((key, begin, wait, (test - begin) // (wait + 1) - 1))
                    wait += rise - test
                    begin, due = rise, rise + wait + 1
            yield pd.DataFrame(rows, columns=["sample_id", "begin", "m", "_last"])

    runs = (_long_falls(run_steps, m).repartition("sample_id").sortWithinPartitions("sample_id", "u")
            .mapInPandas(stretches, f"sample_id {key_type}, begin bigint, m bigint, _last bigint"))
    events = step_grid(runs, "_last", name="_k").withColumn("step", F.col("begin") + F.col("_k") * (F.col("m") + 1))
    return events.select("sample_id", "step", "m", (F.col("step") + F.col("m")).alias("next_change"))


def temperature_stages(run_steps: DataFrame, temp_changes: DataFrame, t0: float, factor: float) -> DataFrame:
    """Reference temperature per step: t0 times factor to the number of lowerings so far.

    The first change at which kinetic and thermic energy have parted (relative difference
    above 1 / factor / 2) is recorded but lowers nothing.
    """
    steps = run_steps.select("sample_id", "step", "kinetic", "thermic")
    at = temp_changes.select("sample_id", "step").distinct().join(steps, ["sample_id", "step"])
    gap = F.abs(F.col("kinetic") - F.col("thermic"))
    parted = F.when(F.col("thermic") == 0, gap > 0).otherwise(F.try_divide(gap, F.col("thermic")) > 1 / factor / 2)
    first = at.groupBy("sample_id").agg(F.min(F.when(parted, F.col("step"))).alias("_parted"))
    lowered = (attach(at, first).select("sample_id", "step",
               F.when(F.col("step") == F.col("_parted"), 0).otherwise(1).cast("long").alias("_low")))
    out = running(steps.join(lowered, ["sample_id", "step"], "left"), RUN, "step",
                  {"lowerings": F.coalesce("_low", F.lit(0).cast("long"))})
    return out.select("sample_id", "step", "lowerings",
                      (F.lit(t0) * F.pow(F.lit(factor), F.col("lowerings"))).alias("temperature"))


# --- run outcome ------------------------------------------------------------------------


def relative_change(now: str, before: str) -> Column:
    """Change in per cent of the value before; any change from zero is beyond all bounds."""
    change = F.abs(F.col(now) - F.col(before)) / F.abs(F.col(before)) * 100
    return F.when(F.col(before) == 0, F.lit(float("inf"))).otherwise(change)


def stagnation(run_steps: DataFrame, n: int = STAGNATION_STEPS, percent: float = STAGNATION_PERCENT) -> DataFrame:
    """Steps past n whose last n relative changes all stay under ``percent`` per cent."""
    steps = run_steps.select("sample_id", "step", "total_overlap")
    lagged = over_halo(steps, RUN, "step", {"_prev": lambda w: F.lag("total_overlap").over(w)}, before=1)
    moved = lagged.withColumn("_change", relative_change("total_overlap", "_prev"))
    worst = over_halo(moved, RUN, "step", {"_worst": lambda w: F.max("_change").over(w.rowsBetween(-(n - 1), 0))},
                      before=n)
    return worst.select("sample_id", "step", F.coalesce(
        (F.col("step") > n) & (F.col("_worst") < percent), F.lit(False)).alias("stagnant"))


def is_legal(max_residue: float | Column) -> Column:
    limit = max_residue if isinstance(max_residue, Column) else F.lit(max_residue)
    return F.col("total_overlap") <= limit + LEGAL_MARGIN


def legal_streak(run_steps: DataFrame, max_residue: float | Column, max_steps_to_relax: int) -> DataFrame:
    """Consecutive legal steps up to each step, and whether the run may end there."""
    steps = run_steps.select("sample_id", "step", "total_overlap")
    last = running_max(steps, RUN, "step", {"_bad": F.when(~is_legal(max_residue), F.col("step"))})
    streak = F.col("step") - F.coalesce("_bad", F.lit(-1).cast("long"))
    return last.select("sample_id", "step", streak.alias("streak"), (streak > max_steps_to_relax).alias("ends"))


def run_milestones(run_steps: DataFrame, temp_changes: DataFrame, max_residue: float) -> DataFrame:
    """First legal step, last temperature change, and steps from that change to legality."""
    legal = run_steps.groupBy("sample_id").agg(
        F.min(F.when(is_legal(max_residue), F.col("step"))).alias("first_legal"),
        (F.max("step") + 1).alias("n_steps"))
    last = temp_changes.groupBy("sample_id").agg(F.max("step").alias("last_change"))
    return attach(legal, last, how="left").withColumn("to_converge", F.col("first_legal") - F.col("last_change"))


def legal_runs(runs: DataFrame, legal: bool = True) -> DataFrame:
    """Runs whose final overlap is within the residue (or the others: they are kept, not analysed)."""
    ok = F.coalesce(F.col("total_overlap") <= F.col("max_residue") + LEGAL_MARGIN, F.lit(False))
    return runs.where(ok if legal else ~ok)


def batch_report(runs: DataFrame) -> DataFrame:
    """One row: samples, legal, illegal and unfinished ones, and the time they took."""
    return runs.agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("status").cast("long")).alias("n_legal"),
                    F.sum((~F.col("status")).cast("long")).alias("n_illegal"),
                    F.sum(F.col("status").isNull().cast("long")).alias("n_unfinished"),
                    F.sum("seconds").alias("seconds"))


def time_report(times: DataFrame) -> DataFrame:
    """Seconds per named step and share of the total; sub-steps ("- ...") are left out of the total."""
    sums = times.groupBy("name").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum(F.when(~F.col("name").startswith("- "), F.col("seconds"))).alias("_total"))
    return sums.select("name", "n", "seconds", F.try_divide(F.col("seconds"), total.scalar()).alias("share"))


# --- smoothing --------------------------------------------------------------------------


# moments counted from afar lose digits: from the middle of 2 048 steps 4e-10 of a value of 42
SMOOTH_BLOCK = 1 << 8


def _length(series: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    return series.groupBy(*keys).agg((F.max(step) + 1).alias("_len"))


def moving_average(series: DataFrame, value: str, n: int = 5, keys: Sequence[str] = RUN, step: str = "step") -> DataFrame:
    """Centred average of n values; null unless n // 2 < index < length - n // 2."""
    h = n // 2
    out = over_halo(series, keys, step, {"_avg": lambda w: F.sum(value).over(w.rowsBetween(-h, h)) / (2 * h + 1)},
                    before=h, after=h)
    out = attach(out, _length(series, keys, step), keys)
    keep = (F.col(step) > h) & (F.col(step) < F.col("_len") - h)
    return out.withColumn("moving_average", F.when(keep, F.col("_avg"))).drop("_avg", "_len")


def savgol(series: DataFrame, value: str, window: int = 41, keys: Sequence[str] = RUN, step: str = "step") -> DataFrame:
    """Quadratic Savitzky-Golay smoothing; the ends take the quadratic of the first and last window.

    The window is the lesser of ``window`` and the largest odd number not above the length;
    series of one or two values stay as they are. Each window is reduced to its moments with
    the discrete orthogonal polynomials 1, j, j^2 - m(m+1)/3, which three moving sums give: v, p v and p^2 v, where
    p counts from the middle of a short block, so that shifting them to the window's centre loses few digits.
    """
    most = (window - 1) // 2
    block = max(SMOOTH_BLOCK, window)
    size = F.least(F.lit(window), F.col("_len") - (1 - F.col("_len") % 2))
    sized = attach(series, _length(series, keys, step), keys).withColumn("_m", F.floor((size - 1) / 2).cast("long"))
    v = F.col(value).cast("double")
    p = (F.col(step) - F.col("_block") * block - block // 2).cast("double")
    near = lambda w: w.rowsBetween(-most, most)
    framed = over_halo(sized, keys, step, {
        "_p": lambda w: p, "_v0": lambda w: F.sum(v).over(near(w)), "_v1": lambda w: F.sum(p * v).over(near(w)),
        "_v2": lambda w: F.sum(p * p * v).over(near(w)), "_rows": lambda w: F.count(F.lit(1)).over(near(w)),
        "_known": lambda w: F.count(v).over(near(w)), "_first": lambda w: F.first(v).over(near(w)),
        "_final": lambda w: F.last(v).over(near(w))}, before=most, after=most, block=block)
    m = F.col("_m").cast("double")
    bend = m * (m + 1) / 3
    # an even series shorter than the window has one value more in the frame than in its window
    low = F.col(step) == F.col("_m")
    j = F.when(low, m + 1).otherwise(-(m + 1))
    more = F.when(F.col("_rows") > 2 * F.col("_m") + 1, F.when(low, F.col("_final")).otherwise(F.col("_first"))).otherwise(0.0)
    at = F.col("_p")
    s0 = F.col("_v0") - more
    s1 = F.col("_v1") - at * F.col("_v0") - j * more
    s2 = F.col("_v2") - 2 * at * F.col("_v1") + at * at * F.col("_v0") - j * j * more
    whole = F.col("_known") == F.col("_rows")
    centre = framed.where((F.col(step) >= F.col("_m")) & (F.col(step) <= F.col("_len") - 1 - F.col("_m"))).select(
        *keys, F.col(step).alias("_c"), F.when(whole, s0).alias("_s0"), F.when(whole, s1).alias("_s1"),
        F.when(whole, s2 - bend * s0).alias("_s2"))
    rows = sized.withColumn("_c", F.least(F.greatest(F.col(step), F.col("_m")), F.col("_len") - 1 - F.col("_m")))
    x = (F.col(step) - F.col("_c")).cast("double")
    n0 = 2 * m + 1
    n1 = m * (m + 1) * n0 / 3
    n2 = n0 * (2 * m - 1) * (2 * m + 3) * m * (m + 1) / 45
    smooth = F.col("_s0") / n0 + x * F.col("_s1") / n1 + (x * x - bend) * F.col("_s2") / n2
    return (rows.join(centre, [*keys, "_c"], "left")
            .withColumn("smoothed", F.when(F.col("_m") >= 1, smooth).otherwise(F.col(value).cast("double")))
            .drop("_c", "_s0", "_s1", "_s2", "_m", "_len"))


# --- motion -----------------------------------------------------------------------------


def cut_common_steps(paths: DataFrame) -> DataFrame:
    """Paths cut at the last step that every particle of the sample reached."""
    last = paths.groupBy("sample_id", "particle_id").agg(F.max("step").alias("_last"))
    common = last.groupBy("sample_id").agg(F.min("_last").alias("_last"))
    return attach(paths, common).where(F.col("step") <= F.col("_last")).drop("_last")


PATH = ["sample_id", "particle_id"]


def displacement(paths: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Step vectors by minimum image, the unwrapped displacement since the start, and the path length."""
    boxed = attach_box(paths, samples, dim)
    lagged = over_halo(boxed, PATH, "step", {
        f"step_{a}": (lambda w, a=a: F.coalesce(min_image(F.col(a) - F.lag(a).over(w), F.col(f"l{a}")), F.lit(0.0)))
        for a in axes(dim)}, before=1)
    square = None
    for a in axes(dim):
        term = F.col(f"step_{a}") * F.col(f"step_{a}")
        square = term if square is None else square + term
    sums = {f"moved_{a}": F.col(f"step_{a}") for a in axes(dim)}
    return running(lagged, PATH, "step", {**sums, "path_length": F.sqrt(square)}).drop(*[f"l{a}" for a in axes(dim)])


def mean_square_displacement(moved: DataFrame, dim: int) -> DataFrame:
    square = None
    for a in axes(dim):
        term = F.col(f"moved_{a}") * F.col(f"moved_{a}")
        square = term if square is None else square + term
    return moved.groupBy("sample_id", "step").agg(F.avg(square).alias("msd"), F.count(F.lit(1)).alias("n"))


def kinetic_energy(moved: DataFrame, particles: DataFrame, dim: int) -> DataFrame:
    """Sum of m v^2 / 2 per step, the velocities being step vectors over dt; ``mass`` is a column."""
    square = None
    for a in axes(dim):
        term = F.col(f"step_{a}") * F.col(f"step_{a}")
        square = term if square is None else square + term
    both = moved.join(particles.select(*PATH, "mass"), PATH)
    return both.groupBy("sample_id", "step").agg(
        F.sum(F.try_divide(0.5 * F.col("mass") * square, F.col("dt") * F.col("dt"))).alias("kinetic"))


def thermic_energy(stages: DataFrame, particles: DataFrame, dim: int, k_b: float = 1.0) -> DataFrame:
    """k_B T dim n / 2 per step."""
    n = particles.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    return attach(stages, n).withColumn("thermic", F.lit(0.5 * k_b * dim) * F.col("temperature") * F.col("_n")).drop("_n")


def asof_thermic(kinetic: DataFrame, thermic: DataFrame) -> DataFrame:
    """Histories of unequal length aligned at their last steps: ``pos`` counts the thermic records."""
    nk = kinetic.groupBy("sample_id").agg((F.max("step") + 1).alias("_nk"))
    nt = thermic.groupBy("sample_id").agg((F.max("pos") + 1).alias("_nt"))
    shifted = attach(attach(thermic, nk), nt).select(
        "sample_id", (F.col("pos") + F.col("_nk") - F.col("_nt")).alias("step"), "thermic")
    return kinetic.select("sample_id", "step", "kinetic").join(shifted, ["sample_id", "step"], "left")


def adaptive_dt(coordination: DataFrame, harmonic: DataFrame) -> DataFrame:
    """sqrt(2 / max(1, z)) * sqrt(harmonic mean radius)."""
    z = F.greatest(F.lit(1.0), F.col("mean_coordination"))
    return attach(coordination, harmonic).withColumn("dt", F.sqrt(2 / z) * F.sqrt(F.col("harmonic_radius"))).select(
        "sample_id", "dt")


# --- ordered geometry -------------------------------------------------------------------


def rve_offset(particles: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Best cut plane per axis: the middle of the widest gap no particle spans, else of the widest.

    The extremes are sorted on the circle; a running count of the particles begun and not
    ended says how many span the gap after each, so no gap is tested against every particle.
    Ties go to the gap that starts last.
    """
    flat = with_extents(attach_box(particles, samples, dim), dim)
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"lo_{a}").alias("lo"), F.col(f"hi_{a}").alias("hi"),
                               F.col(f"l{a}").alias("len")) for a in axes(dim)])
    rows = flat.select("sample_id", F.explode(sides).alias("_s")).select("sample_id", "_s.*")
    start, end = F.col("lo") - F.col("len") * F.floor(F.col("lo") / F.col("len")), \
        F.col("hi") - F.col("len") * F.floor(F.col("hi") / F.col("len"))
    whole = F.col("hi") - F.col("lo") >= F.col("len")
    rows = rows.withColumn("_a", start).withColumn("_z", end).withColumn("_whole", whole)
    key = ["sample_id", "axis"]
    base = rows.groupBy(*key).agg(
        F.sum((F.col("_whole") | (F.col("_a") > F.col("_z"))).cast("long")).alias("_base"), F.first("len").alias("len"))
    events = F.array(F.struct(F.col("_a").alias("at"), F.when(F.col("_whole"), 0).otherwise(1).cast("long").alias("n")),
                     F.struct(F.col("_z").alias("at"), F.when(F.col("_whole"), 0).otherwise(-1).cast("long").alias("n")))
    limits = (rows.select(*key, F.explode(events).alias("_e")).groupBy(*key, F.col("_e.at").alias("at"))
              .agg(F.sum("_e.n").alias("_n")))
    ordered = running(number_rows(limits, key, ["at"], "_k"), key, "_k", {"_open": F.col("_n")})
    gaps = over_halo(ordered, key, "_k", {"_next": lambda w: F.lead("at").over(w)}, after=1)
    first = limits.groupBy(*key).agg(F.min("at").alias("_first"))
    gaps = attach(attach(gaps, first, key), base, key)
    width = F.coalesce(F.col("_next"), F.col("_first") + F.col("len")) - F.col("at")
    middle = F.col("at") + width / 2
    best = gaps.select(*key, F.struct((F.col("_open") + F.col("_base") == 0).alias("free"), width.alias("gap"),
                                      F.col("at").alias("start"),
                                      (middle - F.col("len") * F.floor(middle / F.col("len"))).alias("offset")).alias("_g"))
    return best.groupBy(*key).agg(F.max("_g").alias("_g")).select(*key, "_g.offset", "_g.gap", "_g.free")


def acceptance_curve(accepted: DataFrame, samples: DataFrame) -> DataFrame:
    """Fraction filled and number accepted after each step; ``accepted`` has a volume and a flag per step."""
    taken = F.when(F.col("accepted"), F.col("volume")).otherwise(0.0)
    out = running(accepted, RUN, "step", {"_v": taken, "n_accepted": F.col("accepted").cast("long")}, sparse=True)
    return attach(out, samples.select("sample_id", (F.col("lx") * F.col("ly")).alias("_box"))).select(
        "sample_id", "step", "n_accepted", (F.col("_v") / F.col("_box")).alias("vf"))


def fill_to_fraction(draws: DataFrame, keys: Sequence[str], order: str, volume: str, target: Column) -> DataFrame:
    """Draws kept until their running volume first reaches the target."""
    out = running(draws, keys, order, {"_sum": F.col(volume)}, sparse=True)
    return out.where(F.col("_sum") - F.col(volume) < target).drop("_sum")


