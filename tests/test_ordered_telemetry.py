import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from packstat.functions import ordered as od
from packstat.operators import telemetry as tm
from packstat.streaming import monitors as mo


def series(spark, values, sample="a"):
    return spark.createDataFrame([(sample, k, float(v)) for k, v in enumerate(values)], "sample_id string, step bigint, total_overlap double")


def both(spark, n=300):
    rng = np.random.default_rng(1)
    return series(spark, rng.random(n)).unionByName(series(spark, rng.random(17), "b"))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 17])
def test_blocked_windows_equal_plain_windows(spark, block):
    df = both(spark)
    w = Window.partitionBy("sample_id").orderBy("step")
    plain = df.select("sample_id", "step", F.lag("total_overlap", 5).over(w).alias("l"), F.lead("total_overlap", 2).over(w).alias("n"),
                      F.max("total_overlap").over(w.rowsBetween(-4, 2)).alias("m")).orderBy("sample_id", "step").collect()
    out = od.over_halo(df, ["sample_id"], "step", {
        "l": lambda v: F.lag("total_overlap", 5).over(v), "n": lambda v: F.lead("total_overlap", 2).over(v),
        "m": lambda v: F.max("total_overlap").over(v.rowsBetween(-4, 2))}, before=5, after=2, block=block)
    assert out.select("sample_id", "step", "l", "n", "m").orderBy("sample_id", "step").collect() == plain


@pytest.mark.parametrize("block", [3, 50])
def test_running_totals_and_maxima_across_blocks(spark, block):
    df = both(spark)
    w = Window.partitionBy("sample_id").orderBy("step")
    flag = F.when(F.col("total_overlap") > 0.9, F.col("step"))
    plain = df.select("sample_id", "step", F.count(flag).over(w).alias("s"), F.max(flag).over(w).alias("m"),
                      F.max(flag).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("x")).orderBy("sample_id", "step").collect()
    out = od.running(df, ["sample_id"], "step", {"s": F.when(flag.isNotNull(), 1).otherwise(0)}, block)
    out = od.running_max(out, ["sample_id"], "step", {"m": flag}, block)
    out = od.running_max(out, ["sample_id"], "step", {"x": flag}, block, inclusive=False)
    assert out.select("sample_id", "step", "s", "m", "x").orderBy("sample_id", "step").collect() == plain


def test_numbers_are_consecutive_per_key(spark):
    df = spark.range(5000).select((F.col("id") % 1000 == 0).alias("rare"), F.xxhash64("id").alias("v"), "id")
    w = Window.partitionBy("rare").orderBy("v", "id")
    want = df.withColumn("step", F.row_number().over(w).cast("long") - 1)
    got = od.number_rows(df, ["rare"], ["v", "id"])
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == 5000


def plain_equilibrium(values, m):
    events, due = [], m
    for step in range(len(values)):
        if step > due:
            last = -(-m // 2)
            if any(values[k] > values[k - 1] for k in range(max(step - last + 1, 1), step + 1)):
                m += step - due - 1
                due = step + m
                events.append((step, m, due))
    return events


@pytest.mark.parametrize("scan", [1, 3, 1 << 10])
def test_original_criterion_equals_the_plain_loop(spark, monkeypatch, scan):
    monkeypatch.setattr(tm, "SCAN", scan)
    rng = np.random.default_rng(7)
    # long falls between bursts, so that the wait grows
    values = np.cumsum(np.where((np.arange(700) // 60) % 3 == 0, rng.standard_normal(700), -0.01)) + 50
    falling = list(range(100, 0, -1))
    df = series(spark, values).unionByName(series(spark, falling, "b"))
    got = [(r.step, r.m, r.next_change) for r in tm.equilibrium_original(df, 5).where("sample_id = 'a'").orderBy("step").collect()]
    assert got == plain_equilibrium(values, 5) and len(got) > 3
    assert tm.equilibrium_original(df, 5).where("sample_id = 'b'").isEmpty()


def test_original_criterion_of_many_runs_in_small_batches(spark):
    rng = np.random.default_rng(11)
    runs = {f"run{k}": np.cumsum(np.where(rng.random(n) < p, 1.0, -0.1)) for k, (n, p) in enumerate(
        [(1, 0.5), (2, 0.5), (6, 1.0), (400, 1.0), (400, 0.0), (900, 0.01), (900, 0.05), (900, 0.2), (2000, 0.1), (2000, 0.5)])}
    df = spark.createDataFrame([(key, k, float(v)) for key, values in runs.items() for k, v in enumerate(values)],
                               "sample_id string, step bigint, total_overlap double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for m in (1, 2, 5, 10):
            got = sorted((r.sample_id, r.step, r.m, r.next_change) for r in tm.equilibrium_original(df, m).collect())
            assert got == sorted((key, *e) for key, values in runs.items() for e in plain_equilibrium(values, m))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_original_criterion_of_no_runs(spark):
    assert tm.equilibrium_original(spark.createDataFrame([], "sample_id string, step bigint, total_overlap double"), 5).isEmpty()


def test_savgol_is_the_local_quadratic(spark):
    rng = np.random.default_rng(3)
    y = rng.random(60)
    got = [r.smoothed for r in tm.savgol(series(spark, y), "total_overlap").orderBy("step").collect()]
    want = []
    for k in range(60):
        c = min(max(k, 20), 39)
        x = np.arange(c - 20, c + 21)
        want.append(np.polyval(np.polyfit(x - c, y[x], 2), k - c))
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n", [3, 4, 9, 40, 41, 42, 5000])
def test_savgol_of_any_length(spark, n):
    y = np.random.default_rng(n).random(n) * 100
    got = [r.smoothed for r in tm.savgol(series(spark, y), "total_overlap").orderBy("step").collect()]
    m = (min(41, n - (1 - n % 2)) - 1) // 2
    at = [min(max(k, m), n - 1 - m) for k in range(n)]
    fits = {c: np.polyfit(np.arange(-m, m + 1), y[c - m: c + m + 1], 2) for c in set(at)}
    assert got == pytest.approx([np.polyval(fits[c], k - c) for k, c in enumerate(at)], abs=1e-9)


def test_savgol_of_a_missing_value(spark):
    gap = series(spark, range(100)).withColumn("total_overlap", F.when(F.col("step") != 50, F.col("total_overlap")))
    got = [r.smoothed for r in tm.savgol(gap, "total_overlap").orderBy("step").collect()]
    assert [k for k, x in enumerate(got) if x is None] == list(range(30, 71))


@pytest.mark.parametrize("block", [4, 16, 1 << 17])
def test_running_totals_of_scattered_ids(spark, block):
    rng = np.random.default_rng(5)
    ids = np.unique(rng.integers(-2**62, 2**62, 300))
    values = rng.integers(0, 50, len(ids))
    df = spark.createDataFrame([("a" if k % 3 else "b", int(i), int(v)) for k, (i, v) in enumerate(zip(ids, values))], "k string, id long, v long")
    total = {r.id: r.t for r in od.running(df, ["k"], "id", {"t": F.col("v")}, block=block, sparse=True).collect()}
    most = {r.id: r.t for r in od.running_max(df, ["k"], "id", {"t": F.col("v")}, block=block, inclusive=False, sparse=True).collect()}
    for key in (0, 1):
        mine = [k for k in range(len(ids)) if (k % 3 == 0) == bool(key)]
        sums = np.cumsum(values[mine])
        assert [total[int(ids[k])] for k in mine] == list(sums)
        assert [most[int(ids[k])] for k in mine] == [None, *np.maximum.accumulate(values[mine])[:-1]]


def test_savgol_leaves_short_series(spark):
    assert [r.smoothed for r in tm.savgol(series(spark, [3, 1]), "total_overlap").orderBy("step").collect()] == [3, 1]
    assert [round(r.smoothed, 9) for r in tm.savgol(series(spark, [3, 1, 2, 9]), "total_overlap").orderBy("step").collect()][:3] == [3, 1, 2]


def test_stagnation_needs_every_change_small(spark):
    values = [100.0] * 520
    values[515] = 200.0
    hit = [r.step for r in tm.stagnation(series(spark, values)).where("stagnant").collect()]
    assert sorted(hit) == list(range(501, 515))


def test_common_steps_of_an_interrupted_run(spark):
    rows = [("a", p, s) for p, n in ((0, 3), (1, 2)) for s in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, particle_id bigint, step bigint")
    assert tm.cut_common_steps(df).count() == 4


def test_offset_of_a_lone_particle_is_opposite(spark, boxes, disks):
    rows = tm.rve_offset(disks([(0.5, 0.9, 0.2)]), boxes(1, 1), 2).collect()
    got = {r.axis: round(r.offset, 9) % 1 for r in rows}
    assert got == {"x": 0.0, "y": 0.4}


def test_offset_falls_back_to_the_widest_gap(spark, boxes, disks):
    rows = tm.rve_offset(disks([(0.2, 0.5, 0.45), (0.7, 0.5, 0.45)]), boxes(1, 1), 2).collect()
    assert {r.axis: r.free for r in rows} == {"x": False, "y": True}


def delivered(spark, tmp_path, monitor, *parts, late="300 days"):
    """What a monitor gives of deliveries, a trigger each; every step is an hour."""
    source, out, offsets = (str(tmp_path / name) for name in ("steps", "out", "offsets"))
    for part in parts:
        timed = part.withColumn("ts", F.timestamp_seconds(1_700_000_000 + 3600 * F.col("step")))
        timed.write.mode("append").parquet(source)
        events = mo.monitored(spark.readStream.schema(timed.schema).parquet(source), monitor, late)
        mo.run_to_end(events, out, offsets)
    return [tuple(r) for r in spark.read.schema(events.schema).parquet(out).collect()]


def test_monitor_in_pieces_equals_the_batch_rule(spark, tmp_path):
    df = both(spark, 120).withColumn("ratio", F.col("total_overlap") * 2)
    # late halves first, overlapping, and one step in three later still
    parts = [df.where("step >= 60 AND step % 3 <> 0"), df.where("step < 62 AND step % 3 <> 0"), df.where("step % 3 = 0 OR step > 100")]
    found = delivered(spark, tmp_path, mo.run_monitor(0.6, 2, 4, 60.0), *parts)
    legal = tm.legal_streak(df, 0.6, 2).where("ends").select("sample_id", "step", F.lit("finished").alias("event"), "streak").collect()
    assert sorted(x for x in found if x[2] == "finished") == sorted(tuple(r) for r in legal)
    still = tm.stagnation(df, 4, 60.0).where("stagnant").collect()
    assert sorted((x[0], x[1]) for x in found if x[2] == "failed") == sorted((r.sample_id, r.step) for r in still)


def test_a_lost_step_is_given_up_once_the_watermark_has_passed(spark, tmp_path):
    df = series(spark, [5.0, 4.0, 3.0, 2.0, 9.0, 9.5, 1.0, 0.5]).withColumn("ratio", F.lit(2.0))
    monitor = mo.equilibrium_monitor(1)
    waiting = delivered(spark, tmp_path, monitor, df.where("step IN (0, 1, 4)"), df.where("step = 5"), late="1 hour")
    assert waiting == []
    # step 7 moves the watermark past steps 4 and 5; 2 and 3 come too late
    found = delivered(spark, tmp_path, monitor, df.where("step = 7"), df.where("step IN (2, 3)"), late="1 hour")
    assert sorted(r[1] for r in found) == [4, 5]


def test_streamed_criterion_equals_the_plain_loop(spark, tmp_path):
    values = np.cumsum(np.where(np.random.default_rng(5).random(300) < 0.15, 1.0, -0.1))
    df = series(spark, [float(v) for v in values]).withColumn("ratio", F.lit(None).cast("double"))
    found = delivered(spark, tmp_path, mo.equilibrium_monitor(7, m=4), df.where("step % 2 = 1"), df.where("step % 2 = 0"))
    assert sorted(r[1] for r in found if r[2] == "original") == [e[0] for e in plain_equilibrium(values, 4)]
    assert sorted(r[1] for r in found if r[2] == "rolling") == [k for k in range(7, 300) if values[k] > values[k - 7]]
    assert not [r for r in found if r[2] == "ratio"]


def test_ratio_of_pairs(spark):
    rows = [("a", 0, 1, 0, 1.0), ("a", 0, 1, 1, 3.0), ("a", 0, 2, 0, 5.0), ("a", 0, 2, 1, 1.0), ("a", 0, 1, 2, 3.0), ("a", 0, 2, 2, 1.0), ("a", 0, 1, 3, 4.0), ("a", 0, 2, 3, 1.0)]
    df = spark.createDataFrame(rows, "sample_id string, i bigint, j bigint, step bigint, overlap double")
    assert [(r.step, r.ratio) for r in tm.overlap_ratio(df).orderBy("step").collect()] == [(1, 0.5), (2, 1.0), (3, 1e12)]


def test_zero_overlaps_are_no_error(spark, tmp_path):
    df = series(spark, [0.0, 0.0, 1.0, 1.0, 1.0, 0.0])
    assert tm.stagnation(df, 2, 1.0).where("stagnant").count() == 1
    found = delivered(spark, tmp_path, mo.run_monitor(-1.0, 9, 2, 1.0), df)
    assert [(r[1], r[2]) for r in found] == [(4, "failed")]
