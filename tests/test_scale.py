import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packstat.functions import ordered
from packstat.llm import quality
from packstat.operators import sampling
from packstat.operators import spatial as sp
from packstat.operators import voxel as vx
from packstat.plans import io_queries
from packstat.sources import runs


def tree(df):
    """Lines of the physical plan with their depths."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [(len(x) - len(x.lstrip(" :+-")), x) for x in lines]


def broadcast_unfolded(df):
    """Whether rows multiplied by an explode go to a broadcast."""
    plan = tree(df)
    for k, (depth, line) in enumerate(plan):
        if line.lstrip(" :+-").startswith("BroadcastExchange"):
            for below, x in plan[k + 1:]:
                if below <= depth:
                    break
                if "Generate " in x:
                    return True
    return False


@pytest.fixture
def small(spark):
    """Particles and samples that Spark's estimates call small, however many they become."""
    k = F.col("id")
    p = spark.range(300).select(F.floor(k / 100).cast("long").alias("sample_id"), (k % 100).alias("particle_id"), F.lit("1").alias("phase"),
                                F.lit("Disk").alias("shape"), (k * 37 % 101 / 101).alias("cx"), (k * 53 % 97 / 97).alias("cy"), F.lit(0.05).alias("r"))
    s = spark.range(3).select(k.alias("sample_id"), F.lit(2).alias("dim"), F.lit(1.0).alias("lx"), F.lit(1.0).alias("ly"), F.lit(None).cast("double").alias("lz"),
                              F.lit(True).alias("periodic"), F.lit("3").alias("matrix_phase"))
    return p, s


def test_unfolded_rows_are_not_broadcast(spark, small):
    p, s = small
    moved = p.withColumn("cx", F.col("cx") + F.when(F.col("particle_id") % 7 == 0, 0.1).otherwise(0.0))
    leavers = sp.left_neighborhood(p, moved, s, 2)
    points = spark.range(3000).select((F.col("id") % 3).alias("sample_id"), F.col("id").alias("point_id"), (F.col("id") * 31 % 89 / 89).alias("x"), (F.col("id") * 7 % 83 / 83).alias("y"))
    specs = s.select("sample_id", F.lit("1").alias("phase"), F.lit("a").alias("name"), F.lit("uniform").alias("distribution"),
                     F.create_map(F.lit("low"), F.lit(0.0), F.lit("high"), F.lit(1.0)).alias("params"),
                     F.lit(None).cast("array<double>").alias("values"), F.lit(None).cast("array<double>").alias("probabilities"))
    rows = s.select("sample_id", F.lit("1").alias("phase"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("k"))
    for df in (sp.neighbor_candidates(p, s, 2), sp.overlaps(p, s, 2), sp.refresh_neighbors(sp.verlet_neighbors(p, s, 2), leavers, moved, s, 2),
               sp.points_in_particles(points, p, s, 2), sampling.draw(rows, specs), ordered.running(rows, ["sample_id"], "k", {"t": F.col("k")})):
        assert not broadcast_unfolded(df)


def test_rows_are_not_taken_for_the_smaller_side(small):
    p, s = small
    for df in (sp.neighbor_candidates(p, s, 2), sp.overlaps(p, s, 2)):
        plan = df._jdf.queryExecution().optimizedPlan()
        # facts of samples are read with the size of their file, not with a product of sizes
        assert "HashAggregate" not in df._jdf.queryExecution().executedPlan().toString() and plan.stats().sizeInBytes() > 0


def test_points_are_thrown_where_the_pair_is(small):
    p, s = small
    plan = tree(sampling.overlap_volume_mc(p, s, 2, 7, 1))
    at = next(k for k, (_, x) in enumerate(plan) if "Generate explode(" in x and "k#" in x.split("[")[-1])
    depth = plan[at][0]
    for above, x in reversed(plan[:at]):
        if above < depth:
            depth = above
            assert "Exchange" not in x
            if "Join" in x:
                break


def test_short_rows_that_unfold_stay_spread(spark, small):
    _, s = small
    grids = s.select("sample_id", F.lit(4).cast("long").alias("nx"), F.lit(3).cast("long").alias("ny"), F.lit(2).cast("long").alias("nz"))
    cells = vx.grid_cells_of(grids, 3)
    assert cells.count() == cells.distinct().count() == 72
    assert "REPARTITION_BY_NUM" in cells._jdf.queryExecution().executedPlan().toString()


def test_archives_are_packed_and_read_a_few_at_a_time(spark):
    whole = pd.DataFrame({"sample_id": range(200), "overlaps": [np.arange(5.0) * k for k in range(200)]})
    parts = list(io_queries._pack(iter([whole])))
    assert max(len(x) for x in parts) <= 64 and sum(len(x) for x in parts) == 200
    rows = [(int(r.sample_id), bytes(r.content)) for x in parts for r in x.itertuples()] + [(300, None), (301, b""), (302, b"PK broken")]
    t = runs.unpack_runs(spark.createDataFrame(rows, "sample_id long, content binary"))
    assert t["runs"].count() == 200 and t["runs"].where("seconds = 1.25 AND max_residue IS NULL").count() == 200
    steps = {(r.sample_id, r.step): (r.total_overlap, r.kinetic, r.thermic, r.dt) for r in t["run_steps"].collect()}
    assert len(steps) == 1000 and steps[7, 2] == (14.0, 7.0, 4.5, None) and steps[3, 2] == (6.0, 3.0, None, None)
    assert t["paths"].count() == 2000


def test_rare_languages_and_no_language_are_judged(spark):
    rng = np.random.default_rng(9)
    en, es = quality.COMMON["en"] + ["lantern", "meadow"], quality.COMMON["es"] + ["farol", "prado"]
    odd = [f"zq{k}x" for k in range(40)]
    tags = [("en", en)] * 30 + [("es", es)] * 10 + [("es", en)] + [(None, en)] * 3 + [(None, odd)]
    rows = [(i, " ".join(rng.choice(words, 300)), tag) for i, (tag, words) in enumerate(tags)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, kept in sorted(got.items()) if not kept] == [40, 44]
    alone = quality.judge(spark.createDataFrame([(1, rows[0][1], None)], "doc_id long, text string, lang string")).collect()
    assert [r.kept for r in alone] == [True]
