"""Particles, points, run histories and specifications derived from the driver tables.

Integer arithmetic only, so another engine derives the same rows from the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packstat.functions.hashing import u2, u3, u4
from packstat.functions.ordered import number_rows

PER_SAMPLE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(key: Column, by: int) -> Column:
    return F.floor(key / by).cast("long")


def samples(spark: SparkSession, sf_dir: str, dim: int = 2) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lz = F.lit(1.0 if dim == 3 else None).cast("double")
    return (part.select(_div(F.col("p_partkey"), PER_SAMPLE).alias("sample_id")).distinct()
            .select("sample_id", F.lit(dim).alias("dim"), F.lit(1.0).alias("lx"), F.lit(1.0).alias("ly"),
                    lz.alias("lz"), F.lit(True).alias("periodic"), F.lit("3").alias("matrix_phase")))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _div(key, PER_SAMPLE).alias("sample_id"), (key % PER_SAMPLE).alias("particle_id"),
        F.when(F.col("p_size") % 3 == 0, "2").otherwise("1").alias("phase"),
        u2(key).alias("cx"), u3(key).alias("cy"), u4(key).alias("cz"),
        (F.lit(0.015) + F.lit(0.0005) * F.col("p_size")).alias("r"),
        F.col("p_size").alias("size"), key.alias("key"),
    )


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).select(
        "sample_id", "particle_id", "phase", F.lit("Disk").alias("shape"), "cx", "cy", "r")


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).select(
        "sample_id", "particle_id", "phase", F.lit("Sphere").alias("shape"), "cx", "cy", "cz",
        (F.col("r") * 2).alias("r"))


def crowded(particles: DataFrame, dim: int) -> DataFrame:
    """Every other particle moved into about a thousandth of the box; powers of two, so that other engines get the same."""
    axes, scale = ("x", "y", "z")[:dim], {2: 1 / 32, 3: 1 / 8}[dim]
    inside = F.col("particle_id") % 2 == 0
    return particles.withColumns({f"c{a}": F.when(inside, F.lit(0.25) + F.col(f"c{a}") * scale).otherwise(F.col(f"c{a}")) for a in axes})


def _sized(shape: str, column: str, value: Column) -> Column:
    return F.when(F.col("shape") == shape, value).alias(column)


def mixed_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks, squares and ellipses by key, with per-shape null sizes."""
    kind = F.col("key") % 3
    shape = F.when(kind == 0, "Disk").when(kind == 1, "Square").otherwise("Ellipse")
    r = F.col("r")
    return (_seeded(spark, sf_dir).withColumn("shape", shape)
            .select("sample_id", "particle_id", "phase", "shape", "cx", "cy",
                    _sized("Disk", "r", r), _sized("Square", "side", 2 * r),
                    _sized("Ellipse", "major_axis", 3 * r), _sized("Ellipse", "minor_axis", 2 * r),
                    _sized("Ellipse", "angle", 2 * F.pi() * F.col("cz"))))


def mixed_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spheres, ellipsoids and cylinders by key."""
    kind = F.col("key") % 3
    shape = F.when(kind == 0, "Sphere").when(kind == 1, "Ellipsoid").otherwise("Cylinder")
    r, turn = F.col("r") * 2, 2 * F.pi() * F.col("cx")
    return (_seeded(spark, sf_dir).withColumn("shape", shape)
            .select("sample_id", "particle_id", "phase", "shape", "cx", "cy", "cz",
                    _sized("Sphere", "r", r),
                    _sized("Ellipsoid", "axis_1", 3 * r), _sized("Ellipsoid", "axis_2", 2 * r),
                    _sized("Ellipsoid", "axis_3", 1.5 * r), _sized("Ellipsoid", "rot_x", F.col("cx") + 0.5),
                    _sized("Ellipsoid", "rot_y", F.col("cy") + 0.5), _sized("Ellipsoid", "rot_z", F.col("cz") + 0.5),
                    _sized("Ellipsoid", "angle", turn),
                    _sized("Cylinder", "r_cyl", r), _sized("Cylinder", "length", 3 * r),
                    _sized("Cylinder", "azimuth_angle", turn),
                    _sized("Cylinder", "polar_angle", F.pi() * F.col("cy"))))


def fibers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fibres whose axis is a function of the sample, so that each sample has one axis."""
    return _seeded(spark, sf_dir).select(
        "sample_id", "particle_id", "phase", F.lit("CylindricalFiber").alias("shape"),
        "cx", "cy", "r", (F.col("sample_id") % 3).cast("int").alias("direction"))


def one_sample(particles: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same rows as one huge sample, sizes shrunk so that the area fraction stays."""
    total = particles.agg(F.count(F.lit(1)).alias("_n")).scalar()
    merged = (particles
              .withColumn("particle_id", F.col("sample_id") * PER_SAMPLE + F.col("particle_id"))
              .withColumn("sample_id", F.lit(0).cast("long"))
              .withColumn("r", F.col("r") * F.sqrt(F.lit(float(PER_SAMPLE)) / total)))
    return merged, samples.where("sample_id = 0")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points spread over the samples by key; x, y, z in the unit box."""
    n = table(spark, sf_dir, "part").agg((F.floor(F.max("p_partkey") / PER_SAMPLE) + 1).cast("long").alias("_n")).scalar()
    key = F.col("point_id")
    return (table(spark, sf_dir, "lineitem")
            .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id")).distinct()
            .select((key % n).alias("sample_id"), "point_id",
                    u2(key).alias("x"), u3(key).alias("y"), u4(key).alias("z")))


def run_steps(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """Histories from the event stream: a run per ``by`` value, a step per event in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col(by).alias("sample_id"), "ts", "event_id", F.col("value").alias("total_overlap"))
    steps = number_rows(events, ["sample_id"], ["ts", "event_id"], "step")
    # powers of two, so that the derived energies are exact in any engine
    return steps.select("sample_id", "step", "ts", "total_overlap",
                        (F.col("total_overlap") * 0.5).alias("kinetic"),
                        F.when(F.col("step") > 0, F.col("total_overlap") * 0.25 + 1).alias("thermic"),
                        (F.lit(1.0) / (1 + F.col("step") % 7)).alias("dt"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories: a particle per user, a step per event, a hashed walk in the unit box."""
    steps = run_steps(spark, sf_dir)
    key = F.col("sample_id") * 1000 + F.col("step")
    return steps.select((F.col("sample_id") % 10).alias("sample_id"), F.col("sample_id").alias("particle_id"),
                        "step", u2(key).alias("x"), u3(key).alias("y"), "dt")


def pair_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse overlap histories of the pairs (i, j): a row where the pair overlapped."""
    steps = run_steps(spark, sf_dir)
    return (steps.select((F.col("sample_id") % 5).alias("sample_id"),
                         F.floor(F.col("sample_id") / 5).cast("long").alias("i"),
                         (F.floor(F.col("sample_id") / 5) + 1 + F.col("sample_id") % 3).cast("long").alias("j"),
                         "step", F.col("total_overlap").alias("overlap"))
            .where("step % 4 <> 2"))
