import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packstat.functions.shapes import by_shape
from packstat.operators import geometry as g


def ellipses(spark, rows):
    return spark.createDataFrame([("a", k, "2", "Ellipse", *map(float, r)) for k, r in enumerate(rows)],
                                 "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, "
                                 "major_axis double, minor_axis double, angle double")


def test_disk_crossing_a_face_is_not_interior(boxes, disks):
    p = disks([(0.3, 0.3, 0.15), (0.98, 0.8, 0.12)])
    assert [r.particle_id for r in g.interior_particles(p, boxes(1, 1), 2).collect()] == [0]
    assert [r.particle_id for r in g.crossing_particles(p, boxes(1, 1), 2).collect()] == [1]


def test_boundary_removal(boxes, disks):
    p = disks([(0.02, 0.5, 0.05), (0.98, 0.5, 0.05), (0.5, 0.01, 0.05), (0.5, 0.5, 0.05), (0.3, 0.7, 0.05)])
    assert sorted(r.particle_id for r in g.interior_particles(p, boxes(1, 1), 2).collect()) == [3, 4]


def test_dilation_undone_gives_the_ellipse_back(spark):
    p = ellipses(spark, [(0.3, 0.35, 0.15, 0.1, 0.4), (0.95, 0.75, 0.3, 0.05, -0.9)])
    grown = g.dilate(p, 0.01)
    back = g.contract(grown, 0.01).orderBy("particle_id").collect()
    assert [(round(r.major_axis, 10), round(r.minor_axis, 10), round(r.delta, 12)) for r in back] == [(0.15, 0.1, 0), (0.3, 0.05, 0)]
    for row in grown.collect():
        a, b = (0.15, 0.1) if row.particle_id == 0 else (0.3, 0.05)
        roots = np.roots([a + b, a * b, -(a + b) * 1e-4, -((a + b) / 2) ** 2 * 1e-4])
        assert row.inflation == pytest.approx(max(roots.real[abs(roots.imag) < 1e-9]), abs=1e-10)


def test_slender_ellipse_cannot_be_contracted(spark):
    p = ellipses(spark, [(0.5, 0.5, 0.4, 0.3, 0.0), (0.5, 0.5, 0.4, 0.001, 0.0)])
    bad = g.contraction_problems(g.contract(p, 0.05)).collect()
    for row in bad:
        assert row.particle_id == 1


def test_real_volume_is_without_the_dilation(spark):
    p = g.dilate(ellipses(spark, [(0.3, 0.35, 0.15, 0.1, 0.4)]), 0.02)
    row = g.with_volume(p, 2).first()
    assert row.real_volume == pytest.approx(math.pi * 0.15 * 0.1 / 4)
    assert row.volume > row.real_volume


def test_cylinder_sizes_take_a_length_with_a_fraction_first(spark):
    spec = spark.createDataFrame([("Cylinder", 1.0, 1.0, 1.0, 0.2, 0.1, 10.0, 0.05)],
                                 "shape string, lx double, ly double, lz double, length double, vf double, n double, r_cyl double")
    row = g.resolve_sizes(spec).first()
    assert row.r_cyl == pytest.approx(math.sqrt(0.1 / (0.2 * math.pi * 10)))


def test_ellipsoid_axis_from_tilt_and_azimuth(spark):
    x, y, z, angle = g.angles_to_axis(F.lit(0.4), F.lit(1.1))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z"), angle.alias("t")).first()
    ry = np.array([[math.cos(0.4), 0, -math.sin(0.4)], [0, 1, 0], [math.sin(0.4), 0, math.cos(0.4)]])
    rz = np.array([[math.cos(1.1), -math.sin(1.1), 0], [math.sin(1.1), math.cos(1.1), 0], [0, 0, 1]])
    m = rz @ ry
    assert row.t == pytest.approx(math.acos((np.trace(m) - 1) / 2))
    assert (row.x, row.y, row.z) == pytest.approx((m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]))


def test_support_lies_on_the_extent(spark):
    p = ellipses(spark, [(0.3, 0.35, 0.15, 0.1, 0.4)])
    top = g.support(g.with_extents(p, 2), [F.lit(0.0), F.lit(1.0)]).first()
    assert top.sy == pytest.approx(top.hi_y)


def test_cylinder_support_along_its_axis_is_the_cap_centre(spark):
    p = spark.createDataFrame([("a", 0, "2", "Cylinder", 0.5, 0.5, 0.5, 0.1, 0.4, 0.0, 0.0)],
                              "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, cz double, "
                              "r_cyl double, length double, azimuth_angle double, polar_angle double")
    row = g.support(p, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]).first()
    assert (row.sx, row.sy, row.sz) == pytest.approx((0.5, 0.5, 0.7))


def test_scale_keeps_angles_and_ratios(spark, boxes):
    p = ellipses(spark, [(0.3, 0.35, 0.15, 0.1, 0.4)])
    q, s = g.scaled(p, boxes(4, 2), 2)
    row = q.first()
    assert (row.major_axis, row.angle, s.first().ly) == (0.075, 0.4, 1.0)


def test_containment_includes_the_rim(spark, disks):
    p = disks([(0.5, 0.5, 0.25)]).withColumn("x", F.lit(0.75)).withColumn("y", F.lit(0.5))
    inside = by_shape(p, lambda s, c: s.contains(c, [F.col("x") - F.col("cx"), F.col("y") - F.col("cy")]))
    assert p.select(inside.alias("i")).first().i
