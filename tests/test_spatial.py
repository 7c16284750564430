import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packstat.operators import convex, sampling
from packstat.operators import spatial as sp
from packstat.operators import voronoi as vo


def cloud(n, seed, radii):
    rng = np.random.default_rng(seed)
    return [(x, y, r) for x, y, r in zip(rng.random(n), rng.random(n), rng.choice(radii, n))]


def brute(rows, lx=1.0, ly=1.0):
    out = set()
    for i, (x, y, r) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            dx, dy = rows[j][0] - x, rows[j][1] - y
            d = math.hypot(dx - lx * round(dx / lx), dy - ly * round(dy / ly))
            if d < r + rows[j][2]:
                out.add((i, j))
    return out


@pytest.mark.parametrize("radii", [[0.02], [0.002, 0.01, 0.3], [0.45], [0.001, 0.2]])
def test_pairs_equal_brute_force_for_any_mix_of_sizes(boxes, disks, radii):
    rows = cloud(150, 3, radii)
    got = {(r.i, r.j) for r in sp.neighbor_candidates(disks(rows), boxes(1, 1), 2).collect()}
    assert got == brute(rows)


def test_salted_cells_give_the_same_pairs(boxes, disks, monkeypatch):
    rows = cloud(200, 5, [0.05])
    monkeypatch.setattr(sp, "CELL_LOAD", 1)
    out = sp.neighbor_candidates(disks(rows), boxes(1, 1), 2).collect()
    assert len(out) == len({(r.i, r.j) for r in out})
    assert {(r.i, r.j) for r in out} == brute(rows)


def test_long_box_and_unwrapped_centres(boxes, disks):
    rows = [(x * 3 - 1, y, r) for x, y, r in cloud(120, 8, [0.05, 0.1])]
    got = {(r.i, r.j) for r in sp.neighbor_candidates(disks(rows), boxes(3, 1), 2).collect()}
    assert got == brute(rows, 3.0, 1.0)


def test_nearest_neighbor_golden(boxes, disks):
    p = disks([(0.05, 0.5, 0.02), (0.95, 0.5, 0.02), (0.5, 0.5, 0.02), (0.5, 0.8, 0.02)])
    got = {r.particle_id: round(r.nn, 9) for r in sp.nearest_neighbor(p, boxes(1, 1), 2).collect()}
    assert got == {0: 5.0, 1: 5.0, 2: 15.0, 3: 15.0}


def test_lone_particle_has_no_neighbor(boxes, disks):
    assert sp.nearest_neighbor(disks([(0.5, 0.5, 0.1)]), boxes(1, 1), 2).first().nn == float("inf")


def test_isolated_particles_are_found_past_the_first_ring(boxes, disks):
    rows = [(0.001 * k, 0.001 * (k % 7), 0.001) for k in range(60)] + [(0.6, 0.6, 0.001)]
    far = {r.particle_id: r.d for r in sp.nearest(disks(rows), boxes(1, 1), 2).collect()}[60]
    want = min(math.hypot(*[d - round(d) for d in (x - 0.6, y - 0.6)]) for x, y, _ in rows[:60])
    assert far == pytest.approx(want)


def test_k_nearest_with_fewer_particles_than_k(boxes, disks):
    out = sp.nearest(disks([(0.1, 0.1, 0.1), (0.2, 0.1, 0.1), (0.9, 0.1, 0.1)]), boxes(1, 1), 2, 5).collect()
    assert len(out) == 6


def test_coincident_centres_push_along_the_first_axis(boxes, disks):
    row = sp.overlaps(disks([(0.5, 0.5, 0.1), (0.5, 0.5, 0.2)]), boxes(1, 1), 2).first()
    assert (round(row.length, 9), row.ux, row.uy) == (0.3, 1.0, 0.0)


def test_points_in_hot_cells_are_salted(spark, boxes, disks, monkeypatch):
    monkeypatch.setattr(sp, "CELL_LOAD", 4)
    p = disks([(0.5, 0.5, 0.3), (0.05, 0.95, 0.1)])
    rng = np.random.default_rng(2)
    xy = rng.random((400, 2))
    pts = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(xy)],
                                "sample_id string, point_id bigint, x double, y double")
    got = sorted((r.point_id, r.particle_id) for r in sp.points_in_particles(pts, p, boxes(1, 1), 2).collect())
    want = []
    for j, (cx, cy, r) in enumerate([(0.5, 0.5, 0.3), (0.05, 0.95, 0.1)]):
        d = xy - [cx, cy]
        d -= np.round(d)
        want += [(k, j) for k in np.flatnonzero(np.hypot(*d.T) <= r)]
    assert got == sorted(want)


def mixed(spark):
    rows = [("a", 0, "1", "Square", 0.3, 0.3, None, 0.2, None, None, None), ("a", 1, "1", "Disk", 0.45, 0.3, 0.1, None, None, None, None),
            ("a", 2, "1", "Ellipse", 0.3, 0.5, None, None, 0.3, 0.1, 0.7), ("a", 3, "1", "Disk", 0.9, 0.9, 0.1, None, None, None, None),
            ("a", 4, "1", "Ellipse", 0.35, 0.55, None, None, 0.2, 0.1, -0.3)]
    return spark.createDataFrame(rows, "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, "
                                 "r double, side double, major_axis double, minor_axis double, angle double")


def test_exact_depth_is_the_least_over_directions(spark, boxes):
    p = mixed(spark)
    got = {(r.i, r.j): r.length for r in sp.overlaps(p, boxes(1, 1), 2, "exact").collect()}
    assert got[0, 1] == pytest.approx(0.05, abs=1e-9)
    rows = {r.particle_id: r for r in p.collect()}
    t = np.linspace(0, 2 * np.pi, 20001)

    def width(r):
        if r.shape == "Disk":
            return np.full_like(t, r.r)
        if r.shape == "Square":
            return r.side / 2 * (abs(np.cos(t)) + abs(np.sin(t)))
        return np.hypot(r.major_axis / 2 * np.cos(t - r.angle), r.minor_axis / 2 * np.sin(t - r.angle))

    for i in rows:
        for j in rows:
            if i < j:
                d = np.array([rows[j].cx - rows[i].cx, rows[j].cy - rows[i].cy])
                d -= np.round(d)
                depth = np.min(width(rows[i]) + width(rows[j]) - d[0] * np.cos(t) - d[1] * np.sin(t))
                assert (got.get((i, j), 0) == pytest.approx(max(depth, 0), abs=1e-7))


def test_a_mixed_table_gives_every_pair_by_default(spark, boxes):
    p = mixed(spark)
    closed, exact = ({(r.i, r.j): r.length for r in sp.overlaps(p, boxes(1, 1), 2, how).collect()} for how in ("closed", "exact"))
    assert closed and closed == pytest.approx(exact, abs=1e-9)


def test_shared_areas_of_a_mixed_table(spark, boxes):
    p = mixed(spark)
    names = [c for c in p.columns if c not in ("sample_id", "particle_id")]
    areas = {(r.i, r.j): r.size for r in convex.overlap_areas(sp.near_pairs(p, boxes(1, 1), 2, sp.radius(p), names)).collect()}
    got = {(r.i, r.j): r.size for r in sp.overlap_sizes(p, boxes(1, 1), 2).collect()}
    assert got and got == pytest.approx(areas, rel=1e-4)


def test_slender_cylinders_have_the_depth_of_a_dense_search(spark, boxes):
    rng = np.random.default_rng(4)
    rows = [("a", k, "1", "Cylinder", 0.5 + x, 0.5 + y, 0.5 + z, 0.01, 0.6, a, q) for k, (x, y, z, a, q) in enumerate(
        np.column_stack([0.02 * rng.standard_normal((12, 3)), 2 * np.pi * rng.random(12), np.pi * rng.random(12)]).tolist())]
    p = spark.createDataFrame(rows, "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, cz double, "
                              "r_cyl double, length double, azimuth_angle double, polar_angle double")
    got = {(r.i, r.j): r.length for r in sp.overlaps(p, boxes(1, 1, 1), 3).collect()}
    framed = {r.particle_id: r for r in sp.framed(p, 3).collect()}
    u = rng.standard_normal((400_000, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)

    def width(r):
        along = u @ np.array([r.m11, r.m12, r.m13])
        return 0.3 * abs(along) + 0.01 * np.sqrt(np.maximum(1 - along ** 2, 0))

    for i in framed:
        for j in framed:
            if i < j:
                a, b = framed[i], framed[j]
                depth = np.min(width(a) + width(b) - u @ np.array([b.cx - a.cx, b.cy - a.cy, b.cz - a.cz]))
                assert got.get((i, j), 0) <= max(depth, 0) + 1e-9
                assert got.get((i, j), 0) >= depth - 6e-3


def test_nesting_looks_at_shapes_and_not_at_their_balls(spark, boxes):
    rows = [("a", 0, None, "Ellipse", 0.5, 0.5, None, 0.4, 0.05, 0.3, None), ("a", 1, 0, "Disk", 0.5, 0.5, 0.1, None, None, None, None),
            ("a", 2, 0, "Disk", 0.5, 0.5, 0.02, None, None, None, None), ("a", 3, 0, "Ellipse", 0.5, 0.5, None, 0.3, 0.03, 0.3, None),
            ("a", 4, 0, "Ellipse", 0.5, 0.5, None, 0.3, 0.03, 1.3, None), ("a", 5, 0, "Square", 0.5, 0.5, None, None, None, None, 0.03)]
    p = spark.createDataFrame(rows, "sample_id string, particle_id bigint, parent_id bigint, shape string, cx double, cy double, r double, "
                              "major_axis double, minor_axis double, angle double, side double")
    row = sp.inside_outer(p, boxes(1, 1), 2).first()
    assert (row.children, row.whole) == (5, 3)


def test_a_child_takes_less_than_half_of_what_is_left(spark):
    # volumes in squares: the parent has 1; phase 4 has its own remainder
    rows = [("a", 0, None, "1", 1.0), ("a", 900, 0, "3", 0.49 ** 0.5), ("a", 7, 0, "3", 0.4 ** 0.5), ("a", 1 << 40, 0, "3", 0.05 ** 0.5),
            ("a", 8, 0, "4", 0.49 ** 0.5), ("a", 9, 0, "4", 0.26 ** 0.5), ("a", 10, 77, "3", 0.1), ("b", 1, 0, "3", 0.1),
            ("c", 0, None, "1", 0.0), ("c", 1, 0, "3", 0.1)]
    p = spark.createDataFrame(rows, "sample_id string, particle_id bigint, parent_id bigint, phase string, side double").selectExpr(
        "*", "'Square' AS shape", "0.5D AS cx", "0.5D AS cy")
    got = {(r.sample_id, r.particle_id): (r.left, r.fits) for r in sp.nested_remainder(p, 2).collect()}
    assert got.pop(("c", 1))[1] is False
    assert {k: v[1] for k, v in got.items()} == {("a", 7): True, ("a", 900): False, ("a", 1 << 40): True,
                                                ("a", 8): True, ("a", 9): False}
    assert got["a", 900][0] == pytest.approx(0.6) and got["a", 1 << 40][0] == pytest.approx(0.11) and got["a", 9][0] == pytest.approx(0.51)
    assert sp.nested_remainder(p.where("false"), 2).isEmpty()


def test_exact_is_never_deeper_than_along_the_centres(spark, boxes):
    p = mixed(spark)
    exact = {(r.i, r.j): r.length for r in sp.overlaps(p, boxes(1, 1), 2, "exact").collect()}
    approx = {(r.i, r.j): r.length for r in sp.overlaps(p, boxes(1, 1), 2, "approx").collect()}
    assert exact and all(v <= approx[k] + 1e-12 for k, v in exact.items())


def test_area_by_strips_of_disks_is_the_lens(boxes, disks):
    p = disks([(0.4, 0.5, 0.2), (0.6, 0.5, 0.15)])
    pairs = sp.near_pairs(p, boxes(1, 1), 2, sp.radius(p), ["shape", "r"])
    strips, closed = convex.overlap_areas(pairs).first().size, sp.overlap_sizes(p, boxes(1, 1), 2).first().size
    assert strips == pytest.approx(closed, rel=1e-5)


def test_area_by_strips_of_a_square_and_a_contained_ellipse(spark, boxes):
    p = mixed(spark).where("particle_id IN (0, 2)").withColumn("cx", F.lit(0.5)).withColumn("cy", F.lit(0.5)).withColumn(
        "major_axis", F.col("major_axis") / 2)
    names = [c for c in p.columns if c not in ("sample_id", "particle_id")]
    area = convex.overlap_areas(sp.near_pairs(p, boxes(1, 1), 2, sp.radius(p), names)).first().size
    assert area == pytest.approx(math.pi * 0.15 * 0.1 / 4, rel=1e-5)


def test_monte_carlo_volume_within_its_error(boxes, disks):
    p = disks([(0.4, 0.5, 0.2), (0.6, 0.5, 0.15)])
    row = sampling.overlap_volume_mc(p, boxes(1, 1), 2, 4000, seed=3, tolerance=1e-3).first()
    assert row.size == pytest.approx(sp.overlap_sizes(p, boxes(1, 1), 2).first().size, abs=3 * row.error)
    assert row.error <= 1e-3


def test_thinning_is_the_sequential_rule(boxes, disks):
    rows = cloud(250, 11, [0.03, 0.06])
    kept = []
    for j in range(len(rows)):
        if not brute([rows[k] for k in kept] + [rows[j]]) - brute([rows[k] for k in kept]):
            kept.append(j)
    got = sorted(r.particle_id for r in sampling.thin_by_arrival(disks(rows), boxes(1, 1), 2).collect())
    assert got == kept


def test_thinning_to_targets(spark, boxes, disks):
    rows = cloud(200, 12, [0.03])
    p = disks(rows).withColumn("phase", F.when(F.col("particle_id") % 2 == 0, "1").otherwise("2"))
    targets = spark.createDataFrame([("1", 0, 20, None), ("2", 1, None, 0.03)], "phase string, phase_order int, n long, vf double")
    out = sampling.thin_by_arrival(p, boxes(1, 1), 2, targets).orderBy("particle_id").collect()
    kept, area = [], 0.0
    for phase, n, vf in ((0, 20, 9), (1, 10 ** 9, 0.03)):
        count, area = 0, 0.0
        for j in range(phase, len(rows), 2):
            if count >= n or area >= vf:
                break
            if not brute([rows[k] for k in kept] + [rows[j]]):
                kept.append(j)
                count, area = count + 1, area + math.pi * 0.03 ** 2
    assert [r.particle_id for r in out] == sorted(kept)


def test_refreshed_list_sees_every_new_pair(boxes, disks):
    rows = cloud(120, 21, [0.02, 0.05])
    now = [(x + (0.2 if k % 5 == 0 else 0.0), y, r) for k, (x, y, r) in enumerate(rows)]
    before, after, s = disks(rows), disks(now), boxes(1, 1)
    leavers = sp.left_neighborhood(before, after, s, 2, 1.1)
    got = {(r.i, r.j) for r in sp.refresh_neighbors(sp.verlet_neighbors(before, s, 2, 1.1), leavers, after, s, 2, 1.1).collect()}
    big = [(x, y, r * 1.1) for x, y, r in now]
    assert {p for p in brute(big) if p[0] % 5 == 0 or p[1] % 5 == 0} <= got


@pytest.mark.parametrize("dim, k", [(2, 1), (2, 4), (3, 1)])
def test_nearest_in_crowds(spark, dim, k):
    """Half of the particles in a millionth of the box; no particle meets many more than the k it looks for."""
    rng, n = np.random.default_rng(dim), 3000
    x = rng.random((n, dim))
    x[: n // 2] = 0.4 + x[: n // 2] * 1e-6 ** (1 / dim)
    rows = [(0, i, *map(float, c)) for i, c in enumerate(x)] + [(1, 0, *[0.5] * dim), (2, 0, *[0.1] * dim), (2, 1, *[0.9] * dim)]
    names = ", ".join(f"c{a} double" for a in "xyz"[:dim])
    particles = spark.createDataFrame(rows, f"sample_id long, particle_id long, {names}").repartition(5)
    samples = spark.createDataFrame([(s, *[1.0] * dim) for s in (0, 1, 2)], "sample_id long, " + ", ".join(f"l{a} double" for a in "xyz"[:dim]))
    got = {(r.sample_id, r.particle_id, r["rank"]): (r.other_id, r.d) for r in sp.nearest(particles, samples, dim, k).collect()}
    assert not any(s == 1 for s, _, _ in got) and got[2, 0, 1][0] == 1
    d = x[:, None] - x[None]
    d = np.sqrt(((d - np.rint(d)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :k]
    assert np.allclose([[got[0, i, j + 1][1] for j in range(k)] for i in range(n)], want, rtol=1e-9, atol=0)
    rings = {r.particle_id: r._ring for r in sp.local_reach(particles, samples, dim, k).where("sample_id = 0").collect()}
    met = (d <= np.array([rings[i] for i in range(n)])[:, None]).sum(axis=1)
    assert (met >= k).all() and met.mean() < 30 * k


def test_voronoi_cells_beside_a_crowd_gather_few(spark):
    rng = np.random.default_rng(5)
    x = rng.random((1500, 2))
    x[:1000] = 0.4 + x[:1000] * 0.01
    seeds = spark.createDataFrame([(0, i, *map(float, c)) for i, c in enumerate(x)], "sample_id long, seed_id long, x double, y double")
    samples = spark.createDataFrame([(0, 1.0, 1.0)], "sample_id long, lx double, ly double")
    edges = vo.voronoi_2d(seeds, samples)
    assert edges.selectExpr("round(sum(d / 2 * length) / 2, 9) AS a", "count_if(NOT closed) AS o").first()[:] == (1.0, 0)
