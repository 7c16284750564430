import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packstat.operators import stats as st
from packstat.operators import voronoi as vo


def share(spark, x, y, r, lx, ly):
    cols = [F.lit(float(v)) for v in (x, y, r, lx, ly)]
    return spark.range(1).select(st.disk_share(*cols).alias("s")).first().s


def test_edge_correction_of_known_disks(spark):
    assert share(spark, 0.5, 0.85, 0.2, 1, 1.7) == pytest.approx(1)
    assert share(spark, 0, 0, 0.2, 1, 1.7) == pytest.approx(0.25)
    r, d = 0.3, 0.2
    segment = r * r * math.acos(d / r) - d * math.sqrt(r * r - d * d)
    assert share(spark, d, 0.85, r, 1, 1.7) == pytest.approx(1 - segment / (math.pi * r * r))


def test_ripley_equals_its_definition(boxes, disks):
    rng = np.random.default_rng(4)
    rows = [(x, y, 0.02) for x, y in 0.05 + 0.9 * rng.random((40, 2))]
    out = st.ripley_k(disks(rows), boxes(1, 1), 10, 4).orderBy("t").collect()
    xy = np.array(rows)[:, :2]
    low = xy.min(0) - 0.02
    side = xy.max(0) + 0.02 - low
    xy = xy - low
    want = np.zeros(40)
    for i in range(40):
        for j in range(40):
            if i != j:
                d = math.hypot(*(xy[i] - xy[j]))
                # the share of the circle's disk in the box, by many points of a fine polar grid
                corner = lambda w, h: corner_area(d, w, h)
                inside = sum(corner(w, h) for w in (xy[i][0], side[0] - xy[i][0]) for h in (xy[i][1], side[1] - xy[i][1]))
                want[np.arange(40) * 0.02 / 4 > d] += math.pi * d * d / inside / 40
    want *= side.prod() / 40
    assert [r.k for r in out] == pytest.approx(want.tolist(), abs=1e-5)
    assert out[0].k == 0 and all(a.k <= b.k for a, b in zip(out, out[1:]))


def corner_area(r, w, h, n=4000):
    x = (np.arange(n) + 0.5) * min(w, r) / n
    return float(np.sum(np.minimum(np.sqrt(np.maximum(r * r - x * x, 0)), h)) * min(w, r) / n)




def test_equal_values_make_one_bin(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5, "sample_id string, v double")
    rows = st.histogram(df, ["sample_id"], "v", 10).collect()
    assert [(round(r.lo, 9), round(r.hi, 9), r.n) for r in rows] == [(1.9, 2.1, 5)]


def test_two_point_at_zero_is_the_fraction(boxes, disks):
    p, s = disks([(0.3, 0.3, 0.15), (0.98, 0.8, 0.12)]), boxes(1, 1)
    out = {r.sep: r.s2 for r in st.two_point(p, s, st.random_points(s, 4000, 2, 1), 2, [0.0, 1.0]).collect()}
    assert out[0] == pytest.approx(math.pi * (0.15 ** 2 + 0.12 ** 2), abs=0.02)
    assert out[1] <= out[0]


def test_two_point_in_three_dimensions_needs_a_direction(boxes, disks):
    with pytest.raises(ValueError):
        st.two_point(disks([(0.3, 0.3, 0.15)]), boxes(1, 1, 1), boxes(1, 1, 1), 3, [0.0])


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 10, 2.0 ** -10])
def test_cells_of_a_long_box_tile_it_in_any_units(spark, boxes, disks, scale):
    p = disks([(0.3 * scale, 0.3 * scale, 0.08), (0.8 * scale, 0.7 * scale, 0.08), (1.3 * scale, 0.4 * scale, 0.08),
               (1.7 * scale, 0.8 * scale, 0.08), (1.1 * scale, 0.1 * scale, 0.08)])
    edges = vo.voronoi_2d(vo.seeds_of(p, 2), boxes(2 * scale, scale))
    cells = vo.cells_2d(vo.closed_cells(edges)).collect()
    assert len(cells) == 5
    assert sum(c.area for c in cells) == pytest.approx(2 * scale * scale)


def test_one_seed_has_the_box_for_a_cell(boxes, disks):
    row = vo.cells_2d(vo.voronoi_2d(vo.seeds_of(disks([(0.3, 0.6, 0.1)]), 2), boxes(1, 1))).first()
    assert (row.n_edges, round(row.area, 9), round(row.perimeter, 9)) == (4, 1.0, 4.0)


def test_clustered_seeds_still_tile_the_box(boxes, disks):
    rng = np.random.default_rng(6)
    rows = [(*(0.5 + 0.004 * rng.standard_normal(2)), 0.001) for _ in range(120)] + [(0.1, 0.1, 0.001), (0.9, 0.8, 0.001)]
    cells = vo.cells_2d(vo.voronoi_2d(vo.seeds_of(disks(rows), 2), boxes(1, 1))).collect()
    assert sum(c.area for c in cells) == pytest.approx(1.0)


def test_cells_of_the_union_are_set_cells(boxes, disks):
    p, s = disks([(0.25, 0.25, 0.1), (0.75, 0.25, 0.05), (0.25, 0.75, 0.08), (0.75, 0.75, 0.06)]), boxes(1, 1)
    edges = vo.set_voronoi_2d(p, s, 10)
    assert {r.particle_id for r in edges.select("particle_id").distinct().collect()} == {0, 1, 2, 3}
    assert edges.where("particle_id = neighbor_id AND image_x = 0 AND image_y = 0").isEmpty()


def spheres(spark, rows):
    return spark.createDataFrame([("a", k, "2", "Sphere", *map(float, r)) for k, r in enumerate(rows)],
                                 "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, cz double, r double")


def test_3d_cells_tile_the_box(spark, boxes):
    rng = np.random.default_rng(9)
    p = spheres(spark, [(*rng.random(3) * [2, 1, 1], 0.05) for _ in range(60)])
    cells = vo.cells_3d(vo.voronoi_3d(vo.seeds_of(p, 3), boxes(2, 1, 1))).collect()
    assert len(cells) == 60 and sum(c.volume for c in cells) == pytest.approx(2.0)


def test_one_3d_seed_has_the_box_for_a_cell(spark, boxes):
    facets = vo.voronoi_3d(vo.seeds_of(spheres(spark, [(0.5, 0.5, 0.5, 0.1)]), 3), boxes(1, 1, 1))
    assert vo.cells_3d(facets).first().volume == pytest.approx(1.0)
    q = vo.imt_3d(facets).first()
    assert (round(q.q_4, 4), round(q.q_6, 4), round(q.area, 9)) == (0.7638, 0.3536, 6.0)


def test_3d_cells_cut_together_are_those_cut_alone():
    rng = np.random.default_rng(4)
    lattice = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)], float)
    cells = [rng.normal(size=(n, 3)) * rng.random((n, 1)) for n in (5, 12, 30, 90, 400)] + [lattice, np.concatenate([lattice, 7 * rng.normal(size=(40, 3))]), np.abs(rng.normal(size=(50, 3)))]
    for k, (areas, radius, corners) in enumerate(vo._cells_3d(cells)):
        alone, far, _ = vo._cells_3d(cells[k:k + 1])[0]
        assert np.allclose(areas, alone, rtol=1e-9, atol=1e-12) and radius == pytest.approx(far) and (corners is None) == (radius == np.inf)
        if corners is not None:  # no bisector cuts a corner off, and the facets close the surface
            size = np.linalg.norm(cells[k], axis=1)
            assert (corners @ cells[k].T <= size**2 / 2 * (1 + 1e-6) + 1e-9).all()
            assert np.allclose((areas / size) @ cells[k], 0, atol=1e-8 * areas.sum())
    cube, _, corners = vo._cells_3d(cells)[5]
    assert np.allclose(np.sort(cube)[-6:], 1) and cube.sum() == pytest.approx(6)
    assert vo._cells_3d(cells)[7][2] is None


def test_structure_metrics_of_a_cube_do_not_turn_with_it(spark):
    a, b = 0.7, 0.3
    ra = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    rb = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    for m in (np.eye(3), ra @ rb):
        rows = [("a", 0, *map(float, s * m[:, k]), 1.0) for k in range(3) for s in (1, -1)]
        f = spark.createDataFrame(rows, "sample_id string, i bigint, nx double, ny double, nz double, area double")
        q = vo.imt_3d(f).first()
        assert [round(q[f"q_{k}"], 4) for k in range(1, 7)] == [0, 0, 0, 0.7638, 0, 0.3536]
        assert vo.imt_3d(f, unit_q0=True).first().q_0 == 1.0


def test_quantiles_of_any_spread(spark):
    rng = np.random.default_rng(2)
    values = {"even": rng.random(999), "spread": 10.0 ** rng.uniform(-300, 300, 500), "signs": rng.normal(size=400) * 2e307,
              "ties": rng.integers(0, 3, 700).astype(float), "hot": np.array([5.0] * 900 + [1.0, 9.0]), "near": 1 + rng.integers(0, 50, 300) * 2.0**-52,
              "one": np.array([4.0]), "ends": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(None, 7.0), ("even", None), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.k: r.quantiles for r in st.quantiles(df, ["k"], "v", at).collect()}
    assert set(got) == {*values, None} and got[None] == [7.0] * len(at)
    assert got["ends"] == [-np.inf, -np.inf, 1.0, 2.0, np.inf, np.inf, np.inf]
    for k, v in values.items():
        s = sorted(v)
        if k == "ends":
            continue
        want = [s[int(np.floor(p * (len(s) - 1)))] * (1 - p * (len(s) - 1) % 1) + s[int(np.ceil(p * (len(s) - 1)))] * (p * (len(s) - 1) % 1) for p in at]
        assert got[k] == pytest.approx(want, rel=1e-12), k
    assert st.quantiles(df.where("k = 'even'"), [], "v", [0.5]).first().quantiles == [pytest.approx(np.median(values["even"]))]
    assert st.quantiles(df.where("false"), ["k"], "v", [0.5]).isEmpty()
