import os
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packstat.operators import cells as ce
from packstat.operators import voronoi as vo
from packstat.plans import QUERIES
from packstat.session import shared_dir


def written(spark):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_dir(spark)) for f in files)


def seed_table(spark, dim, rows):
    return spark.createDataFrame([(s, i, *[None if c is None else float(c) for c in x]) for s, i, x in rows],
                                 "sample_id string, seed_id long, " + ", ".join(f"{a} double" for a in "xyz"[:dim]))


def box_table(spark, dim, sides):
    return spark.createDataFrame([(s, *map(float, x)) for s, x in sides.items()], "sample_id string, " + ", ".join(f"l{a} double" for a in "xyz"[:dim]))


def facets(spark, dim, rows, sides):
    df = (vo.voronoi_2d if dim == 2 else vo.voronoi_3d)(seed_table(spark, dim, rows), box_table(spark, dim, sides))
    return df.withColumnRenamed("length" if dim == 2 else "area", "size").toPandas()


def brute(x, i, sides, images=2):
    """Neighbours with facets of seed i among all images, by cutting with all of them."""
    moves = np.array(list(product(range(-images, images + 1), repeat=x.shape[1])))
    o = (x[None] + moves[:, None] * sides - x[i]).reshape(-1, x.shape[1])
    j, moved = np.tile(np.arange(len(x)), len(moves)), np.repeat(moves, len(x), axis=0)
    keep = np.linalg.norm(o, axis=1) > 0
    o, j, moved = o[keep], j[keep], moved[keep]
    if x.shape[1] == 2:
        lo, hi = vo._intervals(o)
        size = np.where(hi > lo, hi - lo, 0.0)
    else:
        size = vo._cells_3d([o])[0][0]
    return {(int(j[k]), *map(int, moved[k])): size[k] for k in np.flatnonzero(size > 1e-9)}


def spheres(spark, rows):
    return spark.createDataFrame([("a", k, "2", "Sphere", *map(float, r)) for k, r in enumerate(rows)],
                                 "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, cz double, r double")


def test_set_cells_of_spheres_tile_the_box_and_write_little(spark, boxes):
    rng = np.random.default_rng(17)
    p, s = spheres(spark, [(*rng.random(3), 0.03 + 0.001 * rng.integers(50)) for _ in range(60)]), boxes(1, 1, 1)
    before = written(spark)
    cells = vo.cells_3d(vo.voronoi_3d(vo._surface_seeds(p, 3, 3), s)).agg(F.sum("volume").alias("v"), F.count(F.lit(1)).alias("n")).first()
    assert written(spark) - before < 60 * 5 * 200
    assert cells.v == pytest.approx(1.0, abs=1e-9) and cells.n == vo._surface_seeds(p, 3, 3).count()


@pytest.mark.parametrize("dim", [2, 3])
def test_facets_by_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    sides = {"few": [1.0] * dim, "long": [3.0, 1.0, 1.0][:dim], "outside": [1.0] * dim, "crowd": [1.0] * dim, "lattice": [1.0] * dim}
    x = {"few": rng.random((3, dim)), "long": rng.random((25, dim)) * sides["long"], "outside": rng.random((40, dim)) * 1.4 - 0.2,
         "crowd": np.concatenate([0.4 + rng.random((20, dim)) * 0.01, rng.random((20, dim))]), "lattice": np.array(list(product((0, 0.25, 0.5, 0.75), repeat=dim)))}
    out = facets(spark, dim, [(s, i, c) for s in x for i, c in enumerate(x[s])], sides)
    assert out.closed.all()
    for s, at in x.items():
        own = out[(out.sample_id == s) & (out["size"] > 1e-9)]
        assert (own["size"] * own.d).sum() / (2 * dim) == pytest.approx(np.prod(sides[s]), rel=1e-9)
        for i in range(0, len(at), 1 if len(at) < 10 else 7):
            got = {tuple(map(int, k)): v for *k, v in own[own.i == i][["j", *[f"image_{a}" for a in "xyz"[:dim]], "size"]].to_numpy()}
            want = brute(at, i, np.array(sides[s]), 1 if s in ("crowd", "lattice") else 3 if dim == 2 else 2)
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-10) for k in want), (s, i)


@pytest.mark.parametrize("dim", [2, 3])
def test_tiles_of_a_large_sample_have_the_cells_of_the_whole(spark, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    crowd = rng.random((300, dim))
    crowd[:200] = 0.4 + crowd[:200] * 0.01
    crowd[250:255] = crowd[240]
    rows = [("even", i, c) for i, c in enumerate(rng.random((300, dim)) * 1.2 - 0.1)] + [("crowd", None if i == 220 else i, c) for i, c in enumerate(crowd)]
    rows += [("small", 0, [0.5] * dim), ("even", 900, [None] * dim), ("even", 901, [float("nan")] * dim)]
    sides = {"even": [1.0] * dim, "crowd": [1.0] * dim, "small": [1.0] * dim}
    key = ["sample_id", "i", "j", *[f"image_{a}" for a in "xyz"[:dim]], "size"]
    whole = facets(spark, dim, rows, sides)[key].sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(vo, "SAMPLE", 50)
    monkeypatch.setattr(vo, "STRETCH", 64)
    tiled = facets(spark, dim, rows, sides)[key].sort_values(key).reset_index(drop=True)
    whole, tiled = whole[whole["size"] > 1e-9].reset_index(drop=True), tiled[tiled["size"] > 1e-9].reset_index(drop=True)
    assert whole[key[:-1]].equals(tiled[key[:-1]]) and np.allclose(whole["size"], tiled["size"], rtol=1e-9, atol=1e-12)
    assert not whole.i.isna().any() and whole.j.isna().any() and not (whole.i >= 900).any()


def test_seeds_that_come_twice_have_a_facet_each(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, c) for i, c in enumerate(rng.random((20, 3)))]
    key = ["i", "j", "image_x", "image_y", "image_z"]
    once, twice = facets(spark, 3, rows, {"a": [1.0] * 3}), facets(spark, 3, rows + rows[:1], {"a": [1.0] * 3})
    n, m = once.groupby(key).size(), twice.groupby(key).size()
    assert n.index.equals(m.index) and (n == 1).all()
    assert all(m[k] == (2 if k[0] == 0 else 1) * (2 if k[1] == 0 else 1) for k in m.index)


@pytest.mark.parametrize("dim", [2, 3])
def test_torn_cells_are_cut_by_other_means(dim, monkeypatch):
    rng = np.random.default_rng(dim)
    x = np.where(np.arange(3) < dim, rng.random((12, 3)), 0.0)
    tile, ids = ce.Tile(x, np.arange(12), np.where(np.arange(3) < dim, 1.0, 0.0), dim), pa.array(range(12))
    key = ["i", "j", *[f"image_{a}" for a in "xyz"[:dim]]]
    want = next(vo._faces(pa.array(["a"]), [ids], [tile], dim)).to_pandas().sort_values(key).reset_index(drop=True)

    def torn(tiles):
        out = ce.cells_of(tiles, None)
        out[0].torn[::2] = True
        yield np.arange(len(tiles)), tiles, out

    monkeypatch.setattr(vo, "parts_of", torn)
    got = next(vo._faces(pa.array(["a"]), [ids], [tile], dim)).to_pandas().sort_values(key).reset_index(drop=True)
    assert got[key].equals(want[key]) and np.allclose(got.drop(columns=["sample_id"]), want.drop(columns=["sample_id"]), rtol=1e-7, atol=1e-10)


@pytest.mark.parametrize("dim, n", [(2, 150), (3, 300)])
def test_a_cell_of_many_neighbours_is_cut_alone(spark, dim, n):
    rng = np.random.default_rng(n)
    shell = rng.normal(size=(n, dim))
    x = 0.5 + np.concatenate([np.zeros((1, dim)), 0.2 * shell / np.linalg.norm(shell, axis=1)[:, None]])
    out = facets(spark, dim, [("a", i, c) for i, c in enumerate(x)], {"a": [1.0] * dim})
    assert (out["size"] * out.d).sum() / (2 * dim) == pytest.approx(1.0, rel=1e-9)
    own, want = out[out.i == 0], brute(x, 0, np.ones(dim), 0)
    assert len(want) > ce.MOST and {*own.j[own["size"] > 1e-9]} == {j for j, *_ in want} and own["size"].sum() == pytest.approx(sum(want.values()))
    tile = ce.Tile(np.pad(x, ((0, 0), (0, 3 - dim))), np.arange(n + 1), np.where(np.arange(3) < dim, 1.0, 0.0), dim)
    (_, _, many), *alone = ce.parts_of([tile])
    assert many[0].label.shape[1] <= 2 * ce.MOST and many[0].outgrown[0] and len(alone) == many[0].outgrown.sum()


def test_few_rows_around_a_tile_are_held(monkeypatch):
    rng = np.random.default_rng(8)
    n = 5000
    x = rng.random((n, 3))
    own = (np.abs(x - 0.5) < 0.1).all(axis=1)
    x, own = x[np.argsort(~own, kind="stable")], np.sort(own)[::-1]
    rows = pa.table({"sample_id": ["a"] * n, "_tile": np.zeros(n, int), "_own": own, "seed_id": np.arange(n), **{a: x[:, k] for k, a in enumerate("xyz")}, **{f"l{a}": np.ones(n) for a in "xyz"}})
    key = ["i", "j", "image_x", "image_y", "image_z"]

    def cut():
        group, = vo._groups(iter(rows.to_batches(max_chunksize=500)), 3)
        group = group.combine_chunks()
        out = next(vo._faces(pa.array(["a"]), [group.column("seed_id").combine_chunks()], [vo._tile(group, 3)], 3))
        return group.num_rows, out.to_pandas().sort_values(key).reset_index(drop=True)

    held, want = cut()
    monkeypatch.setattr(vo, "HELD", 600)
    fewer, got = cut()
    assert held == n and fewer < 1500 and got[key].equals(want[key]) and np.allclose(got.area, want.area, rtol=1e-9, atol=1e-12)


#: Tables that a query may write on the way, in bytes a particle.
LITTLE = {"voronoi_3d_volumes": 400, "imt_3d_of_cells": 400, "voronoi_crowded_3d_volumes": 400, "set_voronoi_2d": 600}


@pytest.mark.parametrize("name", LITTLE)
def test_queries_of_cells_write_no_neighbours(spark, tmp_path, name):
    keys = range(400)
    spark.createDataFrame([(k, 1 + k * 7 % 50) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    before = written(spark)
    out = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert written(spark) - before < LITTLE[name] * len(keys)
    if name.endswith("volumes"):
        assert sorted(out.sample_id) == [0, 1, 2, 3] and (out.cells == 100).all() and (out.volume == 1).all()
    else:
        assert len(out) == len(keys) and not out.isna().any().any()
