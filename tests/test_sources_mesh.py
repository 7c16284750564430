import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from packstat.operators import mesh as ms
from packstat.operators import rules as ru
from packstat.operators import sampling as sa
from packstat.operators import voxel as vx
from packstat.sources import corpus as co
from packstat.sources import runs as rn
from packstat.sources import tables as tb

DOCUMENT = """{
  "format": "some-microstructure",
  "version": 1,
  "rve_dims": [1.0, 2.0],
  "dim": 2,
  "periodic": true,
  "matrix_phase": "1",
  "provenance": {"generated": "2024-05-06T07:08:09Z", "achieved_volume_fraction": 0.25},
  "phases": {
    "1": {"type": "Matrix", "type_code": 1, "inner_phase": false, "outer_phase": null},
    "2": {"type": "Ellipse", "type_code": 3, "inner_phase": false, "outer_phase": null, "descriptors": {"n": {"distribution": "fixed", "value": 2}, "angle": {"distribution": "discrete", "values": [0.0, 1.0], "probabilities": [0.5, 0.4]}}}
  },
  "particles": [
    {"id": 0, "phase": "2", "shape": "Ellipse", "center": [0.3, 0.35], "major_axis": 0.15, "minor_axis": 0.1, "angle": 0.4},
    {"id": 1, "phase": "2", "shape": "Ellipse", "center": [0.95, NaN], "major_axis": 0.15, "minor_axis": 0.1, "angle": -0.9, "parent_id": 0}
  ]
}
"""


def test_documents_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "sample_id=good").mkdir()
    (tmp_path / "sample_id=good" / "mic.json").write_text(DOCUMENT)
    (tmp_path / "sample_id=odd").mkdir()
    (tmp_path / "sample_id=odd" / "mic.json").write_text(DOCUMENT.replace('"version": 1', '"version": 7'))
    t = co.read_corpus(spark, str(tmp_path))
    s = t["samples"].collect()
    assert [(r.sample_id, r.dim, r.lx, r.ly, r.lz, r.matrix_phase, r.achieved_vf) for r in s] == [("good", 2, 1.0, 2.0, None, "1", 0.25)]
    assert str(s[0].generated) == "2024-05-06 07:08:09"
    p = t["particles"].orderBy("particle_id").collect()
    assert [(r.cx, r.cy, r.major_axis, r.angle, r.parent_id) for r in p] == [(0.3, 0.35, 0.15, 0.4, None), (0.95, None, 0.15, -0.9, 0)]
    assert t["phases"].count() == 2
    assert ru.distribution_problems(t["descriptors"]).first().message == "probabilities do not add up to one"
    got = {(r.sample_id, r.location) for r in t["problems"].collect()}
    assert got == {("odd", "version"), ("good", "particles.1")}


def test_written_documents_are_json_and_number_their_particles(spark, tmp_path, boxes):
    import json

    p = spark.createDataFrame([("a", 10 * k, "2", "Sphere", 0.1 * k, 0.2, 0.3, 0.05, 10 * (k - 1) if k else None) for k in range(5)],
                              "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, cz double, r double, parent_id bigint")
    phases = spark.createDataFrame([("a", "9", "Matrix", False, None), ("a", "2", "Sphere", False, None)],
                                   "sample_id string, phase string, type string, inner_phase boolean, outer_phase string")
    co.write_corpus({"samples": boxes(1, 1, 1), "phases": phases, "particles": p}, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "sample_id=a").glob("part-*"))
    document = json.loads("".join(x.read_text() for x in parts))
    assert [r["id"] for r in document["particles"]] == [0, 1, 2, 3, 4]
    assert [r.get("parent_id") for r in document["particles"]] == [None, 0, 1, 2, 3]
    assert document["rve_dims"] == [1.0, 1.0, 1.0] and document["phases"]["2"]["type_code"] == 4
    back = co.read_corpus(spark, str(tmp_path / "out"))["particles"]
    assert sorted(round(r.cx, 9) for r in back.collect()) == [0.0, 0.1, 0.2, 0.3, 0.4]


def test_run_archives(spark, tmp_path):
    raw = io.BytesIO()
    np.savez(raw, step=3, time=1.5, status=True, max_residue=1e-6, total_overlap_history=[3.0, 2, 1], kinetic_energy_history=[0.5, 0.4, 0.3],
             thermic_energy_history=[0.1, 0.2], all_dt=[1.0, 1.0], temp_change_steps=[0, 2], ratio=[1.2],
             position_center_history=np.arange(12.0).reshape(2, 3, 2))
    (tmp_path / "sample_id=a").mkdir()
    (tmp_path / "sample_id=a" / "state.npz").write_bytes(raw.getvalue())
    t = rn.read_runs(spark, str(tmp_path))
    assert tuple(t["runs"].first()) == ("a", 3, 1.5, True, 1e-6)
    steps = t["run_steps"].orderBy("step").collect()
    assert [(r.total_overlap, r.kinetic, r.thermic, r.ratio) for r in steps] == [(3, 0.5, None, None), (2, 0.4, 0.1, None), (1, 0.3, 0.2, 1.2)]
    assert sorted(r.step for r in t["temp_changes"].collect()) == [0, 2]
    assert t["paths"].where("particle_id = 1 AND step = 2").select("x", "y", "z").first() == (10.0, 11.0, None)


def test_status_files(spark, tmp_path):
    for name, text in (("mic_0", "Time: 1.250s\nOverlap: 1.000e-05\nStatus: True\nMesh voxel: written\n"), ("mic_1", "Time: none\nStatus: None\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "status").write_text(text)
    got = sorted(tuple(r) for r in rn.read_status(spark, str(tmp_path)).collect())
    assert got == [("mic_0", 1.25, 1e-05, True, 1), ("mic_1", None, None, None, 0)]


def test_image_pixels(spark, tmp_path):
    # a bitmap of 3 x 2 pixels, rows from the bottom, blue-green-red, padded to four bytes
    rows = [[(0, 0, 255), (0, 0, 0), (9, 8, 7)], [(1, 2, 3), (4, 5, 6), (255, 255, 255)]]
    body = b"".join(b"".join(bytes(p) for p in row) + b"\0" * 3 for row in reversed(rows))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + body)
    got = {(r.px, r.py): r.value for r in rn.image_pixels(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 255, (1, 0): 0, (2, 0): 7, (0, 1): 3, (1, 1): 6, (2, 1): 255}


def test_ragged_rows(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4]), (3, [5, 6])], "k int, v array<int>")
    flat, offsets = tb.flatten_ragged(df, [], ["k"], "v")
    assert [r.value for r in flat.orderBy("position").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.offset for r in offsets.orderBy("row").collect()] == [0, 3, 3, 4]


def grid(spark, boxes, dim):
    s = boxes(1, 1, 1) if dim == 3 else boxes(1, 1)
    g = spark.createDataFrame([("a", 3, 2, 4)], "sample_id string, nx long, ny long, nz long")
    return s, ms.grid_nodes(g, s, dim)


@pytest.mark.parametrize("dim, faces, edges, corners", [(2, 1 + 2, 0, 3), (3, 1 * 3 + 2 * 3 + 2 * 1, 3 * (2 + 1 + 3), 7)])
def test_a_regular_grid_conforms(spark, boxes, dim, faces, edges, corners):
    s, nodes = grid(spark, boxes, dim)
    c = ms.classify_nodes(nodes, s, dim)
    pairs = ms.pair_boundary_nodes(c, dim)
    got = {r.kind: r["count"] for r in pairs.groupBy("kind").count().collect()}
    assert (got["face"], got.get("edge", 0), got["corner"]) == (faces, edges, corners)
    assert ms.conformity(c, ms.unmatched_nodes(c, pairs, dim), dim).first().is_conforming


def test_a_moved_node_is_reported(spark, boxes):
    s, nodes = grid(spark, boxes, 2)
    moved = nodes.withColumn("y", F.when((F.col("x") > 0.99) & F.col("y").between(0.1, 0.9), F.col("y") + 1e-3).otherwise(F.col("y")))
    c = ms.classify_nodes(moved, s, 2)
    row = ms.conformity(c, ms.unmatched_nodes(c, ms.pair_boundary_nodes(c, 2), 2), 2).first()
    assert not row.is_conforming and row.mismatch == "direction x: 3 nodes on x- and 3 on x+, 1 without a partner"


def test_measures_of_hexahedra_and_tetrahedra(spark, boxes):
    s, nodes = grid(spark, boxes, 3)
    g = spark.createDataFrame([("a", 3, 2, 4)], "sample_id string, nx long, ny long, nz long")
    voxels = vx.grid_cells_of(g, 3).withColumn("phase", F.lit("1"))
    measures = ms.cell_measures(nodes, ms.grid_cells(voxels, g, 3))
    assert {round(r.measure, 12) for r in measures.collect()} == {round(1 / 24, 12)}
    assert ms.fill_check(measures, nodes, s, 3).first().fills


def test_later_particles_win_voxels_and_wrap(spark, boxes, disks):
    p = disks([(0.0, 0.5, 0.3), (0.1, 0.5, 0.1)]).withColumn("phase", (F.col("particle_id") + 1).cast("string"))
    g = spark.createDataFrame([("a", 10, 10)], "sample_id string, nx long, ny long")
    got = {(r.ix, r.iy): r.phase for r in vx.voxelize(p, boxes(1, 1), g, 2).collect()}
    assert len(got) == 100 and got[9, 5] == "1" and got[0, 5] == "2" and got[5, 0] == "9"


def test_draws_have_their_moments(spark):
    rows = spark.range(1, 20001).select(F.lit("a").alias("sample_id"), F.lit("1").alias("phase"), F.col("id").alias("k"))
    spec = [("a", "1", "n", "normal", {"mean": 2.0, "sigma": 3.0}), ("a", "1", "l", "lognormal", {"mean": 2.0, "sigma": 0.5}),
            ("a", "1", "v", "vonmises", {"kappa": 4.0, "loc": 0.5, "scale": 1.0})]
    d = spark.createDataFrame(spec, "sample_id string, phase string, name string, distribution string, params map<string,double>"
                              ).withColumn("values", F.lit(None).cast("array<double>")).withColumn("probabilities", F.lit(None).cast("array<double>"))
    out = {r.name: r for r in sa.draw(rows, d, 1).groupBy("name").agg(
        F.avg("value").alias("m"), F.stddev("value").alias("s"), F.median("value").alias("q"), F.avg(F.cos(F.col("value") - 0.5)).alias("c")).collect()}
    assert out["n"].m == pytest.approx(2, abs=0.1) and out["n"].s == pytest.approx(3, abs=0.1)
    assert out["l"].q == pytest.approx(2, abs=0.05)
    # mean resultant length of kappa = 4: I1(4) / I0(4)
    assert out["v"].m == pytest.approx(0.5, abs=0.02) and out["v"].c == pytest.approx(0.8635, abs=0.01)
    assert sa.draw(rows, d, 1).exceptAll(sa.draw(rows, d, 1)).isEmpty()


def test_a_phase_that_cannot_be_filled_is_a_problem(spark, boxes):
    d = spark.createDataFrame([("a", "1", "r", "fixed", {"value": 0.001}), ("a", "1", "vf", "fixed", {"value": 0.5})],
                              "sample_id string, phase string, name string, distribution string, params map<string,double>"
                              ).withColumn("values", F.lit(None).cast("array<double>")).withColumn("probabilities", F.lit(None).cast("array<double>"))
    phases = spark.createDataFrame([("a", "1")], "sample_id string, phase string")
    volume = F.pi() * F.col("r") * F.col("r")
    done, problems = sa.populate(phases, d, boxes(1, 1), ["r"], volume, max_particles=500)
    assert done.isEmpty() and problems.count() == 1
    done, problems = sa.populate(phases, d, boxes(1, 1), ["r"], volume)
    assert done.count() == 159155 and problems.isEmpty()
    done, problems = sa.populate(phases, d, boxes(1, 1), ["r"], 0 * F.col("r"))
    assert done.isEmpty() and problems.count() == 1


def test_one_irregular_document_is_cut_over_many_splits(spark, tmp_path):
    import gzip
    import json

    from packstat.sources import structure as st

    n = 1500
    odd = 'a "quoted" } name, {[ back\\slash'
    phases = {"1": {"type": "Matrix", "type_code": 1}, odd: {"type": "Disk", "type_code": 2, "descriptors": {"r": {"distribution": "fixed", "value": 2}}}}
    head = {"format": "some-microstructure", "version": 1, "rve_dims": [1.0, 2.0], "dim": 2, "periodic": True, "matrix_phase": "1",
            "provenance": {"note": "}{][ \\", "deep": {"a": [{"b": 1}, [2]]}}, "extra": [{"phases": {"x": {}}}, 5]}
    rows = [{"id": k, "phase": odd, "shape": "Disk", "center": [k / n, 0.5], "r": 0.25 + k, **({"meta": {"x": {"y": [k]}}} if k % 7 == 0 else {})}
            for k in range(n)]
    compact = json.dumps({**head, "phases": phases, "particles": rows})
    first = json.dumps({"particles": rows, **head, "phases": phases})
    mixed = json.dumps({**head, "phases": phases, "particles": rows}, indent=2).replace("},\n    {", "},{", 200)
    texts = {"compact": compact, "first": first, "mixed": mixed, "torn": compact[:-1], "twice": compact + compact, "open": compact[: len(compact) // 2]}
    for name, text in texts.items():
        (tmp_path / f"sample_id={name}").mkdir()
        (tmp_path / f"sample_id={name}" / "mic.json").write_text(text)
    (tmp_path / "sample_id=parts").mkdir()
    at = [0, len(mixed) // 3, len(mixed) // 2, len(mixed)]
    for k in range(3):
        (tmp_path / "sample_id=parts" / f"part-{k}.json").write_text(mixed[at[k]: at[k + 1]])
    (tmp_path / "sample_id=packed").mkdir()
    (tmp_path / "sample_id=packed" / "mic.json.gz").write_bytes(gzip.compress(compact.encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        share = st.read_pieces(spark, str(tmp_path), co._sample_of).where("sample_id = 'compact'").groupBy("_block").agg(
            F.sum(F.octet_length("value") + 1).alias("n")).collect()
        assert len(share) > 10 and max(r.n for r in share) < 8192 + 400
        t = co.read_corpus(spark, str(tmp_path))
        got = t["particles"].groupBy("sample_id").agg(F.count("*").alias("n"), F.countDistinct("particle_id").alias("d"), F.sum("r").alias("r"),
                                                      F.min("phase").alias("a"), F.max("phase").alias("z")).collect()
        assert {tuple(r) for r in got} == {(s, n, n, sum(r["r"] for r in rows), odd, odd) for s in ("compact", "first", "mixed", "packed", "parts")}
        assert {tuple(r) for r in t["phases"].select("sample_id", "phase", "type").collect()} == {
            (s, p, v["type"]) for s in ("compact", "first", "mixed", "packed", "parts") for p, v in phases.items()}
        assert t["descriptors"].count() == 5
        assert {r.sample_id for r in t["problems"].where("message LIKE '%no document%'").collect()} == {"torn", "twice", "open"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_of_any_layout(spark, tmp_path):
    import json

    document = json.loads(DOCUMENT.replace("NaN", "0.5"))
    texts = {"compact": json.dumps(document), "two": json.dumps(document, indent=2), "four": json.dumps(document, indent=4),
             "tabs": json.dumps(document, indent="\t"), "cut": DOCUMENT[:700], "garbage": "no document",
             "pairs": DOCUMENT.replace("},\n    {\"id\": 1", "}, {\"id\": 1")}
    for name, text in texts.items():
        (tmp_path / f"sample_id={name}").mkdir()
        (tmp_path / f"sample_id={name}" / "mic.json").write_text(text)
    t = co.read_corpus(spark, str(tmp_path))
    good = {"compact", "two", "four", "tabs", "pairs"}
    assert {r.sample_id for r in t["samples"].where("lx = 1 AND ly = 2 AND dim = 2 AND periodic AND achieved_vf = 0.25").collect()} == good
    particles = t["particles"].groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("major_axis").alias("a"), F.max("parent_id").alias("p"))
    assert {(r.sample_id, r.n, round(r.a, 9), r.p) for r in particles.collect()} == {(n, 2, 0.3, 0) for n in good}
    assert {r.sample_id: r["count"] for r in t["phases"].groupBy("sample_id").count().collect()} == dict.fromkeys(good, 2)
    assert {r.sample_id for r in t["problems"].where("message LIKE '%no document%'").collect()} == {"cut", "garbage"}
