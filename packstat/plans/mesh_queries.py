"""Voxels, grids, periodic boundaries, constraints and cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from packstat.functions.hashing import u3
from packstat.operators import mesh as ms
from packstat.operators import stats as st
from packstat.operators import voxel as vx
from packstat.plans.geometry_queries import _FRAMES, _ROT
from packstat.plans.registry import query, r, rounded
from packstat.plans.sqlfix import sql, u
from packstat.sources import fixtures as fx


def _grids(spark, d, dim=2, n=(16, 12, 10)):
    return fx.samples(spark, d, dim).select("sample_id", *[F.lit(k).cast("long").alias(f"n{a}") for a, k in zip("xyz", n)][:dim])


# every voxel centre against every particle, the last holder wins
_VOX2 = """SELECT sample_id, ix, iy, coalesce((SELECT arg_max(m.phase, m.particle_id) FROM mixed2 m WHERE m.sample_id=s.sample_id AND
CASE m.shape WHEN 'Disk' THEN sqrt(pow(x-m.cx-round_even(x-m.cx,0),2)+pow(y-m.cy-round_even(y-m.cy,0),2))<=m.r
WHEN 'Square' THEN abs(x-m.cx-round_even(x-m.cx,0))<=m.side/2 AND abs(y-m.cy-round_even(y-m.cy,0))<=m.side/2
ELSE pow(((x-m.cx-round_even(x-m.cx,0))*cos(m.angle)+(y-m.cy-round_even(y-m.cy,0))*sin(m.angle))/(m.major_axis/2),2)
+pow((-(x-m.cx-round_even(x-m.cx,0))*sin(m.angle)+(y-m.cy-round_even(y-m.cy,0))*cos(m.angle))/(m.minor_axis/2),2)<=1+1e-8 END),'3') AS phase
FROM (SELECT sample_id, ix, iy, (ix+0.5e0)/16 AS x, (iy+0.5e0)/12 AS y FROM samples, generate_series(0,15) a(ix), generate_series(0,11) b(iy)) s"""
_V2 = dict(vox=_VOX2)


def _voxels(spark, d):
    return vx.voxelize(fx.mixed_2d(spark, d), fx.samples(spark, d), _grids(spark, d), 2)


@query(sql("SELECT * FROM vox", "samples", "mixed2", **_V2))
def voxelize(spark, d):
    return _voxels(spark, d)


_VOX3 = """SELECT sample_id, ix, iy, iz, coalesce((SELECT arg_max(m.phase, m.particle_id) FROM (SELECT *, x-cx-round_even(x-cx,0) AS dx,
y-cy-round_even(y-cy,0) AS dy, z-cz-round_even(z-cz,0) AS dz FROM shaped q WHERE q.sample_id=s.sample_id) m WHERE
CASE shape WHEN 'Sphere' THEN (dx*dx+dy*dy+dz*dz)/(r*r)-1<=1e-6 WHEN 'Ellipsoid' THEN pow((dx*m11+dy*m12+dz*m13)/(axis_1/2),2)
+pow((dx*m21+dy*m22+dz*m23)/(axis_2/2),2)+pow((dx*m31+dy*m32+dz*m33)/(axis_3/2),2)-1<=1e-6
ELSE abs(dx*m11+dy*m12+dz*m13)<=length/2 AND sqrt(greatest(dx*dx+dy*dy+dz*dz-pow(dx*m11+dy*m12+dz*m13,2),0))<r_cyl END),'3') AS phase
FROM (SELECT sample_id, ix, iy, iz, (ix+0.5e0)/16 AS x, (iy+0.5e0)/12 AS y, (iz+0.5e0)/10 AS z FROM samples,
generate_series(0,15) a(ix), generate_series(0,11) b(iy), generate_series(0,9) c(iz)) s"""


@query(sql("SELECT * FROM vox", "samples", "mixed3", frames=_FRAMES, rot=_ROT,
           shaped="SELECT rot.*, phase FROM rot JOIN (SELECT sample_id, particle_id, phase FROM mixed3) USING (sample_id, particle_id)",
           vox=_VOX3))
def voxelize_3d(spark, d):
    return vx.voxelize(fx.mixed_3d(spark, d), fx.samples(spark, d, 3), _grids(spark, d, 3), 3)


@query(sql("""SELECT sample_id, ix, iy, iz, coalesce((SELECT arg_max(f.phase, f.particle_id) FROM fibers f WHERE f.sample_id=s.sample_id AND
sqrt(pow(u-f.cx-round_even(u-f.cx,0),2)+pow(v-f.cy-round_even(v-f.cy,0),2))<=f.r),'3') AS phase FROM (SELECT sample_id, ix, iy, iz,
CASE WHEN sample_id%3=0 THEN (iy+0.5e0)/12 ELSE (ix+0.5e0)/16 END AS u, CASE WHEN sample_id%3=2 THEN (iy+0.5e0)/12 ELSE (iz+0.5e0)/10 END AS v
FROM samples, generate_series(0,15) a(ix), generate_series(0,11) b(iy), generate_series(0,9) c(iz)) s""", "samples", "fibers"))
def voxelize_fibers(spark, d):
    return vx.voxelize_fibers(fx.fibers(spark, d), fx.samples(spark, d, 3), _grids(spark, d, 3))


@query(sql("""SELECT CAST(sample_id AS VARCHAR) AS sample_id, phase, count(*) AS n, round(count(*)/192,6) AS fraction FROM vox GROUP BY vox.sample_id, phase
UNION ALL SELECT 'all', phase, count(*), round(count(*)/(SELECT count(*) FROM vox),6) FROM vox GROUP BY phase""", "samples", "mixed2", **_V2))
def voxel_phase_fractions(spark, d):
    out = vx.voxel_phase_fractions(_voxels(spark, d))
    return out.select(F.coalesce(F.col("sample_id").cast("string"), F.lit("all")).alias("sample_id"), "phase", "n",
                      r("fraction").alias("fraction"))


@query(sql("""SELECT s.sample_id, k AS shift, round((SELECT count(*) FROM vox a JOIN vox b ON a.sample_id=b.sample_id AND
b.ix=(a.ix+dx)%16 AND b.iy=(a.iy+dy)%12 WHERE a.sample_id=s.sample_id AND a.phase<>'3' AND b.phase<>'3')/192,6) AS s2
FROM samples s, (VALUES (0,0,0),(1,1,0),(2,0,3),(3,5,11)) AS q(k,dx,dy)""", "samples", "mixed2", **_V2))
def two_point_voxels(spark, d):
    out = vx.two_point_voxels(_voxels(spark, d), _grids(spark, d), 2, [(0, 0), (1, 0), (0, 3), (5, 11)], "3")
    return rounded(out, "s2")


@query(sql("""SELECT e.sample_id, e.phase, round(e.v,6) AS expected, round(coalesce(k,0),6) AS kept, abs(coalesce(k,0)-e.v)>0.01e0*e.v AS warn
FROM (SELECT sample_id, phase, sum(CASE shape WHEN 'Disk' THEN pi()*r*r WHEN 'Square' THEN side*side ELSE pi()*major_axis*minor_axis/4 END) AS v
FROM mixed2 GROUP BY 1,2) e LEFT JOIN (SELECT sample_id, phase, count(*)/192 AS k FROM vox GROUP BY 1,2) USING (sample_id, phase)""",
    "samples", "mixed2", **_V2))
def phase_volume_check(spark, d):
    fractions = vx.voxel_phase_fractions(_voxels(spark, d))
    out = vx.phase_volume_check(fractions, fx.mixed_2d(spark, d), fx.samples(spark, d), 2)
    return rounded(out, "expected", "kept")


# --- grid meshes, with every 97th node (by key) moved a thousandth along y -----------------

_N2 = """SELECT sample_id, ix*13+iy AS node_id, ix/16e0 AS x, iy/12e0+CASE WHEN (31*(ix*13+iy)+7*sample_id)%97=0 THEN 1e-3 ELSE 0 END AS y, 0e0 AS z
FROM samples, generate_series(0,16) a(ix), generate_series(0,12) b(iy)"""
_N3 = """SELECT sample_id, (ix*4+iy)*6+iz AS node_id, ix/4e0 AS x, iy/3e0+CASE WHEN (31*((ix*4+iy)*6+iz)+7*sample_id)%97=0 THEN 1e-3 ELSE 0 END AS y,
iz/5e0 AS z FROM samples, generate_series(0,4) a(ix), generate_series(0,3) b(iy), generate_series(0,5) c(iz)"""
_CLASS = """SELECT *, abs(ox)+abs(oy)+abs(oz) AS n_faces, CASE WHEN ox<0 THEN 'x-' WHEN ox>0 THEN 'x+' ELSE '' END||
CASE WHEN oy<0 THEN 'y-' WHEN oy>0 THEN 'y+' ELSE '' END||CASE WHEN oz<0 THEN 'z-' WHEN oz>0 THEN 'z+' ELSE '' END AS name FROM (
SELECT *, CASE WHEN abs(x)<1e-8 THEN -1 WHEN abs(x-1)<1e-8 THEN 1 ELSE 0 END AS ox, CASE WHEN abs(y)<1e-8 THEN -1 WHEN abs(y-1)<1e-8 THEN 1 ELSE 0 END AS oy,
CASE WHEN {three} AND abs(z)<1e-8 THEN -1 WHEN {three} AND abs(z-1)<1e-8 THEN 1 ELSE 0 END AS oz FROM nodes)"""
_B2 = dict(nodes=_N2, cl=_CLASS.format(three="false"))
_B3 = dict(nodes=_N3, cl=_CLASS.format(three="true"))
_PAIRS2 = """SELECT s.sample_id, 'face' AS kind, 'x' AS axis, s.node_id AS slave, m.node_id AS master FROM cl s JOIN cl m
ON s.sample_id=m.sample_id AND s.n_faces=1 AND m.n_faces=1 AND s.ox=1 AND m.ox=-1 AND abs(s.y-m.y)<1e-8
UNION ALL SELECT s.sample_id, 'face', 'y', s.node_id, m.node_id FROM cl s JOIN cl m
ON s.sample_id=m.sample_id AND s.n_faces=1 AND m.n_faces=1 AND s.oy=1 AND m.oy=-1 AND abs(s.x-m.x)<1e-8
UNION ALL SELECT s.sample_id, 'corner', NULL, s.node_id, m.node_id FROM cl s JOIN cl m
ON s.sample_id=m.sample_id AND s.n_faces=2 AND m.name='x-y-' AND s.name<>'x-y-'"""


def _face3(axis: str, others: tuple[str, str]) -> str:
    p, q = others
    return (f"SELECT s.sample_id, 'face' AS kind, '{axis}' AS axis, s.node_id AS slave, m.node_id AS master FROM cl s JOIN cl m ON "
            f"s.sample_id=m.sample_id AND s.n_faces=1 AND m.n_faces=1 AND s.o{axis}=1 AND m.o{axis}=-1 AND "
            f"sqrt(pow(s.{p}-m.{p},2)+pow(s.{q}-m.{q},2))<1e-8 UNION ALL SELECT s.sample_id, 'edge', '{axis}', s.node_id, m.node_id "
            f"FROM cl s JOIN cl m ON s.sample_id=m.sample_id AND s.n_faces=2 AND m.n_faces=2 AND s.o{axis}=0 AND m.o{axis}=0 "
            f"AND m.o{p}=-1 AND m.o{q}=-1 AND NOT (s.o{p}=-1 AND s.o{q}=-1) AND abs(s.{axis}-m.{axis})<1e-8")


_PAIRS3 = " UNION ALL ".join([_face3("x", ("y", "z")), _face3("y", ("x", "z")), _face3("z", ("x", "y")),
                              "SELECT s.sample_id, 'corner', NULL, s.node_id, m.node_id FROM cl s JOIN cl m ON "
                              "s.sample_id=m.sample_id AND s.n_faces=3 AND m.name='x-y-z-' AND s.name<>'x-y-z-'"])


def _nodes(spark, d, dim):
    grids = _grids(spark, d, dim, (16, 12) if dim == 2 else (4, 3, 5))
    moved = (31 * F.col("node_id") + 7 * F.col("sample_id")) % 97 == 0
    return ms.grid_nodes(grids, fx.samples(spark, d, dim), dim).withColumn(
        "y", F.col("y") + F.when(moved, 1e-3).otherwise(0.0))


def _classified(spark, d, dim):
    return ms.classify_nodes(_nodes(spark, d, dim), fx.samples(spark, d, dim), dim)


@query(sql("SELECT sample_id, node_id, round(x,6) AS x, round(y,6) AS y FROM nodes", "samples", nodes=_N2))
def grid_nodes(spark, d):
    return rounded(_nodes(spark, d, 2).drop("z"), "x", "y")


@query(sql("SELECT sample_id, node_id, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM nodes", "samples", nodes=_N3))
def grid_nodes_3d(spark, d):
    return rounded(_nodes(spark, d, 3), "x", "y", "z")


@query(sql("""SELECT sample_id, ix*12+iy AS cell_id, phase, concat_ws(',',ix*13+iy,(ix+1)*13+iy,(ix+1)*13+iy+1,ix*13+iy+1) AS conn FROM vox""",
           "samples", "mixed2", **_V2))
def grid_cells(spark, d):
    cells = ms.grid_cells(_voxels(spark, d), _grids(spark, d), 2)
    return cells.select("sample_id", "cell_id", "phase", F.concat_ws(",", F.col("conn").cast("array<string>")).alias("conn"))


@query(sql("""SELECT sample_id, node_id, (CASE ox WHEN -1 THEN 1 WHEN 1 THEN 2 ELSE 0 END+CASE oy WHEN -1 THEN 4 WHEN 1 THEN 8 ELSE 0 END
+CASE oz WHEN -1 THEN 16 WHEN 1 THEN 32 ELSE 0 END)::BIGINT AS face_mask, n_faces::BIGINT AS n_faces,
CASE n_faces WHEN 1 THEN 'face' WHEN 2 THEN 'edge' WHEN 3 THEN 'corner' END AS kind, name FROM cl""", "samples", **_B3))
def classified_nodes(spark, d):
    c = _classified(spark, d, 3)
    return c.select("sample_id", "node_id", F.col("face_mask").cast("long").alias("face_mask"),
                    F.col("n_faces").cast("long").alias("n_faces"), "kind", "name")


@query(sql("""SELECT sample_id, 'face' AS kind, n AS name, node_id, 'FACE_'||upper(n[1:1])||CASE WHEN n[2:2]='-' THEN 'NEG' ELSE 'POS' END AS set_name
FROM (SELECT *, unnest([CASE ox WHEN -1 THEN 'x-' WHEN 1 THEN 'x+' END, CASE oy WHEN -1 THEN 'y-' WHEN 1 THEN 'y+' END]) AS n FROM cl) WHERE n IS NOT NULL
UNION ALL SELECT sample_id, 'corner', name, node_id, 'CORNER_X'||CASE WHEN ox<0 THEN 'NEG' ELSE 'POS' END||'_Y'||CASE WHEN oy<0 THEN 'NEG' ELSE 'POS' END
FROM cl WHERE n_faces=2""", "samples", **_B2))
def node_sets(spark, d):
    return ms.node_sets(_classified(spark, d, 2), 2)


@query(sql("SELECT * FROM pr", "samples", **_B2, pr=_PAIRS2))
def periodic_pairs(spark, d):
    return ms.pair_boundary_nodes(_classified(spark, d, 2), 2)


@query(sql("SELECT * FROM pr", "samples", **_B3, pr=_PAIRS3))
def periodic_pairs_3d(spark, d):
    return ms.pair_boundary_nodes(_classified(spark, d, 3), 3)


_MISS2 = """SELECT sample_id, 'x' AS axis, node_id FROM cl WHERE n_faces=1 AND ox=1 UNION ALL SELECT sample_id, 'y', node_id FROM cl WHERE n_faces=1 AND oy=1
EXCEPT SELECT sample_id, axis, slave FROM pr WHERE kind='face'"""


@query(sql("SELECT * FROM miss", "samples", **_B2, pr=_PAIRS2, miss=_MISS2))
def unmatched_nodes(spark, d):
    c = _classified(spark, d, 2)
    return ms.unmatched_nodes(c, ms.pair_boundary_nodes(c, 2), 2)


@query(sql("""SELECT sample_id, mismatch='' AS is_conforming, mismatch FROM (SELECT c.sample_id, concat_ws('; ',
CASE WHEN mx>0 THEN 'direction x: '||xn||' nodes on x- and '||xp||' on x+, '||mx||' without a partner' END,
CASE WHEN my>0 THEN 'direction y: '||yn||' nodes on y- and '||yp||' on y+, '||my||' without a partner' END) AS mismatch FROM
(SELECT sample_id, sum((ox=-1)::INT) AS xn, sum((ox=1)::INT) AS xp, sum((oy=-1)::INT) AS yn, sum((oy=1)::INT) AS yp FROM cl GROUP BY 1) c
LEFT JOIN (SELECT sample_id, sum((axis='x')::INT) AS mx, sum((axis='y')::INT) AS my FROM miss GROUP BY 1) USING (sample_id))""",
    "samples", **_B2, pr=_PAIRS2, miss=_MISS2))
def conformity(spark, d):
    c = _classified(spark, d, 2)
    return ms.conformity(c, ms.unmatched_nodes(c, ms.pair_boundary_nodes(c, 2), 2), 2)


_SEP2 = """SELECT p.*, round_even(s.x-m.x,0)::BIGINT AS kx, round_even(s.y-m.y,0)::BIGINT AS ky FROM pr p JOIN nodes s ON s.sample_id=p.sample_id
AND s.node_id=p.slave JOIN nodes m ON m.sample_id=p.sample_id AND m.node_id=p.master"""


@query(sql("""SELECT sample_id, slave, master, dof::INTEGER AS dof, term, node_id, c AS coefficient FROM (
SELECT *, 'slave' AS term, slave AS node_id, 1e0 AS c FROM sep UNION ALL SELECT *, 'master', master, -1e0 FROM sep
UNION ALL SELECT *, 'reference_x', NULL, -kx::DOUBLE FROM sep WHERE kx<>0 UNION ALL SELECT *, 'reference_y', NULL, -ky::DOUBLE FROM sep WHERE ky<>0),
generate_series(1,2) AS g(dof)""", "samples", **_B2, pr=_PAIRS2, sep=_SEP2))
def constraint_terms(spark, d):
    nodes = _nodes(spark, d, 2)
    s = fx.samples(spark, d)
    pairs = ms.pair_boundary_nodes(ms.classify_nodes(nodes, s, 2), 2)
    return ms.constraint_terms(ms.separations(pairs, nodes, s, 2), 2)


@query(sql("""SELECT sample_id, run, pattern::INTEGER AS pattern, count(*) AS n_pairs, min(n) AS start FROM (SELECT *, sum(c) OVER
(PARTITION BY sample_id ORDER BY n)::BIGINT AS run FROM (SELECT *, coalesce((pattern<>lag(pattern) OVER (PARTITION BY sample_id ORDER BY n))::INT,0) AS c
FROM (SELECT sample_id, (kx<>0)::INT+2*(ky<>0)::INT AS pattern, row_number() OVER (PARTITION BY sample_id ORDER BY slave)-1 AS n FROM sep)))
GROUP BY 1,2,3""", "samples", **_B2, pr=_PAIRS2, sep=_SEP2))
def separation_patterns(spark, d):
    nodes, s = _nodes(spark, d, 2), fx.samples(spark, d)
    pairs = ms.pair_boundary_nodes(ms.classify_nodes(nodes, s, 2), 2)
    return ms.patterns(ms.separations(pairs, nodes, s, 2), 2, ["slave"])


@query(sql("""SELECT sample_id, a AS reference, ux, uy FROM samples, (VALUES ('x',0.1e0,0.02e0),('y',0.05e0,-0.1e0)) AS q(a,ux,uy)""", "samples"))
def reference_loading(spark, d):
    return ms.reference_loading(fx.samples(spark, d), [[0.1, 0.05], [0.02, -0.1]], 2)


def _cells(spark, d):
    """The grid's cells in two blocks: quadrilaterals, and every fifth one as its first triangle and the rest."""
    return ms.grid_cells(_voxels(spark, d), _grids(spark, d), 2)


_SHOE = """SELECT v.sample_id, ix*12+iy AS cell_id, phase, 0.5e0*abs((a.x-c.x)*(b.y-e.y)-(b.x-e.x)*(a.y-c.y)) AS measure FROM vox v
JOIN nodes a ON a.sample_id=v.sample_id AND a.node_id=ix*13+iy JOIN nodes b ON b.sample_id=v.sample_id AND b.node_id=(ix+1)*13+iy
JOIN nodes c ON c.sample_id=v.sample_id AND c.node_id=(ix+1)*13+iy+1 JOIN nodes e ON e.sample_id=v.sample_id AND e.node_id=ix*13+iy+1"""


@query(sql("SELECT sample_id, cell_id, round(measure,9) AS measure FROM shoe", "samples", "mixed2", **_V2, nodes=_N2, shoe=_SHOE))
def cell_measures(spark, d):
    return rounded(ms.cell_measures(_nodes(spark, d, 2), _cells(spark, d)).select("sample_id", "cell_id", "measure"),
                   "measure", digits=9)


@query(sql("""SELECT c.sample_id, round(covered,6) AS covered, outside, abs(covered-1)<=1e-6 AND NOT outside AS fills FROM
(SELECT sample_id, sum(measure) AS covered FROM shoe GROUP BY 1) c JOIN (SELECT sample_id, bool_or(y>1+1e-6) AS outside FROM nodes GROUP BY 1)
USING (sample_id)""", "samples", "mixed2", **_V2, nodes=_N2, shoe=_SHOE))
def fill_check(spark, d):
    nodes = _nodes(spark, d, 2)
    out = ms.fill_check(ms.cell_measures(nodes, _cells(spark, d)), nodes, fx.samples(spark, d), 2)
    return out.select("sample_id", r("covered").alias("covered"), "outside", "fills")


@query(sql("""SELECT sample_id, 'quad' AS cell_type, phase, count(*) AS n_cells, min(ix*12+iy) AS first_cell, max(ix*12+iy) AS last_cell
FROM vox GROUP BY 1,3""", "samples", "mixed2", **_V2))
def phase_blocks(spark, d):
    return ms.phase_blocks(_cells(spark, d)).drop("block")


@query(sql("""SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY phase) AS group_id, phase, 1::BIGINT AS element_type_id,
row_number() OVER (PARTITION BY sample_id ORDER BY phase='3' DESC, phase) AS material_id, n_cells FROM
(SELECT sample_id, phase, count(*) AS n_cells FROM vox GROUP BY 1,2)""", "samples", "mixed2", **_V2))
def element_groups(spark, d):
    return ms.element_groups(_cells(spark, d), fx.samples(spark, d)).drop("block", "cell_type")


@query(sql("""SELECT sample_id, phase, row_number() OVER (PARTITION BY sample_id ORDER BY try_cast(phase AS INTEGER) NULLS LAST, phase) AS position
FROM (SELECT DISTINCT p_partkey//100 AS sample_id, CASE WHEN p_size%4=0 THEN p_brand ELSE p_size::VARCHAR END AS phase FROM part)"""))
def phase_order(spark, d):
    names = fx.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 100).cast("long").alias("sample_id"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("phase"))
    return ms.phase_order(names)


@query(sql("""SELECT cell_id, concat_ws(',',k,k+4,k+1,k+5,k+2,k+6,k+3,k+7) AS conn FROM (SELECT o_orderkey AS cell_id, 10*o_orderkey AS k FROM orders)"""))
def reordered_cells(spark, d):
    k = 10 * F.col("o_orderkey")
    cells = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.lit("quad8").alias("cell_type"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: k + i).alias("conn"))
    return ms.reorder_cells(cells).select("cell_id", F.concat_ws(",", F.col("conn").cast("array<string>")).alias("conn"))


@query(sql("""SELECT p_partkey, p_size AS phase FROM part"""))
def phase_from_tags(spark, d):
    cells = fx.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("gmsh:physical"), F.lit(9).alias("medit:ref"))
    return ms.phase_from_tags(cells)


@query(sql("""SELECT sample_id, node_id, node_id-(SELECT count(*) FROM nodes b WHERE b.sample_id=a.sample_id AND b.node_id<=a.node_id AND b.node_id%5=2)
AS new_id FROM nodes a WHERE node_id%5<>2""", "samples", nodes=_N2))
def renumbered(spark, d):
    nodes = _nodes(spark, d, 2)
    return ms.renumber(nodes, nodes.where("node_id % 5 = 2"))


@query(sql("""SELECT sample_id, ring, row_number() OVER (PARTITION BY sample_id, ring ORDER BY atan2(cy-my,cx-mx), particle_id)-1 AS position,
particle_id FROM (SELECT sample_id, particle_id%10 AS ring, particle_id, cx, cy, avg(cx) OVER w AS mx, avg(cy) OVER w AS my FROM disks
WINDOW w AS (PARTITION BY sample_id, particle_id%10))""", "disks"))
def sorted_around(spark, d):
    points = fx.disks(spark, d).select("sample_id", (F.col("particle_id") % 10).alias("ring"), "particle_id",
                                       F.col("cx").alias("x"), F.col("cy").alias("y"))
    return ms.sort_around(points, ["sample_id", "ring"], "particle_id")


@query(sql("""SELECT sample_id, max(x)-min(x) AS lx, round(max(y)-min(y),6) AS ly, 2 AS dim FROM nodes GROUP BY 1""", "samples", nodes=_N2))
def bounding_box(spark, d):
    return ms.bounding_box(_nodes(spark, d, 2)).select("sample_id", "lx", r("ly").alias("ly"), "dim")


# --- section images: the voxels as pixels, particles white -----------------------------------

_PIX = "SELECT sample_id AS image_id, ix AS px, iy AS py, CASE WHEN phase<>'3' THEN 255 ELSE 0 END AS value FROM vox"


def _image(spark, d):
    pixels = _voxels(spark, d).select(F.col("sample_id").alias("image_id"), F.col("ix").alias("px"), F.col("iy").alias("py"),
                                      F.when(F.col("phase") != "3", 255).otherwise(0).alias("value"))
    images = fx.samples(spark, d).select(F.col("sample_id").alias("image_id"), F.lit(16).alias("width"), F.lit(12).alias("height"), "lx", "ly")
    points = fx.points(spark, d).select(F.col("sample_id").alias("image_id"), "point_id", (F.col("x") * 3 - 1).alias("x"), "y")
    return pixels, images, points


@query(sql("""SELECT p.point_id, x.value FROM points p JOIN px x ON x.image_id=p.sample_id AND x.px=least(floor(((p.x*3-1)-floor(p.x*3-1))*16),15)
AND x.py=least(floor(p.y*12),11)""", "points", "samples", "mixed2", **_V2, px=_PIX))
def lookup_image(spark, d):
    pixels, images, points = _image(spark, d)
    return st.lookup_image(points, pixels, images).select("point_id", "value")


@query(sql(f"""SELECT s.image_id, s.sep, round(coalesce(h,0)/n,6) AS s2 FROM (SELECT sample_id AS image_id, sep, count(*) AS n FROM points, generate_series(0,3) g(sep) GROUP BY 1,2) s
LEFT JOIN (SELECT f.image_id, f.sep, count(*) AS h FROM (SELECT p.sample_id AS image_id, sep, p.x*3-1+sep*0.03e0*cos(2*pi()*{u('u3', 'point_id*7+sep')}) AS x,
p.y+sep*0.03e0*sin(2*pi()*{u('u3', 'point_id*7+sep')}) AS y FROM points p JOIN px a ON a.image_id=p.sample_id AND a.px=least(floor(((p.x*3-1)-floor(p.x*3-1))*16),15)
AND a.py=least(floor(p.y*12),11) AND a.value=255, generate_series(0,3) g(sep)) f JOIN px b ON b.image_id=f.image_id AND b.px=least(floor((f.x-floor(f.x))*16),15)
AND b.py=least(floor((f.y-floor(f.y))*12),11) AND b.value=255 GROUP BY 1,2) h USING (image_id, sep)""", "points", "samples", "mixed2", **_V2, px=_PIX))
def two_point_image(spark, d):
    pixels, images, points = _image(spark, d)
    angle = 2 * F.pi() * u3(F.col("point_id") * 7 + F.col("sep"))
    out = st.two_point_image(points, pixels, images, [0.0, 1.0, 2.0, 3.0], 0.03, angle, st.is_particle_pixel(F.col("value"), F.lit(1)))
    return rounded(out, "s2")
