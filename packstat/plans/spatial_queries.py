"""Neighbours, overlaps, points in particles, nearest neighbours, images, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from packstat.operators import geometry as g
from packstat.operators import spatial as sp
from packstat.plans.geometry_queries import _FRAMES, _ROT
from packstat.plans.registry import query, r, rounded
from packstat.plans.sqlfix import sql
from packstat.sources import fixtures as fx

_OVER = "SELECT sample_id, i, j, ri+rj-d AS length, dx/d AS ux, dy/d AS uy FROM pairs WHERE d < ri+rj"


@query(sql("""SELECT s.sample_id, n, round(coalesce(o,0e0),6) AS total_overlap, round(vf,6) AS vf
FROM (SELECT sample_id, count(*) AS n, sum(pi()*r*r) AS vf FROM disks GROUP BY 1) s
LEFT JOIN (SELECT sample_id, sum(ri+rj-d) AS o FROM pairs WHERE d<ri+rj GROUP BY 1) t ON s.sample_id=t.sample_id""", "pairs"))
def sample_report(spark, d):
    p, s = fx.disks(spark, d), fx.samples(spark, d)
    totals = sp.overlaps(p, s, 2).groupBy("sample_id").agg(F.sum("length").alias("o"))
    facts = p.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pi() * F.col("r") * F.col("r")).alias("vf"))
    return facts.join(totals, "sample_id", "left").select(
        "sample_id", "n", r(F.coalesce("o", F.lit(0.0))).alias("total_overlap"), r("vf").alias("vf"))


@query(sql("SELECT sample_id, i, j, round(d,6) AS d FROM pairs WHERE d < ri+rj", "pairs"))
def neighbor_candidates(spark, d):
    return rounded(sp.neighbor_candidates(fx.disks(spark, d), fx.samples(spark, d), 2), "d")


@query(sql("SELECT sample_id, i, j, round(d,6) AS d FROM pairs3 WHERE d < ri+rj", "pairs3"))
def neighbor_candidates_3d(spark, d):
    return rounded(sp.neighbor_candidates(fx.spheres(spark, d), fx.samples(spark, d, 3), 3), "d")


@query(sql("SELECT sample_id, i, j, round(ri+rj-d,6) AS length, round(dx/d,6)+0e0 AS ux, round(dy/d,6)+0e0 AS uy "
           "FROM pairs WHERE d < ri+rj", "pairs"))
def overlaps_disks(spark, d):
    return rounded(sp.overlaps(fx.disks(spark, d), fx.samples(spark, d), 2), "length", "ux", "uy")


@query(sql("SELECT sample_id, i, j, round(ri+rj-d,6) AS length, round(dx/d,6)+0e0 AS ux, round(dy/d,6)+0e0 AS uy, "
           "round(dz/d,6)+0e0 AS uz FROM pairs3 WHERE d < ri+rj", "pairs3"))
def overlaps_spheres(spark, d):
    return rounded(sp.overlaps(fx.spheres(spark, d), fx.samples(spark, d, 3), 3), "length", "ux", "uy", "uz")


@query(sql("""SELECT a.sample_id, a.particle_id AS i, b.particle_id AS j, round(a.r+b.r-d,6) AS length FROM (
SELECT a, b, sqrt(pow(b.cx-a.cx-round_even(b.cx-a.cx,0),2)+pow(b.cy-a.cy-round_even(b.cy-a.cy,0),2)) AS d
FROM one a JOIN one b ON a.particle_id<b.particle_id) WHERE d < a.r+b.r""", "one"))
def overlaps_one_sample(spark, d):
    """All particles in one box: the hot-sample case, spread by cell."""
    p, s = fx.one_sample(fx.disks(spark, d), fx.samples(spark, d))
    return rounded(sp.overlaps(p, s, 2).select("sample_id", "i", "j", "length"), "length")


@query(sql("""SELECT sample_id, i AS particle_id, round(sum(ri+rj-d),6) AS overlap, count(*) AS coordination,
round(-sum((ri+rj-d)*dx/d),6)+0e0 AS fx, round(-sum((ri+rj-d)*dy/d),6)+0e0 AS fy
FROM directed WHERE d<ri+rj GROUP BY 1,2""", "directed"))
def overlap_totals(spark, d):
    p, s = fx.disks(spark, d), fx.samples(spark, d)
    return rounded(sp.overlap_totals(sp.overlaps(p, s, 2), 2), "overlap", "fx", "fy")


@query(sql("""SELECT n.sample_id, n, round(coalesce(t,0e0),6) AS total_overlap, round(coalesce(z,0)/n,6) AS mean_coordination,
round(coalesce(e,0e0),6) AS energy FROM (SELECT sample_id, count(*) AS n FROM disks GROUP BY 1) n LEFT JOIN
(SELECT sample_id, sum(o)/2 AS t, sum(c) AS z, sum(fx*fx+fy*fy) AS e FROM (SELECT sample_id, i, sum(ri+rj-d) AS o, count(*) AS c,
sum((ri+rj-d)*dx/d) AS fx, sum((ri+rj-d)*dy/d) AS fy FROM directed WHERE d<ri+rj GROUP BY 1,2) GROUP BY 1) USING (sample_id)""",
    "directed"))
def overlap_summary(spark, d):
    p, s = fx.disks(spark, d), fx.samples(spark, d)
    return rounded(sp.overlap_summary(p, sp.overlaps(p, s, 2), 2), "total_overlap", "mean_coordination", "energy")


@query(sql("""SELECT sample_id, i, j, round(CASE WHEN d<=abs(ri-rj) THEN pi()*least(ri,rj)*least(ri,rj) ELSE
ri*ri*acos((d*d+ri*ri-rj*rj)/(2*d*ri))+rj*rj*acos((d*d+rj*rj-ri*ri)/(2*d*rj))
-0.5e0*sqrt((-d+ri+rj)*(d+ri-rj)*(d-ri+rj)*(d+ri+rj)) END,9) AS size FROM pairs WHERE d<ri+rj""", "pairs"))
def overlap_areas(spark, d):
    return rounded(sp.overlap_sizes(fx.disks(spark, d), fx.samples(spark, d), 2), "size", digits=9)


@query(sql("""SELECT sample_id, i, j, round(CASE WHEN d<=abs(ri-rj) THEN 4*pi()/3*pow(least(ri,rj),3) ELSE
pi()*h1*h1*(3*ri-h1)/3+pi()*h2*h2*(3*rj-h2)/3 END,9) AS size FROM (SELECT *, ri-(d*d+ri*ri-rj*rj)/(2*d) AS h1,
rj-(d*d+rj*rj-ri*ri)/(2*d) AS h2 FROM pairs3 WHERE d<ri+rj)""", "pairs3"))
def overlap_volumes(spark, d):
    return rounded(sp.overlap_sizes(fx.spheres(spark, d), fx.samples(spark, d, 3), 3), "size", digits=9)


_SQUARES = """SELECT a.sample_id, a.particle_id AS i, b.particle_id AS j, a.side AS si, b.side AS sj,
b.cx-a.cx-round_even(b.cx-a.cx,0) AS dx, b.cy-a.cy-round_even(b.cy-a.cy,0) AS dy FROM mixed2 a JOIN mixed2 b
ON a.sample_id=b.sample_id AND a.particle_id<b.particle_id AND a.shape='Square' AND b.shape='Square'"""


@query(sql("""SELECT sample_id, i, j, round(least((si+sj)/2-abs(dx),(si+sj)/2-abs(dy)),6) AS length FROM sq
WHERE abs(dx)<(si+sj)/2 AND abs(dy)<(si+sj)/2""", "mixed2", sq=_SQUARES))
def overlaps_squares(spark, d):
    p = fx.mixed_2d(spark, d).where("shape = 'Square'")
    return rounded(sp.overlaps(p, fx.samples(spark, d), 2).select("sample_id", "i", "j", "length"), "length")


_CONVEX = """SELECT *, sqrt(dx*dx+dy*dy) AS d FROM (SELECT a.sample_id, a.particle_id AS i, b.particle_id AS j, a, b,
b.cx-a.cx-round_even(b.cx-a.cx,0) AS dx, b.cy-a.cy-round_even(b.cy-a.cy,0) AS dy FROM mixed2 a JOIN mixed2 b
ON a.sample_id=b.sample_id AND a.particle_id<b.particle_id)"""


def _width2(p: str) -> str:
    return (f"CASE {p}.shape WHEN 'Disk' THEN {p}.r WHEN 'Square' THEN {p}.side/2*(abs(ux)+abs(uy)) ELSE "
            f"sqrt(pow({p}.major_axis/2*(ux*cos({p}.angle)+uy*sin({p}.angle)),2)"
            f"+pow({p}.minor_axis/2*(-ux*sin({p}.angle)+uy*cos({p}.angle)),2)) END")


@query(sql(f"""SELECT sample_id, i, j, round(w-d,6) AS length, round(ux,6)+0e0 AS ux, round(uy,6)+0e0 AS uy FROM (
SELECT *, {_width2('a')}+{_width2('b')} AS w FROM (SELECT *, dx/d AS ux, dy/d AS uy FROM convex)) WHERE w>d""",
    "mixed2", convex=_CONVEX))
def overlaps_convex_approx(spark, d):
    """Any convex 2D pair, separated along the line of centres."""
    p, s = fx.mixed_2d(spark, d), fx.samples(spark, d)
    return rounded(sp.overlaps(p, s, 2, "approx"), "length", "ux", "uy")


@query(sql("""SELECT sample_id, least(si, ci) AS i, greatest(si, ci) AS j FROM (SELECT *, abs(vx*kx+vy*ky+vz*kz) AS t,
sqrt(greatest(vx*vx+vy*vy+vz*vz-pow(vx*kx+vy*ky+vz*kz,2),0)) AS w FROM (SELECT s.sample_id, s.particle_id AS si,
c.particle_id AS ci, s.r, c.r_cyl, c.length, s.cx-c.cx-round_even(s.cx-c.cx,0) AS vx, s.cy-c.cy-round_even(s.cy-c.cy,0) AS vy,
s.cz-c.cz-round_even(s.cz-c.cz,0) AS vz, sin(c.polar_angle)*cos(c.azimuth_angle) AS kx,
sin(c.polar_angle)*sin(c.azimuth_angle) AS ky, cos(c.polar_angle) AS kz FROM mixed3 s JOIN mixed3 c
ON s.sample_id=c.sample_id AND s.shape='Sphere' AND c.shape='Cylinder'))
WHERE CASE WHEN t<=length/2 THEN w<r+r_cyl WHEN w<=r_cyl THEN t-length/2<r ELSE sqrt(pow(t-length/2,2)+pow(w-r_cyl,2))<r END""",
    "mixed3"))
def sphere_cylinder_contacts(spark, d):
    return sp.sphere_cylinder_contacts(fx.mixed_3d(spark, d), fx.samples(spark, d, 3))


@query(sql("""SELECT f.sample_id, i, j, round(a_r+b_r-d,6) AS length FROM (SELECT a.sample_id, a.particle_id AS i, b.particle_id AS j,
a.r AS a_r, b.r AS b_r, sqrt(pow(b.cx-a.cx-round_even(b.cx-a.cx,0),2)+pow(b.cy-a.cy-round_even(b.cy-a.cy,0),2)) AS d
FROM fibers a JOIN fibers b ON a.sample_id=b.sample_id AND a.particle_id<b.particle_id) f WHERE d<a_r+b_r""", "fibers"))
def overlaps_fibers(spark, d):
    flat, planes = g.as_disks(fx.fibers(spark, d), fx.samples(spark, d, 3))
    out = sp.overlaps(flat, planes, 2)
    return out.select(F.element_at(F.split("sample_id", "/"), 1).cast("long").alias("sample_id"), "i", "j",
                      r("length").alias("length"))


def _moved(spark, d):
    """The disks a little later: every seventh moved by a tenth of the box."""
    jump = F.when(F.col("particle_id") % 7 == 0, 0.1).otherwise(0.0)
    return fx.disks(spark, d).withColumn("cx", F.col("cx") + jump)


_NOW = """SELECT sample_id, particle_id, r, cx+CASE WHEN particle_id%7=0 THEN 0.1e0 ELSE 0 END AS cx, cy FROM disks"""
_NOWPAIRS = """SELECT a.sample_id, a.particle_id AS i, b.particle_id AS j FROM now_ a JOIN now_ b ON a.sample_id=b.sample_id
AND a.particle_id<b.particle_id WHERE sqrt(pow(b.cx-a.cx-round_even(b.cx-a.cx,0),2)+pow(b.cy-a.cy-round_even(b.cy-a.cy,0),2))
<(a.r+b.r)*1.1e0"""


@query(sql("SELECT sample_id, i, j FROM pairs WHERE d<(ri+rj)*1.1e0", "pairs"))
def verlet_neighbors(spark, d):
    return sp.verlet_neighbors(fx.disks(spark, d), fx.samples(spark, d), 2, 1.1)


@query(sql("SELECT sample_id, particle_id, 0.1e0 AS moved FROM disks WHERE particle_id%7=0", "disks"))
def left_neighborhood(spark, d):
    s = fx.samples(spark, d)
    return rounded(sp.left_neighborhood(fx.disks(spark, d), _moved(spark, d), s, 2, 1.1), "moved")


@query(sql("""SELECT sample_id, i, j FROM nowpairs WHERE i%7=0 OR j%7=0 UNION ALL
SELECT sample_id, i, j FROM pairs WHERE d<(ri+rj)*1.1e0 AND i%7<>0 AND j%7<>0""", "pairs", now_=_NOW, nowpairs=_NOWPAIRS))
def refreshed_neighbors(spark, d):
    before, now, s = fx.disks(spark, d), _moved(spark, d), fx.samples(spark, d)
    leavers = sp.left_neighborhood(before, now, s, 2, 1.1)
    return sp.refresh_neighbors(sp.verlet_neighbors(before, s, 2, 1.1), leavers, now, s, 2, 1.1)


@query(sql("""SELECT p.point_id, m.particle_id FROM points p JOIN (SELECT * FROM mixed2) m ON p.sample_id=m.sample_id AND
CASE m.shape WHEN 'Disk' THEN sqrt(pow(p.x-m.cx-round_even(p.x-m.cx,0),2)+pow(p.y-m.cy-round_even(p.y-m.cy,0),2))<=m.r
WHEN 'Square' THEN abs(p.x-m.cx-round_even(p.x-m.cx,0))<=m.side/2 AND abs(p.y-m.cy-round_even(p.y-m.cy,0))<=m.side/2
ELSE pow(((p.x-m.cx-round_even(p.x-m.cx,0))*cos(m.angle)+(p.y-m.cy-round_even(p.y-m.cy,0))*sin(m.angle))/(m.major_axis/2),2)
+pow((-(p.x-m.cx-round_even(p.x-m.cx,0))*sin(m.angle)+(p.y-m.cy-round_even(p.y-m.cy,0))*cos(m.angle))/(m.minor_axis/2),2)
<=1+1e-8 END""", "points", "mixed2"))
def points_in_particles(spark, d):
    return sp.points_in_particles(fx.points(spark, d), fx.mixed_2d(spark, d), fx.samples(spark, d), 2).drop("sample_id")


@query(sql("""SELECT sample_id, count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS inside FROM (
SELECT p.sample_id, p.point_id, EXISTS (SELECT 1 FROM disks m WHERE m.sample_id=p.sample_id AND
sqrt(pow(p.x-m.cx-round_even(p.x-m.cx,0),2)+pow(p.y-m.cy-round_even(p.y-m.cy,0),2))<=m.r) AS hit FROM points p) GROUP BY 1""",
    "points", "disks"))
def point_flags(spark, d):
    flags = sp.point_flags(fx.points(spark, d), fx.disks(spark, d), fx.samples(spark, d), 2)
    return flags.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inside").cast("long")).alias("inside"))


@query(sql("""SELECT point_id, particle_id FROM (SELECT *, dx*kx+dy*ky+dz*kz AS ax, dx*dx+dy*dy+dz*dz AS dd FROM (
SELECT p.point_id, f.particle_id, f.shape, f.r, f.axis_1, f.axis_2, f.axis_3, f.r_cyl, f.length, f.m11, f.m12, f.m13, f.m21, f.m22,
f.m23, f.m31, f.m32, f.m33, f.m11 AS kx, f.m12 AS ky, f.m13 AS kz, p.x-f.cx-round_even(p.x-f.cx,0) AS dx,
p.y-f.cy-round_even(p.y-f.cy,0) AS dy, p.z-f.cz-round_even(p.z-f.cz,0) AS dz FROM points p JOIN rot f USING (sample_id)))
WHERE CASE shape WHEN 'Sphere' THEN dd/(r*r)-1<=1e-6 WHEN 'Ellipsoid' THEN pow((dx*m11+dy*m12+dz*m13)/(axis_1/2),2)
+pow((dx*m21+dy*m22+dz*m23)/(axis_2/2),2)+pow((dx*m31+dy*m32+dz*m33)/(axis_3/2),2)-1<=1e-6
ELSE abs(ax)<=length/2 AND sqrt(greatest(dd-ax*ax,0))<r_cyl END""", "points", "mixed3", frames=_FRAMES, rot=_ROT))
def points_in_particles_3d(spark, d):
    return sp.points_in_particles(fx.points(spark, d), fx.mixed_3d(spark, d), fx.samples(spark, d, 3), 3).drop("sample_id")


@query(sql("""SELECT sample_id, i AS particle_id, arg_min(j, (d, j)) AS other_id, round(min(d)/any_value(m),6) AS nn
FROM directed JOIN (SELECT sample_id, avg(r) AS m FROM disks GROUP BY 1) USING (sample_id) GROUP BY 1,2""", "directed"))
def nearest_neighbor(spark, d):
    return rounded(sp.nearest_neighbor(fx.disks(spark, d), fx.samples(spark, d), 2), "nn")


@query(sql("""SELECT sample_id, particle_id, round(min(d),6) AS d FROM (SELECT sample_id, i AS particle_id, d FROM pairs3
UNION ALL SELECT sample_id, j, d FROM pairs3) GROUP BY 1,2""", "pairs3"))
def nearest_neighbor_3d(spark, d):
    out = sp.nearest(fx.spheres(spark, d), fx.samples(spark, d, 3), 3)
    return rounded(out.select("sample_id", "particle_id", "d"), "d")


@query(sql("""SELECT sample_id, particle_id, other_id, rank, round(d,6) AS d FROM (SELECT sample_id, i AS particle_id, j AS other_id, d,
row_number() OVER (PARTITION BY sample_id, i ORDER BY d, j) AS rank FROM directed) WHERE rank<=5""", "directed"))
def k_nearest(spark, d):
    return rounded(sp.nearest(fx.disks(spark, d), fx.samples(spark, d), 2, 5), "d")


_APART = "(b.c{a}-a.c{a})-round_even(b.c{a}-a.c{a},0)"
_CROWD = {dim: "SELECT a.sample_id, a.particle_id, b.particle_id AS other_id, sqrt(" + "+".join(f"pow({_APART.format(a=a)},2)" for a in "xyz"[:dim])
          + f") AS d FROM crowd{dim} a JOIN crowd{dim} b ON a.sample_id=b.sample_id AND a.particle_id<>b.particle_id" for dim in (2, 3)}


@query(sql("""SELECT sample_id, particle_id, arg_min(other_id, (d, other_id)) AS other_id, round(min(d),9) AS d FROM apart GROUP BY 1,2""",
           "crowd3", apart=_CROWD[3]))
def nearest_crowded_3d(spark, d):
    """Half of the particles in a small part of the box."""
    out = sp.nearest(fx.crowded(fx.spheres(spark, d), 3), fx.samples(spark, d, 3), 3)
    return rounded(out.select("sample_id", "particle_id", "other_id", "d"), "d", digits=9)


@query(sql("""SELECT sample_id, particle_id, other_id, rank, round(d,9) AS d FROM (SELECT *,
row_number() OVER (PARTITION BY sample_id, particle_id ORDER BY d, other_id) AS rank FROM apart) WHERE rank<=5""", "crowd2", apart=_CROWD[2]))
def k_nearest_crowded(spark, d):
    return rounded(sp.nearest(fx.crowded(fx.disks(spark, d), 2), fx.samples(spark, d), 2, 5), "d", digits=9)


@query(sql("""SELECT sample_id, particle_id, ix AS image_x, iy AS image_y, round(cx+ix,6) AS cx, round(cy+iy,6) AS cy FROM disks,
(VALUES (-1),(0),(1)) a(ix), (VALUES (-1),(0),(1)) b(iy) WHERE
sqrt(pow(greatest(-(cx+ix),cx+ix-1,0),2)+pow(greatest(-(cy+iy),cy+iy-1,0),2))<=r""", "disks"))
def periodic_images(spark, d):
    p = sp.periodic_images(fx.disks(spark, d), fx.samples(spark, d), 2, F.col("r"))
    return rounded(p.select("sample_id", "particle_id", "image_x", "image_y", "cx", "cy"), "cx", "cy")


def _width(side: str, t: str) -> str:
    """Half the width of a body along an angle: the one size that is not null says which shape it is."""
    return (f"coalesce({side}r, {side}side/2*(abs(cos({t}))+abs(sin({t}))), "
            f"sqrt(pow({side}major_axis/2*cos({t}-{side}angle),2)+pow({side}minor_axis/2*sin({t}-{side}angle),2)))")


def _gap(t: str) -> str:
    return f"{_width('a_', t)}+{_width('b_', t)}-dx*cos({t})-dy*sin({t})"


_SIZES = ("r", "side", "major_axis", "minor_axis", "angle")


@query(sql(f"""SELECT sample_id, i, j, round(length,6) AS length FROM (SELECT sample_id, i, j, min({_gap("t")}) AS length FROM
(SELECT *, t0+unnest(range(-1000,1001))*pi()/360000 AS t FROM coarse) GROUP BY ALL) WHERE length>0""", "mixed2",
           reach="SELECT *, coalesce(r, side/sqrt(2e0), major_axis/2) AS reach FROM mixed2",
           near=f"""SELECT * FROM (SELECT a.sample_id, a.particle_id AS i, b.particle_id AS j, a.reach+b.reach AS most,
(b.cx-a.cx)-round_even(b.cx-a.cx,0) AS dx, (b.cy-a.cy)-round_even(b.cy-a.cy,0) AS dy, {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _SIZES)}
FROM reach a JOIN reach b ON a.sample_id=b.sample_id AND a.particle_id<b.particle_id) WHERE sqrt(dx*dx+dy*dy)<most""",
           coarse=f"""SELECT *, (SELECT arg_min(t, g) FROM (SELECT t, {_gap("t")} AS g FROM (SELECT unnest(range(720))*pi()/360 AS t))) AS t0 FROM near"""))
def overlaps_mixed(spark, d):
    """Disks, squares and ellipses in one call: closed forms where there are any, the exact search elsewhere."""
    out = sp.overlaps(fx.mixed_2d(spark, d), fx.samples(spark, d), 2)
    return rounded(out.select("sample_id", "i", "j", "length"), "length")


@query(sql("""SELECT c.sample_id, c.particle_id-c.particle_id%4 AS parent_id, round(sqrt(sum(c.r*c.r*0.16e0)/any_value(p.r*p.r)),6) AS root_fill,
count(*) AS children, sum(CASE WHEN sqrt(pow(0.01e0*(c.cx-0.5e0),2)+pow(0.01e0*(c.cy-0.5e0),2))+0.4e0*c.r<=p.r THEN 1 ELSE 0 END)::BIGINT
AS whole FROM disks c JOIN disks p ON c.sample_id=p.sample_id AND p.particle_id=c.particle_id-c.particle_id%4
WHERE c.particle_id%4<>0 GROUP BY 1,2""", "disks"))
def inside_outer(spark, d):
    """Three of four disks shrunk and put beside the centre of the fourth, their parent."""
    p = fx.disks(spark, d)
    head = F.col("particle_id") - F.col("particle_id") % 4
    parents = p.where("particle_id % 4 = 0").select("sample_id", F.col("particle_id").alias("parent_id"),
                                                    F.col("cx").alias("px"), F.col("cy").alias("py"))
    children = (p.where("particle_id % 4 <> 0").withColumn("parent_id", head).join(parents, ["sample_id", "parent_id"])
                .withColumn("cx", F.col("px") + 0.01 * (F.col("cx") - 0.5))
                .withColumn("cy", F.col("py") + 0.01 * (F.col("cy") - 0.5)).withColumn("r", F.col("r") * 0.4)
                .drop("px", "py"))
    whole = p.where("particle_id % 4 = 0").withColumn("parent_id", F.lit(None).cast("long")).unionByName(children)
    out = sp.inside_outer(whole, fx.samples(spark, d), 2)
    return out.select("sample_id", "parent_id", r(F.sqrt("fill")).alias("root_fill"), "children", "whole")


_FILL_RULE = """SELECT sample_id, parent_id, phase, particle_id, round(own,6) AS own, round(room,6) AS left, own<room/2 AS fits FROM (
SELECT *, 1-coalesce(sum(own) OVER (PARTITION BY sample_id, parent_id, phase ORDER BY particle_id ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING),0) AS room FROM (SELECT c.sample_id, p.particle_id AS parent_id, c.phase, c.particle_id, c.v/p.v AS own
FROM sized c JOIN sized p ON c.sample_id=p.sample_id AND p.particle_id=c.particle_id-c.particle_id%10 WHERE c.particle_id%10<>0))"""


def _fill_rule(particles, dim):
    """Nine of ten particles are children of the tenth."""
    head = F.col("particle_id") - F.col("particle_id") % 10
    nested = particles.withColumn("parent_id", F.when(F.col("particle_id") % 10 != 0, head))
    return rounded(sp.nested_remainder(nested, dim), "own", "left")


@query(sql(_FILL_RULE, "mixed2", sized="""SELECT sample_id, particle_id, phase, CASE shape WHEN 'Disk' THEN pi()*r*r WHEN 'Square'
THEN side*side ELSE pi()/4*major_axis*minor_axis END*CASE WHEN particle_id%10=0 THEN 1e0 ELSE 10/97e0 END AS v FROM mixed2"""))
def fill_rule_2d(spark, d):
    """Disks, squares and ellipses of 10/97 of their area in the first of ten, phase by phase."""
    p = fx.mixed_2d(spark, d)
    small = F.when(F.col("particle_id") % 10 == 0, 1.0).otherwise(F.sqrt(F.lit(10 / 97)))
    return _fill_rule(p.withColumns({c: F.col(c) * small for c in ("r", "side", "major_axis", "minor_axis")}), 2)


@query(sql(_FILL_RULE, "mixed3", sized="""SELECT sample_id, particle_id, phase, CASE shape WHEN 'Sphere' THEN 4*pi()/3*r*r*r
WHEN 'Ellipsoid' THEN pi()/6*axis_1*axis_2*axis_3 ELSE pi()*r_cyl*r_cyl*length END*CASE WHEN particle_id%10=0 THEN 1e0 ELSE 1000/6859e0
END AS v FROM mixed3"""))
def fill_rule_3d(spark, d):
    """Spheres, ellipsoids and cylinders of 10/19 of their lengths in the first of ten, phase by phase."""
    p = fx.mixed_3d(spark, d)
    small = F.when(F.col("particle_id") % 10 == 0, 1.0).otherwise(10 / 19)
    sizes = ("r", "axis_1", "axis_2", "axis_3", "r_cyl", "length")
    return _fill_rule(p.withColumns({c: F.col(c) * small for c in sizes}), 3)


@query(sql("""SELECT DISTINCT sample_id, particle_id, ix, iy, (ix+a+n)%n AS near_x, (iy+b+n)%n AS near_y FROM (
SELECT sample_id, particle_id, n, least(floor(cx*n)::BIGINT,n-1) AS ix, least(floor(cy*n)::BIGINT,n-1) AS iy FROM disks JOIN
(SELECT sample_id, greatest(1,floor(1/(2*max(r))))::BIGINT AS n FROM disks GROUP BY 1) USING (sample_id)),
(VALUES (-1),(0),(1)) p(a), (VALUES (-1),(0),(1)) q(b)""", "disks"))
def surrounding_cells(spark, d):
    return sp.surrounding_cells(fx.disks(spark, d), fx.samples(spark, d), 2)
