"""Derived geometry, predicates and aggregates of single tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from packstat.functions.fourier import normal_density, outline_point
from packstat.functions.periodic import axis_to_angles, grid_index, min_image, wrap
from packstat.functions.shapes import with_rotation
from packstat.functions.text import resolution_label, type_name
from packstat.operators import geometry as g
from packstat.operators import stats as st
from packstat.operators.spatial import attach_box
from packstat.plans.registry import query, r, rounded
from packstat.plans.sqlfix import sql
from packstat.sources import fixtures as fx

_M2_RAD = ("CASE shape WHEN 'Disk' THEN r WHEN 'Ellipse' THEN major_axis/2 ELSE side/2*sqrt(2) END")
_M3_RAD = ("CASE shape WHEN 'Sphere' THEN r WHEN 'Ellipsoid' THEN greatest(axis_1,axis_2,axis_3)/2 "
           "ELSE sqrt(length*length/4+r_cyl*r_cyl) END")
_M2_VOL = "CASE shape WHEN 'Disk' THEN pi()*r*r WHEN 'Ellipse' THEN pi()*major_axis*minor_axis/4 ELSE side*side END"
_M3_VOL = ("CASE shape WHEN 'Sphere' THEN 4*pi()*r*r*r/3 WHEN 'Ellipsoid' THEN pi()*axis_1*axis_2*axis_3/6 "
           "ELSE pi()*r_cyl*r_cyl*length END")


@query(sql("SELECT point_id, round((3*x-1)-floor(3*x-1),6)+0e0 AS x, round((5*y-2)-2*floor((5*y-2)/2),6)+0e0 AS y, "
           "round((3*x-1)-2*round_even((3*x-1)/2,0),6)+0e0 AS dx FROM points", "points"))
def wrap_and_min_image(spark, d):
    p = fx.points(spark, d)
    x, y = 3 * F.col("x") - 1, 5 * F.col("y") - 2
    return p.select("point_id", r(wrap(x, F.lit(1.0))).alias("x"), r(wrap(y, F.lit(2.0))).alias("y"),
                    r(min_image(x, F.lit(2.0))).alias("dx"))


@query(sql("SELECT sample_id, particle_id, round(cx/4,6) AS cx, round(r/4,6) AS r, 0.5e0 AS lx, 0.25e0 AS ly FROM disks",
           "disks"))
def scaled_units(spark, d):
    s = fx.samples(spark, d).withColumn("lx", F.lit(8.0)).withColumn("ly", F.lit(4.0))
    p, s = g.scaled(fx.disks(spark, d), s, 2, g.unit_scale(2) * 1.0)
    return rounded(attach_box(p, s.withColumn("lx", F.col("lx") / 4).withColumn("ly", F.col("ly") / 4), 2)
                   .select("sample_id", "particle_id", "cx", "r", "lx", "ly"), "cx", "r")


@query(sql(f"""SELECT sample_id, particle_id, round({_M2_VOL},9) AS volume, round({_M2_VOL},9) AS real_volume,
round(pi()*({_M2_RAD})*({_M2_RAD}),9) AS volume_circ, round({_M2_RAD},6) AS radius,
round(CASE shape WHEN 'Disk' THEN r WHEN 'Ellipse' THEN minor_axis/2 ELSE side*sqrt(2)/2 END,6) AS radius_insc,
round(sqrt(1-minor_axis*minor_axis/(major_axis*major_axis)),6) AS eccentricity,
round(CASE shape WHEN 'Disk' THEN r WHEN 'Ellipse' THEN (minor_axis/2)*(minor_axis/2)/(major_axis/2) ELSE side/8 END,6) AS erosion,
round({_M2_RAD},6) AS mass FROM mixed2""", "mixed2"))
def sizes_2d(spark, d):
    p = g.with_mass(g.with_erosion(g.with_radii(g.with_volume(fx.mixed_2d(spark, d), 2))), "radius")
    return p.select("sample_id", "particle_id", *[r(c, 9).alias(c) for c in ("volume", "real_volume", "volume_circ")],
                    *[r(c).alias(c) for c in ("radius", "radius_insc", "eccentricity", "erosion", "mass")])


@query(sql(f"""SELECT sample_id, particle_id, round({_M3_VOL},9) AS volume, round(4*pi()/3*pow({_M3_RAD},3),9) AS volume_circ,
round({_M3_RAD},6) AS radius,
round(CASE shape WHEN 'Sphere' THEN r WHEN 'Ellipsoid' THEN least(axis_1,axis_2,axis_3)/2 ELSE least(length/2,r_cyl) END,6) AS radius_insc,
round(CASE shape WHEN 'Sphere' THEN 0.9e0*r WHEN 'Ellipsoid' THEN
pow(least(axis_1,axis_2,axis_3)/2,2)/(greatest(axis_1,axis_2,axis_3)/2) END,6) AS erosion,
round({_M3_VOL},9) AS mass FROM mixed3""", "mixed3"))
def sizes_3d(spark, d):
    p = g.with_mass(g.with_erosion(g.with_radii(g.with_volume(fx.mixed_3d(spark, d), 3))), "volume")
    return p.select("sample_id", "particle_id", *[r(c, 9).alias(c) for c in ("volume", "volume_circ", "mass")],
                    *[r(c).alias(c) for c in ("radius", "radius_insc", "erosion")])


_FRAMES = """SELECT *, rot_x/rn AS kx, rot_y/rn AS ky, rot_z/rn AS kz FROM (SELECT *,
sqrt(rot_x*rot_x+rot_y*rot_y+rot_z*rot_z) AS rn FROM mixed3)"""
# Rodrigues' formula, where the engine uses the quaternion
_ROT = """SELECT sample_id, particle_id, shape, cx, cy, cz, r, axis_1, axis_2, axis_3, r_cyl, length,
CASE shape WHEN 'Sphere' THEN 1 WHEN 'Cylinder' THEN sin(polar_angle)*cos(azimuth_angle) ELSE cos(angle)+kx*kx*(1-cos(angle)) END AS m11,
CASE shape WHEN 'Sphere' THEN 0 WHEN 'Cylinder' THEN sin(polar_angle)*sin(azimuth_angle) ELSE ky*kx*(1-cos(angle))+kz*sin(angle) END AS m12,
CASE shape WHEN 'Sphere' THEN 0 WHEN 'Cylinder' THEN cos(polar_angle) ELSE kz*kx*(1-cos(angle))-ky*sin(angle) END AS m13,
CASE shape WHEN 'Sphere' THEN 0 WHEN 'Cylinder' THEN cos(polar_angle)*cos(azimuth_angle) ELSE kx*ky*(1-cos(angle))-kz*sin(angle) END AS m21,
CASE shape WHEN 'Sphere' THEN 1 WHEN 'Cylinder' THEN cos(polar_angle)*sin(azimuth_angle) ELSE cos(angle)+ky*ky*(1-cos(angle)) END AS m22,
CASE shape WHEN 'Sphere' THEN 0 WHEN 'Cylinder' THEN -sin(polar_angle) ELSE kz*ky*(1-cos(angle))+kx*sin(angle) END AS m23,
CASE shape WHEN 'Sphere' THEN 0 WHEN 'Cylinder' THEN -sin(azimuth_angle) ELSE kx*kz*(1-cos(angle))+ky*sin(angle) END AS m31,
CASE shape WHEN 'Sphere' THEN 0 WHEN 'Cylinder' THEN cos(azimuth_angle) ELSE ky*kz*(1-cos(angle))-kx*sin(angle) END AS m32,
CASE shape WHEN 'Sphere' THEN 1 WHEN 'Cylinder' THEN 0 ELSE cos(angle)+kz*kz*(1-cos(angle)) END AS m33 FROM frames"""
_CELLS = [f"m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


@query(sql("SELECT sample_id, particle_id, " + ", ".join(f"round(CAST({m} AS DOUBLE),6)+0e0 AS {m}" for m in _CELLS)
           + " FROM rot", "mixed3", frames=_FRAMES, rot=_ROT))
def rotations_3d(spark, d):
    p = with_rotation(fx.mixed_3d(spark, d), 3)
    return p.select("sample_id", "particle_id", *[r(m).alias(m) for m in _CELLS])


def _reach3(j: int) -> str:
    """Half extent along axis j from the rotation cells."""
    return (f"CASE shape WHEN 'Sphere' THEN r WHEN 'Ellipsoid' THEN sqrt(pow(axis_1/2*m1{j},2)+pow(axis_2/2*m2{j},2)"
            f"+pow(axis_3/2*m3{j},2)) ELSE length/2*abs(m1{j})+r_cyl*sqrt(greatest(1-m1{j}*m1{j},0)) END")


@query(sql("SELECT sample_id, particle_id, " + ", ".join(
    f"round(c{a}-({_reach3(j)}),6)+0e0 AS lo_{a}, round(c{a}+({_reach3(j)}),6)+0e0 AS hi_{a}"
    for j, a in ((1, "x"), (2, "y"), (3, "z"))) + " FROM rot", "mixed3", frames=_FRAMES, rot=_ROT))
def extents_3d(spark, d):
    p = g.with_extents(fx.mixed_3d(spark, d), 3)
    return p.select("sample_id", "particle_id", *[r(c).alias(c) for c in p.columns if c[:3] in ("lo_", "hi_")])


_HALF2 = {"x": "CASE shape WHEN 'Disk' THEN r WHEN 'Square' THEN side/2 ELSE "
               "sqrt(pow(major_axis/2*cos(angle),2)+pow(minor_axis/2*sin(angle),2)) END",
          "y": "CASE shape WHEN 'Disk' THEN r WHEN 'Square' THEN side/2 ELSE "
               "sqrt(pow(major_axis/2*sin(angle),2)+pow(minor_axis/2*cos(angle),2)) END"}
_IN2 = f"cx-({_HALF2['x']})>=0 AND cx+({_HALF2['x']})<=1 AND cy-({_HALF2['y']})>=0 AND cy+({_HALF2['y']})<=1"


@query(sql("SELECT sample_id, particle_id, " + ", ".join(
    f"round(c{a}-({_HALF2[a]}),6)+0e0 AS lo_{a}, round(c{a}+({_HALF2[a]}),6)+0e0 AS hi_{a}" for a in "xy")
    + " FROM mixed2", "mixed2"))
def extents_2d(spark, d):
    p = g.with_extents(fx.mixed_2d(spark, d), 2)
    return p.select("sample_id", "particle_id", *[r(c).alias(c) for c in p.columns if c[:3] in ("lo_", "hi_")])


# the direction of the support query: the centre of the particle seen from the middle of the box
_U2 = ("(cx-0.5e0)", "(cy-0.5e0)")


@query(sql(f"""SELECT sample_id, particle_id, round(cx+CASE shape WHEN 'Disk' THEN r*ux/sqrt(ux*ux+uy*uy)
WHEN 'Square' THEN CASE WHEN ux<0 THEN -side/2 ELSE side/2 END
ELSE (pow(major_axis/2,2)*p*cos(angle)-pow(minor_axis/2,2)*q*sin(angle))/w END,6)+0e0 AS sx,
round(cy+CASE shape WHEN 'Disk' THEN r*uy/sqrt(ux*ux+uy*uy)
WHEN 'Square' THEN CASE WHEN uy<0 THEN -side/2 ELSE side/2 END
ELSE (pow(major_axis/2,2)*p*sin(angle)+pow(minor_axis/2,2)*q*cos(angle))/w END,6)+0e0 AS sy FROM loc""", "mixed2",
    loc="""SELECT *, sqrt(pow(major_axis/2*p,2)+pow(minor_axis/2*q,2)) AS w FROM (SELECT *, ux*cos(angle)+uy*sin(angle) AS p,
-ux*sin(angle)+uy*cos(angle) AS q FROM (SELECT *, cx-0.5e0 AS ux, cy-0.5e0 AS uy FROM mixed2))"""))
def support_2d(spark, d):
    p = g.support(fx.mixed_2d(spark, d), [F.col("cx") - 0.5, F.col("cy") - 0.5])
    return p.select("sample_id", "particle_id", r("sx").alias("sx"), r("sy").alias("sy"))


@query(sql("""SELECT sample_id, particle_id, round(cx+sx,6)+0e0 AS sx, round(cy+sy,6)+0e0 AS sy, round(cz+sz,6)+0e0 AS sz FROM (
SELECT *, """ + ", ".join(f"""CASE shape WHEN 'Sphere' THEN r*u{a}/un WHEN 'Ellipsoid' THEN
(pow(axis_1/2,2)*l1*m1{j}+pow(axis_2/2,2)*l2*m2{j}+pow(axis_3/2,2)*l3*m3{j})/sqrt(pow(axis_1/2*l1,2)+pow(axis_2/2*l2,2)+pow(axis_3/2*l3,2))
ELSE sign(l1)*length/2*m1{j}+r_cyl*(u{a}-l1*m1{j})/sqrt(un*un-l1*l1) END AS s{a}"""
    for j, a in ((1, "x"), (2, "y"), (3, "z"))) + """ FROM (
SELECT *, ux*m11+uy*m12+uz*m13 AS l1, ux*m21+uy*m22+uz*m23 AS l2, ux*m31+uy*m32+uz*m33 AS l3, sqrt(ux*ux+uy*uy+uz*uz) AS un
FROM (SELECT *, cx-0.5e0 AS ux, cy-0.5e0 AS uy, cz-0.5e0 AS uz FROM rot)))""", "mixed3", frames=_FRAMES, rot=_ROT))
def support_3d(spark, d):
    p = g.support(fx.mixed_3d(spark, d), [F.col(f"c{a}") - 0.5 for a in "xyz"])
    return p.select("sample_id", "particle_id", *[r(f"s{a}").alias(f"s{a}") for a in "xyz"])


@query(sql("""SELECT sample_id, particle_id, round(r+0.01e0,6) AS r, round(side+0.02e0,6) AS side,
round(CASE WHEN shape='Disk' THEN pi()*r*r ELSE side*side END,9) AS real_volume FROM mixed2 WHERE shape<>'Ellipse'""", "mixed2"))
def dilated(spark, d):
    p = g.dilate(fx.mixed_2d(spark, d).where("shape <> 'Ellipse'"), 0.01)
    return g.with_volume(p, 2).select("sample_id", "particle_id", r("r").alias("r"), r("side").alias("side"),
                                      r("real_volume", 9).alias("real_volume"))


# the root is bracketed by bisection here, where the engine has it in closed form
@query(sql("""SELECT sample_id, particle_id, round(2*(a+t),6) AS major_axis, round(2*(b+t),6) AS minor_axis,
round(t,6) AS inflation FROM (SELECT *, (lo+hi)/2 AS t FROM bis WHERE n=60)""", "mixed2", **{"RECURSIVE_bis": ""}).replace(
    ", RECURSIVE_bis AS ()", """, bis AS (SELECT sample_id, particle_id, major_axis/2 AS a, minor_axis/2 AS b, 0e0 AS lo, 0.1e0 AS hi, 0 AS n
FROM mixed2 WHERE shape='Ellipse' UNION ALL SELECT sample_id, particle_id, a, b, CASE WHEN f<0 THEN (lo+hi)/2 ELSE lo END,
CASE WHEN f<0 THEN hi ELSE (lo+hi)/2 END, n+1 FROM (SELECT *, 2*(a+b)*pow((lo+hi)/2,3)+4*a*b*pow((lo+hi)/2,2)
-2*(a+b)*0.0001e0*(lo+hi)/2-(a+b)*(a+b)*0.0001e0 AS f FROM bis) WHERE n<60)""").replace("WITH ", "WITH RECURSIVE ", 1))
def dilated_ellipses(spark, d):
    p = g.dilate(fx.mixed_2d(spark, d).where("shape = 'Ellipse'"), 0.01)
    return p.select("sample_id", "particle_id", *[r(c).alias(c) for c in ("major_axis", "minor_axis", "inflation")])


@query(sql("""SELECT sample_id, particle_id, k, round(cx+CASE shape WHEN 'Disk' THEN (r-0.002e0)*cos(t)
WHEN 'Ellipse' THEN cos(angle)*(a*cos(t)-0.002e0*cos(w))-sin(angle)*(b*sin(t)-0.002e0*sin(w))
ELSE (side/2-0.002e0)*CASE WHEN k<3 THEN -1+2*k/3e0 WHEN k<6 THEN 1 WHEN k<8 THEN 1-2*(k-6)/2e0 ELSE -1 END END,6)+0e0 AS x,
round(cy+CASE shape WHEN 'Disk' THEN (r-0.002e0)*sin(t)
WHEN 'Ellipse' THEN sin(angle)*(a*cos(t)-0.002e0*cos(w))+cos(angle)*(b*sin(t)-0.002e0*sin(w))
ELSE (side/2-0.002e0)*CASE WHEN k<3 THEN -1 WHEN k<6 THEN -1+2*(k-3)/3e0 WHEN k<8 THEN 1 ELSE 1-2*(k-8)/2e0 END END,6)+0e0 AS y
FROM (SELECT *, major_axis/2 AS a, minor_axis/2 AS b, 2*pi()*k/10 AS t,
atan2(major_axis*sin(2*pi()*k/10), minor_axis*cos(2*pi()*k/10)) AS w FROM mixed2, generate_series(0,9) AS q(k))""", "mixed2"))
def surface_points_2d(spark, d):
    p = g.surface_points(fx.mixed_2d(spark, d), 10, F.lit(0.002))
    return p.select("sample_id", "particle_id", F.col("k").cast("long").alias("k"), r("x").alias("x"), r("y").alias("y"))


@query(sql("""SELECT sample_id, particle_id, direction::BIGINT AS direction, 1e0 AS lu, 1e0 AS lv, round(pi()*r*r,9) AS volume
FROM fibers""", "fibers"))
def fibers_across(spark, d):
    p = g.with_volume(g.across_axes(fx.fibers(spark, d), fx.samples(spark, d, 3)), 2)
    return p.select("sample_id", "particle_id", F.col("direction").cast("long").alias("direction"), "lu", "lv",
                    r("volume", 9).alias("volume"))


@query(sql(f"""SELECT sample_id, particle_id, round(CASE WHEN a<0 THEN a+2*pi() ELSE a END,6) AS azimuth,
round(acos(uz),6) AS polar FROM (SELECT *, atan2(uy,ux) AS a FROM (SELECT sample_id, particle_id, (cx-0.5e0)/n AS ux,
(cy-0.5e0)/n AS uy, (cz-0.5e0)/n AS uz FROM (SELECT *, sqrt(pow(cx-0.5e0,2)+pow(cy-0.5e0,2)+pow(cz-0.5e0,2)) AS n FROM spheres)))""",
    "spheres"))
def axis_angles(spark, d):
    p = fx.spheres(spark, d)
    v = [F.col(f"c{a}") - 0.5 for a in "xyz"]
    azimuth, polar = axis_to_angles(*v)
    return p.select("sample_id", "particle_id", r(azimuth).alias("azimuth"), r(polar).alias("polar"))


@query(sql("SELECT point_id, least(floor(x*7)::BIGINT,6) AS ix, least(floor(y*5)::BIGINT,4) AS iy, "
           "round((least(floor(x*7),6)+0.5e0)/7,6) AS vx FROM points", "points"))
def cell_indices(spark, d):
    ix, iy = grid_index(F.col("x"), F.lit(1.0), F.lit(7)), grid_index(F.col("y"), F.lit(1.0), F.lit(5))
    return fx.points(spark, d).select("point_id", ix.alias("ix"), iy.alias("iy"), r((ix + 0.5) / 7).alias("vx"))


@query(sql(f"SELECT sample_id, particle_id FROM mixed2 WHERE {_IN2}", "mixed2"))
def interior_particles(spark, d):
    return g.interior_particles(fx.mixed_2d(spark, d), fx.samples(spark, d), 2).select("sample_id", "particle_id")


@query(sql(f"SELECT sample_id, particle_id FROM mixed2 WHERE NOT ({_IN2})", "mixed2"))
def crossing_particles(spark, d):
    return g.crossing_particles(fx.mixed_2d(spark, d), fx.samples(spark, d), 2).select("sample_id", "particle_id")


@query(sql(f"""SELECT sample_id, round(min(cx-h),6)+0e0 AS ox, round(min(cy-v),6)+0e0 AS oy, round(max(cx+h)-min(cx-h),6) AS lx,
round(max(cy+v)-min(cy-v),6) AS ly FROM (SELECT *, {_HALF2['x']} AS h, {_HALF2['y']} AS v FROM mixed2) GROUP BY 1""", "mixed2"))
def shrunk_boxes(spark, d):
    return rounded(g.shrunk_box(fx.mixed_2d(spark, d), 2), "ox", "oy", "lx", "ly")


@query(sql(f"""SELECT CAST(sample_id AS VARCHAR) AS sample_id, phase, count(*) AS n, round(sum(v),6) AS vf,
round(sum(c),6) AS circ_vf FROM (SELECT *, {_M2_VOL} AS v, pi()*pow({_M2_RAD},2) AS c FROM mixed2) GROUP BY sample_id, phase
UNION ALL SELECT CAST(sample_id AS VARCHAR), 'all', count(*), round(sum(v),6), round(sum(c),6) FROM
(SELECT *, {_M2_VOL} AS v, pi()*pow({_M2_RAD},2) AS c FROM mixed2) GROUP BY sample_id""", "mixed2"))
def volume_fractions(spark, d):
    out = st.volume_fractions(fx.mixed_2d(spark, d), fx.samples(spark, d), 2)
    return out.select(F.col("sample_id").cast("string").alias("sample_id"), F.coalesce("phase", F.lit("all")).alias("phase"),
                      "n", r("vf").alias("vf"), r("circ_vf").alias("circ_vf"))


@query(sql(f"""SELECT sample_id, round(min(CASE shape WHEN 'Disk' THEN r WHEN 'Ellipse' THEN
pow(minor_axis/2,2)/(major_axis/2) ELSE side/8 END),6) AS erosion, round(max(rad),6) AS max_radius,
round(avg(rad),6) AS mean_radius, round(count(*)/sum(1/rad),6) AS harmonic_radius,
round(min(CASE shape WHEN 'Disk' THEN r WHEN 'Ellipse' THEN minor_axis/2 ELSE side*sqrt(2)/2 END),6) AS min_radius_insc
FROM (SELECT *, {_M2_RAD} AS rad FROM mixed2) GROUP BY 1""", "mixed2"))
def radius_summary(spark, d):
    return rounded(st.radius_summary(fx.mixed_2d(spark, d)), "erosion", "max_radius", "mean_radius",
                   "harmonic_radius", "min_radius_insc")


@query(sql("""SELECT s_suppkey, shape, round(CASE shape WHEN 'Disk' THEN CASE k%3 WHEN 0 THEN a WHEN 1 THEN sqrt(a*a/pi()) ELSE sqrt(0.3e0/n/pi()) END
WHEN 'Sphere' THEN CASE k%3 WHEN 0 THEN a WHEN 1 THEN cbrt(3*a*a*a/(4*pi())) ELSE cbrt(3*0.3e0/n/(4*pi())) END END,6) AS r,
round(CASE WHEN shape='Square' THEN CASE k%3 WHEN 0 THEN a WHEN 1 THEN a ELSE sqrt(0.3e0/n) END END,6) AS side
FROM (SELECT s_suppkey, s_suppkey//3 AS k, CASE s_suppkey%3 WHEN 0 THEN 'Disk' WHEN 1 THEN 'Sphere' ELSE 'Square' END AS shape,
0.02e0+0.0001e0*(s_suppkey%50) AS a, 10+s_suppkey%20 AS n FROM supplier)"""))
def resolved_sizes(spark, d):
    key = F.col("s_suppkey")
    kind, a = F.floor(key / 3) % 3, F.lit(0.02) + F.lit(0.0001) * (key % 50)
    spec = fx.table(spark, d, "supplier").select(
        "s_suppkey", F.lit(1.0).alias("lx"), F.lit(1.0).alias("ly"), F.lit(1.0).alias("lz"),
        F.when(key % 3 == 0, "Disk").when(key % 3 == 1, "Sphere").otherwise("Square").alias("shape"),
        F.when(kind == 0, a).alias("r"), F.when(kind == 0, a).alias("side"), F.when(kind == 1, a * a).alias("area"),
        F.when(kind == 1, a * a * a).alias("volume"), (10 + key % 20).alias("n"), F.lit(0.3).alias("vf"))
    return rounded(g.resolve_sizes(spec).select("s_suppkey", "shape", "r", "side"), "r", "side")


@query(sql(f"SELECT sample_id, round(sum({_M3_VOL}),6) AS volume FROM mixed3 GROUP BY 1", "mixed3"))
def occupied_volume_3d(spark, d):
    p = g.with_volume(fx.mixed_3d(spark, d), 3)
    return rounded(p.groupBy("sample_id").agg(F.sum("volume").alias("volume")), "volume")


@query(sql("""SELECT sample_id, rank, particle_id, round(r,6) AS radius FROM (SELECT *,
row_number() OVER (PARTITION BY sample_id ORDER BY r DESC, particle_id) AS rank FROM disks) WHERE rank<=3""", "disks"))
def largest_particles(spark, d):
    return rounded(st.extreme_particles(fx.disks(spark, d), 3), "radius")


@query(sql("""SELECT sample_id, rank, particle_id, round(r,6) AS radius FROM (SELECT *,
row_number() OVER (PARTITION BY sample_id ORDER BY r, particle_id) AS rank FROM disks) WHERE rank<=3""", "disks"))
def smallest_particles(spark, d):
    return rounded(st.extreme_particles(fx.disks(spark, d), 3, largest=False), "radius")


@query(sql("SELECT sample_id, phase, count(*) AS n, round(avg(r),6) AS mean, round(stddev_pop(r),6) AS sigma "
           "FROM disks GROUP BY 1, 2", "disks"))
def descriptor_stats(spark, d):
    return rounded(st.descriptor_stats(fx.disks(spark, d), ["sample_id", "phase"], "r"), "mean", "sigma")


@query(sql("""SELECT sample_id, particle_id, t::INTEGER AS theta_k, k::INTEGER AS k, round(cx+CASE shape WHEN 'Sphere' THEN (r-0.002e0)*sin(pi()*t/3)*cos(phi)
ELSE m11*(x-0.002e0*x/a/a/w)+m21*(y-0.002e0*y/b/b/w)+m31*(z-0.002e0*z/c/c/w) END,6)+0e0 AS x,
round(cy+CASE shape WHEN 'Sphere' THEN (r-0.002e0)*sin(pi()*t/3)*sin(phi)
ELSE m12*(x-0.002e0*x/a/a/w)+m22*(y-0.002e0*y/b/b/w)+m32*(z-0.002e0*z/c/c/w) END,6)+0e0 AS y,
round(cz+CASE shape WHEN 'Sphere' THEN (r-0.002e0)*cos(pi()*t/3)
ELSE m13*(x-0.002e0*x/a/a/w)+m23*(y-0.002e0*y/b/b/w)+m33*(z-0.002e0*z/c/c/w) END,6)+0e0 AS z FROM (SELECT *,
sqrt(pow(x/a/a,2)+pow(y/b/b,2)+pow(z/c/c,2)) AS w FROM (SELECT *, axis_1/2*sin(th)*cos(phi) AS x, axis_2/2*sin(th)*sin(phi) AS y, axis_3/2*cos(th) AS z,
axis_1/2 AS a, axis_2/2 AS b, axis_3/2 AS c FROM (SELECT *, pi()/5+(pi()-pi()/5)*t/4 AS th, 2*pi()*k/4 AS phi FROM rot, generate_series(0,3) p(t),
generate_series(0,3) q(k) WHERE shape<>'Cylinder')))""", "mixed3", frames=_FRAMES, rot=_ROT))
def surface_points_3d(spark, d):
    p = g.surface_points(fx.mixed_3d(spark, d), 4, F.lit(0.002))
    return rounded(p.select("sample_id", "particle_id", "theta_k", "k", "x", "y", "z"), "x", "y", "z")


@query(sql("""SELECT sample_id, particle_id, k::INTEGER AS k FROM mixed2, generate_series(0,7) AS q(k) WHERE shape='Ellipse' AND k%3<>1""", "mixed2"))
def on_boundary(spark, d):
    """Points of the outline of an ellipse, every third moved off it by a thousandth of the radius."""
    p = g.surface_points(fx.mixed_2d(spark, d).where("shape = 'Ellipse'"), 8).join(
        fx.mixed_2d(spark, d), ["sample_id", "particle_id"])
    off = F.when(F.col("k") % 3 == 1, 1.001).otherwise(1.0)
    rows = p.withColumn("dx", (F.col("x") - F.col("cx")) * off).withColumn("dy", (F.col("y") - F.col("cy")) * off)
    return g.on_boundary(rows, 2).select("sample_id", "particle_id", F.col("k").cast("int").alias("k"))


@query(sql("""SELECT p_partkey, round(1+a*cos(2*t)-b*sin(2*t)+0.05e0*cos(3*t),6) AS rho,
round(-((1-cos(t))+(a*((1-cos(3*t))/3-(1-cos(t)))+b*(sin(3*t)/3-sin(t)))/2+0.05e0*((1-cos(4*t))/4-(1-cos(2*t))/2)/2)/(2*pi()),6)+0e0 AS x,
round(-(sin(t)+(a*(sin(3*t)/3+sin(t))-b*((1-cos(3*t))/3+(1-cos(t))))/2+0.05e0*(sin(4*t)/4+sin(2*t)/2)/2)/(2*pi()),6)+0e0 AS y
FROM (SELECT p_partkey, p_size*0.125e0 AS t, 0.001e0*p_size AS a, 0.002e0*p_size AS b FROM part)"""))
def outlines(spark, d):
    """Normal density and outline of three harmonics, at an angle from the part's size."""
    size = F.col("p_size")
    re = F.array(F.lit(1.0), F.lit(7.0), 0.001 * size, F.lit(0.05))
    im = F.array(F.lit(0.0), F.lit(7.0), 0.002 * size, F.lit(0.0))
    rows = fx.table(spark, d, "part").select("p_partkey", (size * 0.125).alias("t"), re.alias("re"), im.alias("im"))
    x, y = outline_point(F.col("t"), F.col("re"), F.col("im"))
    return rows.select("p_partkey", r(normal_density(F.col("t"), F.col("re"), F.col("im"))).alias("rho"), r(x).alias("x"), r(y).alias("y"))


@query(sql("""SELECT p_partkey, 'tri6'||CASE WHEN p_size%3<>0 THEN '_h'||(p_size*0.125e0)::DECIMAL(10,3)::DOUBLE::VARCHAR ELSE '' END||
CASE WHEN p_size%4=0 THEN '_epp'||p_size::VARCHAR ELSE '' END AS label, ['disk','cylindrical_fiber','ellipsoid'][1+p_size%3] AS type FROM part""".replace(
    "(p_size*0.125e0)::DECIMAL(10,3)::DOUBLE::VARCHAR", "regexp_replace((p_size*0.125e0)::VARCHAR, '\\.0$', '')")))
def labels(spark, d):
    size = F.col("p_size")
    kind = F.element_at(F.array(F.lit("Disk"), F.lit("CylindricalFiber"), F.lit("Ellipsoid")), (1 + size % 3).cast("int"))
    return fx.table(spark, d, "part").select("p_partkey", resolution_label(
        F.lit("tri6"), F.when(size % 3 != 0, size * 0.125), F.when(size % 4 == 0, size.cast("double"))).alias("label"),
        type_name(kind).alias("type"))
