"""Ripley's K, two-point correlation, histograms, chi-squared, nearest-neighbour summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from packstat.functions.hashing import u3
from packstat.operators import spatial as sp
from packstat.operators import stats as st
from packstat.plans.registry import query, rounded
from packstat.plans.sqlfix import sql, u
from packstat.sources import fixtures as fx


def _corner(w: str, h: str) -> str:
    """Quarter disk clipped by two sides, from the sector and triangles it is made of."""
    c = f"least(sqrt(greatest(d*d-({h})*({h}),0)),least({w},d))"
    m = f"least({w},d)"
    arc = lambda x: f"({x}*sqrt(greatest(d*d-{x}*{x},0))+d*d*asin(least({x}/d,1)))/2"
    return f"(({h})*{c}+{arc(m)}-{arc(c)})"


_RIPLEY = dict(
    inner="SELECT * FROM disks WHERE cx-r>=0 AND cx+r<=1 AND cy-r>=0 AND cy+r<=1",
    facts="SELECT sample_id, min(cx-r) AS ox, min(cy-r) AS oy, max(cx+r)-min(cx-r) AS bx, max(cy+r)-min(cy-r) AS by_, "
          "avg(r) AS m, count(*) AS n FROM inner_ GROUP BY 1",
    p="SELECT a.sample_id, a.cx-ox AS x, a.cy-oy AS y, bx, by_, m, n, sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)) AS d "
      "FROM inner_ a JOIN inner_ b ON a.sample_id=b.sample_id AND a.particle_id<>b.particle_id JOIN facts f ON f.sample_id=a.sample_id",
    w=f"SELECT sample_id, m, n, bx, by_, d, 1/(({_corner('x', 'y')}+{_corner('x', '(by_-y)')}+{_corner('(bx-x)', 'y')}"
      f"+{_corner('(bx-x)', '(by_-y)')})/(pi()*d*d))/n AS w FROM p",
)
_RIPLEY = {("inner_" if k == "inner" else k): v for k, v in _RIPLEY.items()}


@query(sql("""SELECT f.sample_id, t, round(m*(t*0.1e0),6) AS r, round(coalesce(sum(w),0e0)*any_value(bx*by_)/any_value(n),6) AS k
FROM (SELECT sample_id, t, m, bx, by_, n FROM facts, generate_series(0,99) AS g(t)) f
LEFT JOIN (SELECT sample_id, d, w FROM w) w ON w.sample_id=f.sample_id AND w.d<m*(t*0.1e0) GROUP BY 1,2,m""", "disks", **_RIPLEY))
def ripley_k(spark, d):
    return rounded(st.ripley_k(fx.disks(spark, d), fx.samples(spark, d), 10, 10), "r", "k")


_HIT = ("EXISTS (SELECT 1 FROM disks m WHERE m.sample_id={p}.sample_id AND sqrt(pow({p}.x-m.cx-round_even({p}.x-m.cx,0),2)"
        "+pow({p}.y-m.cy-round_even({p}.y-m.cy,0),2))<=m.r)")


@query(sql(f"""SELECT s.sample_id, s.sep, s.ratio AS r_over_R, round(coalesce(hits,0)/n,6) AS s2 FROM (
SELECT sample_id, sep, sep*0.5e0 AS ratio, n FROM (SELECT sample_id, count(*) AS n FROM points GROUP BY 1),
generate_series(0,5) AS g(sep)) s LEFT JOIN (SELECT sample_id, sep, count(*) AS hits FROM second_ q WHERE {_HIT.format(p='q')}
GROUP BY 1,2) h USING (sample_id, sep)""", "points", "disks",
    mean_="SELECT sample_id, avg(r) AS m FROM disks GROUP BY 1",
    first_=f"SELECT * FROM points p WHERE {_HIT.format(p='p')}",
    second_=f"""SELECT sample_id, sep, x+sep*0.5e0*m*cos(2*pi()*{u('u3', 'point_id*7+sep')}) AS x,
y+sep*0.5e0*m*sin(2*pi()*{u('u3', 'point_id*7+sep')}) AS y FROM first_ JOIN mean_ USING (sample_id), generate_series(0,5) AS g(sep)"""))
def two_point(spark, d):
    angle = 2 * F.pi() * u3(F.col("point_id") * 7 + F.col("sep"))
    out = st.two_point(fx.disks(spark, d), fx.samples(spark, d), fx.points(spark, d), 2,
                       [0.5 * k for k in range(6)], angle=angle)
    return rounded(out, "s2")


@query()
def two_point_random(spark, d):
    """First points and directions from hashes: the estimate itself, without given points."""
    s = fx.samples(spark, d)
    pts = st.random_points(s, 500, 2, seed=7)
    return rounded(st.two_point(fx.disks(spark, d), s, pts, 2, [0.25 * k for k in range(16)], seed=7), "s2")


_HIT3 = ("EXISTS (SELECT 1 FROM spheres m WHERE m.sample_id={p}.sample_id AND (pow({p}.x-m.cx-round_even({p}.x-m.cx,0),2)"
         "+pow({p}.y-m.cy-round_even({p}.y-m.cy,0),2)+pow({p}.z-m.cz-round_even({p}.z-m.cz,0),2))/(m.r*m.r)-1<=1e-6)")


@query(sql(f"""SELECT s.sample_id, s.sep, round(s.ratio,6) AS r_over_R, round(coalesce(hits,0)/n,6) AS s2 FROM (
SELECT sample_id, sep, sep*0.7e0 AS ratio, n FROM (SELECT sample_id, count(*) AS n FROM points GROUP BY 1),
generate_series(0,3) AS g(sep)) s LEFT JOIN (SELECT sample_id, sep, count(*) AS hits FROM second_ q WHERE {_HIT3.format(p='q')}
GROUP BY 1,2) h USING (sample_id, sep)""", "points", "spheres",
    mean_="SELECT sample_id, avg(r) AS m FROM spheres GROUP BY 1",
    first_=f"SELECT * FROM points p WHERE {_HIT3.format(p='p')}",
    second_="""SELECT sample_id, sep, x+sep*0.7e0*m*1/3 AS x, y+sep*0.7e0*m*2/3 AS y, z+sep*0.7e0*m*2/3 AS z
FROM first_ JOIN mean_ USING (sample_id), generate_series(0,3) AS g(sep)"""))
def two_point_direction_3d(spark, d):
    out = st.two_point(fx.spheres(spark, d), fx.samples(spark, d, 3), fx.points(spark, d), 3,
                       [0.7 * k for k in range(4)], direction=[1.0, 2.0, 2.0])
    return rounded(out, "r_over_R", "s2")


@query(sql("""SELECT sample_id, bin, round(lo+bin*(hi-lo)/8,6) AS lo, round(lo+(bin+1)*(hi-lo)/8,6) AS hi,
(SELECT count(*) FROM disks x WHERE x.sample_id=f.sample_id AND least(floor((x.r-lo)/(hi-lo)*8),7)=bin) AS n
FROM (SELECT sample_id, min(r) AS lo, max(r) AS hi FROM disks GROUP BY 1) f, generate_series(0,7) AS g(bin)""", "disks"))
def radius_histogram(spark, d):
    return rounded(st.histogram(fx.disks(spark, d), ["sample_id"], "r", 8), "lo", "hi")


@query(sql("""SELECT sample_id, bin, round(lo+bin*(hi-lo)/b,6) AS lo, round(lo+(bin+1)*(hi-lo)/b,6) AS hi,
(SELECT count(*) FROM disks x WHERE x.sample_id=f.sample_id AND least(floor((x.r-lo)/(hi-lo)*b),b-1)=bin) AS n
FROM (SELECT *, ceil((hi-lo)/CASE WHEN q>0 THEN least(2*q/cbrt(n),(hi-lo)/(log2(n)+1)) ELSE (hi-lo)/(log2(n)+1) END)::BIGINT AS b
FROM (SELECT sample_id, min(r) AS lo, max(r) AS hi, count(*) AS n, quantile_cont(r,0.75)-quantile_cont(r,0.25) AS q
FROM disks GROUP BY 1)) f, unnest(generate_series(0,b-1)) AS g(bin)""", "disks"))
def radius_histogram_auto(spark, d):
    return rounded(st.histogram(fx.disks(spark, d), ["sample_id"], "r", "auto"), "lo", "hi")


@query(sql("""SELECT phase, bin, round(bin*0.1e0,6) AS lo, round((bin+1)*0.1e0,6) AS hi,
(SELECT count(*) FROM disks x WHERE x.phase=f.phase AND least(floor(x.cx/1*10),9)=bin) AS n
FROM (SELECT DISTINCT phase FROM disks) f, generate_series(0,9) AS g(bin)""", "disks"))
def position_deciles(spark, d):
    return rounded(st.histogram(fx.disks(spark, d), ["phase"], "cx", 10, (0.0, 1.0)), "lo", "hi")


@query(sql("""SELECT round(sum(pow(coalesce(o,0)-e,2)/e),6) AS chi, count(*) AS used FROM (SELECT r.sample_id, c.b, c.n*r.n/s AS e
FROM (SELECT sample_id, count(*) AS n FROM v WHERE b BETWEEN 1 AND 20 GROUP BY 1) r,
(SELECT b, count(*) AS n FROM v WHERE b BETWEEN 1 AND 20 GROUP BY 1) c, (SELECT count(*) AS s FROM v)) g LEFT JOIN
(SELECT sample_id, b, count(*) AS o FROM v GROUP BY 1,2) o USING (sample_id, b)""", "disks",
    v="SELECT sample_id, ceil(cx*20)::BIGINT AS b FROM disks"))
def chi_squared(spark, d):
    return rounded(st.chi_squared(fx.disks(spark, d), "sample_id", "cx"), "chi")


@query(sql("""SELECT sample_id, count(*) AS n, round(avg(nn),6) AS mean, round(min(nn),6) AS least, round(max(nn),6) AS largest FROM (
SELECT sample_id, i, min(d)/any_value(m) AS nn FROM directed JOIN (SELECT sample_id, avg(r) AS m FROM disks GROUP BY 1)
USING (sample_id) GROUP BY 1,2) GROUP BY 1""", "directed"))
def nn_summary(spark, d):
    nn = sp.nearest_neighbor(fx.disks(spark, d), fx.samples(spark, d), 2)
    return rounded(st.nn_summary(nn), "mean", "least", "largest")


@query(sql("""SELECT flag, unnest([0e0,0.25e0,0.5e0,0.999e0,1e0]) AS p, round(unnest(q),6) AS price FROM (SELECT l_returnflag AS flag,
quantile_cont(l_extendedprice::DOUBLE,[0,0.25,0.5,0.999,1]) AS q FROM lineitem GROUP BY 1)"""))
def price_quantiles(spark, d):
    """Exact quantiles of a few keys, each of which holds a large part of all rows."""
    at = [0.0, 0.25, 0.5, 0.999, 1.0]
    found = st.quantiles(fx.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice", at)
    each = found.select("flag", F.posexplode("quantiles").alias("_i", "price"))
    return rounded(each.select("flag", F.get(F.array(*[F.lit(p) for p in at]), F.col("_i")).alias("p"), "price"), "price")
