"""Run telemetry: equilibrium criteria, outcome, smoothing, motion, ordered geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from packstat.functions.ordered import number_rows, running
from packstat.operators import geometry as g
from packstat.operators import spatial as sp
from packstat.operators import stats as st
from packstat.operators import telemetry as tm
from packstat.operators.mesh import renumber
from packstat.plans.registry import query, r, rounded
from packstat.plans.sqlfix import VIEWS, sql
from packstat.sources import fixtures as fx

_CHANGES = "SELECT sample_id, step FROM steps WHERE step%13=0 AND total_overlap>15"


def _changes(steps):
    return steps.where("step % 13 = 0 AND total_overlap > 15").select("sample_id", "step")


@query(sql("""SELECT sample_id, step, ts, total_overlap, kinetic, thermic, round(dt,6) AS dt FROM steps""", "steps"))
def run_steps(spark, d):
    return rounded(fx.run_steps(spark, d), "dt")


_CHANGE = """SELECT g.sample_id, g.i, g.j, g.step, coalesce(a.v,0)-coalesce(b.v,0) AS c FROM
(SELECT DISTINCT p.sample_id, p.i, p.j, s.step FROM pair_overlaps p JOIN grid s USING (sample_id)) g
LEFT JOIN tot a ON (a.sample_id,a.i,a.j,a.step)=(g.sample_id,g.i,g.j,g.step)
LEFT JOIN tot b ON (b.sample_id,b.i,b.j,b.step)=(g.sample_id,g.i,g.j,g.step-1)"""
_RATIO = """SELECT g.sample_id, g.step, coalesce(grown,0) AS grown, coalesce(shrunk,0) AS shrunk,
CASE WHEN shrunk>0 THEN grown/shrunk WHEN grown>0 THEN 1e12 ELSE 1e0 END AS ratio FROM grid g LEFT JOIN
(SELECT sample_id, step, sum(CASE WHEN c>0 THEN c ELSE 0 END) AS grown, sum(CASE WHEN c<0 THEN -c ELSE 0 END) AS shrunk
FROM change GROUP BY 1,2) USING (sample_id, step)"""
_RATIO_CTES = dict(
    grid="SELECT sample_id, unnest(generate_series(1, max(step))) AS step FROM pair_overlaps GROUP BY 1",
    tot="SELECT sample_id, i, j, step, sum(overlap) AS v FROM pair_overlaps GROUP BY 1,2,3,4", change=_CHANGE)


@query(sql("SELECT sample_id, step, round(grown,6) AS grown, round(shrunk,6) AS shrunk, round(ratio,6) AS ratio "
           f"FROM ({_RATIO})", "pair_overlaps", **_RATIO_CTES))
def overlap_ratio(spark, d):
    return rounded(tm.overlap_ratio(fx.pair_overlaps(spark, d)), "grown", "shrunk", "ratio")


_CROSS = """SELECT *, sum(CASE WHEN crossing THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY step)::BIGINT AS n_crossings
FROM (SELECT sample_id, step, coalesce((ratio-1)*(lag(ratio) OVER (PARTITION BY sample_id ORDER BY step)-1)<=0,false) AS crossing
FROM q)"""


@query(sql(f"SELECT *, crossing AND n_crossings%2=0 AS event FROM ({_CROSS})", "longsteps",
           q="SELECT sample_id, step, total_overlap/8 AS ratio FROM longsteps"))
def ratio_crossings(spark, d):
    q = fx.run_steps(spark, d, "event_type").withColumn("ratio", F.col("total_overlap") / 8)
    return tm.ratio_crossings(q, 2).select("sample_id", "step", "crossing", "n_crossings", "event")


@query(sql("""SELECT sample_id, step, coalesce(total_overlap>lag(total_overlap,5) OVER w AND step-(SELECT max(c.step) FROM ch c
WHERE c.sample_id=s.sample_id AND c.step<s.step)>5,false) AS equilibrium FROM steps s
WINDOW w AS (PARTITION BY sample_id ORDER BY step)""", "steps", ch=_CHANGES))
def equilibrium_rolling(spark, d):
    steps = fx.run_steps(spark, d)
    return tm.equilibrium_rolling(steps, _changes(steps), 5)


_ORIGINAL = """WITH RECURSIVE {steps}, seen AS (SELECT sample_id, step, max(CASE WHEN up THEN step END) OVER (PARTITION BY sample_id
ORDER BY step) AS risen FROM (SELECT sample_id, step, total_overlap>lag(total_overlap) OVER (PARTITION BY sample_id ORDER BY step) AS up
FROM longsteps)), events(sample_id, step, m, next_change) AS (SELECT DISTINCT sample_id, -1::BIGINT, 10::BIGINT, 10::BIGINT FROM seen
UNION ALL SELECT sample_id, found, m+found-next_change-1, found+m+found-next_change-1 FROM (SELECT e.sample_id, e.m, e.next_change,
min(s.step) AS found FROM events e JOIN seen s ON s.sample_id=e.sample_id AND s.step>e.next_change AND s.step-s.risen<(e.m+1)//2
GROUP BY ALL)) SELECT * FROM events WHERE step>=0"""


@query(_ORIGINAL.format(steps=VIEWS["longsteps"]))
def equilibrium_original(spark, d):
    """Self-lengthening waits, event by event."""
    return tm.equilibrium_original(fx.run_steps(spark, d, "event_type"), 10)


@query(sql("""SELECT s.sample_id, s.step, coalesce(sum(low) OVER (PARTITION BY s.sample_id ORDER BY s.step),0)::BIGINT AS lowerings,
round(2*pow(0.9e0,coalesce(sum(low) OVER (PARTITION BY s.sample_id ORDER BY s.step),0)),6) AS temperature FROM steps s LEFT JOIN
(SELECT sample_id, step, CASE WHEN step=min(CASE WHEN parted THEN step END) OVER (PARTITION BY sample_id) THEN 0 ELSE 1 END AS low
FROM (SELECT sample_id, step, abs(kinetic-thermic)/thermic>1/0.9e0/2 AS parted FROM steps JOIN ch USING (sample_id, step))) e
USING (sample_id, step)""", "steps", ch=_CHANGES))
def temperature_stages(spark, d):
    steps = fx.run_steps(spark, d)
    return rounded(tm.temperature_stages(steps, _changes(steps), 2.0, 0.9), "temperature")


@query(sql("""SELECT sample_id, step, coalesce(step>5 AND max(c) OVER (PARTITION BY sample_id ORDER BY step
ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)<300,false) AS stagnant FROM (SELECT sample_id, step,
abs(total_overlap-lag(total_overlap) OVER w)/lag(total_overlap) OVER w*100 AS c FROM steps
WINDOW w AS (PARTITION BY sample_id ORDER BY step))""", "steps"))
def stagnation(spark, d):
    return tm.stagnation(fx.run_steps(spark, d), 5, 300.0)


@query(sql("""SELECT sample_id, step, coalesce(step>500 AND max(c) OVER (PARTITION BY sample_id ORDER BY step
ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)<1e-2,false) AS stagnant FROM (SELECT sample_id, step,
abs(v-lag(v) OVER w)/lag(v) OVER w*100 AS c FROM (SELECT sample_id, step,
CASE WHEN step%1100<700 THEN 5e0 ELSE total_overlap END AS v FROM longsteps)
WINDOW w AS (PARTITION BY sample_id ORDER BY step))""", "longsteps"))
def stagnation_long(spark, d):
    """The published limits, on runs that stand still for 700 of every 1100 steps."""
    steps = fx.run_steps(spark, d, "event_type").withColumn(
        "total_overlap", F.when(F.col("step") % 1100 < 700, 5.0).otherwise(F.col("total_overlap")))
    return tm.stagnation(steps)


@query(sql("""SELECT sample_id, step, streak, streak>3 AS ends FROM (SELECT sample_id, step, step-coalesce(max(CASE WHEN
total_overlap>20+1e-12 THEN step END) OVER (PARTITION BY sample_id ORDER BY step),-1) AS streak FROM steps)""", "steps"))
def legal_streak(spark, d):
    return tm.legal_streak(fx.run_steps(spark, d), 20.0, 3)


@query(sql("""SELECT a.sample_id, first_legal, n_steps, last_change, first_legal-last_change AS to_converge FROM
(SELECT sample_id, min(CASE WHEN total_overlap<=1+1e-12 THEN step END) AS first_legal, max(step)+1 AS n_steps FROM steps GROUP BY 1) a
LEFT JOIN (SELECT sample_id, max(step) AS last_change FROM ch GROUP BY 1) USING (sample_id)""", "steps", ch=_CHANGES))
def run_milestones(spark, d):
    steps = fx.run_steps(spark, d)
    return tm.run_milestones(steps, _changes(steps), 1.0)


def _runs(spark, d):
    """One run per order: its price stands for the final overlap, its status for the outcome."""
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 1000).alias("total_overlap"),
        F.lit(100.0).alias("max_residue"), F.floor(F.col("o_totalprice") / 100).alias("seconds"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice") / 1000 <= 100).alias("status"))


_RUNS = """SELECT o_orderkey AS sample_id, o_totalprice/1000 AS total_overlap, 100e0 AS max_residue,
floor(o_totalprice/100)::BIGINT AS seconds, CASE WHEN o_orderstatus='P' THEN NULL ELSE o_totalprice/1000<=100 END AS status FROM orders"""


@query(sql("SELECT sample_id FROM runs WHERE total_overlap<=max_residue+1e-12", runs=_RUNS))
def legal_runs(spark, d):
    return tm.legal_runs(_runs(spark, d)).select("sample_id")


@query(sql("SELECT sample_id FROM runs WHERE NOT (total_overlap<=max_residue+1e-12)", runs=_RUNS))
def failed_runs(spark, d):
    return tm.legal_runs(_runs(spark, d), legal=False).select("sample_id")


@query(sql("""SELECT count(*) AS n_samples, sum(CASE WHEN status THEN 1 ELSE 0 END)::BIGINT AS n_legal,
sum(CASE WHEN NOT status THEN 1 ELSE 0 END)::BIGINT AS n_illegal, sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END)::BIGINT
AS n_unfinished, sum(seconds)::BIGINT AS seconds FROM runs""", runs=_RUNS))
def batch_report(spark, d):
    return tm.batch_report(_runs(spark, d))


@query(sql("""SELECT name, n, round(seconds,2) AS seconds, round(seconds/(SELECT sum(seconds) FROM t WHERE name NOT LIKE '- %'),6) AS share
FROM t""", t="""SELECT CASE WHEN event_type='error' THEN '- error' ELSE event_type END AS name, sum(value) AS seconds, count(*) AS n
FROM events GROUP BY 1"""))
def time_report(spark, d):
    times = fx.table(spark, d, "events").select(
        F.when(F.col("event_type") == "error", "- error").otherwise(F.col("event_type")).alias("name"),
        F.col("value").alias("seconds"))
    return tm.time_report(times).select("name", "n", r("seconds", 2).alias("seconds"), r("share").alias("share"))


@query(sql("""SELECT sample_id, step, CASE WHEN step>2 AND step<len-2 THEN round(a,6) END AS moving_average FROM (SELECT sample_id, step,
avg(total_overlap) OVER (PARTITION BY sample_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a,
count(*) OVER (PARTITION BY sample_id) AS len FROM longsteps)""", "longsteps"))
def moving_average(spark, d):
    out = tm.moving_average(fx.run_steps(spark, d, "event_type"), "total_overlap", 5)
    return out.select("sample_id", "step", r("moving_average").alias("moving_average"))


# least squares by the normal equations around the window's centre, from DuckDB's own sums
@query(sql("""SELECT sample_id, step, round(s0/(2*m+1)+x*s1/q2+(x*x-q2/(2*m+1))*(s2-q2/(2*m+1)*s0)/(q4-q2*q2/(2*m+1)),5)+0e0 AS smoothed
FROM (SELECT a.sample_id, a.step, a.m, a.step-a.c AS x, sum(b.total_overlap) AS s0, sum((b.step-a.c)*b.total_overlap) AS s1,
sum((b.step-a.c)*(b.step-a.c)*b.total_overlap) AS s2, sum((b.step-a.c)*(b.step-a.c))::DOUBLE AS q2,
sum(pow(b.step-a.c,4)) AS q4 FROM a JOIN steps b ON a.sample_id=b.sample_id AND abs(b.step-a.c)<=a.m GROUP BY 1,2,3,4)""",
    "steps", a="""SELECT sample_id, step, m, least(greatest(step,m),len-1-m) AS c FROM (SELECT *, (least(41,len-(1-len%2))-1)//2 AS m
FROM (SELECT sample_id, step, count(*) OVER (PARTITION BY sample_id) AS len FROM steps))"""))
def savgol(spark, d):
    out = tm.savgol(fx.run_steps(spark, d), "total_overlap")
    return out.select("sample_id", "step", r("smoothed", 5).alias("smoothed"))


@query(sql("""SELECT p.sample_id, particle_id, step FROM paths p JOIN (SELECT sample_id, min(m) AS m FROM (SELECT sample_id,
particle_id, max(step) AS m FROM paths GROUP BY 1,2) GROUP BY 1) c USING (sample_id) WHERE step<=c.m""", "paths"))
def common_steps(spark, d):
    return tm.cut_common_steps(fx.paths(spark, d)).select("sample_id", "particle_id", "step")


_MOVED = """SELECT *, sum(sx) OVER w AS mx, sum(sy) OVER w AS my, sum(sqrt(sx*sx+sy*sy)) OVER w AS len FROM (SELECT sample_id, particle_id, step, dt,
coalesce(x-lag(x) OVER v-round_even(x-lag(x) OVER v,0),0) AS sx, coalesce(y-lag(y) OVER v-round_even(y-lag(y) OVER v,0),0) AS sy
FROM paths WINDOW v AS (PARTITION BY particle_id ORDER BY step)) WINDOW w AS (PARTITION BY particle_id ORDER BY step)"""


@query(sql("""SELECT sample_id, particle_id, step, round(sx,6)+0e0 AS step_x, round(sy,6)+0e0 AS step_y, round(mx,6)+0e0 AS moved_x,
round(my,6)+0e0 AS moved_y, round(len,6) AS path_length FROM moved""", "paths", moved=_MOVED))
def displacement(spark, d):
    out = tm.displacement(fx.paths(spark, d), _boxes(spark, d), 2)
    return rounded(out.drop("x", "y", "dt"), "step_x", "step_y", "moved_x", "moved_y", "path_length")


def _boxes(spark, d):
    """A unit box for every sample of the trajectories."""
    ids = fx.table(spark, d, "events").select((F.col("user_id") % 10).alias("sample_id")).distinct()
    return ids.select("sample_id", F.lit(2).alias("dim"), F.lit(1.0).alias("lx"), F.lit(1.0).alias("ly"),
                      F.lit(None).cast("double").alias("lz"), F.lit(True).alias("periodic"), F.lit("3").alias("matrix_phase"))


@query(sql("SELECT sample_id, step, round(avg(mx*mx+my*my),6) AS msd, count(*) AS n FROM moved GROUP BY 1,2", "paths", moved=_MOVED))
def mean_square_displacement(spark, d):
    moved = tm.displacement(fx.paths(spark, d), _boxes(spark, d), 2)
    return rounded(tm.mean_square_displacement(moved, 2), "msd")


@query(sql("SELECT sample_id, step, round(sum(0.5e0*(1+particle_id%3)*(sx*sx+sy*sy)/(dt*dt)),5) AS kinetic FROM moved GROUP BY 1,2",
           "paths", moved=_MOVED))
def kinetic_energy(spark, d):
    paths = fx.paths(spark, d)
    masses = paths.select("sample_id", "particle_id").distinct().withColumn("mass", (1 + F.col("particle_id") % 3) * 1.0)
    moved = tm.displacement(paths, _boxes(spark, d), 2)
    return rounded(tm.kinetic_energy(moved, masses, 2), "kinetic", digits=5)


@query(sql("""SELECT sample_id, step, round(0.5e0*2*(2*pow(0.9e0,step%4))*n,6) AS thermic FROM steps JOIN (SELECT user_id AS sample_id,
count(*) AS n FROM events GROUP BY 1) USING (sample_id)""", "steps"))
def thermic_energy(spark, d):
    stages = fx.run_steps(spark, d).select("sample_id", "step", (2 * F.pow(F.lit(0.9), F.col("step") % 4)).alias("temperature"))
    counts = fx.table(spark, d, "events").select(F.col("user_id").alias("sample_id"))
    return rounded(tm.thermic_energy(stages, counts, 2).drop("temperature"), "thermic")


@query(sql("SELECT sample_id, step, kinetic, thermic FROM steps", "steps"))
def asof_thermic(spark, d):
    """The thermic history starts a step late; aligned at the last steps it meets its own step again."""
    steps = fx.run_steps(spark, d)
    thermic = steps.where("step > 0").select("sample_id", (F.col("step") - 1).alias("pos"), "thermic")
    return tm.asof_thermic(steps.select("sample_id", "step", "kinetic"), thermic)


@query(sql("""SELECT n.sample_id, round(sqrt(2/greatest(1,coalesce(z,0)/n))*sqrt(n/s),6) AS dt FROM (SELECT sample_id, count(*) AS n,
sum(1/r) AS s FROM disks GROUP BY 1) n LEFT JOIN (SELECT sample_id, count(*) AS z FROM directed WHERE d<ri+rj GROUP BY 1)
USING (sample_id)""", "directed"))
def adaptive_dt(spark, d):
    p, s = fx.disks(spark, d), fx.samples(spark, d)
    summary = sp.overlap_summary(p, sp.overlaps(p, s, 2), 2)
    return rounded(tm.adaptive_dt(summary.select("sample_id", "mean_coordination"),
                                  st.radius_summary(p).select("sample_id", "harmonic_radius")), "dt")


_OFFSET = dict(
    small="SELECT sample_id, particle_id, axis, lo, hi, lo-floor(lo) AS a, hi-floor(hi) AS z FROM (SELECT sample_id, particle_id, 'x' AS axis, "
          "cx-r/4 AS lo, cx+r/4 AS hi FROM disks UNION ALL SELECT sample_id, particle_id, 'y', cy-r/4, cy+r/4 FROM disks)",
    lims="SELECT DISTINCT sample_id, axis, a AS pos FROM small UNION SELECT DISTINCT sample_id, axis, z FROM small",
    gaps="SELECT sample_id, axis, pos, coalesce(lead(pos) OVER (PARTITION BY sample_id, axis ORDER BY pos), "
         "1+min(pos) OVER (PARTITION BY sample_id, axis))-pos AS gap FROM lims",
    tested="SELECT *, NOT EXISTS (SELECT 1 FROM small s WHERE s.sample_id=g.sample_id AND s.axis=g.axis AND "
           "((pos+gap/2-s.lo)-floor(pos+gap/2-s.lo))<s.hi-s.lo) AS free FROM gaps g",
)


@query(sql("""SELECT sample_id, axis, round(m-floor(m),6) AS "offset", round(gap,6) AS gap, free FROM (SELECT *, pos+gap/2 AS m,
row_number() OVER (PARTITION BY sample_id, axis ORDER BY free DESC, gap DESC, pos DESC) AS k FROM tested) WHERE k=1""",
    "disks", **_OFFSET))
def rve_offset(spark, d):
    p = fx.disks(spark, d).withColumn("r", F.col("r") / 4)
    return rounded(tm.rve_offset(p, fx.samples(spark, d), 2), "offset", "gap")


@query(sql("""SELECT sample_id, particle_id AS step, sum(CASE WHEN phase='1' THEN 1 ELSE 0 END) OVER w::BIGINT AS n_accepted,
round(sum(CASE WHEN phase='1' THEN pi()*r*r ELSE 0 END) OVER w,6) AS vf FROM disks
WINDOW w AS (PARTITION BY sample_id ORDER BY particle_id)""", "disks"))
def acceptance_curve(spark, d):
    steps = g.with_volume(fx.disks(spark, d), 2).select(
        "sample_id", F.col("particle_id").alias("step"), "volume", (F.col("phase") == "1").alias("accepted"))
    return rounded(tm.acceptance_curve(steps, fx.samples(spark, d)), "vf")


@query(sql("""SELECT sample_id, particle_id FROM (SELECT *, sum(pi()*r*r) OVER (PARTITION BY sample_id ORDER BY particle_id)-pi()*r*r AS b
FROM disks) WHERE b<0.1e0""", "disks"))
def fill_to_fraction(spark, d):
    draws = g.with_volume(fx.disks(spark, d), 2)
    return tm.fill_to_fraction(draws, ["sample_id"], "particle_id", "volume", F.lit(0.1)).select("sample_id", "particle_id")


@query(sql("""SELECT l_orderkey, l_linenumber, l_partkey, dense_id FROM (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus,
l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS dense_id FROM lineitem)"""))
def dense_ids(spark, d):
    """One numbering of all rows from 1, in group order: sorted ranges and their offsets, no single-task window."""
    rows = fx.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber",
                                                 "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return number_rows(rows, [], rows.columns, "dense_id", start=1).select(
        "l_orderkey", "l_linenumber", "l_partkey", "dense_id")


@query(sql("""SELECT sample_id, particle_id, step, round(x*2-0.25e0-4*floor((x*2-0.25e0)/4),6)+0e0 AS x,
round(y*2-0.5e0-2*floor((y*2-0.5e0)/2),6)+0e0 AS y FROM paths""", "paths"))
def paths_to_units(spark, d):
    boxes = _boxes(spark, d).withColumn("lx", F.lit(4.0)).withColumn("ly", F.lit(2.0))
    out = g.paths_to_units(fx.paths(spark, d), boxes, 2, [F.lit(0.25), F.lit(0.5)])
    return rounded(out.drop("dt"), "x", "y")


@query(sql("SELECT sample_id, step, round(total_overlap*2,6) AS total_overlap FROM steps", "steps"))
def run_records_to_units(spark, d):
    steps = fx.run_steps(spark, d).select("sample_id", "step", "total_overlap")
    boxes = steps.select("sample_id").distinct().withColumn("lx", F.lit(4.0)).withColumn("ly", F.lit(2.0))
    return rounded(g.run_records_to_units(steps, boxes, 2), "total_overlap")


_HASHED = "SELECT 0 AS sample_id, (p_partkey*2654435761)%1099511627776 AS id, 1+p_size AS volume FROM part"


def _hashed(spark, d):
    """Every part under a scattered id, all of one key."""
    return fx.table(spark, d, "part").select(F.lit(0).alias("sample_id"), (F.col("p_partkey").cast("long") * 2654435761 % 1099511627776).alias("id"),
                                             (1 + F.col("p_size")).cast("long").alias("volume"))


@query(sql("""SELECT id, total::BIGINT AS total FROM (SELECT id, volume, sum(volume) OVER (ORDER BY id) AS total, sum(volume) OVER () AS whole FROM hashed)
WHERE total-volume<whole*0.5e0""", hashed=_HASHED))
def fill_scattered(spark, d):
    """Parts in the order of scattered ids, all of one key, until half of their volume is reached."""
    rows = _hashed(spark, d)
    half = rows.agg((F.sum("volume") * 0.5).alias("v")).scalar()
    kept = tm.fill_to_fraction(rows, ["sample_id"], "id", "volume", half)
    return running(kept, ["sample_id"], "id", {"total": F.col("volume")}, sparse=True).select("id", F.col("total").cast("long").alias("total"))


@query(sql("""SELECT id, id-gone::BIGINT AS new_id FROM (SELECT id, volume, sum(CASE WHEN volume%3=0 THEN 1 ELSE 0 END) OVER (ORDER BY id) AS gone FROM hashed)
WHERE volume%3<>0""", hashed=_HASHED))
def renumber_scattered(spark, d):
    """Scattered ids of one key, less the number of removed ones below."""
    rows = _hashed(spark, d).withColumnRenamed("id", "node_id")
    out = renumber(rows, rows.where("volume % 3 = 0"))
    return out.select(F.col("node_id").alias("id"), "new_id")
