"""Population sampling, placement, thinning, convex pairs, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from packstat.functions.hashing import u2, u3
from packstat.functions.shapes import by_shape
from packstat.operators import convex as cx
from packstat.operators import rules as ru
from packstat.operators import sampling as sa
from packstat.operators import spatial as sp
from packstat.operators import stats as st
from packstat.plans.registry import query, r, rounded
from packstat.plans.sqlfix import sql, u
from packstat.session import unfolded
from packstat.sources import fixtures as fx

# --- specifications derived from suppliers: one sample each, faults by key -------------------


def _descriptor(name, kind, params=None, values=None, probabilities=None):
    pairs = [x for k, v in (params or {}).items() for x in (F.lit(k), v.cast("double") if hasattr(v, "cast") else F.lit(float(v)))]
    return F.struct(
        F.lit(name).alias("name"), (kind if hasattr(kind, "cast") else F.lit(kind)).alias("distribution"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")).alias("params"),
        (F.lit(None).cast("array<double>") if values is None else F.array(*[F.lit(float(v)) for v in values])).alias("values"),
        (F.lit(None).cast("array<double>") if probabilities is None
         else F.array(*[F.lit(float(v)) for v in probabilities])).alias("probabilities"))


def _suppliers(spark, d):
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"))


def _unfold(rows, *entries):
    return rows.select("sample_id", F.lit("1").alias("phase"), F.explode(F.array(*entries)).alias("_d")).select(
        "sample_id", "phase", "_d.*")


def _draw_specs(spark, d):
    k = F.col("sample_id")
    return _unfold(_suppliers(spark, d),
                   _descriptor("a", "fixed", {"value": k * 0.5}), _descriptor("b", "uniform", {"low": k * 1.0, "high": k * 1.0 + 4}),
                   _descriptor("c", "discrete", None, [1, 2, 5], [0.25, 0.25, 0.5]),
                   _descriptor("d", "specified", None, [3, 1, 4, 1, 5, 9]))


def _draw_rows(spark, d):
    n = F.lit(1).cast("long"), (4 + F.col("sample_id") % 5).cast("long")
    return _suppliers(spark, d).select("sample_id", F.lit("1").alias("phase"), F.explode(F.sequence(*n)).alias("k"))


_ROWS = """SELECT s_suppkey AS sample_id, unnest(generate_series(1, 4+s_suppkey%5)) AS k FROM supplier"""
_DRAWN = f"""SELECT sample_id, k, name, CASE name WHEN 'a' THEN sample_id*0.5e0 WHEN 'b' THEN sample_id+4*u
WHEN 'c' THEN CASE WHEN u<0.25e0 THEN 1e0 WHEN u<0.5e0 THEN 2e0 ELSE 5e0 END ELSE [3e0,1e0,4e0,1e0,5e0,9e0][k] END AS value
FROM (SELECT *, {u('u2', 'sample_id*1000+k*10')} AS u FROM rows_, (VALUES ('a'),('b'),('c'),('d')) v(name))"""


@query(sql("SELECT sample_id, k, name, round(value,6) AS value FROM dr", rows_=_ROWS, dr=_DRAWN))
def draw(spark, d):
    """Fixed, uniform, discrete and specified descriptors from uniforms of the key."""
    out = sa.draw(_draw_rows(spark, d), _draw_specs(spark, d), u=lambda: u2(F.col("sample_id") * 1000 + F.col("k") * 10))
    return rounded(out.drop("phase"), "value")


@query(sql("SELECT sample_id, name, count(*) AS n_missing FROM dr WHERE value IS NULL GROUP BY 1,2", rows_=_ROWS, dr=_DRAWN))
def short_specifications(spark, d):
    return sa.short_problems(sa.draw(_draw_rows(spark, d), _draw_specs(spark, d))).drop("phase")


@query()
def drawn_moments(spark, d):
    """Mean and deviation of normal, lognormal (log), von Mises and hashed uniform draws, one per part."""
    rows = fx.table(spark, d, "part").select(F.lit(0).cast("long").alias("sample_id"), F.lit("1").alias("phase"),
                                             F.col("p_partkey").alias("k"))
    specs = _unfold(rows.where("k = 0").select("sample_id"), _descriptor("normal", "normal", {"mean": 2, "sigma": 3}),
                    _descriptor("lognormal", "lognormal", {"mean": 2, "sigma": 0.5}),
                    _descriptor("vonmises", "vonmises", {"kappa": 4, "loc": 0.5, "scale": 1}),
                    _descriptor("uniform", "uniform", {"low": -1, "high": 1}))
    out = sa.draw(rows, specs, 3)
    value = F.when(F.col("name") == "lognormal", F.log("value")).otherwise(F.col("value"))
    return rounded(out.withColumn("value", value).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma")), "mean", "sigma")


@query(sql("""SELECT sample_id, CASE WHEN sample_id%2=0 THEN 5+sample_id%7 ELSE ceil(0.2e0/(pi()*r*r))::BIGINT END AS n, round(r,6) AS r
FROM (SELECT s_suppkey AS sample_id, 0.01e0+0.0005e0*(s_suppkey%20) AS r FROM supplier)"""))
def populate(spark, d):
    """Disks of one radius per sample: by number for even keys, to a fraction of 0.2 for odd ones."""
    k = F.col("sample_id")
    rows = _suppliers(spark, d)
    samples = rows.select("sample_id", F.lit(1.0).alias("lx"), F.lit(1.0).alias("ly"), F.lit(None).cast("double").alias("lz"))
    specs = _unfold(rows, _descriptor("r", "fixed", {"value": 0.01 + 0.0005 * (k % 20)})).unionByName(
        _unfold(rows.where("sample_id % 2 = 0"), _descriptor("n", "fixed", {"value": 5 + k % 7}))).unionByName(
        _unfold(rows.where("sample_id % 2 = 1"), _descriptor("vf", "fixed", {"value": 0.2})))
    phases = rows.select("sample_id", F.lit("1").alias("phase"))
    done, _ = sa.populate(phases, specs, samples, ["r"], F.pi() * F.col("r") * F.col("r"))
    return rounded(done.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")), "r")


@query(sql(f"SELECT sample_id, particle_id, round({u('u2', 'sample_id*100+particle_id')}*2,6) AS cx, "
           f"round({u('u3', 'sample_id*100+particle_id')},6) AS cy FROM disks", "disks"))
def place_random(spark, d):
    key = F.col("sample_id") * 100 + F.col("particle_id")
    wide = fx.samples(spark, d).withColumn("lx", F.lit(2.0))
    p = sa.place_random(fx.disks(spark, d).select("sample_id", "particle_id"), wide, 2, u=[u2(key), u3(key)])
    return rounded(p, "cx", "cy")


@query(sql("""SELECT p.sample_id, p.particle_id, round((cell//side+0.5e0)/side,6) AS cx, round((cell%side+0.5e0)/side,6) AS cy FROM
(SELECT sample_id, particle_id, row_number() OVER (PARTITION BY sample_id ORDER BY particle_id) AS k, ceil(sqrt(count(*) OVER
(PARTITION BY sample_id)))::BIGINT AS side FROM disks WHERE particle_id%10<9) p JOIN (SELECT sample_id, cell, row_number() OVER
(PARTITION BY sample_id ORDER BY (cell*37)%101, cell) AS k FROM samples, generate_series(0,99) AS g(cell)) c ON p.sample_id=c.sample_id AND p.k=c.k""",
    "samples", "disks"))
def place_grid(spark, d):
    p = fx.disks(spark, d).where("particle_id % 10 < 9").select("sample_id", "particle_id")
    return rounded(sa.place_grid(p, fx.samples(spark, d), 2, shuffle=F.col("_cell") * 37 % 101), "cx", "cy")


_CUBES = "SELECT sample_id, 1+sample_id%3 AS l FROM samples"


def _cubes(spark, d):
    return fx.samples(spark, d, 3).withColumn("lx", (1 + F.col("sample_id") % 3).cast("double"))


@query(sql("""SELECT sample_id, layer*16+a*4+b AS particle_id, round((a+0.5e0*(layer%2))*l/4,6) AS cx, round((b+0.5e0*(layer%2))*l/4,6) AS cy,
round(layer*0.5e0*l/4,6) AS cz FROM cubes, generate_series(0,7) p(layer), generate_series(0,3) q(a), generate_series(0,3) r(b)""",
    "samples", cubes=_CUBES))
def place_bcc(spark, d):
    return rounded(sa.place_bcc(_cubes(spark, d)), "cx", "cy", "cz")


@query(sql("""SELECT sample_id, layer*32+s*16+a*4+b AS particle_id, round((a+dx)*l/4,6) AS cx, round((b+dy)*l/4,6) AS cy, round(layer*0.5e0*l/4,6) AS cz
FROM cubes, generate_series(0,7) p(layer), (VALUES (0,0,0e0,0e0),(0,1,1.5e0,0.5e0),(1,0,0.5e0,0e0),(1,1,0e0,0.5e0)) v(odd,s,dx,dy),
generate_series(0,3) q(a), generate_series(0,3) r(b) WHERE odd=layer%2""", "samples", cubes=_CUBES))
def place_fcc(spark, d):
    return rounded(sa.place_fcc(_cubes(spark, d)), "cx", "cy", "cz")


@query(sql("SELECT sample_id, 42+sample_id AS seed FROM samples", "samples"))
def sample_seeds(spark, d):
    return sa.sample_seeds(fx.samples(spark, d), 42).select("sample_id", "seed")


@query(sql("SELECT sample_id, 200::BIGINT AS n, 200::BIGINT AS inside, 200::BIGINT AS unit FROM samples", "samples"))
def random_points(spark, d):
    """All points in the box, all directions of length one."""
    pts = st.random_directions_2d(st.random_points(fx.samples(spark, d), 200, 2, 5), ["sample_id", "point_id"], 5)
    inside = (F.col("x") >= 0) & (F.col("x") < 1) & (F.col("y") >= 0) & (F.col("y") < 1)
    unit = F.abs(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") - 1) < 1e-12
    return pts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("inside"),
                                        F.sum(unit.cast("long")).alias("unit"))


@query(sql("SELECT sample_id, particle_id, 20::BIGINT AS n, 20::BIGINT AS inside FROM mixed3", "mixed3"))
def random_points_inside(spark, d):
    """Every point drawn in a 3D particle passes its containment test."""
    p = fx.mixed_3d(spark, d)
    pts = sa.random_points_inside(p, 20, 3, 11).join(unfolded(p), ["sample_id", "particle_id"])
    inside = by_shape(pts, lambda s, c: s.contains(c, [F.col(a) - F.col(f"c{a}") for a in "xyz"]), dim=3)
    return pts.groupBy("sample_id", "particle_id").agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("inside"))


@query(sql("""SELECT sample_id, particle_id, ring::INTEGER AS ring, k::INTEGER AS k, round(cx+cos(angle)*x-sin(angle)*y,6)+0e0 AS x,
round(cy+sin(angle)*x+cos(angle)*y,6)+0e0 AS y FROM (SELECT *, major_axis/2*ring/3*cos(2*pi()*k/8) AS x, minor_axis/2*ring/3*sin(2*pi()*k/8) AS y
FROM mixed2, generate_series(1,3) a(ring), generate_series(0,7) b(k) WHERE shape='Ellipse')""", "mixed2"))
def polar_points_inside(spark, d):
    return rounded(sa.polar_points_inside(fx.mixed_2d(spark, d).where("shape = 'Ellipse'"), 3, 8), "x", "y")


@query()
def overlap_volume_mc(spark, d):
    """Shared volume of 3D pairs by points, with its error."""
    out = sa.overlap_volume_mc(fx.mixed_3d(spark, d), fx.samples(spark, d, 3), 3, 200, 1).where("size > 0")
    return rounded(out, "size", "error", digits=9)


# the sequential rule itself: one arrival after another against the list of those accepted
_CONFLICTS = "SELECT sample_id, j, list(i) AS earlier FROM pairs WHERE d<ri+rj GROUP BY 1,2"


@query(sql("""SELECT sample_id, unnest(acc) AS particle_id FROM walk WHERE k=99""", "samples", "pairs", conf=_CONFLICTS, walk="""
SELECT sample_id, -1::BIGINT AS k, []::BIGINT[] AS acc FROM samples UNION ALL SELECT w.sample_id, w.k+1,
CASE WHEN list_has_any(w.acc, coalesce(c.earlier, [])) THEN w.acc ELSE list_append(w.acc, w.k+1) END FROM walk w
LEFT JOIN conf c ON c.sample_id=w.sample_id AND c.j=w.k+1 WHERE w.k<99""").replace("WITH ", "WITH RECURSIVE ", 1))
def thin_by_arrival(spark, d):
    return sa.thin_by_arrival(fx.disks(spark, d), fx.samples(spark, d), 2).select("sample_id", "particle_id")


@query()
def thin_to_targets(spark, d):
    """Phase 1 to thirty particles, then phase 2 to a fraction of 0.05, a gap of 0.004 kept."""
    targets = _suppliers(spark, d).sparkSession.createDataFrame(
        [("1", 0, 30, None), ("2", 1, None, 0.05)], "phase string, phase_order int, n long, vf double")
    out = sa.thin_by_arrival(fx.disks(spark, d), fx.samples(spark, d), 2, targets, 0.004)
    return out.groupBy("sample_id", "phase").agg(F.count(F.lit(1)).alias("n"))


@query()
def overlaps_convex_exact(spark, d):
    """Any convex 2D pair, least separation over all directions."""
    return rounded(sp.overlaps(fx.mixed_2d(spark, d), fx.samples(spark, d), 2, "exact"), "length", "ux", "uy")


@query()
def overlaps_convex_exact_3d(spark, d):
    return rounded(sp.overlaps(fx.mixed_3d(spark, d), fx.samples(spark, d, 3), 3, "exact"), "length", digits=5).drop("ux", "uy", "uz")


@query()
def overlap_areas_convex(spark, d):
    """Shared area of any 2D pair."""
    p = fx.mixed_2d(spark, d)
    names = [c for c in p.columns if c not in ("sample_id", "particle_id")]
    pairs = sp.near_pairs(p, fx.samples(spark, d), 2, sp.radius(p), names)
    return rounded(cx.overlap_areas(pairs), "size", digits=8)


# --- quality rules -----------------------------------------------------------------------

_TYPES = ["Matrix", "Disk", "Ellipse", "Sphere", "Ellipsoid", "CylindricalFiber", "Cylinder", "Square"]
_DIMS = [None, 2, 2, 3, 3, 3, 3, 2]


def _spec(spark, d):
    """Four phases per supplier: types, nesting and directions by key, often at fault."""
    key, p = F.col("sample_id"), F.col("phase_order")
    samples = _suppliers(spark, d).select("sample_id", (2 + key % 2).cast("int").alias("dim"), F.lit(1.0).alias("lx"),
                                          F.lit(1.0).alias("ly"), F.when(key % 2 == 1, 1.0).alias("lz"))
    rows = _suppliers(spark, d).withColumn("phase_order", F.explode(F.sequence(F.lit(1), F.lit(4))))
    code = ((key * 5 + p * p * 3 + F.floor(key / 8)) % 8).cast("int")
    outer = (key + p) % 6
    phases = rows.select("sample_id", p.cast("string").alias("phase"), "phase_order",
                         F.element_at(F.array(*[F.lit(t) for t in _TYPES]), code + 1).alias("type"),
                         F.when(outer > 0, outer.cast("string")).alias("outer_phase"), (outer > 0).alias("inner_phase"))
    return samples, phases


_SPEC = dict(
    ph="SELECT sample_id, p::VARCHAR AS phase, p, [" + ",".join(f"'{t}'" for t in _TYPES) + "][code+1] AS type, ["
       + ",".join("NULL" if x is None else str(x) for x in _DIMS) + "][code+1] AS tdim, "
       "CASE WHEN (sample_id+p)%6>0 THEN ((sample_id+p)%6)::VARCHAR END AS outer_phase, 2+sample_id%2 AS dim, dir FROM (SELECT s_suppkey AS sample_id, p, "
       "((s_suppkey*5+p*p*3+s_suppkey//8)%8)::INT AS code, (s_suppkey+p)%3 AS dir FROM supplier, generate_series(1,4) AS g(p))",
)


def _directions(phases):
    """A direction descriptor for every phase, drawn from a distribution in one sample of nine."""
    kind = F.when(F.col("sample_id") % 9 == 0, "uniform").otherwise("fixed")
    value = (F.col("sample_id") + F.col("phase_order")) % 3
    return phases.select("sample_id", "phase", F.lit("direction").alias("name"), kind.alias("distribution"),
                         F.create_map(F.lit("value"), value.cast("double")).alias("params"))


@query(sql("""SELECT sample_id, '' AS location, CASE WHEN n=0 THEN 'no phase is the matrix' ELSE 'more than one phase is the matrix: '||names END AS message
FROM (SELECT sample_id, count(*) FILTER (type='Matrix') AS n, string_agg(phase, ', ' ORDER BY phase) FILTER (type='Matrix') AS names FROM ph GROUP BY 1) WHERE n<>1
UNION ALL SELECT sample_id, phase||'.type', type||' has '||tdim||' dimensions in a box of '||dim FROM ph WHERE type<>'Matrix' AND tdim<>dim
UNION ALL SELECT a.sample_id, a.phase||'.type', 'fibres stand alone, and there are some: phase '||f FROM ph a JOIN
(SELECT sample_id, arg_min(phase, p) AS f FROM ph WHERE type='CylindricalFiber' GROUP BY 1) USING (sample_id) WHERE type NOT IN ('Matrix','CylindricalFiber')
UNION ALL SELECT a.sample_id, a.phase||'.inside', 'outer phase '||a.outer_phase||' is not another phase of particles' FROM ph a LEFT JOIN ph b
ON a.sample_id=b.sample_id AND a.outer_phase=b.phase WHERE a.type<>'Matrix' AND a.outer_phase IS NOT NULL AND (a.outer_phase=a.phase OR coalesce(b.type,'Matrix')='Matrix')
UNION ALL SELECT sample_id, '', 'the fibres of a sample run in one fixed direction' FROM ph WHERE type='CylindricalFiber' GROUP BY 1
HAVING count(DISTINCT dir)>1 AND sample_id%9<>0 OR sample_id%9=0""", **_SPEC))
def phase_problems(spark, d):
    samples, phases = _spec(spark, d)
    return ru.phase_problems(samples, phases, _directions(phases))


@query(sql("SELECT sample_id, phase FROM ph WHERE NOT (sample_id+p)%6>0", **_SPEC))
def packing(spark, d):
    """Phases of the arrangement, inner ones left out (one particle row per phase)."""
    _, phases = _spec(spark, d)
    return ru.packing(phases.select("sample_id", "phase"), phases)


def _given(spark, d):
    """Disks described by r and n, by n alone, with an angle, with odd numbers - by key."""
    k = F.col("sample_id")
    rows = _suppliers(spark, d)
    n = _unfold(rows, _descriptor("n", F.when(k % 11 == 0, "uniform").otherwise("fixed"), {"value": 5 + F.when(k % 7 == 0, 0.5).otherwise(0.0)}))
    r_ = _unfold(rows.where("sample_id % 5 <> 0"), _descriptor("r", "fixed", {"value": 0.01 * (k % 40)}))
    angle = _unfold(rows.where("sample_id % 13 = 0"), _descriptor("angle", "specified", None, [1, 2, 3, 4, 5]))
    phases = rows.select("sample_id", F.lit("1").alias("phase"), F.lit("Disk").alias("type"))
    return phases, n.unionByName(r_).unionByName(angle)


@query(sql("""SELECT sample_id, '1' AS location, 'not a description of a Disk: '||given AS message FROM (SELECT sample_id,
CASE WHEN sample_id%13=0 THEN 'angle ' ELSE '' END||'n'||CASE WHEN sample_id%5<>0 THEN ' r' ELSE '' END AS given FROM k) WHERE given<>'n r'
UNION ALL SELECT sample_id, '1.angle', 'a Disk has no such descriptor' FROM k WHERE sample_id%13=0
UNION ALL SELECT sample_id, '1.n', 'takes one fixed number' FROM k WHERE sample_id%11=0
UNION ALL SELECT sample_id, '1.n', 'takes a whole number' FROM k WHERE sample_id%11<>0 AND sample_id%7=0
UNION ALL SELECT sample_id, '1.angle.values', '5 values for 5 particles' FROM k WHERE sample_id%13=0 AND sample_id%11<>0 AND sample_id%7=0""",
    k="SELECT s_suppkey AS sample_id FROM supplier"))
def description_problems(spark, d):
    return ru.description_problems(*_given(spark, d))


@query(sql("""SELECT sample_id, '1.r' AS location, printf('%.6g', 0.01e0*(sample_id%40))||' is out of bounds for a side of 1.00000' AS message
FROM (SELECT s_suppkey AS sample_id FROM supplier) WHERE sample_id%40=0 OR 0.01e0*(sample_id%40)>=0.25e0""").replace(
    "printf('%.6g', 0.01e0*(sample_id%40))", "CASE WHEN sample_id%40=0 THEN '0.00000' ELSE printf('%.6f', 0.01e0*(sample_id%40)) END"))
def bound_problems(spark, d):
    k = F.col("sample_id")
    rows = _suppliers(spark, d)
    values = rows.select("sample_id", F.lit("1").alias("phase"), F.lit("Disk").alias("type"), F.lit("r").alias("name"),
                         (0.01 * (k % 40)).alias("value"))
    return ru.bound_problems(values, rows.select("sample_id", F.lit(1.0).alias("lx"), F.lit(2.0).alias("ly")))


@query(sql("""SELECT sample_id, '1.x' AS location, message FROM (SELECT s_suppkey AS sample_id, CASE s_suppkey%8 WHEN 0 THEN CASE WHEN s_suppkey%3=0 THEN 'sigma is negative' END
WHEN 1 THEN CASE WHEN s_suppkey%3=0 THEN 'mean and sigma are above zero' END WHEN 2 THEN CASE WHEN s_suppkey%3=0 THEN 'low is above high' END
WHEN 3 THEN CASE WHEN s_suppkey%3=0 THEN 'kappa and scale are above zero' END WHEN 4 THEN 'one probability per value'
WHEN 5 THEN 'probabilities do not add up to one' WHEN 6 THEN NULL ELSE 'unknown distribution' END AS message FROM supplier) WHERE message IS NOT NULL"""))
def distribution_problems(spark, d):
    k = F.col("sample_id")
    sign = F.when(k % 3 == 0, -1.0).otherwise(1.0)
    cases = [_descriptor("x", "normal", {"mean": 0, "sigma": sign}), _descriptor("x", "lognormal", {"mean": sign, "sigma": 1}),
             _descriptor("x", "uniform", {"low": 0, "high": sign}), _descriptor("x", "vonmises", {"kappa": sign, "scale": 1, "loc": 0}),
             _descriptor("x", "discrete", None, [1, 2], [1]), _descriptor("x", "discrete", None, [1, 2], [0.5, 0.4]),
             _descriptor("x", "discrete", None, [1, 2], [0.5, 0.5]), _descriptor("x", "cauchy", {"loc": 0})]
    parts = [_unfold(_suppliers(spark, d).where(k % 8 == n), case) for n, case in enumerate(cases)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return ru.distribution_problems(out)


def _records(spark, d):
    """Document headers and particle records with faults by key."""
    p = fx.disks(spark, d)
    i = F.col("particle_id")
    documents = fx.samples(spark, d).select("sample_id", F.when(F.col("sample_id") % 7 == 3, "something").otherwise("a-microstructure").alias("format"),
                                            F.when(F.col("sample_id") % 5 == 2, 9).otherwise(1).alias("version"))
    particles = p.select("sample_id", "particle_id", F.when(i % 31 == 0, "Cube").when(i % 29 == 0, "Sphere").otherwise("Disk").alias("shape"),
                         F.when(i % 23 == 0, "9").otherwise(F.col("phase")).alias("phase"), "cx", "cy", F.lit(None).cast("double").alias("cz"),
                         F.when(i % 19 == 0, i + 50).alias("parent_id"))
    phases = p.select("sample_id", "phase").distinct()
    return documents, particles, phases


@query(sql("""SELECT sample_id, 'format' AS location, 'not a microstructure document: something' AS message FROM samples WHERE sample_id%7=3
UNION ALL SELECT sample_id, 'version', 'unknown version 9' FROM samples WHERE sample_id%5=2
UNION ALL SELECT sample_id, 'particles.'||particle_id, 'unknown shape Cube' FROM disks WHERE particle_id%31=0
UNION ALL SELECT sample_id, 'particles.'||particle_id, '2 coordinates for a Sphere' FROM disks WHERE particle_id%29=0 AND particle_id%31<>0
UNION ALL SELECT sample_id, 'particles.'||particle_id, 'no phase 9' FROM disks WHERE particle_id%23=0
UNION ALL SELECT sample_id, 'particles.'||particle_id, 'no parent '||(particle_id+50) FROM disks WHERE particle_id%19=0 AND particle_id+50>=100""",
    "samples", "disks"))
def record_problems(spark, d):
    return ru.record_problems(*_records(spark, d))


@query(sql("""SELECT sample_id, 'meshes' AS location, 'a grid of '||(2+(sample_id//2)%2)||' directions in a box of '||(2+sample_id%2) AS message FROM k
WHERE (sample_id//2)%2<>sample_id%2 UNION ALL SELECT sample_id, '1.angle', 'is given particle by particle, but every try draws anew' FROM k
WHERE sample_id%3=0 AND sample_id%13=0 UNION ALL SELECT sample_id, '', printf('the volume fraction is over one: %.4f', 0.3e0*(sample_id%5)+0.25e0*(sample_id%2)) FROM k
WHERE 0.3e0*(sample_id%5)+0.25e0*(sample_id%2)>1 UNION ALL SELECT sample_id, '3', printf('fills %.4f inside a phase of %.4f', 0.4e0, 0.3e0*(sample_id%5)) FROM k WHERE sample_id%5<2
UNION ALL SELECT sample_id, '2', 'too many particles: '||(sample_id*2000) FROM k WHERE sample_id*2000>100000""", k="SELECT s_suppkey AS sample_id FROM supplier"))
def spec_problems(spark, d):
    k = F.col("sample_id")
    rows = _suppliers(spark, d)
    samples = rows.select("sample_id", (2 + k % 2).cast("int").alias("dim"))
    phases = rows.select("sample_id", F.explode(F.array(
        F.struct(F.lit("1").alias("phase"), F.lit("Disk").alias("type"), F.lit(False).alias("inner_phase"), F.lit(None).cast("string").alias("outer_phase")),
        F.struct(F.lit("2").alias("phase"), F.lit("Disk").alias("type"), F.lit(False).alias("inner_phase"), F.lit(None).cast("string").alias("outer_phase")),
        F.struct(F.lit("3").alias("phase"), F.lit("Disk").alias("type"), F.lit(True).alias("inner_phase"), F.lit("1").alias("outer_phase")))).alias("_p")).select("sample_id", "_p.*")
    runs = rows.select("sample_id", F.when(k % 3 == 0, "random_sequential_adsorption").otherwise("molecular_dynamics").alias("method"),
                       (2 + F.floor(k / 2) % 2).cast("int").alias("n_grid"))
    fractions = rows.select("sample_id", F.explode(F.array(
        F.struct(F.lit("1").alias("phase"), (0.3 * (k % 5)).alias("vf"), F.lit(10).cast("long").alias("n")),
        F.struct(F.lit("2").alias("phase"), (0.25 * (k % 2)).alias("vf"), (k * 2000).alias("n")),
        F.struct(F.lit("3").alias("phase"), F.lit(0.4).alias("vf"), F.lit(5).cast("long").alias("n")))).alias("_f")).select("sample_id", "_f.*")
    return ru.spec_problems(samples, phases, _given(spark, d)[1], runs, fractions)


@query(sql("""SELECT sample_id, round(CASE WHEN sample_id%2=0 THEN least(0.02e0,2*m/4) ELSE 0.02e0 END,6) AS mesh_size,
CASE WHEN sample_id%2=0 THEN 'derived' WHEN 0.02e0>m THEN 'above' ELSE 'none' END AS warning FROM (SELECT sample_id, min(r) AS m FROM disks GROUP BY 1)""", "disks"))
def mesh_size_warnings(spark, d):
    requests = fx.samples(spark, d).select("sample_id", F.lit(0.02).alias("mesh_size"),
                                           F.when(F.col("sample_id") % 2 == 0, 4.0).alias("elements_per_particle"))
    out = ru.mesh_size_warnings(fx.disks(spark, d), requests)
    kind = F.when(F.col("warning").startswith("element"), "derived").when(F.col("warning").isNotNull(), "above").otherwise("none")
    return out.select("sample_id", r("mesh_size").alias("mesh_size"), kind.alias("warning"))


@query(sql("""SELECT sample_id, particle_id, CASE WHEN particle_id%7=0 THEN 'removed' WHEN particle_id%5=0 THEN 'changed' END AS change FROM disks
WHERE particle_id%7=0 OR particle_id%5=0 UNION ALL SELECT sample_id, particle_id+1000, 'added' FROM disks WHERE particle_id%11=0""", "disks"))
def corpus_diff(spark, d):
    p = fx.disks(spark, d)
    i = F.col("particle_id")
    after = p.where(i % 7 != 0).withColumn("r", F.when(i % 5 == 0, F.col("r") * 2).otherwise(F.col("r"))).unionByName(
        p.where(i % 11 == 0).withColumn("particle_id", i + 1000))
    return ru.corpus_diff(p, after, ["sample_id", "particle_id"])


@query(sql("""SELECT m.sample_id, m.phase, count(*) AS n, 40e0 AS n_specified, round(sum(pi()*r*r),6) AS vf, 0.2e0 AS vf_specified
FROM disks m GROUP BY 1,2""", "disks"))
def microstructure_info(spark, d):
    p, s = fx.disks(spark, d), fx.samples(spark, d)
    specs = p.select("sample_id", "phase").distinct().withColumn("_d", F.explode(F.array(
        _descriptor("n", "fixed", {"value": 40}), _descriptor("vf", "fixed", {"value": 0.2})))).select("sample_id", "phase", "_d.*")
    return rounded(st.microstructure_info(p, s, specs, 2).drop("real_vf"), "vf")


