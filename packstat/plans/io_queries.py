"""Sources, sinks and streams, each over tables derived from the driver's."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from packstat.functions.udtf import periodic_images_of
from packstat.plans.registry import query, r, rounded
from packstat.plans.sqlfix import VIEWS, sql
from packstat.session import scratch_path
from packstat.sources import corpus as co
from packstat.sources import fixtures as fx
from packstat.sources import runs as rn
from packstat.sources import tables as tb
from packstat.streaming import monitors as mo


def _tables(spark, d):
    p = fx.mixed_2d(spark, d).withColumn("sample_id", F.col("sample_id").cast("string"))
    p = p.withColumn("parent_id", F.when(F.col("particle_id") % 10 == 3, F.col("particle_id") - 3))
    s = fx.samples(spark, d).withColumn("sample_id", F.col("sample_id").cast("string"))
    phases = s.select("sample_id", F.explode(F.array(
        F.struct(F.lit("1").alias("phase"), F.lit("Disk").alias("type"), F.lit(False).alias("inner_phase"), F.lit(None).cast("string").alias("outer_phase")),
        F.struct(F.lit("2").alias("phase"), F.lit("Disk").alias("type"), F.lit(True).alias("inner_phase"), F.lit("1").alias("outer_phase")),
        F.struct(F.lit("3").alias("phase"), F.lit("Matrix").alias("type"), F.lit(False).alias("inner_phase"), F.lit(None).cast("string").alias("outer_phase")),
    )).alias("_p")).select("sample_id", "_p.*")
    descriptors = s.select("sample_id", F.lit("1").alias("phase"), F.lit("r").alias("name"), F.lit("normal").alias("distribution"),
                           F.create_map(F.lit("mean"), F.lit(0.02), F.lit("sigma"), F.lit(-0.01)).alias("params"),
                           F.lit(None).cast("array<double>").alias("values"), F.lit(None).cast("array<double>").alias("probabilities"))
    return {"samples": s, "phases": phases, "descriptors": descriptors, "particles": p}


def _written(spark, d):
    path = scratch_path(spark, "corpus")
    co.write_corpus(_tables(spark, d), path)
    return path


@query(sql("""SELECT sample_id::VARCHAR AS sample_id, particle_id, phase, shape, cx, cy, r, side, major_axis, minor_axis, angle,
CASE WHEN particle_id%10=3 THEN particle_id-3 END AS parent_id FROM mixed2""", "mixed2").replace(
    "cx, cy, r, side, major_axis, minor_axis, angle", ", ".join(f"round({c},12) AS {c}" for c in
                                                            ("cx", "cy", "r", "side", "major_axis", "minor_axis", "angle")), 1))
def corpus_round_trip(spark, d):
    """Particles written as documents and read back."""
    p = co.read_corpus(spark, _written(spark, d))["particles"]
    return p.select("sample_id", "particle_id", "phase", "shape", *[r(c, 12).alias(c) for c in (
        "cx", "cy", "r", "side", "major_axis", "minor_axis", "angle")], "parent_id")


@query(sql("""SELECT sample_id::VARCHAR AS sample_id, phase, type, inner_phase, outer_phase, 1e0 AS lx, '3' AS matrix_phase FROM samples,
(VALUES ('1','Disk',false,NULL),('2','Disk',true,'1'),('3','Matrix',false,NULL)) v(phase,type,inner_phase,outer_phase)""", "samples"))
def corpus_phases(spark, d):
    """Phases and headers of the documents."""
    tables = co.read_corpus(spark, _written(spark, d))
    return tables["phases"].join(tables["samples"].select("sample_id", "lx", "matrix_phase"), "sample_id").select(
        "sample_id", "phase", "type", "inner_phase", "outer_phase", "lx", "matrix_phase")


@query(sql("""SELECT sample_id::VARCHAR AS sample_id, particle_id, phase, shape, round(cx,12) AS cx, CASE WHEN particle_id%10=3 THEN particle_id-3 END
AS parent_id FROM mixed2 WHERE sample_id%3<>2""", "mixed2"))
def corpus_layouts(spark, d):
    """Documents on one line (sample 0, 3, ...) and indented by tabs (1, 4, ...); those cut short (2, 5, ...) give no rows."""
    kind, lines = F.col("sample_id").cast("long") % 3, F.transform(F.array_sort(F.collect_list(F.struct("part", "position", "value"))), lambda e: e["value"])
    whole = co.document_lines(_tables(spark, d)).groupBy("sample_id").agg(lines.alias("_l"))
    tabs = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("\t"), F.regexp_replace(F.ltrim(x), "\\[", "[\n"))), "\n")
    text = F.when(kind == 0, F.array_join("_l", "")).when(kind == 1, tabs).otherwise(F.array_join(F.slice("_l", 1, 5), "\n"))
    path = scratch_path(spark, "layouts")
    whole.select("sample_id", text.alias("value")).write.partitionBy("sample_id").text(path)
    return co.read_corpus(spark, path)["particles"].select("sample_id", "particle_id", "phase", "shape", r("cx", 12).alias("cx"), "parent_id")


@query(sql("SELECT sample_id, particle_id, round(cx,9) AS cx FROM disks WHERE sample_id IN (1, 3, 8)", "disks"))
def saved_table(spark, d):
    """A table saved by hash of the sample, some samples read back."""
    path = scratch_path(spark, "table")
    tb.save_table(fx.disks(spark, d), path, 16)
    return rounded(tb.load_table(spark, path, [1, 3, 8], 16).select("sample_id", "particle_id", "cx"), "cx", digits=9)


_RAGGED = """SELECT p_partkey AS user_id, [p_size, 2*p_size, 3*p_size, 4*p_size][:p_size%5] AS vals FROM part"""


def _ragged(spark, d):
    """Rows of none to four multiples of the part's size."""
    size = F.col("p_size")
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("user_id"), F.slice(
        F.array(size, 2 * size, 3 * size, 4 * size), 1, size % 5).alias("vals"))
    return tb.flatten_ragged(rows, [], ["user_id"], "vals")


@query(sql("""SELECT row_number() OVER (ORDER BY user_id)-1 AS row, coalesce(len(vals),0) AS size,
(sum(coalesce(len(vals),0)) OVER (ORDER BY user_id)-coalesce(len(vals),0))::BIGINT AS "offset" FROM rg""", rg=_RAGGED))
def ragged_offsets(spark, d):
    return _ragged(spark, d)[1]


@query(sql("""SELECT o+p-1 AS position, vals[p] AS value FROM (SELECT *, unnest(generate_series(1, len(vals))) AS p FROM (SELECT *,
(sum(coalesce(len(vals),0)) OVER (ORDER BY user_id)-coalesce(len(vals),0))::BIGINT AS o FROM rg) WHERE vals IS NOT NULL)""", rg=_RAGGED))
def ragged_values(spark, d):
    return _ragged(spark, d)[0]


@query(sql("""SELECT 0::BIGINT AS sample_id, vec_id AS particle_id, round(embedding[1],6) AS cx, round(embedding[2],6) AS cy, 'Disk' AS shape FROM embeddings""".replace(
    "round(embedding[1],6)", "round(embedding[1]::DOUBLE,6)").replace("round(embedding[2],6)", "round(embedding[2]::DOUBLE,6)")))
def corpus_from_tables(spark, d):
    """Embeddings as disks, by their first two components."""
    out = co.corpus_from_tables(fx.table(spark, d, "embeddings"), {
        "sample_id": F.lit(0).cast("long"), "particle_id": "vec_id", "cx": F.get("embedding", 0).cast("double"),
        "cy": F.get("embedding", 1).cast("double"), "r": F.lit(0.01)})
    return rounded(out.select("sample_id", "particle_id", "cx", "cy", "shape"), "cx", "cy")


@query(sql("""SELECT o_orderkey::VARCHAR AS sample_id, o_orderkey*0.125e0 AS seconds, CASE WHEN o_orderkey%3<>0 THEN o_orderkey*0.5e0 END AS total_overlap,
o_orderkey%2=0 AS status, 1::BIGINT AS n_meshes FROM orders"""))
def status_records(spark, d):
    """Status lines of every order, parsed back."""
    k = F.col("o_orderkey")
    lines = fx.table(spark, d, "orders").select(k.cast("string").alias("sample_id"), F.explode(F.array(
        F.concat(F.lit("Time: "), (k * 0.125).cast("decimal(20,3)").cast("string"), F.lit("s")),
        F.concat(F.lit("Overlap: "), F.when(k % 3 == 0, "none").otherwise((k * 0.5).cast("string"))),
        F.concat(F.lit("Status: "), F.when(k % 2 == 0, "True").otherwise("False")), F.lit("Mesh voxel done"))).alias("value"))
    return rounded(rn.parse_status(lines), "seconds", digits=3)


@query(sql("""SELECT sample_id, particle_id, ix AS image_x, iy AS image_y, round(cx+ix,6) AS cx, round(cy+iy,6) AS cy FROM disks,
(VALUES (-1),(0),(1)) a(ix), (VALUES (-1),(0),(1)) b(iy) WHERE
sqrt(pow(greatest(-(cx+ix),cx+ix-1,0),2)+pow(greatest(-(cy+iy),cy+iy-1,0),2))<=r""", "disks"))
def periodic_images_sql(spark, d):
    """The table function from SQL: a lateral join gives the images of each row."""
    spark.udtf.register("packstat_images", periodic_images_of)
    fx.disks(spark, d).createOrReplaceTempView("packstat_disks")
    out = spark.sql("SELECT p.sample_id, p.particle_id, t.image_x, t.image_y, t.cx, t.cy FROM packstat_disks p, "
                    "LATERAL packstat_images(p.cx, p.cy, 1.0D, 1.0D, p.r) t")
    return rounded(out, "cx", "cy")


# --- run archives and rasters ---------------------------------------------------------------


def _pack(batches):
    """An archive per run: histories of which the thermic one starts a step late, some without a member."""
    for batch in (whole.iloc[k:k + 64] for whole in batches for k in range(0, len(whole), 64)):
        contents = []
        for run in batch.itertuples(index=False):
            overlap = np.asarray(run.overlaps, float)
            members = {"step": len(overlap), "time": len(overlap) / 4, "status": run.sample_id % 2 == 0, "total_overlap_history": overlap,
                       "kinetic_energy_history": overlap / 2, "temp_change_steps": np.flatnonzero(overlap > 15),
                       "position_center_history": np.stack([np.stack([overlap, -overlap], axis=1), np.stack([overlap * 2, overlap / 4], axis=1)])}
            if run.sample_id % 3:
                members["thermic_energy_history"] = overlap[1:] / 4 + 1
            raw = io.BytesIO()
            np.savez_compressed(raw, **members)
            contents.append(raw.getvalue())
        yield batch[["sample_id"]].assign(content=contents)


def _archives(spark, d):
    steps = fx.run_steps(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("step", "total_overlap"))).alias("_s"))
    key = steps.schema["sample_id"].dataType.simpleString()
    return steps.select("sample_id", F.col("_s.total_overlap").alias("overlaps")).mapInPandas(_pack, f"sample_id {key}, content binary")


@query(sql("""SELECT sample_id, count(*) AS n_steps, count(*)/4 AS seconds, sample_id%2=0 AS status, NULL::DOUBLE AS max_residue
FROM steps GROUP BY sample_id""", "steps"))
def archived_runs(spark, d):
    return rn.unpack_runs(_archives(spark, d))["runs"]


@query(sql("""SELECT sample_id, step, total_overlap, kinetic, CASE WHEN sample_id%3<>0 THEN thermic END AS thermic, NULL::DOUBLE AS dt,
NULL::DOUBLE AS ratio FROM steps""", "steps"))
def archived_steps(spark, d):
    return rn.unpack_runs(_archives(spark, d))["run_steps"]


@query(sql("SELECT sample_id, step FROM steps WHERE total_overlap>15", "steps"))
def archived_changes(spark, d):
    return rn.unpack_runs(_archives(spark, d))["temp_changes"]


@query(sql("""SELECT sample_id, particle_id, step, CASE particle_id WHEN 0 THEN total_overlap ELSE total_overlap*2 END AS x,
CASE particle_id WHEN 0 THEN -total_overlap ELSE total_overlap/4 END AS y, NULL::DOUBLE AS z FROM steps, (VALUES (0::BIGINT),(1)) v(particle_id)""", "steps"))
def archived_paths(spark, d):
    return rn.unpack_runs(_archives(spark, d))["paths"]


@query(sql("""SELECT (p_partkey//100)::VARCHAR AS image_id, p_partkey%10 AS px, p_partkey%100//10 AS py, p_size AS value, 3 AS channels
FROM part WHERE p_partkey//100 IN (SELECT p_partkey//100 FROM part GROUP BY 1 HAVING count(*)=100)"""))
def raster_pixels(spark, d):
    """Sizes of a sample's hundred parts as an image of ten by ten with three channels, of which the last is the file's first."""
    part = fx.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).cast("string").alias("image_id"), "p_partkey", "p_size")
    cell = F.struct("p_partkey", F.concat(F.lit("FF00"), F.lpad(F.hex("p_size"), 2, "0")).alias("v"))
    whole = part.groupBy("image_id").agg(F.sort_array(F.collect_list(cell)).alias("_c")).where(F.size("_c") == 100)
    return rn.pixels(whole.select("image_id", F.lit(10).alias("height"), F.lit(10).alias("width"), F.lit(3).alias("channels"),
                                  F.unhex(F.array_join("_c.v", "")).alias("data")))


# --- streams: the events replayed as files, to the end --------------------------------------


def _stored_events(spark, d):
    return fx.table(spark, d, "events").select(F.col("user_id").alias("sample_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                                               F.col("value").alias("total_overlap"))


def _events(spark, d):
    schema = fx.table(spark, d, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
            .select(F.col("user_id").alias("sample_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("total_overlap")))


def _closed(spark, d, step, name):
    """All that ``step`` gives of the events once a closing mark has arrived in a delivery of its own."""
    events, source, path, offsets = _stored_events(spark, d), *(scratch_path(spark, f"{name}-{part}") for part in ("events", "out", "offsets"))
    for rows in (events, mo.closing_event(events)):
        rows.write.mode("append").parquet(source)
        stream = step(spark.readStream.schema(events.schema).parquet(source))
        mo.run_to_end(stream, path, offsets)
    out = spark.read.schema(stream.schema).parquet(path).where("sample_id IS NOT NULL")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


def _drained(spark, stream, name):
    path = scratch_path(spark, name)
    mo.run_to_end(stream, path, scratch_path(spark, name + "-state"))
    out = spark.read.schema(stream.schema).parquet(path)
    # event times go back to the wall-clock type they came in
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


def _monitored(spark, d, monitor, name):
    """The steps of the events in four deliveries that hold every fourth step of a run, none in order, some sent twice."""
    source, out, offsets = (scratch_path(spark, f"{name}-{part}") for part in ("steps", "events", "offsets"))
    steps = fx.run_steps(spark, d).select("sample_id", "step", F.col("ts").cast("timestamp").alias("ts"), "total_overlap",
                                          (F.col("total_overlap") / 8).alias("ratio"))
    turn = (F.col("step") * 3 + F.col("sample_id")) % 4
    for part in range(4):
        steps.where((turn == part) | ((F.col("step") % 11 == 0) & (turn < part))).write.mode("append").parquet(source)
        mo.run_to_end(mo.monitored(spark.readStream.schema(steps.schema).parquet(source), monitor, "400 days"), out, offsets)
    fields = f"sample_id {steps.schema['sample_id'].dataType.simpleString()}, {monitor.fields}"
    return spark.read.schema(fields).parquet(out)


@query(sql("""SELECT s AS start, s+INTERVAL 6 HOUR AS "end", user_id AS sample_id, count(*) AS n, round(sum(value),4) AS overlap, max(value) AS largest
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s FROM events) GROUP BY s, user_id"""))
def windowed_telemetry(spark, d):
    return rounded(_closed(spark, d, lambda e: mo.windowed_telemetry(e, "6 hours"), "windows"), "overlap", digits=4)


@query(sql("""SELECT s AS start, s+INTERVAL 6 HOUR AS "end", user_id AS sample_id, count(*) AS n, round(sum(value),4) AS overlap, max(value) AS largest
FROM (SELECT *, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01')-INTERVAL 3 HOUR]) AS s
FROM events) GROUP BY ALL"""))
def sliding_telemetry(spark, d):
    return rounded(_closed(spark, d, lambda e: mo.windowed_telemetry(e, "6 hours", "3 hours"), "sliding"), "overlap", digits=4)


@query(sql("""SELECT min(ts) AS start, max(ts)+INTERVAL 12 HOUR AS "end", user_id AS sample_id, count(*) AS n FROM (SELECT *, sum(new) OVER
(PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)>=INTERVAL 12 HOUR)::INT,1) AS new
FROM events)) GROUP BY user_id, s"""))
def session_activity(spark, d):
    return _closed(spark, d, lambda e: mo.session_activity(e, "12 hours"), "sessions")


@query(sql("""SELECT DISTINCT user_id AS sample_id, event_id AS step, ts FROM events"""))
def dedup_steps(spark, d):
    """Every event sent twice, kept once."""
    twice = _events(spark, d).withColumn("step", F.col("event_id")).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_k")
    return _drained(spark, mo.dedup_steps(twice.select("sample_id", "step", "ts")), "dedup")


@query(sql("""SELECT sample_id, step, 'finished' AS event, streak FROM (SELECT sample_id, step, step-coalesce(max(CASE WHEN total_overlap>20+1e-12
THEN step END) OVER (PARTITION BY sample_id ORDER BY step),-1) AS streak FROM steps) WHERE streak>6 UNION ALL
SELECT sample_id, step, 'failed', quiet FROM (SELECT sample_id, step, step-max(CASE WHEN coalesce(c,1e9)>=300 THEN step END) OVER (PARTITION BY sample_id ORDER BY step) AS quiet
FROM (SELECT sample_id, step, abs(total_overlap-lag(total_overlap) OVER w)/lag(total_overlap) OVER w*100 AS c FROM steps
WINDOW w AS (PARTITION BY sample_id ORDER BY step))) WHERE step>5 AND quiet>=5""", "steps"))
def monitor_runs(spark, d):
    return _monitored(spark, d, mo.run_monitor(20.0, 6, 5, 300.0), "monitor")


@query(sql("""SELECT sample_id, step, 'rolling' AS event FROM (SELECT *, lag(total_overlap,5) OVER (PARTITION BY sample_id ORDER BY step) AS l FROM steps)
WHERE total_overlap>l UNION ALL SELECT sample_id, step, 'ratio' FROM (SELECT *, sum(c) OVER (PARTITION BY sample_id ORDER BY step) AS n FROM (
SELECT sample_id, step, coalesce(((total_overlap/8-1)*(lag(total_overlap/8) OVER (PARTITION BY sample_id ORDER BY step)-1)<=0)::INT,0) AS c FROM steps))
WHERE c=1 AND n%2=0""", "steps"))
def equilibrium_events(spark, d):
    return _monitored(spark, d, mo.equilibrium_monitor(5, 2), "equilibrium")


@query("WITH RECURSIVE " + VIEWS["steps"] + """, seen AS (SELECT sample_id, step, max(CASE WHEN up THEN step END) OVER (PARTITION BY sample_id
ORDER BY step) AS risen FROM (SELECT sample_id, step, total_overlap>lag(total_overlap) OVER (PARTITION BY sample_id ORDER BY step) AS up
FROM steps)), waits(sample_id, step, m, due) AS (SELECT DISTINCT sample_id, -1::BIGINT, 3::BIGINT, 3::BIGINT FROM seen UNION ALL
SELECT sample_id, found, m+found-due-1, found+m+found-due-1 FROM (SELECT e.sample_id, e.m, e.due, min(s.step) AS found FROM waits e
JOIN seen s ON s.sample_id=e.sample_id AND s.step>e.due AND s.step-s.risen<(e.m+1)//2 GROUP BY ALL)),
lags AS (SELECT sample_id, step, total_overlap>lag(total_overlap,4) OVER w AS rose,
coalesce(((total_overlap/8-1)*(lag(total_overlap/8) OVER w-1)<=0)::INT,0) AS c FROM steps WINDOW w AS (PARTITION BY sample_id ORDER BY step))
SELECT sample_id, step, 'original' AS event FROM waits WHERE step>=0 UNION ALL SELECT sample_id, step, 'rolling' FROM lags WHERE rose
UNION ALL SELECT sample_id, step, 'ratio' FROM (SELECT *, sum(c) OVER (PARTITION BY sample_id ORDER BY step) AS n FROM lags) WHERE c=1 AND n%3=0""")
def equilibrium_criteria(spark, d):
    """All three criteria at once, as the steps arrive."""
    return _monitored(spark, d, mo.equilibrium_monitor(4, 3, 3), "criteria")


@query(sql("SELECT sample_id::VARCHAR AS sample_id, '1.r' AS location, 'sigma is negative' AS message FROM samples", "samples"))
def stream_quality(spark, d):
    """Documents streamed as they lie in the folder, their distributions checked on the way."""
    path = _written(spark, d)
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_extract(F.input_file_name(), "sample_id=([^/]+)/", 1).alias("sample_id"), "value")
    return _drained(spark, mo.stream_quality(lines), "quality")
