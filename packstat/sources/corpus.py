"""Reading and writing corpora of microstructure documents, one record to a line.

A document is JSON, written with a header entry, a phase or a particle on each line, and read in any
layout: it is cut into records where they lie (structure.py), so one document of any size is split over
many tasks. A sample may be one file, or a folder ``sample_id=<id>`` of parts that follow each other in
name order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packstat.functions.ordered import number_rows
from packstat.operators.rules import problem, record_problems
from packstat.schema import FORMAT_SUFFIX, PARTICLE_SIZES, SHAPES_CENTRE, TYPE_CODES, VERSION
from packstat.session import checkpoint
from packstat.sources.structure import entries, read_pieces

D, L, S, I, B = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_PLAIN = [n for n in PARTICLE_SIZES if not n.startswith("rot_")]
PARTICLE_RECORD = _struct(id=L, phase=S, shape=S, center=T.ArrayType(D), **{n: D for n in _PLAIN},
                          rotation_axis=T.ArrayType(D), direction=I, parent_id=L)
DESCRIPTOR_RECORD = _struct(distribution=S, value=D, values=T.ArrayType(D), probabilities=T.ArrayType(D), mean=D, sigma=D,
                            low=D, high=D, kappa=D, loc=D, scale=D)
PHASE_RECORD = _struct(type=S, type_code=I, inner_phase=B, outer_phase=S,
                       descriptors=T.MapType(S, DESCRIPTOR_RECORD))
_PARAMS = ("value", "mean", "sigma", "low", "high", "kappa", "loc", "scale")

# fixed values: header entries of a document
HEADER = ("format", "version", "rve_dims", "dim", "periodic", "matrix_phase", "provenance")


def _sample_of(path: Column) -> Column:
    """The folder name after ``sample_id=``, else the file's whole path."""
    named = F.regexp_extract(path, "sample_id=([^/]+)/", 1)
    plain = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "\\.json$", "")
    return F.when(named != "", named).otherwise(plain)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines of documents (``sample_id, value``) with what each one is: ``entry, name, body``."""
    bare = F.regexp_replace(F.trim("value"), ",$", "")
    name = F.regexp_extract(bare, '^"((?:[^"\\\\]|\\\\.)*)": ', 1)
    body = F.regexp_replace(bare, '^"((?:[^"\\\\]|\\\\.)*)": ', "")
    # two spaces lead a header entry, four a phase or a particle
    deep = F.col("value").startswith("    ")
    entry = F.when(deep & bare.startswith("{"), "particle").when(deep & (name != ""), "phase").when(
        name.isin(*HEADER), "header")
    return lines.select("sample_id", entry.alias("entry"), name.alias("name"), body.alias("body")).where("entry IS NOT NULL")


def _number(column: Column) -> Column:
    """NaN stands for a missing number and is read as null."""
    return F.when(~F.isnan(column), column)


def particles_from(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("entry = 'particle'").select("sample_id", "body", F.from_json("body", PARTICLE_RECORD).alias("_p"))
    p = F.col("_p")
    turn = [F.get(p["rotation_axis"], k).alias(n) for k, n in enumerate(("rot_x", "rot_y", "rot_z"))]
    centre = [_number(F.get(p["center"], k)).alias(n) for k, n in enumerate(("cx", "cy", "cz"))]
    return rows.select("sample_id", p["id"].alias("particle_id"), p["phase"].alias("phase"), p["shape"].alias("shape"), *centre,
                       *[_number(p[n]).alias(n) for n in _PLAIN], *turn, p["direction"].alias("direction"),
                       p["parent_id"].alias("parent_id"), F.lit(0.0).alias("delta"))


def phases_from(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = parsed.where("entry = 'phase'").select("sample_id", F.col("name").alias("phase"),
                                                  F.from_json("body", PHASE_RECORD).alias("_p"))
    p = F.col("_p")
    phases = rows.select("sample_id", "phase", F.col("phase").try_cast("int").alias("phase_order"), p["type"].alias("type"),
                         p["type_code"].alias("type_code"), p["inner_phase"].alias("inner_phase"), p["outer_phase"].alias("outer_phase"))
    each = rows.select("sample_id", "phase", F.explode(p["descriptors"]).alias("name", "_d"))
    d = F.col("_d")
    params = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in _PARAMS]), F.array(*[d[n] for n in _PARAMS])),
                          lambda _, v: v.isNotNull())
    descriptors = each.select("sample_id", "phase", "name", d["distribution"].alias("distribution"), params.alias("params"),
                              d["values"].alias("values"), d["probabilities"].alias("probabilities"))
    return phases, descriptors


def headers_from(parsed: DataFrame) -> DataFrame:
    """One row per document from its header entries."""
    pick = lambda n: F.max(F.when((F.col("entry") == "header") & (F.col("name") == n), F.col("body")))
    rows = parsed.where("entry = 'header'").groupBy("sample_id").agg(*[pick(n).alias(n) for n in HEADER])
    text = lambda n: F.when(F.col(n) != "null", F.regexp_replace(n, '^"|"$', ""))
    sides = F.from_json("rve_dims", "array<double>")
    prov = lambda n: F.get_json_object("provenance", f"$.{n}")
    return rows.select(
        "sample_id", text("format").alias("format"), F.col("version").try_cast("int").alias("version"),
        F.col("dim").try_cast("int").alias("dim"), F.get(sides, 0).alias("lx"), F.get(sides, 1).alias("ly"),
        F.get(sides, 2).alias("lz"), (F.col("periodic") == "true").alias("periodic"), text("matrix_phase").alias("matrix_phase"),
        prov("achieved_volume_fraction").try_cast("double").alias("achieved_vf"),
        prov("total_overlap").try_cast("double").alias("total_overlap"),
        F.to_timestamp(prov("generated")).alias("generated"),
        F.from_json("provenance", "map<string,string>").alias("provenance"))


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a corpus: samples, phases, descriptors, particles - and its problems.

    Documents of an unknown format or version, and files that hold no document, give problems and no rows. Of records
    with the same name or number all are read.
    Spark's readers do not list files of no bytes: they give nothing.
    """
    place = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_sample_of(place).alias("sample_id")).distinct()
    parsed = entries(read_pieces(spark, path, _sample_of), HEADER)
    headers = checkpoint(headers_from(parsed))
    unread = files.join(headers.select("sample_id"), "sample_id", "left_anti").select(
        *problem(F.lit(""), F.lit("the file holds no document that can be read")))
    good = headers.where(F.coalesce(F.col("format").endswith(FORMAT_SUFFIX) & (F.col("version") == VERSION), F.lit(False)))
    known = parsed.join(good.select("sample_id"), "sample_id", "left_semi")
    phases, descriptors = phases_from(known)
    particles = particles_from(known)
    return {"samples": good.drop("format", "version"), "phases": phases, "descriptors": descriptors, "particles": particles,
            "problems": record_problems(headers, particles, phases).unionByName(unread)}


def document_lines(tables: dict[str, DataFrame], name: str = "particle" + FORMAT_SUFFIX) -> DataFrame:
    """The lines of every document: ``sample_id, part, position, value``.

    A particle's id is its place in the list, a parent is named only when it is in the sample.
    """
    samples, phases, particles = tables["samples"], tables["phases"], tables["particles"]
    listed = checkpoint(number_rows(particles, ["sample_id"], ["particle_id"], "_id"))
    parents = listed.select("sample_id", F.col("particle_id").alias("parent_id"), F.col("_id").alias("_parent"))
    if "parent_id" in listed.columns:
        listed = listed.join(parents, ["sample_id", "parent_id"], "left")
    else:
        listed = listed.withColumn("_parent", F.lit(None).cast("long"))
    have = set(listed.columns)
    value = lambda n, t="double": F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    flat = F.col("shape").isin(*SHAPES_CENTRE[2])
    centre = F.when(flat, F.array("cx", "cy")).otherwise(F.array(F.col("cx"), F.col("cy"), value("cz")))
    turn = F.when(value("rot_x").isNotNull(), F.array(value("rot_x"), value("rot_y"), value("rot_z")))
    record = F.to_json(F.struct(F.col("_id").alias("id"), "phase", "shape", centre.alias("center"),
                                *[value(n).alias(n) for n in _PLAIN], turn.alias("rotation_axis"),
                                value("direction", "int").alias("direction"), F.col("_parent").alias("parent_id")))
    counts = listed.groupBy("sample_id").agg(F.max("_id").alias("_last"))
    body = listed.join(counts, "sample_id").select("sample_id", F.lit(3).alias("part"), F.col("_id").alias("position"), F.concat(
        F.lit("    "), record, F.when(F.col("_id") < F.col("_last"), ",").otherwise("")).alias("value"))
    code = F.create_map(*[F.lit(x) for pair in TYPE_CODES.items() for x in pair])
    phase = _phase_json(phases, tables.get("descriptors"), code)
    n_phases = phase.groupBy("sample_id").agg(F.max("position").alias("_last"))
    middle = phase.join(n_phases, "sample_id").select("sample_id", F.lit(1).alias("part"), "position", F.concat(
        F.lit("    "), F.col("value"), F.when(F.col("position") < F.col("_last"), ",").otherwise("")).alias("value"))
    sides = F.when(F.col("dim") == 3, F.array("lx", "ly", "lz")).otherwise(F.array("lx", "ly"))
    head = F.array(F.lit("{"), F.lit(f'  "format": "{name}",'), F.lit(f'  "version": {VERSION},'),
                   F.concat(F.lit('  "rve_dims": '), F.to_json(sides), F.lit(",")),
                   F.concat(F.lit('  "dim": '), F.col("dim").cast("string"), F.lit(",")), F.lit('  "periodic": true,'),
                   F.concat(F.lit('  "matrix_phase": "'), F.col("matrix_phase"), F.lit('",')), F.lit('  "phases": {'))
    frame = [samples.select("sample_id", F.lit(0).alias("part"), F.posexplode(head).alias("position", "value")),
             samples.select("sample_id", F.lit(2).alias("part"), F.posexplode(F.array(F.lit("  },"), F.lit('  "particles": ['))).alias("position", "value")),
             samples.select("sample_id", F.lit(4).alias("part"), F.posexplode(F.array(F.lit("  ]"), F.lit("}"))).alias("position", "value"))]
    out = body
    for rows in [middle.select(*body.columns), *frame]:
        out = out.unionByName(rows.withColumn("position", F.col("position").cast("long")))
    return out


def _phase_json(phases: DataFrame, descriptors: DataFrame | None, code: Column) -> DataFrame:
    rows = phases.withColumn("type_code", F.element_at(code, F.col("type")))
    if descriptors is not None:
        record = F.struct("distribution", *[F.col("params")[n].alias(n) for n in _PARAMS], "values", "probabilities")
        # at most a dozen descriptors describe a phase
        maps = descriptors.groupBy("sample_id", "phase").agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("name", record.alias("r"))))).alias("descriptors"))
        rows = rows.join(maps, ["sample_id", "phase"], "left")
    fields = ["type", "type_code", "inner_phase", "outer_phase"] + (["descriptors"] if descriptors is not None else [])
    text = F.concat(F.to_json(F.create_map("phase", F.struct(*fields))))
    # {"name":{...}} without its outer braces is the entry of the phase
    entry = F.regexp_replace(F.expr("substring(_t, 2, length(_t) - 2)"), '^("(?:[^"\\\\]|\\\\.)*"):', "$1: ")
    return number_rows(rows.select("sample_id", "phase", text.alias("_t")), ["sample_id"], ["phase"], "position").select(
        "sample_id", "position", entry.alias("value"))


def write_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """One document per sample under ``sample_id=<id>``; the parts of a large one follow in name order."""
    lines = document_lines(tables)
    (lines.repartitionByRange("sample_id", "part", "position").sortWithinPartitions("sample_id", "part", "position")
     .select("sample_id", "value").write.partitionBy("sample_id").mode("errorifexists").text(path))


def corpus_from_tables(df: DataFrame, mapping: dict[str, Column | str], shape: str = "Disk") -> DataFrame:
    """Any table with coordinates as particles: ``mapping`` gives particle columns from its own."""
    cols = {k: F.col(v) if isinstance(v, str) else v for k, v in mapping.items()}
    cols.setdefault("phase", F.lit("1"))
    return df.select(*[v.alias(k) for k, v in cols.items()], F.lit(shape).alias("shape"))
