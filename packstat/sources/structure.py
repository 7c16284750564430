"""Cutting JSON documents of any layout into records where they lie.

Files are read up to each closing brace instead of each newline, so a document on one line is split over tasks as one
with a record to a line is. Whether a piece begins inside a string, and how deep it lies, depends on all text before it:
every split is reduced to its quote parity and to the change of depth for either parity, a prefix pass over the splits
of a document composes these, and windows over one split give each piece its own state.
A row holds the text between two closing braces and has to fit a task, as a record has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packstat.session import checkpoint

SPLIT = ["sample_id", "_file", "_block"]
# the size of a compressed file says nothing of its text: it ends in a brace unless its last piece asks for more
_PACKED = "(?i)\\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"


def read_pieces(spark: SparkSession, path: str, sample_of) -> DataFrame:
    """``sample_id, value``: the text up to each closing brace, without it, and its place ``_file, _block, _at``."""
    place = F.col("_metadata.file_path")
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path).select(
        sample_of(place).alias("sample_id"), "value", place.alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_size").alias("_size"))


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _opened(text: Column) -> Column:
    """Objects and lists begun less lists ended, outside strings, in text that begins outside a string."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return (_count(bare, "{[") - _count(bare, "]")).cast("long")


def _sum_before(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def with_depth(pieces: DataFrame) -> DataFrame:
    """Adds ``_depth`` before each piece, ``_after`` its closing brace, ``_closed`` (that brace ends an object) and ``_within``
    (the text after the piece lies in a string).

    No escape reaches past a brace, since backslash and brace are no escape.
    """
    plain = F.regexp_replace("value", "(?s)\\\\.", "")
    each = pieces.withColumns({"_quotes": _count(plain, '"').cast("long"), "_out": _opened(plain),
                               "_in": _opened(F.concat(F.lit('"'), plain)), "_bytes": (F.octet_length("value") + 1).cast("long")})
    order = Window.partitionBy(*SPLIT).orderBy("_at")
    each = each.withColumns({"_odd": _sum_before("_quotes", order) % 2, "_last": F.lead("_at").over(order).isNull()})

    def change(parity: int) -> Column:
        inside = (F.col("_odd") + parity) % 2 == 1
        ends_inside = (F.col("_odd") + F.col("_quotes") + parity) % 2 == 1
        return F.when(inside, F.col("_in")).otherwise(F.col("_out")) - F.when(ends_inside, 0).otherwise(1)

    # text that no brace may follow: nothing, or a sign that asks for more
    hangs = F.col("_last") & F.regexp_like("value", F.lit("(?:^|[,:{\\[])\\s*\\z"))
    splits = each.groupBy(*SPLIT).agg(F.max(hangs).alias("_hangs"), F.sum("_quotes").alias("_quotes"), F.sum(change(0)).alias("_out"), F.sum(change(1)).alias("_in"),
                                      F.sum("_bytes").alias("_bytes"), F.max("_size").alias("_size"))
    # one row per split from here: a document of 100 TB has less than a million
    by_file = Window.partitionBy("sample_id", "_file")
    whole = F.sum("_bytes").over(by_file)
    # a file that ends in its last brace is as long as its pieces and braces; a mark of the byte order adds three
    open_end = F.when(F.regexp_like("_file", F.lit(_PACKED)), F.col("_hangs")).otherwise(~(F.col("_size") - whole).isin(0, 3))
    splits = splits.withColumn("_open_end", (F.lead("_block").over(by_file.orderBy("_block")).isNull() & open_end).cast("long"))
    splits = splits.withColumns({
        "_out": F.col("_out") + F.when(F.col("_quotes") % 2 == 0, F.col("_open_end")).otherwise(0),
        "_in": F.col("_in") + F.when(F.col("_quotes") % 2 == 1, F.col("_open_end")).otherwise(0)})
    by_sample = Window.partitionBy("sample_id").orderBy("_file", "_block")
    splits = splits.withColumn("_parity", _sum_before("_quotes", by_sample) % 2)
    splits = splits.withColumn("_change", F.when(F.col("_parity") == 1, F.col("_in")).otherwise(F.col("_out")))
    splits = checkpoint(splits.select(*SPLIT, "_parity", "_open_end", _sum_before("_change", by_sample).alias("_base")))

    found = each.drop("_size", "_bytes").join(splits, SPLIT)
    inside = (F.col("_odd") + F.col("_parity")) % 2 == 1
    within = (F.col("_odd") + F.col("_quotes") + F.col("_parity")) % 2 == 1
    ended = F.col("_last") & (F.col("_open_end") == 1)
    found = found.withColumns({"_within": within, "_closed": ~within & ~ended, "_ended": ended})
    found = found.withColumn("_step", F.when(inside, F.col("_in")).otherwise(F.col("_out")) - F.col("_closed").cast("long"))
    found = found.withColumn("_depth", F.col("_base") + _sum_before("_step", order))
    return found.withColumn("_after", F.col("_depth") + F.col("_step")).select(
        *SPLIT, "_at", "value", "_depth", "_after", "_closed", "_within", "_ended")


def records(pieces: DataFrame) -> DataFrame:
    """``sample_id, n, text, _depth, _after, _closed, _within``: text between braces that close to a depth of two or less, in order.

    Such a brace ends an element of a list or object of the document, or the list's or object's own. A record of one
    piece, the usual case, is not gathered.
    """
    order = Window.partitionBy(*SPLIT).orderBy("_at")
    cut = with_depth(pieces).withColumn("_cut", F.col("_closed") & (F.col("_after") <= 2))
    text = F.concat("value", F.when(F.col("_ended"), "").otherwise("}"))
    cut = cut.withColumn("_one", F.col("_cut").cast("long")).withColumns({
        "_n": _sum_before("_one", order), "_alone": F.col("_cut") & F.coalesce(F.lag("_cut").over(order), F.lit(False)), "text": text})
    # written once: what follows reads the columns it needs, and the places of pieces stay as they are
    cut = checkpoint(cut.drop("value", "_one", "_ended"))
    counts = cut.groupBy(*SPLIT).agg(F.sum(F.col("_cut").cast("long")).alias("_cuts"))
    by_sample = Window.partitionBy("sample_id").orderBy("_file", "_block")
    counts = checkpoint(counts.select(*SPLIT, _sum_before("_cuts", by_sample).alias("_first")))
    cut = cut.join(counts, SPLIT).withColumn("n", F.col("_first") + F.col("_n"))
    state = ["_depth", "_after", "_closed", "_within"]
    alone = cut.where("_alone").select("sample_id", "n", "text", *state)
    parts = cut.where("NOT _alone").groupBy("sample_id", "n").agg(F.array_sort(F.collect_list(
        F.struct("_file", "_block", "_at", "text", *state))).alias("_p"))
    first, last = F.get("_p", 0), F.element_at("_p", -1)
    joined = parts.select("sample_id", "n", F.array_join("_p.text", "").alias("text"), first["_depth"].alias("_depth"),
                          *[last[c].alias(c) for c in state[1:]])
    return alone.unionByName(checkpoint(joined))


def entries(pieces: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """``sample_id, entry, name, body``: the header entries, phases and particles of documents; none of one that is no JSON."""
    found = records(pieces)
    trimmed = F.regexp_replace("text", "^[\\s,]+", "")
    # a list ends in the text before the next brace
    rest = F.regexp_extract("text", "(?s)^[^\\[\\]{}\"]*\\](.*)$", 1)
    in_list = (F.col("_depth") == 2) & F.regexp_like("text", F.lit("(?s)^[^\\[\\]{}\"]*\\]"))
    top = (F.col("_depth") < 2) | in_list
    rows = found.withColumns({"_top": top, "_body": F.when(in_list, F.regexp_replace(rest, "^[\\s,]+", "")).otherwise(trimmed)})
    heads = rows.where("_top")
    # what precedes the brace is completed to an object: the list or object it opens is closed by either sign
    text = F.when(F.col("_depth") == 0, F.regexp_replace("_body", "^\\{", "")).otherwise(F.col("_body"))
    as_map = lambda end: F.from_json(F.concat(F.lit("{"), text, F.lit(end)), "map<string,string>")
    read = (F.when(F.col("_after") == 0, as_map("")).when(F.col("_after") == 1, as_map("}"))
            .otherwise(F.coalesce(as_map("}}"), as_map("]}"))))
    blank = F.trim("_body").isin("", "﻿") | F.regexp_like("_body", F.lit("^\\s*$"))
    heads = checkpoint(heads.select("sample_id", "n", "_depth", "_after", "_closed", "_within", blank.alias("_blank"),
                         F.regexp_like("_body", F.lit("^\\{")).alias("_opens"), read.alias("_m")))
    wrong = ((F.col("_depth") == 0) & ~F.col("_blank") & ((F.col("n") > 0) | ~F.col("_opens"))) | ~F.col("_blank") & (
        ~F.col("_closed") | F.col("_m").isNull())
    # the last record has to leave the document: outside strings, at depth 0
    state = rows.groupBy("sample_id").agg(F.max_by(F.struct("_after", "_within"), "n").alias("_s"), F.min("_after").alias("_low"))
    broken = state.where("_s._after <> 0 OR _s._within OR _low < 0").select("sample_id").unionByName(
        heads.where(wrong).select("sample_id")).distinct()
    # a few openings per document: a list or object of the header that holds objects opens a section
    opening = heads.where("_after = 2").select("sample_id", F.struct("n", F.element_at(F.map_keys("_m"), -1).alias("section")).alias("_o"))
    sections = opening.groupBy("sample_id").agg(F.array_sort(F.collect_list("_o")).alias("_sections"))
    facts = checkpoint(state.select("sample_id").join(broken, "sample_id", "left_anti").join(sections, "sample_id", "left"))
    inner = rows.where("NOT _top AND _after = 2").join(facts, "sample_id").withColumn("_section", F.try_element_at(
        F.filter("_sections", lambda s: s["n"] < F.col("n")), F.lit(-1))["section"])
    pick = lambda e, name, body: F.struct(F.lit(e).alias("entry"), name.alias("name"), body.alias("body"))
    phases_in = lambda text: F.transform(F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))),
                                         lambda e: pick("phase", e["key"], e["value"]))
    plain = F.transform(F.filter(F.map_entries("_m"), lambda e: e["key"].isin(*header)), lambda e: pick("header", e["key"], e["value"]))
    listed = F.transform(F.coalesce(F.from_json(F.col("_m")["particles"], "array<string>"), F.array().cast("array<string>")),
                         lambda e: pick("particle", F.lit(""), e))
    out = heads.where("_m IS NOT NULL").select("sample_id", F.explode(F.concat(plain, phases_in(F.col("_m")["phases"]), listed)).alias("_e"))
    phases = inner.where("_section = 'phases'").select("sample_id", F.explode(phases_in(
        F.concat(F.lit("{"), F.col("_body"), F.lit("}")))).alias("_e"))
    few = checkpoint(out.join(facts, "sample_id", "left_semi").unionByName(phases).select("sample_id", "_e.*").where("body IS NOT NULL"))
    particles = inner.where("_section = 'particles'").select("sample_id", F.lit("particle").alias("entry"), F.lit("").alias("name"),
                                                              F.col("_body").alias("body"))
    return few.unionByName(particles)
