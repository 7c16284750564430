"""Run histories from array archives, status files and section images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 1 << 16


def _facts(z) -> Iterator[dict]:
    number = lambda key: float(z[key]) if key in z and z[key].dtype.kind in "fiub" and z[key].size == 1 else np.nan
    yield {"n_steps": [int(z["step"])], "seconds": [number("time")], "status": [number("status")], "max_residue": [number("max_residue")]}


#: Histories in an archive, and whether each has a value from the first step.
_HISTORIES = {"total_overlap": ("total_overlap_history", True), "kinetic": ("kinetic_energy_history", True),
              "thermic": ("thermic_energy_history", False), "dt": ("all_dt", False), "ratio": ("ratio", False)}


def _histories(z) -> Iterator[dict]:
    """Steps side by side. Thermic energies, time steps and ratios start late: they are aligned at the last steps."""
    series = {name: np.asarray(z[f], float) if f in z else np.zeros(0) for name, (f, _) in _HISTORIES.items()}
    whole = max(len(series[name]) for name, (_, first) in _HISTORIES.items() if first)
    for lo in range(0, max(len(v) for v in series.values()), _CHUNK):
        steps = np.arange(lo, min(lo + _CHUNK, max(len(v) for v in series.values())))
        cols = {}
        for name, values in series.items():
            at = steps - (0 if _HISTORIES[name][1] else max(whole - len(values), 0))
            there = (at >= 0) & (at < len(values))
            cols[name] = np.full(len(steps), np.nan)
            cols[name][there] = values[at[there]]
        yield {"step": steps, **cols}


def _changes(z) -> Iterator[dict]:
    if "temp_change_steps" in z and len(z["temp_change_steps"]):
        yield {"step": z["temp_change_steps"].astype("int64")}


def _tracks(z) -> Iterator[dict]:
    if "position_center_history" in z:
        for i, track in enumerate(np.asarray(z["position_center_history"], float)):
            for lo in range(0, len(track), _CHUNK):
                part = track[lo:lo + _CHUNK]
                rest = {a: part[:, j] if j < part.shape[1] else np.full(len(part), np.nan) for j, a in enumerate("xyz")}
                yield {"particle_id": np.full(len(part), i), "step": np.arange(lo, lo + len(part)), **rest}


#: Each table with its columns and the members it is made of; no two read the same member.
_PARTS = {
    "runs": ("n_steps bigint, seconds double, status double, max_residue double", _facts),
    "run_steps": ("step bigint, " + ", ".join(f"{name} double" for name in _HISTORIES), _histories),
    "temp_changes": ("step bigint", _changes),
    "paths": ("particle_id bigint, step bigint, x double, y double, z double", _tracks),
}


def unpack_runs(archives: DataFrame) -> dict[str, DataFrame]:
    """Runs, their steps, temperature changes and paths of archives (``sample_id, content``).

    A table opens the directory of an archive and decodes its own members only, so each member is decoded once. An archive is
    one run kept whole by its writer and must fit a task; a batch of them is read where it lies, one archive at a time, and the
    rows an archive unfolds into come in chunks. Absent members give nulls or no rows; null or broken contents give no rows.
    """
    key = archives.schema["sample_id"].dataType.simpleString()

    def table(fields: str, part) -> DataFrame:
        types = {name: {"bigint": pa.int64(), "double": pa.float64()}[kind] for name, kind in (f.split() for f in fields.split(", "))}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, raw in zip(batch.column("sample_id"), batch.column("content")):
                    try:
                        z = np.load(io.BytesIO(raw.as_buffer() or b""), allow_pickle=False)
                    except (ValueError, EOFError, zipfile.BadZipFile):
                        continue
                    with z:
                        for rows in part(z):
                            cols = [pa.array(rows[c], t) for c, t in types.items()]
                            yield pa.RecordBatch.from_arrays([pa.repeat(name, len(cols[0])), *cols], ["sample_id", *types])

        rows = archives.select("sample_id", "content").mapInArrow(run, f"sample_id {key}, {fields}")
        return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])

    tables = {name: table(*part) for name, part in _PARTS.items()}
    tables["runs"] = tables["runs"].withColumn("status", F.col("status") > 0)
    return tables


def read_runs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``unpack_runs`` of the archives in folders ``sample_id=<id>``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    return unpack_runs(files.select(F.regexp_extract("path", "sample_id=([^/]+)/", 1).alias("sample_id"), "content"))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status files: ``Time: 1.234s``, ``Overlap: 1.0e-05``, ``Status: True``, ``Mesh ...`` lines; ``none`` is null."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_status(lines.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("sample_id"), "value"))


def parse_status(lines: DataFrame) -> DataFrame:
    def field(name: str) -> Column:
        text = F.regexp_extract("value", f"^{name}: (.*)$", 1)
        return F.max(F.when(F.col("value").startswith(f"{name}: ") & (text != "none") & (text != "None"), text))

    return (lines.groupBy("sample_id").agg(
        F.regexp_replace(field("Time"), "s$", "").try_cast("double").alias("seconds"),
        field("Overlap").try_cast("double").alias("total_overlap"),
        field("Status").try_cast("boolean").alias("status"),
        F.sum(F.col("value").startswith("Mesh ").cast("long")).alias("n_meshes")))


def _raster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for image in batch.itertuples(index=False):
            cells = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.channels)
            # channels are kept as blue, green, red: the first of the file's is the last here
            first = cells[:, :, -1] if image.channels < 4 else cells[:, :, 2]
            for lo in range(0, image.height, max(1, _CHUNK // max(image.width, 1))):
                part = first[lo:lo + max(1, _CHUNK // max(image.width, 1))]
                py, px = np.indices(part.shape)
                yield pd.DataFrame({"image_id": image.image_id, "px": px.ravel(), "py": py.ravel() + lo,
                                    "value": part.ravel().astype(int), "channels": image.channels})


def pixels(images: DataFrame) -> DataFrame:
    """A row per pixel of decoded images (``image_id, height, width, channels, data``), with the value of its first channel."""
    wanted = images.where("data IS NOT NULL").select("image_id", "height", "width", "channels", "data")
    return wanted.mapInPandas(_raster, "image_id string, px bigint, py bigint, value int, channels int")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Raster of section images: a row per pixel with the value of its first channel."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return pixels(images.select(F.regexp_extract("image.origin", "([^/]+)$", 1).alias("image_id"), "image.height", "image.width",
                                F.col("image.nChannels").alias("channels"), "image.data"))
