"""Helpers the operators share: words of whole texts as hashes, distributed numbering, reading tables.

A word is a run of bytes other than space and the five ASCII control spaces. Inside tasks the
texts of an Arrow batch are treated as one buffer of bytes, in runs of about a megabyte, so
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packstat.session import scratch_path

#: One or more of the separators between words, for Java's and RE2's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"

_SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
_RNG = np.random.default_rng(20)
_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_INSIDE = np.ones(256, bool)
_INSIDE[list(_SPACE_BYTES)] = False
#: Words of so many bytes get a hash of their own: sums of powers modulo two to the 64th are the same for some pairs of long words.
LONG_WORD = 256
_BASE, _POWERS = 0x9E3779B97F4A7C15, {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and their inverses, modulo two to the 64th."""
    if len(_POWERS.get("p", ())) < max(n, 1):
        size = 1 << max(20, max(0, n - 1).bit_length())
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times power; with these, any stretch of values is hashed by one subtraction."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0][: len(values)], out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end], whatever their place."""
    return mix((sums[end] - sums[begin]) * _powers(len(sums))[1][begin])


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, first word of each text and the end, first byte, end byte); ``lower``: A-Z as a-z."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none
    inside = _INSIDE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums((_VALUE_LOWER if lower else _VALUE)[data])
    hashes = stretch_hash(sums, begin, end)
    for k in np.flatnonzero(end - begin >= LONG_WORD).tolist():
        word = data[begin[k]: end[k]].tobytes()
        hashes[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return hashes, np.searchsorted(begin, bounds), begin, end


def texts(column: pa.Array, run: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``run`` bytes: first row, end row, bytes, bounds of the texts. Null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + run, side="right")) - 1)
        yield i, j, data[at[i]: at[j]], at[i: j + 1] - at[i]
        i = j


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str, per_block: int = 50_000, least: int = 64) -> DataFrame:
    """Number the rows of each key from 0 without gaps, no key in one task.

    Rows fall into blocks by a hash of ``order``; they are numbered inside (key, block) and
    moved by the counts of the key's earlier blocks. ``df`` should be checkpointed.
    """
    blocks = max(least, df.count() // per_block + 1)
    rows = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_at"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1)
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(counts, same).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).select(*df.columns, name)


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_key``, a number of its own for each row, in the order of the ids.

    Ids that are whole numbers, each there once, are the keys themselves. Otherwise the rows are sorted by id (null
    ids last) and text, numbered, and written once, so that all readers see the same keys.
    """
    spark, id_ = docs.sparkSession, F.col("doc_id").cast("long")
    if docs.select(id_.alias("_id")).groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1 OR _id IS NULL").isEmpty():
        return docs.withColumn("_row_key", id_)
    rows = docs.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.asc_nulls_last(id_), F.xxhash64("doc_id"), F.xxhash64("text"), "_at")
    place = scratch_path(spark, "rows")
    rows.drop("_at").withColumn("_row_key", F.monotonically_increasing_id()).write.parquet(place)
    return spark.read.parquet(place)


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are moved compressed: column ``text`` becomes ``packed``."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([pack.compress(x or b"") for x in raw], pa.binary())], [*names, "packed"])


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        said = [None if x is None else pack.compress(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def _unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            # a view, not a cast: texts come back byte for byte
            said = pa.array([None if x is None else unpack.decompress(x) for x in part.column(at).to_pylist()], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([said if k == at else c for k, c in enumerate(part.columns)], part.schema.names)


def _typed(df: DataFrame, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kind if f.name == "text" else f.dataType) for f in df.schema])


def compressed(df: DataFrame) -> DataFrame:
    """``df`` with its texts compressed, so that a shuffle of whole rows moves less; null stays null."""
    return df.mapInArrow(_packing, _typed(df, T.BinaryType()))


def restored(df: DataFrame) -> DataFrame:
    """What ``compressed`` had as texts again."""
    return df.mapInArrow(_unpacking, _typed(df, T.StringType()))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: no lineage, sizes as they are."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
