"""Removal of lines that many documents share, with two Bloom filters.

The first pass sets the bits of every line key of every document in a filter of keys seen once, and of those seen
again in a filter of keys seen twice. Each task has a pair of its own; pairs merge in any order, because a key that both
pairs have seen has its bits in both first filters: once = a | b, twice = ta | tb | (a & b). They travel in chunks
of bits and are merged chunk by chunk, in two steps, so no task holds more than a chunk of each.

The second pass reads the texts again with the twice-filter, and only the keys that it has (suspects) are shuffled, as 128-bit
digests with the document they are in. These are counted exactly; those in enough documents are marked in their
documents, and the last pass drops the lines.

The filter has ``BITS`` bits whatever the input, so what is broadcast is bounded (32 MB). It has no false
negatives. Where it is full (some hundred million lines in all) more keys than needed are shuffled, 24 bytes a line at most; the result is
the same. A document is a row: repeated ids and null ids are documents of their own. Null and empty texts are one empty line.
An empty table gives no rows; extra columns come back, but for those that have a name of the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packstat.llm.common import packed_texts, row_keys, written
from packstat.session import spread

#: Bits of each filter, and of a chunk of it; both are powers of two.
BITS, CHUNK = 1 << 28, 1 << 23
#: Pairs of filters merge in two steps of about so many each.
FAN_IN = 64
#: Shares of the documents of a key.
SHARES = 64

_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def line_key(line: bytes) -> bytes:
    """What makes two lines the same: the line without space at its ends, A-Z as a-z."""
    return line.strip(_SPACE).lower()


def _long(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _keys(text: bytes | None, least: int) -> list[bytes]:
    """Distinct keys of a text."""
    return [k for k in set(map(line_key, (text or b"").split(b"\n"))) if _long(k, least)]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            yield batch.slice(i, 1000)


def _places(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter for each key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """A Bloom filter of two bits a key."""

    def __init__(self, bits: int):
        self.data = np.zeros(bits // 8, np.uint8)

    def add(self, places: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> None:
        for p in places:
            np.bitwise_or.at(self.data, p[which] >> 3, np.left_shift(1, p[which] & 7).astype(np.uint8))

    def has(self, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.logical_and(*((self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in places))


_PAIRS = "chunk int, part int, once binary, twice binary"


def _pairs(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1)
    cols = [[r[0] for r in rows], [r[1] for r in rows], [pack.compress(r[2].tobytes()) for r in rows], [pack.compress(r[3].tobytes()) for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], [f.split()[0] for f in _PAIRS.split(", ")])


def _seen(bits: int, chunk: int, least: int):
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pair of filters of a task, in chunks."""
        once, twice, some = Filter(bits), Filter(bits), False
        for batch in _small(batches):
            keys = [k for t in batch.column("text").cast(pa.binary()).to_pylist() for k in _keys(t, least)]
            if not keys:
                continue
            some, places = True, _places(keys, bits)
            # a key is seen again if an earlier batch has it, or an earlier document of this one
            _, first = np.unique(places[0] * bits + places[1], return_index=True)
            again = once.has(places)
            later = np.ones(len(keys), bool)
            later[first] = False
            twice.add(places, np.flatnonzero(again | later))
            once.add(places, first)
        part = TaskContext.get().partitionId() % FAN_IN
        for c in range(bits // chunk if some else 0):
            a = slice(c * chunk // 8, (c + 1) * chunk // 8)
            if once.data[a].any():
                yield _pairs([(c, part, once.data[a], twice.data[a])])
    return seen


def _merged(chunk: int, by_part: bool):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pair for each chunk (and part); pairs come sorted by these."""
        unpack, at = zstandard.ZstdDecompressor(), None
        once = twice = np.zeros(0, np.uint8)
        for batch in batches:
            for c, part, a, b in zip(*(batch.column(k).to_pylist() for k in ("chunk", "part", "once", "twice")), strict=True):
                place = (c, part if by_part else 0)
                if place != at:
                    if at:
                        yield _pairs([(*at, once, twice)])
                    at, once, twice = place, np.zeros(chunk // 8, np.uint8), np.zeros(chunk // 8, np.uint8)
                a, b = (np.frombuffer(unpack.decompress(x), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        if at:
            yield _pairs([(*at, once, twice)])
    return merged


def twice_filter(texts: DataFrame, least_chars: int = 1, bits: int = BITS, chunk: int = CHUNK) -> np.ndarray:
    """Bits of all line keys that two documents have, and of some others; ``bits`` / 8 bytes at most, whatever the table."""
    bits = max(bits, 64)
    chunk = min(chunk, bits)
    pairs = texts.select("text").mapInArrow(_seen(bits, chunk, least_chars), _PAIRS)
    pairs = spread(pairs, "chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(_merged(chunk, True), _PAIRS)
    pairs = pairs.repartition(bits // chunk, "chunk").sortWithinPartitions("chunk").mapInArrow(_merged(chunk, False), _PAIRS)
    out, unpack = np.zeros(bits // 8, np.uint8), zstandard.ZstdDecompressor()
    for r in pairs.select("chunk", "twice").collect():  # bits / chunk rows
        out[r.chunk * chunk // 8: (r.chunk + 1) * chunk // 8] = np.frombuffer(unpack.decompress(bytes(r.twice)), np.uint8)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(twice, bits: int, least: int):
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of each document that the filter of keys seen twice has."""
        seen = Filter(8)
        seen.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(twice.value), np.uint8)
        for batch in _small(batches):
            rows, keys = [], []
            for row, text in zip(batch.column("_row_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = _keys(text, least)
                keys += found
                rows += [row] * len(found)
            if keys:
                which = np.flatnonzero(seen.has(_places(keys, bits))).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([_digest(keys[k]) for k in which], pa.binary()), pa.array([rows[k] for k in which], pa.int64())], ["digest", "row"])
    return suspects


def _dropped(least: int, keep_text: bool):
    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines whose key is marked go; of a key that this document has first its first line stays, if asked for."""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                total, gone, sums, texts = [], [], [], []
                for packed, marks in zip(part.column("packed").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    text = unpack.decompress(packed)
                    lines = text.split(b"\n")
                    kept = lines
                    if marks:
                        marked = {m["digest"]: m["stays"] for m in marks}
                        kept = []
                        for line in lines:
                            key = line_key(line)
                            said = marked.get(_digest(key)) if _long(key, least) else None
                            if said:
                                marked[_digest(key)] = False
                            if said is None or said:
                                kept.append(line)
                        text = b"\n".join(kept)
                    total.append(len(lines))
                    gone.append(len(lines) - len(kept))
                    sums.append(hashlib.sha256(text).hexdigest())
                    texts.append(text if keep_text else None)
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                                                 ["rest", "n_lines", "n_dropped", "kept_sha256", "kept_text"])
    return dropped


def drop_shared_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, keep_text: bool = False, bits: int = BITS) -> DataFrame:
    """The columns of ``docs`` but for text, and n_lines, n_dropped, kept_sha256, kept_text (null unless asked for).

    A key of at least ``least_chars`` code points that at least ``least_docs`` (two or more) documents have loses its lines:
    all of them, or with ``keep_first`` all but the first line of the document with the smallest id.
    """
    if least_docs < 2:
        raise ValueError("a line of one document is not shared")
    made = ("n_lines", "n_dropped", "kept_sha256", "kept_text")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", *made)))
    rows = row_keys(docs.select("doc_id", "text", rest.alias("rest")))
    full = twice_filter(rows, least_chars, bits)
    twice = docs.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(full.tobytes()))
    suspects = written(rows.select("_row_key", "text").mapInArrow(_suspects(twice, len(full) * 8, least_chars), "digest binary, row long"), "suspects")
    # a key is counted, and found again, in shares of its documents, so that a line of a third of them is in many tasks
    suspects = suspects.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SHARES)).cast("int"))
    counts = suspects.groupBy("digest", "share").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    shared = counts.groupBy(F.col("digest").alias("_of")).agg(F.sum("n").alias("_n"), F.min("first").alias("_first")).filter(F.col("_n") >= least_docs)
    shared = counts.join(shared, F.col("digest") == F.col("_of")).select("_of", F.col("share").alias("_share"), "_first")
    stays = (F.col("row") == F.col("_first")) if keep_first else F.lit(False)
    marks = suspects.join(shared, (F.col("digest") == F.col("_of")) & (F.col("share") == F.col("_share")))
    marks = marks.groupBy("row").agg(F.collect_list(F.struct("digest", stays.alias("stays"))).alias("marks"))
    kept = rows.select("rest").schema
    whole = rows.select("rest", "_row_key", "text").mapInArrow(packed_texts, T.StructType([*kept]).add("_row_key", "long").add("packed", "binary"))
    out = whole.join(marks, F.col("_row_key") == F.col("row"), "left").select("rest", "packed", "marks")
    results = T.StructType([*kept]).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string").add("kept_text", "string")
    out = out.mapInArrow(_dropped(least_chars, keep_text), results)
    return out.select("rest.*", *made)
