"""Exact removal of repeated spans by compaction of a De Bruijn graph of token k-mers.

Every window of ``WINDOW`` words is an edge. Consecutive windows of a document whose smallest inner
``MER``-word hash stands at the same place are one path (some seven windows on average), so what is shuffled is a
seventh of the windows. Paths meet under that hash, the node:

* a node with a single path that occurs once holds nothing repeated;
* a node with a single path that occurs several times is nonbranching: its windows are compacted to one
  edge, and all of it but the occurrence with the smallest coordinates (document, start) is repeated;
* a node where different paths meet branches: there, and only there, windows are compared one by one.

Two windows are the same if the hash of the node and the hash of the whole path or window agree, 128
bits over the words themselves; the coordinates of the first occurrence, found by a partial aggregate, tell which copy
stays. Windows are judged on the input. Hot passages are aggregated before they are shuffled, and joined
with the few rows that describe them, which Spark may split.

Null texts have no words. Documents are rows: rows that repeat an id, and rows without one, have coordinates of their own
(``row_keys``: by id, null ids last, then by text), so of two equal rows the second is removed. An empty table gives no rows; extra columns come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packstat.llm.common import packed_texts, prefix_sums, row_keys, stretch_hash, texts, word_hashes
from packstat.session import checkpoint, scratch_path

WINDOW, MER = 20, 6
_MADE = ("n_words", "n_removed", "kept_sha256", "kept_text")


def _nodes(data: np.ndarray, bounds: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, ...]:
    """Of all windows in a buffer of texts: first word, node, place of the node, text; also the sums for hashes, and each text's first word."""
    h, first, _, _ = word_hashes(data, bounds)
    sums = prefix_sums(h)
    n = len(h) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, sums, first
    at = np.arange(len(h) - mer + 1)
    least, place, width = stretch_hash(sums, at, at + mer), at.astype(np.int32), window - mer + 1

    def halved(shift: int) -> None:
        nonlocal least, place
        left = least[:-shift] <= least[shift:]  # of equal hashes the first
        least, place = np.where(left, least[:-shift], least[shift:]), np.where(left, place[:-shift], place[shift:])

    step = 1
    while 2 * step <= width:
        halved(step)
        step *= 2
    if step < width:
        halved(width - step)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    start = np.flatnonzero(owner[:n] == owner[window - 1:])
    return start, least[start], place[start], owner[start], sums, first


def _paths(window: int, mer: int):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, bounds in texts(batch.column("text")):
                start, node, place, owner, sums, first = _nodes(data, bounds, window, mer)
                if not len(start):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
                long = np.diff(np.append(cut, len(start)))
                a, doc = start[cut], owner[cut]
                path = stretch_hash(sums, a, a + long + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[cut].view(np.int64)), pa.array(path.view(np.int64)), pa.array(ids[i + doc].astype(np.int64)), pa.array((a - first[doc]).astype(np.int32)),
                     pa.array(long.astype(np.int32))], ["node", "path", "doc_id", "a", "n"])
    return paths


def _windows(window: int, mer: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of the branching paths of a document."""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                raw = [unpack.decompress(x) for x in part.column("packed").to_pylist()]
                start, node, _, owner, sums, first = _nodes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), window, mer)
                wanted = np.zeros(int(first[-1]) + 1, np.int32)
                spans = part.column("spans")
                offsets = spans.offsets.to_numpy()
                a = spans.values.field("a").to_numpy(zero_copy_only=False)
                n = spans.values.field("n").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(raw)), np.diff(offsets))
                a, n = a[offsets[0]: offsets[-1]], n[offsets[0]: offsets[-1]]
                b = np.minimum(first[doc] + a, len(wanted) - 1)
                np.add.at(wanted, b, 1)
                np.add.at(wanted, np.minimum(b + n, len(wanted) - 1), -1)
                chosen = np.cumsum(wanted)[start] > 0
                start, node, owner = start[chosen], node[chosen], owner[chosen]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(stretch_hash(sums, start, start + window).view(np.int64)), pa.array(ids[owner].astype(np.int64)),
                     pa.array((start - first[owner]).astype(np.int32))], ["node", "edge", "doc_id", "a"])
    return windows


def _removed(window: int, keep_text: bool):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                total, gone, sums, kept = [], [], [], []
                for packed, paths, edges in zip(part.column("packed").to_pylist(), part.column("paths").to_pylist(), part.column("edges").to_pylist(), strict=True):
                    raw = unpack.decompress(packed)
                    words = raw.split()
                    n = len(words)
                    cover = np.zeros(n + 1, np.int64)
                    for a, long in [(s["a"], s["n"]) for s in paths or []] + [(a, 1) for a in edges or []]:
                        cover[min(a, n)] += 1
                        cover[min(a + long + window - 1, n)] -= 1
                    stay = np.cumsum(cover[:n]) == 0
                    left = n if stay.all() else int(stay.sum())
                    text = b" ".join(words if left == n else [words[k] for k in np.flatnonzero(stay)])
                    total.append(n)
                    gone.append(n - left)
                    sums.append(hashlib.sha256(text).hexdigest())
                    # a document of which nothing goes keeps its text as it is
                    kept.append((raw if left == n else text) if keep_text else None)
                names = [c for c in part.schema.names if c not in ("packed", "paths", "edges")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_sha256", "kept_text"])
    return removed


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but for text, and n_words, n_removed, kept_sha256, kept_text (null unless asked for)."""
    spark, every = docs.sparkSession, [c for c in docs.columns if c not in ("text", *_MADE)]
    keyed = row_keys(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in every)).alias("rest")))
    rows = keyed.select(F.col("_row_key").alias("doc_id"), "text")
    paths = rows.mapInArrow(_paths(window, mer), "node long, path long, doc_id long, a int, n int")
    nodes = (paths.groupBy("node").agg(F.min("path").alias("_low"), F.max("path").alias("_high"), F.count("*").alias("_n"), F.min(F.struct("doc_id", "a")).alias("_first"))
             .filter("_n > 1").select(F.col("node").alias("_node"), (F.col("_low") != F.col("_high")).alias("branch"), "_first"))
    nodes = checkpoint(nodes)
    met = paths.select("node", "doc_id", "a", "n").join(nodes, F.col("node") == F.col("_node"))
    met = met.filter(F.col("branch") | (F.struct("doc_id", "a") != F.col("_first")))
    spans = met.groupBy("doc_id").agg(F.collect_list(F.struct("a", "n", "branch")).alias("spans"))
    spans = checkpoint(spans.select(F.col("doc_id").alias("_doc"), F.filter("spans", lambda s: ~s["branch"]).alias("paths"), F.filter("spans", lambda s: s["branch"]).alias("spans")))

    packed = rows.mapInArrow(packed_texts, "doc_id long, packed binary")
    branching = spans.filter(F.size("spans") > 0).select("_doc", "spans")
    windows = packed.join(branching, F.col("doc_id") == F.col("_doc")).select("doc_id", "packed", "spans").mapInArrow(_windows(window, mer), "node long, edge long, doc_id long, a int")
    place = scratch_path(spark, "edges")
    windows.write.parquet(place)
    windows = spark.read.schema("node long, edge long, doc_id long, a int").parquet(place)
    edges = windows.groupBy("node", "edge").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "a")).alias("_first")).filter("_n > 1")
    edges = checkpoint(edges.select(F.col("node").alias("_node"), F.col("edge").alias("_edge"), "_first"))
    again = windows.join(edges, (F.col("node") == F.col("_node")) & (F.col("edge") == F.col("_edge"))).filter(F.struct("doc_id", "a") != F.col("_first"))
    again = again.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("a").alias("edges"))

    kept = keyed.select("_row_key", "rest").schema
    whole = keyed.select("_row_key", "rest", "text").mapInArrow(packed_texts, T.StructType([*kept]).add("packed", "binary"))
    joined = whole.join(spans.select("_doc", "paths"), F.col("_row_key") == F.col("_doc"), "left").join(again, F.col("_row_key") == F.col("_id"), "left").drop("_doc", "_id")
    results = T.StructType([*kept]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    return joined.mapInArrow(_removed(window, keep_text), results).select("rest.*", *_MADE)
