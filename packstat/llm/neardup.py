"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document is its set of word shingles. Its signature has ``VALUES`` minima of ``BITS`` bits, split into
``CHUNKS`` chunks. Two signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)`` values agree on some
chunk but for at most ``ERRORS`` value (pigeonhole), so each chunk is listed once for every value that is
left out, and all such pairs meet under a key. At a similarity of 0.85 a pair misses with probability 2e-8.

Documents with equal sets are one class from the start. The classes that share a key form groups around
the smallest id, and every link of a group is confirmed on whole sets. Groups are cut into chunks
of bounded size that all hold the centre c. What is left are pairs in different chunks, not both linked to c.
For these, sets are written as their difference from c: |x ^ y| = |(x ^ c) ^ (y ^ c)|. Linked pairs
whose differences share nothing are both linked to c; the others share one of the first elements of
their differences (a prefix filter, extra elements before missing ones), which gives groups of their own,
again bounded, until no large group has an unlinked member. So no link is lost and no group is
gathered or paired whole. Components come from alternating stars over the links.

Rows are linked by a key of their own (``row_keys``), so rows that repeat an id and rows without one are documents like
others; of a group one row is kept, that with the smallest id. Null and empty texts have no set and are linked with
nothing. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.llm.common import compressed, mix, prefix_sums, row_keys, stretch_hash, texts, word_hashes
from packstat.session import checkpoint, spent, unfolded

CHUNKS, WIDTH, BITS, ERRORS = 10, 5, 16, 1
VALUES = CHUNKS * WIDTH
#: Members and set elements of a chunk of a group.
ROWS, ELEMENTS = 128, 500_000
#: Members of a chunk once sets are differences from a centre, which are short.
LATER_ROWS = 2000

_RNG = np.random.default_rng(6)
_A = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    h, first, _, _ = word_hashes(data, bounds, lower=True)
    sums = prefix_sums(h)
    at = np.arange(max(0, len(h) - words + 1))
    every = stretch_hash(sums, at, at + words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(every[a: b - words + 1]))
        elif b > a:
            out.append(stretch_hash(sums, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``VALUES`` b-bit minima for each set; none may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint64)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(every * _A[k] + _B[k], starts)
    return (out >> np.uint64(8)) & np.uint64(2**BITS - 1)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk without one of its values."""
    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            key = np.full(len(signature), c * WIDTH + out + 1, np.uint64)
            for j in range(WIDTH):
                if j != out:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, c * WIDTH + j])
            keys.append(key)
    return np.stack(keys, axis=1)


def _sketch(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in texts(batch.column("text")):
                sets = shingle_sets(data, bounds, words)
                full = [s for s in sets if len(s)]
                keys = iter(chunk_keys(signatures(full)).view(np.int64).tolist() if full else [])
                a = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                b = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "a", "b", "keys"])
    return sketch


def _local(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest place each set is connected to, by links inside the chunk."""
    m = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 1 << 14):
        a, b = np.searchsorted(column, [start, start + (1 << 14)])
        part = np.zeros((m, int(column[b - 1]) - start + 1), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        both += part @ part.T
    length = np.array([len(s) for s in sets])
    apart = length[:, None] + length[None, :] - 2 * both
    linked = (100 + percent) * apart <= (100 - percent) * (sizes[:, None] + sizes[None, :])
    label = np.arange(m)
    while True:
        new = np.where(linked, label[None, :], m).min(axis=1)
        new = np.minimum(label, new)
        if (new == label).all():
            return label
        label = new


_SOLVED = "g long, x long, root long, large boolean, linked boolean, n long, nc long, diff binary"


def _solve(words: int, percent: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Rows of one (group, salt) after the other; they come sorted, the centre first."""
        held: list[dict] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in batch.slice(i, 256).to_pylist():
                    if held and (row["g"], row["salt"]) != (held[0]["g"], held[0]["salt"]):
                        yield held
                        held = []
                    if not held or all(row["x"] != x["x"] for x in held[-1:] + held[:1]):
                        held.append(row)
        if held:
            yield held

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        unpack = zstandard.ZstdDecompressor()
        for rows in chunks(batches):
            if "text" in rows[0]:
                raw = [unpack.decompress(r["text"]) for r in rows]
                sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), words)
            else:
                sets = [np.sort(np.frombuffer(r["diff"], np.uint64)) for r in rows]
            sizes = np.array([r["n"] for r in rows], np.int64)
            label = _local(sets, sizes, percent)
            ids = np.array([r["x"] for r in rows], np.int64)
            root = np.array([ids[label == k].min() if (label == k).any() else 0 for k in range(len(rows))])
            for k, r in enumerate(rows):
                diff = None
                if r["large"]:  # against the centre: extra elements, then missing ones
                    extra, missing = np.setdiff1d(sets[k], sets[0], True), np.setdiff1d(sets[0], sets[k], True)
                    diff = np.concatenate([extra, missing]).tobytes()
                if r["large"] or ids[k] != root[label[k]]:
                    out.append((r["g"], int(ids[k]), int(root[label[k]]), r["large"], bool(label[k] == label[0]), int(sizes[k]), int(sizes[0]), diff))
            if len(out) >= 1024:
                yield _batch(out)
                out = []
        yield _batch(out)

    return solve


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _SOLVED.split(", ")])


def _salted(members: DataFrame, rows_: int) -> DataFrame:
    """Members (g, c, x, n) with the chunk each belongs to; the centre belongs to all of its group."""
    size = members.groupBy("g").agg(F.count("*").alias("_rows"), F.sum("n").alias("_elements"))
    size = checkpoint(size.select(F.col("g").alias("_g"), F.greatest(F.ceil(F.col("_rows") / rows_), F.ceil(F.col("_elements") / ELEMENTS)).cast("int").alias("salts")))
    rows = members.join(size, F.col("g") == F.col("_g")).drop("_g").withColumn("large", F.col("salts") > 1).withColumn("centre", F.col("x") == F.col("c"))
    salt: Column = F.when(F.col("centre"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("x", "g"), F.col("salts")).cast("int")))
    return rows.withColumn("salt", F.explode(salt)).select("g", "salt", "centre", "x", "n", "large")


def _solved(rows: DataFrame, words: int, percent: int) -> DataFrame:
    ordered = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", F.desc("centre"), "x")
    return checkpoint(ordered.mapInArrow(_solve(words, percent), _SOLVED))


def _prefixes(large: DataFrame, percent: int) -> DataFrame:
    """(g, x, linked, index, key): the elements of each difference by which linked partners must meet.

    With d elements in a difference and at most h = ``most`` apart from a partner, a pair has to share
    (d_x + d_y - h) / 2 elements, so it meets among the first d - shared + 1 of each. Of two that
    are not linked to the centre, the one with fewer elements shares d - h / 2, the other d - h. One that is linked to the centre
    needs a partner that is not, whose difference is longer than their distance by no less than the sizes tell.
    Every pair has a member that meets by its shorter list, the index.
    """
    d = F.octet_length("diff") / 8
    most = F.floor((100 - percent) * (F.col("n") + F.floor(F.col("n") * 100 / percent)) / (100 + percent))
    shared = F.greatest(F.lit(1), F.ceil((d + (100 - percent) * (F.col("nc") - F.col("n")) / (100 + percent)) / 2))
    index = F.when(F.col("linked"), d - shared + 1).otherwise(F.least(d, F.floor(most / 2) + 1))
    probe = F.when(F.col("linked"), index).otherwise(F.least(d, most + 1))
    rows = large.select("g", "x", "linked", "diff", index.cast("int").alias("_index"), probe.cast("int").alias("_probe")).filter("_probe > 0")
    element = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_probe") - 1), lambda i: F.substring(F.col("diff"), i * 8 + 1, F.lit(8))))
    return rows.select("g", "x", "linked", "_index", element.alias("_i", "_e")).select("g", "x", "linked", (F.col("_i") < F.col("_index")).alias("index"), F.xxhash64("g", "_e").alias("key"))


def links(sketches: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): links that connect the classes, given one sketch (doc_id, n, keys) for each class."""
    listed = sketches.select(F.col("doc_id").alias("x"), "n", F.explode("keys").alias("key"))
    met = listed.groupBy("key").agg(F.min("x").alias("g"), F.count("*").alias("_n")).filter("_n > 1")
    met = checkpoint(met.select(F.col("key").alias("_key"), "g"))
    members = checkpoint(listed.join(met, F.col("key") == F.col("_key")).select("g", "x", "n").distinct())
    for _ in range(2):  # a group goes as a whole to the smallest group that its first member is in
        up = checkpoint(members.groupBy(F.col("x").alias("_x")).agg(F.min("g").alias("_up")))
        members = checkpoint(members.join(up, F.col("g") == F.col("_x")).select(F.col("_up").alias("g"), "x", "n").distinct())
    centre = checkpoint(members.groupBy(F.col("g").alias("_of")).agg(F.min("x").alias("c")))
    chunks = checkpoint(_salted(checkpoint(members.join(centre, F.col("g") == F.col("_of")).drop("_of")), ROWS))
    # whole texts move compressed; chunks unfold, so they are merged with
    texts_ = compressed(docs.select(F.col("doc_id").alias("_x"), "text"))
    solved = _solved(texts_.join(unfolded(chunks), F.col("_x") == F.col("x")).drop("_x"), words, percent)
    spent(met, members, up, centre, chunks)
    found = solved.filter("x <> root").select(F.col("x").alias("u"), F.col("root").alias("v"))
    while True:
        large = solved.filter("large")
        open_ = large.groupBy("g").agg(F.bool_or(~F.col("linked")).alias("_open")).filter("_open").select(F.col("g").alias("_g"))
        large = checkpoint(large.join(open_, F.col("g") == F.col("_g")).select("g", "x", "n", "nc", "linked", "diff").dropDuplicates(["g", "x"]))
        if large.isEmpty():
            return found
        listed = checkpoint(_prefixes(large, percent))
        met = listed.groupBy("key").agg(F.count("*").alias("_n"), F.bool_or(~F.col("linked")).alias("_open"), F.bool_or("index").alias("_index"), F.min("g").alias("_of"),
                                        F.min("x").alias("_least"), F.sum(F.shiftright(F.xxhash64("x"), 20)).alias("_sum")).filter("_n > 1 AND _open AND _index")
        # buckets with the same members are one
        met = checkpoint(met.groupBy("_of", "_n", "_least", "_sum").agg(F.min("key").alias("_key")))
        member = listed.join(met.select("_key"), F.col("key") == F.col("_key")).select("g", "key", "x").distinct()
        sets = large.select(F.col("g").alias("_g"), F.col("x").alias("_x"), "n", "diff")
        member = member.join(sets, (F.col("g") == F.col("_g")) & (F.col("x") == F.col("_x"))).select(F.col("key").alias("g"), "x", "n", "diff")
        member = checkpoint(member)
        # the member next to the old centre is the new one
        centre = member.groupBy("g").agg(F.min(F.struct(F.octet_length("diff").alias("d"), "x")).alias("_c"))
        centre = checkpoint(centre.select(F.col("g").alias("_g"), F.col("_c.x").alias("c")))
        placed = member.select("g", "x", "n").join(centre, F.col("g") == F.col("_g")).select("g", "c", "x", "n")
        chunks = checkpoint(_salted(checkpoint(placed), LATER_ROWS))
        sets = member.select(F.col("g").alias("_g"), F.col("x").alias("_x"), "diff")
        solved = _solved(chunks.join(sets, (F.col("g") == F.col("_g")) & (F.col("x") == F.col("_x"))).drop("_g", "_x"), words, percent)
        spent(large, listed, met, member, centre, chunks)
        found = found.unionByName(solved.filter("x <> root").select(F.col("x").alias("u"), F.col("root").alias("v")))


def components(pairs: DataFrame) -> DataFrame:
    """(u, v): for every node that is not the smallest of its component, the smallest; by alternating stars."""
    edges = checkpoint(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if tuple(state) == before:
            return edges
        before, old = tuple(state), edges
        both = checkpoint(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = checkpoint(both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("_u", "m").alias("m")))
        wide = checkpoint(both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = checkpoint(wide.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")))
        near = wide.join(lower, F.col("u") == F.col("_u")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(near.select("e.u", "e.v").filter("u <> v").distinct())
        spent(old, both, least, wide, lower)


def grouped(rows: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, text) whose ids are long, not null and each there once."""
    rows = rows.select("doc_id", "text")
    sketched = checkpoint(rows.mapInArrow(_sketch(words), "doc_id long, n long, a long, b long, keys array<long>"))
    some = sketched.filter("n > 0")
    classes = checkpoint(some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"), "rep"))
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") == F.col("_n"))
    members = checkpoint(some.join(classes, same).select("doc_id", "n", "rep"))
    reps = classes.select(F.col("rep").alias("_rep"), F.col("_a").alias("_ra"))
    first = checkpoint(some.join(reps, (F.col("doc_id") == F.col("_rep")) & (F.col("a") == F.col("_ra"))).select("doc_id", "n", "keys"))
    label = components(links(first, rows, words, percent)).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    linked = members.join(label, F.col("rep") == F.col("_u"), "left").select("doc_id", "n", F.coalesce("_v", "rep").alias("component_id"))
    alone = checkpoint(sketched.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    spent(sketched, first)
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: linked if 100 * intersection >= percent * union of the shingle sets."""
    rows = row_keys(docs.select("doc_id", "text"))
    found = grouped(rows.select(F.col("_row_key").alias("doc_id"), "text"), words, percent).withColumnsRenamed({"doc_id": "_of", "component_id": "_least"})
    ids = rows.select("_row_key", F.col("doc_id").cast("long").alias("_id"))
    if ids.filter("_id IS NULL OR _id <> _row_key").isEmpty():
        return found.select(F.col("_of").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"), "kept")
    found = found.join(ids, F.col("_of") == F.col("_row_key")).drop("_row_key").withColumnRenamed("_id", "doc_id")
    return found.join(ids, F.col("_least") == F.col("_row_key")).select("doc_id", "n_shingles", F.col("_id").alias("component_id"), "kept")
