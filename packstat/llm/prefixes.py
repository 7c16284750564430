"""The prefix trie of conversations, from padded matrices of turn ids.

A turn is identified by 128 bits of a SHA-256 of its role and text. A conversation is the row of its turns' ids, and rows
are dealt in ranges of their order, so what shares a prefix lies side by side. A range (``shard``) is sorted with numpy as padded
matrices of a few columns; masks of the columns in which a row differs from the row before, accumulated with OR, mark where
a node of each depth starts, and reduceat adds up each depth.

A node may go on in the next range only if it holds a range's first or last row. Such open nodes leave a range as at most two
rows, the first and the last path, with a partial result for every depth; these are merged by the same function,
``FAN_IN`` ranges at a time, until one block is left. Ids of conversations that end at an open node are hashed as a stream
of the ranges' lists. SHA-256 is sequential, so the ids of one node go through one task, some bytes an id, but never at once.

Turns of a conversation are ordered by turn, null first, then by their id. Null role or text is empty. Rows without a conv_id belong to no conversation
and are left out. Repeated rows are turns of their own. An empty table has no nodes, not even a root; extra columns are ignored.
A conversation's ids (20 bytes a turn, no texts) must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.llm.common import word_count, written
from packstat.session import checkpoint

#: Columns of a padded matrix; turns of a range; ranges that are merged at a time; conversations that share their first turns.
COLUMNS, SHARD_TURNS, FAN_IN, FAMILY = 16, 50_000, 32, 20
ID_BYTES = 16

#: kind: a finished node (0), the first or last path of a range (1), ids that end at an open node (2).
_ROWS = ("kind int, shard long, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, path binary, words binary, parts binary, ends string")
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_TYPES = [_KINDS[f.split()[1]] for f in _ROWS.split(", ")]
_NOTHING = hashlib.sha256(b"").hexdigest()
_LAST = np.iinfo(np.int64).max
#: Partial results of a node: members, smallest member, children, leaves and saved tokens of finished nodes below.
_PARTS = 5
#: Shares in which nodes look up an unfinished parent.
_SHARES = 32


def turn_id(role: Column, text: Column) -> Column:
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, ID_BYTES)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (ids of its turns), words (of each turn): the first h turns of the family's first conversation, then its own after h."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").filter("conv_id IS NOT NULL")
    turns = turns.select(base, "conv_id", F.struct("turn", turn_id(role, text).alias("id"), word_count(text).cast("int").alias("words")).alias("t")).repartition("base")
    own = turns.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = own.filter("conv_id = base").select(F.col("base").alias("_base"), F.slice("own", 1, 3).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    both = own.join(head, F.col("base") == F.col("_base"), "left").withColumn("h", h)
    both = both.withColumn("t", F.concat(F.slice(F.coalesce("head", F.array().cast(own.schema["own"].dataType)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))))
    return both.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def _padded(raw: np.ndarray, first: np.ndarray, length: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """Ids of ``rows`` in the columns from ``at``; one that is there has a 1 before it, so shorter rows are smaller."""
    wide = min(COLUMNS, int(length[rows].max()) - at)
    out = np.zeros((len(rows), wide, 3), np.uint64)
    for c in range(wide):
        there = length[rows] > at + c
        out[there, c, 0] = 1
        out[there, c, 1:] = raw[first[rows[there]] + at + c]
    return out


def sorted_paths(raw: np.ndarray, first: np.ndarray, length: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by path, then conversation, and the depth each shares with the row before it in that order."""
    n, most = len(length), int(length.max(initial=0))
    order, group = np.argsort(conv, kind="stable"), np.zeros(n, np.int64)
    for at in range(0, most, COLUMNS):
        deep = length[order] > at
        placed = np.lexsort((deep, group))
        order, group, deep = order[placed], group[placed], deep[placed]
        matrix = _padded(raw, first, length, order[deep], at).reshape(int(deep.sum()), -1)
        within = np.lexsort((*matrix.T[::-1], group[deep]))
        order[deep] = order[deep][within]
        new = np.zeros(n, bool)
        new[1:] = (np.diff(group) != 0) | (deep[1:] != deep[:-1])
        new[np.flatnonzero(deep)[1:]] |= (matrix[within][1:] != matrix[within][:-1]).any(axis=1)
        group = np.cumsum(new)
    shared = np.zeros(n, np.int64)
    pairs = np.arange(1, n)
    for at in range(0, most, COLUMNS):
        pairs = pairs[np.minimum(length[order[pairs]], length[order[pairs - 1]]) > at]
        if not len(pairs):
            break
        both = np.union1d(pairs, pairs - 1)
        matrix = _padded(raw, first, length, order[both], at)
        place = np.searchsorted(both, pairs)
        change = (matrix[place] != matrix[place - 1]).any(axis=2) | (matrix[place, :, 0] == 0)
        np.logical_or.accumulate(change, axis=1, out=change)
        same = (~change).sum(axis=1)
        shared[pairs] += same
        pairs = pairs[same == change.shape[1]]
    return order, shared


def _prefix_ids(path: bytes) -> list[bytes]:
    """Ids of the nodes on a path, the root first."""
    h, out = hashlib.blake2b(digest_size=ID_BYTES), []
    out.append(h.digest())
    for at in range(0, len(path), ID_BYTES):
        h.update(path[at: at + ID_BYTES])
        out.append(h.digest())
    return out


def block_nodes(shard: int, path: list[bytes], words: list[np.ndarray], conv: np.ndarray, parts: list[np.ndarray] | None, final: bool) -> Iterator[tuple]:
    """Rows of ``_ROWS`` for a block of paths; ``parts``: those of each depth of each path, none if the paths are conversations."""
    n = len(path)
    if not n:
        return
    length = np.array([len(p) // ID_BYTES for p in path], np.int64)
    raw = np.frombuffer(b"".join(path), ">u8").astype(np.uint64).reshape(-1, 2)
    order, shared = sorted_paths(raw, np.cumsum(length) - length, length, conv)
    length, conv, path = length[order], conv[order], [path[k] for k in order]
    word, at_word = np.concatenate([words[k] for k in order]).astype(np.int64), np.cumsum(length) - length
    part = None if parts is None else np.concatenate([parts[k] for k in order])
    at_part = np.cumsum(length + 1) - length - 1
    first_ids, last_ids = _prefix_ids(path[0]), _prefix_ids(path[-1])

    # going down: the rows of each depth, where its nodes start, what the rows bring
    levels = []
    for d in range(int(length.max()) + 1):
        rows = np.flatnonzero(length >= d)
        new = shared[rows] < d
        new[0] = True
        starts = np.flatnonzero(new)
        own = np.empty((len(starts), _PARTS), np.int64)
        if part is None:
            own[:, 0], own[:, 1], own[:, 2:] = np.diff(np.append(starts, len(rows))), np.minimum.reduceat(conv[rows], starts), 0
        else:
            mine = part[at_part[rows] + d]
            own[:] = np.add.reduceat(mine, starts, axis=0)
            own[:, 1] = np.minimum.reduceat(mine[:, 1], starts)
        open_ = np.zeros(len(starts), bool)
        if not final:
            open_[0] |= rows[0] == 0
            open_[-1] |= rows[-1] == n - 1
        levels.append((rows, rows[starts], np.cumsum(new) - 1, own, open_, word[at_word[rows[starts]] + d - 1] if d else np.zeros(1, np.int64)))

    # going up: finished children are added to their parents
    for d in range(len(levels) - 1, -1, -1):
        _, _, _, own, open_, said = levels[d]
        done = ~open_
        own[done, 3] += own[done, 2] == 0
        own[done, 4] += (own[done, 0] - 1) * said[done]
        if d:
            rows, _, node, above, _, _ = levels[d - 1]
            parent = node[np.searchsorted(rows, levels[d][1][done])]
            np.add.at(above, (parent, 2), 1)
            np.add.at(above, (parent, 3), own[done, 3])
            np.add.at(above, (parent, 4), own[done, 4])

    ends = {}  # of the conversations: (depth, node) to the row they start at and the list of ids
    if part is None:
        same = np.concatenate([[False], (shared[1:] == length[1:]) & (length[1:] == length[:-1])])
        starts = np.flatnonzero(~same)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            rows, _, node = levels[length[a]][:3]
            ends[int(length[a]), int(node[np.searchsorted(rows, a)])] = (a, ",".join(map(str, conv[a:b].tolist())))

    known = {}
    for d, (rows, starts, node, own, open_, _) in enumerate(levels):
        parents = levels[d - 1][2][np.searchsorted(levels[d - 1][0], starts)] if d else np.zeros(1, np.int64)
        for k in range(len(starts)):
            end = ends.get((d, k))
            if open_[k]:
                if end:
                    yield 2, shard, _prefix_ids(path[end[0]])[d], None, int(conv[end[0]]), d, None, None, None, None, None, None, None, None, None, end[1]
                continue
            above = int(parents[k])
            waits = d > 0 and bool(levels[d - 1][4][above])
            # an unfinished parent holds the first or the last row
            parent = (first_ids if levels[d - 1][1][above] == 0 else last_ids)[d - 1] if waits else None
            if part is not None and int(starts[k]) not in known:
                known[int(starts[k])] = _prefix_ids(path[starts[k]])
            yield (0, shard, None if part is None else known[int(starts[k])][d], parent, int(own[k, 1]), d, None if waits or not d else int(levels[d - 1][3][above, 1]),
                   *(int(x) for x in own[k, [0, 2, 3, 4]]), None if part is not None else hashlib.sha256(end[1].encode()).hexdigest() if end else _NOTHING, None, None, None, None)

    if not final:
        for row in (0, n - 1)[: 1 if path[0] == path[-1] else 2]:
            mine = np.zeros((int(length[row]) + 1, _PARTS), np.int64)
            mine[:, 1] = _LAST
            for d in range(len(mine)):
                rows, starts, node, own = levels[d][:4]
                k = int(node[np.searchsorted(rows, row)])
                if row == 0 or starts[k] > 0:  # a node that holds both goes with the first
                    mine[d] = own[k]
            yield (1, shard, *[None] * 10, path[row], word[at_word[row]: at_word[row] + length[row]].tobytes(), mine.tobytes(), None)


def _rows(found: Iterator[tuple], per_batch: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == per_batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All conversations of a range; the number of ranges grows with the table, so a range does not."""
    path, words, conv = [], [], []
    for batch in batches:
        conv.append(batch.column("conv_id").to_numpy(zero_copy_only=False))
        for ids, said in zip(batch.column("ids").to_pylist(), batch.column("words").to_pylist(), strict=True):
            path.append(b"".join(ids))
            words.append(np.array(said, np.int64))
    yield from _rows(block_nodes(TaskContext.get().partitionId(), path, words, np.concatenate(conv) if conv else np.zeros(0, np.int64), None, False))


def _merge(final: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        path = table.column("path").to_pylist()
        words, parts = ([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()] for c in ("words", "parts"))
        found = block_nodes(key[0].as_py(), path, words, np.zeros(len(path), np.int64), [x.reshape(-1, _PARTS) for x in parts], final)
        batches = list(_rows(found))
        return pa.Table.from_batches(batches) if batches else pa.Table.from_arrays([pa.array([], k) for k in _TYPES], _NAMES)
    return merge


def _stream_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of all ids of a node; lists come sorted by node and first id."""
    at, h = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], ["of", "sha"])

    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    yield row()
                at, h = node, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
    if at is not None:
        yield row()


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, least_shards: int | None = None) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    paths = rebuilt(conversations)
    shards = max(conversations.count() // shard_turns + 1, least_shards or spark.sparkContext.defaultParallelism)
    rows = written(paths.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_range_nodes, _ROWS), "prefixes")
    left, blocks, upper = rows.filter("kind = 1"), (rows.filter("kind = 1").agg(F.max("shard")).first()[0] or 0) + 1, []
    while True:
        blocks = -(-blocks // FAN_IN)
        merged = checkpoint(left.select(F.floor(F.col("shard") / FAN_IN).alias("block"), "path", "words", "parts").groupBy("block").applyInArrow(_merge(blocks == 1), _ROWS))
        upper.append(merged.filter("kind = 0"))
        left = merged.filter("kind = 1")
        if blocks == 1:
            break
    above = upper[0]
    for more in upper[1:]:
        above = above.unionByName(more)
    above = checkpoint(above)
    ids = rows.filter("kind = 2").select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_stream_sha, "of binary, sha string")
    hashed = above.join(ids, F.col("node") == F.col("of"), "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NOTHING)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent"]
    nodes = rows.filter("kind = 0").select(columns).unionByName(hashed.select(columns))
    # most nodes may have the same unfinished parent, the root: it is looked up in shares
    found = above.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv"), F.explode(F.array(*(F.lit(k) for k in range(_SHARES)))).alias("_share"))
    waits = nodes.filter("parent IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(_SHARES)).cast("int"))
    waits = waits.join(found, (F.col("parent") == F.col("_node")) & (F.col("share") == F.col("_share"))).withColumn("parent_conv_id", F.col("_conv"))
    return nodes.filter("parent IS NULL").select(columns[:-1]).unionByName(waits.select(columns[:-1]))
