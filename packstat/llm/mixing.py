"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is owed the same fractional number of copies, target over size of the
source, at most two. Whole copies are given; the fractions are rounded by the pivotal method,
weighted by size: two documents trade words until the copies of one are whole, at random but with
the expected words of each kept, so the words of a pair never change. Each block of a source leaves
at most one fraction, and a small reserve it holds back; those of many blocks meet in the next level
of a reduction tree. At the root the last fraction and the reserve are rounded from the largest to
the smallest, at random as long as the smaller ones can still make up the difference, so a source
misses its target by no more than a small document.

Randomness comes from hashes of (doc_id, text, number among equal rows), so reruns agree, however the rows are dealt to tasks. Null and empty texts have size 0 and take
nothing. A null source is a source of its own, and comes last. Rows that repeat an id count
separately. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packstat.functions.ordered import number_rows
from packstat.llm.common import compressed, restored, word_count
from packstat.session import checkpoint, unfolded

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a block, and fractions that meet in a node of the tree.
BLOCK, FAN_IN = 4096, 64
#: Documents of all sizes that a node holds back for the root.
RESERVE = 32


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: weights repeat over the sources in order; targets stop at ``most`` sizes.

    What a target cannot take is shared again by weight: rounds over one row per source, of which
    only two totals come to the driver.
    """
    ordered = number_rows(sizes.withColumns({"_all": F.lit(0), "_none": F.col("source").isNull()}), ["_all"], ["_none", "source"], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = checkpoint(ordered.select("source", "source_size", weight.alias("_weight"), F.lit(False).alias("_full")))
    cap = F.col("source_size") * F.lit(most)
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    full = -1
    while True:
        got = rows.agg(F.sum(F.when(F.col("_full"), cap)), F.sum(F.when(~F.col("_full"), F.col("_weight"))), F.count_if("_full")).first()
        unit = max(0.0, total - (got[0] or 0.0)) / got[1] if got[1] else 0.0
        if got[2] == full or not got[1]:
            break
        full = got[2]
        rows = checkpoint(rows.withColumn("_full", F.col("_full") | (F.col("_weight") * F.lit(unit) >= cap)))
    return rows.select("source", "source_size", F.when(F.col("_full"), cap).otherwise(F.col("_weight") * F.lit(unit)).cast("double").alias("target"))


def _draw(*parts) -> float:
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest()) / 2.0**64


def _round(frame: pd.DataFrame, seed: int, root: bool) -> pd.DataFrame:
    """Pair fractions until at most one is left besides a reserve; the root closes all of them."""
    frame = frame.sort_values(["size", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    part, size = frame["part"].to_numpy(np.float64).copy(), frame["size"].to_numpy(np.float64)
    ids, given = frame["row"].to_numpy(), frame["copies"].to_numpy(np.int64).copy()
    part[size == 0] = 0.0
    open_ = np.flatnonzero(part > 0)
    back = set(open_[np.unique(np.linspace(0, len(open_) - 1, min(RESERVE, len(open_))).astype(int))].tolist()) if len(open_) else set()
    held = -1
    for i in open_.tolist():
        if i in back:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # words that can move from b to a, and from a to b
        up, down = min((1 - part[a]) * size[a], part[b] * size[b]), min(part[a] * size[a], (1 - part[b]) * size[b])
        words = up if _draw(seed, ids[a], ids[b]) * (up + down) < down else -down
        part[a] += words / size[a]
        part[b] -= words / size[b]
        held = -1
        for x in (a, b):
            if part[x] < 1e-9 or part[x] > 1 - 1e-9:
                given[x] += part[x] > 0.5
                part[x] = 0.0
            else:
                held = x
    if root:
        open_ = np.flatnonzero(part > 0)
        due, rest = float((part * size)[open_].sum()), float(size[open_].sum())
        least = float(size[open_].min(initial=np.inf))
        for i in open_.tolist():  # the largest first: what each leaves is made up by the smaller ones
            rest -= size[i]
            takes = due > rest or (due >= size[i] - least / 2 and _draw(seed, ids[i]) * (rest + size[i]) < due)
            given[i] += int(takes)
            due -= size[i] * takes
            part[i] = 0.0
    return frame.assign(part=part, copies=given)


def _rounding(seed: int, root: bool):
    def rounded(frame: pd.DataFrame) -> pd.DataFrame:
        return _round(frame, seed, root)
    return rounded


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, and the hash of the text."""
    # equal rows are told apart by a number, whichever of them has it, so nothing depends on how the rows are dealt
    equal = docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("_n"))
    each = equal.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    sized = checkpoint(each.select("doc_id", "source", "hash", "size", F.xxhash64("doc_id", "hash", "_k").alias("row")))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), weights, share, most)
    aims = checkpoint(aims)
    wide = aims.select(F.col("source").alias("_source"), "source_size", "target")
    owed = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = sized.join(wide, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_owed", owed)
    blocks = max(1, sized.count() // BLOCK + 1)
    rows = checkpoint(rows.select("doc_id", "row", "hash", "source", "size", "source_size", "target",
                                  F.floor("_owed").cast("long").alias("copies"), (F.col("_owed") - F.floor("_owed")).alias("part"),
                                  F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).alias("node")))
    schema, settled, level = rows.schema, [], 0
    key = ["source", "node"]
    while True:
        done = checkpoint(rows.groupBy(*key).applyInPandas(_rounding(seed + level, blocks == 1), schema))
        settled.append(done.filter("part = 0"))
        rows = done.filter("part > 0")
        if blocks == 1:
            break
        blocks = -(-blocks // FAN_IN)
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        level += 1
    out = settled.pop()
    for part in settled:
        out = out.unionByName(part)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "hash")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Copies are brought to the texts by (doc_id, source, hash of the text); equal rows share theirs.
    """
    given = mix(docs, **options).filter("taken > 0").groupBy("doc_id", "source", "hash").agg(F.sum("copies").alias("_copies"))
    key = lambda text: F.struct("doc_id", "source", text)
    given = given.select(key(F.col("hash").alias("text")).alias("_given"), "_copies")
    # one key, null parts included: the texts move once, compressed, for telling equal rows apart and for the join
    keyed = compressed(docs.withColumn("_key", key(F.xxhash64("text").alias("text")))).dropDuplicates(["_key"])
    taken = keyed.join(unfolded(given), F.col("_key") == F.col("_given"))
    return restored(taken.select(*docs.columns, "_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
