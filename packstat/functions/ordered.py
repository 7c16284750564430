"""Order-dependent work without one task per key.

A window over ``partitionBy(run)`` puts a whole run into one task. Here rows are numbered
by a range-partitioned sort, and every later window runs over ``(key, block)`` where a
block is a bounded stretch of consecutive numbers; neighbours across a block edge come from
copied halo rows, running totals from the totals of the earlier blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstat.session import checkpoint, unfolded

BLOCK = 1 << 17


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "step",
                start: int = 0) -> DataFrame:
    """Consecutive numbers per key in the given (total) order.

    Sorted ranges cut through hot keys. The sorted rows are checkpointed because the sampled
    range bounds must be the same for the counts and for the rows.
    """
    keys, order = list(keys), list(order)
    ranges = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranges = checkpoint(ranges)
    counts = ranges.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (key, range): at most keys + ranges rows in all
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (ranges.withColumn("_row", F.row_number().over(within).cast("long"))
            .join(unfolded(offsets), [*keys, "_range"])
            .withColumn(name, F.col("_before") + F.col("_row") - 1 + start)
            .drop("_range", "_row", "_before"))


def with_blocks(df: DataFrame, step: str = "step", block: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(step) / block).cast("long"))


def with_halo(df: DataFrame, step: str, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Blocks plus copies of the rows a frame of the neighbouring block reaches.

    ``_core`` is true on the one row of each step that belongs to its block; compute the
    window over ``keys + _block`` and keep the core rows.
    """
    block = max(block, before, after, 1)
    at = F.col(step) % block
    own = F.floor(F.col(step) / block).cast("long")
    homes = F.array_compact(F.array(
        own,
        F.when(at >= block - before, own + 1) if before else F.lit(None).cast("long"),
        F.when(at < after, own - 1) if after else F.lit(None).cast("long"),
    ))
    return (df.withColumn("_own", own).withColumn("_block", F.explode(homes))
            .withColumn("_core", F.col("_own") == F.col("_block")).drop("_own"))


def over_halo(df: DataFrame, keys: Sequence[str], step: str, values: dict[str, "callable"],
              before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Add window columns whose frames reach ``before``/``after`` consecutive rows.

    ``values`` maps a name to a function of the ordered window giving the column.
    """
    halo = with_halo(df, step, before, after, block)
    window = Window.partitionBy(*keys, "_block").orderBy(step)
    for name, make in values.items():
        halo = halo.withColumn(name, make(window))
    return halo.where("_core").drop("_core", "_block")


def _earlier(totals: DataFrame, keys: list[str], names: Sequence[str], merge, block: int, levels: int) -> DataFrame:
    """``_o_<name>``: what ``merge`` makes of ``_t_<name>`` in all earlier blocks of the key, null in the first.

    ``levels`` times, blocks are put together ``block`` at a time, so that no window is longer than ``block`` rows.
    """
    own = [f"_t_{n}" for n in names]
    if levels == 0:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, "_block", *[merge(F.col(t)).over(before).alias(f"_o_{n}") for t, n in zip(own, names)])
    inner = totals.withColumn("_up", F.floor(F.col("_block") / block).cast("long"))
    upper = inner.groupBy(*keys, F.col("_up").alias("_block")).agg(*[merge(F.col(t)).alias(t) for t in own])
    upper = _earlier(upper, keys, names, merge, block, levels - 1).withColumnRenamed("_block", "_up").withColumnsRenamed(
        {f"_o_{n}": f"_u_{n}" for n in names})
    before = Window.partitionBy(*keys, "_up").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    both = inner.withColumns({f"_i_{n}": merge(F.col(t)).over(before) for t, n in zip(own, names)}).join(upper, [*keys, "_up"])
    joined = (lambda a, b: F.greatest(a, b)) if merge is F.max else (lambda a, b: F.coalesce(a + b, a, b))
    return both.select(*keys, "_block", *[joined(F.col(f"_u_{n}"), F.col(f"_i_{n}")).alias(f"_o_{n}") for n in names])


def _levels(sparse: bool, block: int) -> int:
    """Levels after which a key has at most ``block`` totals: none for consecutive steps, for any 64-bit ids as many as these need."""
    return max(0, math.ceil(64 / math.log2(block)) - 2) if sparse else 0


def running(df: DataFrame, keys: Sequence[str], step: str, sums: dict[str, Column],
            block: int = BLOCK, sparse: bool = False) -> DataFrame:
    """Inclusive running totals per key: totals of earlier blocks plus the total inside.

    Blocks are stretches of numbers. Where these are not consecutive (ids, hashes), a key may have a block per row:
    ``sparse`` adds the totals up in levels.
    """
    keys = list(keys)
    blocks = with_blocks(df, step, block)
    totals = blocks.groupBy(*keys, "_block").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    offsets = _earlier(totals, keys, list(sums), F.sum, block, _levels(sparse, block))
    inside = (Window.partitionBy(*keys, "_block").orderBy(step)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the window needs the rows dealt by key and block in any case
    out = blocks.join(unfolded(offsets), [*keys, "_block"])
    for name, e in sums.items():
        out = out.withColumn(name, F.coalesce(f"_o_{name}", F.lit(0)) + F.coalesce(F.sum(e).over(inside), F.lit(0)))
    return out.drop("_block", *[f"_o_{n}" for n in sums])


def running_max(df: DataFrame, keys: Sequence[str], step: str, values: dict[str, Column],
                block: int = BLOCK, inclusive: bool = True, sparse: bool = False) -> DataFrame:
    """Running maximum per key (last marked step, last event ...), in the same levels."""
    keys = list(keys)
    blocks = with_blocks(df, step, block)
    totals = blocks.groupBy(*keys, "_block").agg(*[F.max(e).alias(f"_t_{n}") for n, e in values.items()])
    offsets = _earlier(totals, keys, list(values), F.max, block, _levels(sparse, block))
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, end)
    # the window needs the rows dealt by key and block in any case
    out = blocks.join(unfolded(offsets), [*keys, "_block"])
    for name, e in values.items():
        out = out.withColumn(name, F.greatest(F.col(f"_o_{name}"), F.max(e).over(inside)))
    return out.drop("_block", *[f"_o_{n}" for n in values])
