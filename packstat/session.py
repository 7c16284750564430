"""Where intermediate results go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Local sessions (tests) that name none get a temporary one, kept under a setting of its own because
    ``spark.checkpoint.dir`` is fixed once a session runs; a cluster session must
    name its own, because executors cannot see a folder of the driver's machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("packstat.scratch.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="packstat-")
        spark.conf.set("packstat.scratch.dir", named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; cuts the lineage of iterative operators.

    A table that is read has the size of its files. ``DataFrame.checkpoint`` would keep the size that was estimated for ``df``,
    and joins multiply these: in a loop that joins a round with its own descendant they grow without bound.
    """
    spark = df.sparkSession
    place = scratch_path(spark, "round")
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def spent(*rounds: DataFrame) -> None:
    """Delete tables that ``checkpoint`` has written and nothing will read again."""
    for df in rounds:
        spark = df.sparkSession
        for place in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if place.rsplit("/", 1)[1].startswith("round-"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table, a sink or a streaming checkpoint."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions for work that is heavy per row: one per core at least, not merged by size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def unfolded(df: DataFrame) -> DataFrame:
    """A side of a join with rows that were unfolded (exploded), or are as many: such a join sorts and merges, neither side is broadcast.

    Spark's size estimates leave out what ``explode`` adds: a table of a few megabytes passes for small after it became gigabytes.
    """
    return df.hint("merge")


__all__ = ["checkpoint", "scratch_path", "shared_dir", "spent", "spread", "unfolded"]
