"""Result tables on Parquet, and ragged arrays as flat values with offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstat.functions.ordered import number_rows, running


def save_table(df: DataFrame, path: str, buckets: int = 64, key: str = "sample_id", spread: Sequence[str] = ()) -> None:
    """Parquet by ``sample_bucket``, a hash of the key, so that reads of some samples prune folders.

    ``spread`` columns split the rows of one sample over several files.
    """
    out = df.withColumn("sample_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.repartition("sample_bucket", *spread).write.partitionBy("sample_bucket").mode("errorifexists").parquet(path)


def load_table(spark: SparkSession, path: str, sample_ids: Sequence | None = None, buckets: int = 64,
               key: str = "sample_id") -> DataFrame:
    df = spark.read.parquet(path)
    if sample_ids is not None:
        kind = df.schema[key].dataType
        wanted = [F.pmod(F.xxhash64(F.lit(s).cast(kind)), F.lit(buckets)).cast("int") for s in sample_ids]
        df = df.where(F.col("sample_bucket").isin(*wanted) & F.col(key).isin(list(sample_ids)))
    return df.drop("sample_bucket")


def flatten_ragged(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: str) -> tuple[DataFrame, DataFrame]:
    """Array rows as flat values and offsets: row k holds flat[offset_k : offset_k + size_k]."""
    rows = number_rows(df.select(*dict.fromkeys([*keys, *order, values])), keys, order, "row")
    sized = rows.withColumn("size", F.size(values).cast("long"))
    summed = running(sized, list(keys), "row", {"_end": F.col("size")}) if keys else running(
        sized.withColumn("_all", F.lit(0)), ["_all"], "row", {"_end": F.col("size")}).drop("_all")
    offsets = summed.withColumn("offset", F.col("_end") - F.col("size"))
    flat = offsets.select(*keys, "row", "offset", F.posexplode(values).alias("_p", "value")).select(
        *keys, (F.col("offset") + F.col("_p")).alias("position"), "value")
    return flat, offsets.select(*keys, "row", "size", "offset")


def publish(tables: dict[str, DataFrame]) -> None:
    """Tables (or results of operators) as temporary views, for composition in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
