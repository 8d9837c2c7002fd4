"""Joins and windows whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.sources.shared import written

#: A key is hot with over 1 / MANY of all rows (fewer than MANY keys are, so that they may be broadcast), and over BUCKET rows.
MANY = 10_000
BUCKET = 100_000
#: Hashes of keys, by which rows are counted before keys are.
BINS = 1 << 16


def limit(total: int) -> int:
    """Rows that a key has at most if it isn't hot."""
    return max(BUCKET, total // MANY)


def hot_keys(d: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """Hot keys with their rows; None if there are none.

    Rows are counted by BINS hashes of the key first, which shuffles little; only keys of hot bins (fewer than MANY) are counted themselves.
    """
    if total <= limit(total):
        return None
    binned = F.pmod(F.xxhash64(*keys), F.lit(BINS))
    bins = [r["_bin"] for r in d.groupBy(binned.alias("_bin")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit(total)).select("_bin").collect()]
    return hot_of(d.where(binned.isin(bins)).groupBy(*keys).agg(F.count("*").alias("_rows")), total) if bins else None


def hot_of(counted: DataFrame, total: int) -> DataFrame | None:
    """Hot ones of keys with their `_rows`; None if there are none."""
    hot = written(counted.where(F.col("_rows") > limit(total)), "hot")
    return F.broadcast(hot) if hot.limit(1).count() else None


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with a right side that has a row for each key at most: hot keys of the left side by broadcast, so that no task gets one."""
    hot = hot_keys(left, keys, total)
    if hot is None:
        return left.join(right, keys)
    hot = hot.select(*keys)
    some = F.broadcast(right.join(hot, keys, "left_semi"))
    return left.join(some, keys).unionByName(left.join(hot, keys, "left_anti").join(right, keys))


def with_part(d: DataFrame, keys: list[str], value: str, total: int, name: str = "_part") -> DataFrame:
    """d with a part of each key's rows, by the hash of a column: about BUCKET rows a part where the key is hot, else one part."""
    return dealt(d, keys, value, hot_keys(d, keys, total), name).drop(f"{name}s")


def dealt(d: DataFrame, keys: list[str], value: str, hot: DataFrame | None, name: str = "_part") -> DataFrame:
    """with_part, with known hot keys, and with the number of the key's parts."""
    parts = f"{name}s"
    if hot is None:
        return d.withColumn(name, F.lit(0)).withColumn(parts, F.lit(1))
    hot = hot.select(*keys, F.ceil(F.col("_rows") / BUCKET).cast("int").alias(parts))
    return d.join(hot, keys, "left").withColumn(parts, F.coalesce(parts, F.lit(1))).withColumn(name, F.when(F.col(parts) > 1, F.pmod(F.xxhash64(value), F.col(parts))).otherwise(0).cast("int"))
