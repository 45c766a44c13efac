"""Merging and thinning rows that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_meanings(df: DataFrame, key: Column, value: str, order: str, separator: str = "; ") -> DataFrame:
    """One row a key: its first ``order`` and its distinct values joined in order of first arrival."""
    firsts = df.select(key.alias("key"), F.col(value).alias("v"), F.col(order).alias("o")).filter("key <> ''").groupBy("key", "v").agg(F.min("o").alias("o"))
    merged = firsts.groupBy("key").agg(F.min("o").alias("first"), F.array_sort(F.collect_list(F.struct("o", "v"))).alias("l"))
    return merged.select("key", "first", F.array_join(F.transform("l", lambda x: x["v"]), separator).alias("merged"))


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """For each key its first ``order`` and how many rows it has; partial aggregation, no window."""
    return df.select(key.alias("key"), F.col(order).alias("o")).groupBy("key").agg(F.min("o").alias("first"), F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Each key's last row by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def last_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """Each key's last ``n`` rows; Spark drops the others before the shuffle (window group limit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of either side; where both have a key the later ``at`` wins, a tie goes to ``old``."""
    both = old.withColumn("_side", F.lit(1)).unionByName(new.withColumn("_side", F.lit(0)))
    return latest(both, keys, at, "_side").drop("_side")


def replica_merge(local: DataFrame, remote: DataFrame, keys: list[str], counters: list[str], level: str, clock: str) -> DataFrame:
    """Counters take the larger side, ``level`` the side with the later ``clock`` (a tie: local), ``clock`` the later."""
    l, r = (x.select(*keys, F.struct(*[c for c in x.columns if c not in keys]).alias(n)) for x, n in ((local, "l"), (remote, "r")))
    both = l.join(r, keys, "full_outer")
    newer = F.col("l").isNull() | (F.coalesce(F.col(f"r.{clock}") > F.col(f"l.{clock}"), F.lit(False)))
    return both.select(*keys, *[F.greatest(f"l.{c}", f"r.{c}").alias(c) for c in counters], F.when(newer, F.col(f"r.{level}")).otherwise(F.col(f"l.{level}")).alias(level), F.greatest(f"l.{clock}", f"r.{clock}").alias(clock))
