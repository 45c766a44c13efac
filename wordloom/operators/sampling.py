"""Deterministic samples, splits and interleavings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.plans.ordinals import with_ordinal


def hash_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows of least SHA-256 of seed and key: the same on any engine. A top-k, without a full sort."""
    return rows.withColumn("_h", F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def hash_split(rows: DataFrame, key: str, seed: str, shares: dict[str, int]) -> DataFrame:
    """``part``: by the MD5 of seed and key in hundredths."""
    at = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(100))
    part, upto = None, 0
    for name, share in shares.items():
        upto += share
        part = F.when(at < upto, name) if part is None else part.when(at < upto, name)
    return rows.withColumn("part", part)


def stratified(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """Of each stratum max(1, round half up of its share of ``n``) rows, by least key."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    quota = sizes.join(F.broadcast(sizes.agg(F.sum("_size").alias("_all")))).select(stratum, F.greatest(F.lit(1), F.floor(F.col("_size") * n / F.col("_all") + 0.5)).alias("_quota"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).filter(F.col("_rn") <= n)
    return ranked.join(F.broadcast(quota), stratum).filter(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")


def weave(rows: DataFrame, bucket: str, key: str) -> DataFrame:
    """``turn``: rows in the order first of every bucket, second of every bucket, and so on.

    A row's place in its bucket is its ordinal by bucket and key less the bucket's first, so no bucket meets in one task.
    """
    at = with_ordinal(rows, F.col(bucket), F.col(key), name="_o")
    first = at.groupBy(bucket).agg(F.min("_o").alias("_f")).withColumnRenamed(bucket, "_b")
    ranked = at.join(F.broadcast(first), F.col(bucket).eqNullSafe(F.col("_b"))).withColumn("_rn", F.col("_o") - F.col("_f"))
    return with_ordinal(ranked.drop("_o", "_f", "_b"), F.col("_rn"), F.col(bucket), name="turn").drop("_rn")


def systematic(rows: DataFrame, key: str, step: int) -> DataFrame:
    """Every ``step``-th row by key, from the first on."""
    return with_ordinal(rows, F.col(key), name="_o").filter((F.col("_o") - 1) % step == 0).drop("_o")


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``batch``: consecutive groups of ``size`` rows by key."""
    return with_ordinal(rows, F.col(key), name="_o").withColumn("batch", F.floor((F.col("_o") - 1) / size)).drop("_o")


def running_budget(rows: DataFrame, size: Column, key: str, most: int) -> DataFrame:
    """Rows by key until the sum of sizes first passes ``most``; that row and all later ones go."""
    from wordloom.plans.ordinals import with_running_sum

    return with_running_sum(rows, size, F.col(key), name="used").filter(F.col("used") <= most)
