"""Settings that the operators are planned with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins by measured sizes, splits skewed partitions and merges small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("wordloom").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
