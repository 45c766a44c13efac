"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
SALTS = 32


def spread_join(rows: DataFrame, table: DataFrame, key: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) with a table of at most one row a key; the rows of one key go to up to ``salts`` tasks.

    The table is first joined with the distinct pairs of key and salt, at most ``salts`` a key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    wanted = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(wanted, [key, "_salt"], how).drop("_salt")


#: Bits of the filter of ``sifted``, in words of 64: at most 262,144 rows (about 6 MB) go through the driver, whatever there is.
SIFT_BITS = 1 << 24


def sifted(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``table``, so that a join of the two shuffles little. Keys in ``table`` all
    stay; of a table with very many keys more of the others stay, too."""
    at = F.pmod(F.xxhash64(key), F.lit(SIFT_BITS))
    bit = lambda c: F.col(c).bitwiseAND(F.lit(63)).cast("int")
    words = table.select(at.alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("_h"))).alias("_bits"))
    maybe = rows.withColumn("_h", at).withColumn("_word", F.shiftright("_h", 6)).join(F.broadcast(words), "_word")
    return maybe.filter(F.getbit("_bits", bit("_h")) == 1).drop("_h", "_word", "_bits")
