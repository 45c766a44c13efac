"""Greedy picks without conflicts, as an ordered walk makes them, in rounds that work on all items at once.

A walk in order takes an item unless it shares a key with one taken before, and a taken item claims all its keys. In
each round every item that is the first of those left for all of its keys is taken, and all that share a key with one are
out; that is what the walk decides about them, whatever comes later. An item waits only for a chain of conflicts
with ever later items, so random orders need about the logarithm of the number of items in rounds. When at most ``most_local``
(item, key) pairs are left, one task walks through them, which also ends long chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import english_key, gloss_key
from wordloom.plans.joins import spread_join
from wordloom.plans.ordinals import with_ordinal
from wordloom.plans.shared import written

#: Pairs of item and key that one task walks through at the end.
MOST_LOCAL = 20_000


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (_at, _keys) in order; the taken ones."""
    held: set[str] = set()
    for b in batches:
        taken = []
        for at, keys in zip(b["_at"], b["_keys"], strict=True):
            if held.isdisjoint(keys):
                held.update(keys)
                taken.append(at)
        yield pd.DataFrame({"_at": taken}, dtype="int64")


def greedy_picks(items: DataFrame, keys: Column, *order: Column, most_local: int = MOST_LOCAL) -> DataFrame:
    """``items``, ``place`` (from 1, in ``order``, which must not tie), ``picked`` and ``round`` (that an item was taken in; 0 for
    items without keys, which are always taken; null for the others). ``keys``: array of strings, nulls aside."""
    ranked = with_ordinal(items.withColumn("_keys", F.array_distinct(F.array_compact(F.coalesce(keys, F.array().cast("array<string>"))))), *order, name="place")
    ranked = written(ranked, "ranked-items")
    left = written(ranked.select(F.col("place").alias("_at"), F.explode("_keys").alias("_key")), "item-keys")
    taken = ranked.filter(F.size("_keys") == 0).select(F.col("place").alias("_at"), F.lit(0).alias("round"))
    number = 0
    while n := left.count():
        number += 1
        if n <= most_local:
            rows = left.groupBy("_at").agg(F.collect_list("_key").alias("_keys")).repartition(1).sortWithinPartitions("_at")
            taken = taken.unionByName(written(rows.mapInPandas(_walk, "_at long").withColumn("round", F.lit(number)), "picks"))
            break
        first = left.groupBy("_key").agg(F.min("_at").alias("_first"))
        firsts = spread_join(left, first, "_key").groupBy("_at").agg(F.bool_and(F.col("_at") == F.col("_first")).alias("_all"))
        now = written(firsts.filter("_all").select("_at", F.lit(number).alias("round")), "picks")
        claimed = left.join(now.select("_at"), "_at").select("_key").distinct()
        out = spread_join(left, claimed, "_key").select("_at").distinct()
        left = written(left.join(out, "_at", "left_anti"), "item-keys")
        taken = taken.unionByName(now)
    found = ranked.drop("_keys").join(taken, ranked["place"] == taken["_at"], "left").drop("_at")
    return found.withColumn("picked", F.col("round").isNotNull())


def relative_keys(term: Column, meaning: Column, letters: int = 5) -> Column:
    """The keys by which two items of a test cue each other: the first ``letters`` of the term's key, the meaning's key."""
    t, g = english_key(term), gloss_key(meaning)
    return F.array(F.when(F.length(t) >= letters, F.concat(F.lit("t:"), F.left(t, F.lit(letters)))), F.when(F.length(g) >= 2, F.concat(F.lit("g:"), g)))


def exam_items(pool: DataFrame, n: int, keys: Column, *order: Column) -> DataFrame:
    """``n`` items in ``order`` without conflicts; if there aren't so many, the first ``n`` whatever their conflicts."""
    ranked = greedy_picks(pool, keys, *order)
    enough = ranked.filter("picked").limit(n).count() == n
    return ranked.filter("picked" if enough else "true").orderBy("place").limit(n).drop("picked", "round")


def flipped_directions(cards: DataFrame, direction: str, senses: Column, *order: Column, asked: str = "m2w", flipped: str = "w2m") -> DataFrame:
    """``cards`` with those of direction ``asked`` turned to ``flipped`` that share a sense with an earlier one still asked that way.

    Cards of the other direction claim nothing; a card without senses neither claims nor yields."""
    keys = F.when(F.col(direction) == asked, senses)
    ranked = greedy_picks(cards, keys, *order)
    return ranked.withColumn(direction, F.when((F.col(direction) == asked) & ~F.col("picked"), flipped).otherwise(F.col(direction))).drop("picked", "round")
