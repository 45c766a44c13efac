"""Votes, confusion counts, agreement and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """tp, fa, fr, tn, accuracy and recall (null where undefined)."""
    n = lambda p, a: F.count_if(predicted.eqNullSafe(F.lit(p)) & actual.eqNullSafe(F.lit(a)))
    out = rows.groupBy(*by).agg(n(True, True).alias("tp"), n(True, False).alias("fa"), n(False, True).alias("fr"), n(False, False).alias("tn"))
    total = F.col("tp") + F.col("fa") + F.col("fr") + F.col("tn")
    return out.withColumns({"accuracy": F.round(F.try_divide(F.col("tp") + F.col("tn"), total), 6), "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fr")), 6)})


def majority(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """item, yes, n and verdict (yes by more than half)."""
    return votes.groupBy(item).agg(F.count_if(F.col(vote)).alias("yes"), F.count("*").alias("n")).withColumn("verdict", 2 * F.col("yes") > F.col("n"))


def plurality(votes: DataFrame, item: str, value: str, least: int = 2) -> DataFrame:
    """item and the value with most votes, of at least ``least``; a tie goes to the smaller value."""
    counts = votes.groupBy(item, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(item).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col(value)).alias("v"))).alias("m"))
    return best.select(item, F.when(F.col("m.n") >= least, F.col(f"m.{value}")).alias("winner"), F.col("m.n").alias("votes"))


def agreement(rows: DataFrame, *judges: str) -> DataFrame:
    """pair, both (items that the two have judged) and agree (share of equal verdicts)."""
    out = None
    for i, a in enumerate(judges):
        for b in judges[i + 1 :]:
            part = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.lit(f"{a}|{b}").alias("pair"), F.count("*").alias("both"), F.round(F.avg((F.col(a) == F.col(b)).cast("int")), 6).alias("agree"))
            out = part if out is None else out.unionByName(part)
    return out


def best_threshold(rows: DataFrame, band: str, cost: str, label: Column) -> DataFrame:
    """For each band the largest cost below every rejected row's (no false accept), and the share of accepted rows under it."""
    limits = rows.groupBy(band).agg(F.min(F.when(~label, F.col(cost))).alias("least_bad"))
    joined = rows.join(limits, band)
    ok = label & (F.col("least_bad").isNull() | (F.col(cost) < F.col("least_bad")))
    return joined.groupBy(band).agg(F.max(F.when(ok, F.col(cost))).alias("threshold"), F.round(F.try_divide(F.count_if(ok), F.count_if(label)), 6).alias("recall"))


def fold_statistics(rows: DataFrame, fold: Column, value: str) -> DataFrame:
    """Mean and population deviation of the folds' means."""
    means = rows.groupBy(fold.alias("fold")).agg(F.avg(value).alias("m"))
    return means.agg(F.count("*").alias("folds"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_pop("m"), 4).alias("sd"))


def weighted_flags(rows: DataFrame, id_: str, flags: dict[str, tuple[Column, int]]) -> DataFrame:
    """id, score (sum of weights of the flags that hold) and their names."""
    score = sum((F.when(c, w).otherwise(0) for c, w in flags.values()), F.lit(0))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (c, _) in flags.items()]))
    return rows.select(id_, score.alias("score"), F.array_join(names, ",").alias("flags"))


def coverage_point(counts: DataFrame, n: str, key: str, share: float) -> DataFrame:
    """The least number of keys, most frequent first, that hold ``share`` of all counts."""
    from wordloom.plans.ordinals import with_ordinal, with_running_sum

    total = counts.agg(F.sum(n).alias("total"))
    ranked = with_ordinal(with_running_sum(counts, F.col(n), F.col(n).desc(), F.col(key)), F.col(n).desc(), F.col(key), name="rank")
    return ranked.join(F.broadcast(total)).filter(F.col("running") >= share * F.col("total")).agg(F.min("rank").alias("keys"))


def top_reason(rows: DataFrame, entity: str, reason: str) -> DataFrame:
    """Each entity's most frequent reason; a tie goes to the first by name."""
    c = rows.groupBy(entity, reason).agg(F.count("*").alias("n"))
    w = Window.partitionBy(entity).orderBy(F.col("n").desc(), F.col(reason))
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
