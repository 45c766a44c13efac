"""Units that must stay together: owners connected by shared forms, and folds that no form crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import fnv1a
from wordloom.plans.joins import spread_join
from wordloom.plans.shared import written


def shared_units(forms: DataFrame) -> DataFrame:
    """(owner, unit): ``unit`` is the least owner reachable over forms (owner, form) that owners share.

    Labels spread owner to form to owner, never over pairs of owners, so a form of many owners costs a row each. In each
    round the root of every label takes the least label that its members met, and labels follow their own labels, so the
    rounds grow with the logarithm of the longest chain. Null forms connect nothing, null owners are left out.
    """
    forms = forms.filter("owner IS NOT NULL").select("owner", "form").distinct()
    forms = written(forms, "forms")
    shared = forms.filter("form IS NOT NULL").groupBy("form").agg(F.min("owner").alias("_a"), F.max("owner").alias("_b")).filter("_a < _b").select("form")
    rows = written(spread_join(forms, shared, "form"), "shared-forms")
    labels = written(rows.select("owner").distinct().withColumn("label", F.col("owner")), "labels")
    changed = labels.count()
    while changed:
        told = spread_join(rows, labels, "owner")
        met = spread_join(rows, told.groupBy("form").agg(F.min("label").alias("met")), "form").groupBy("owner").agg(F.min("met").alias("met"))
        now = written(labels.join(met, "owner"), "met")
        roots = now.groupBy("label").agg(F.min("met").alias("_root")).withColumnRenamed("label", "_of")
        now = now.join(roots, now["owner"] == roots["_of"], "left").select("owner", F.col("label").alias("was"), F.least("label", "met", F.coalesce("_root", "met")).alias("label"))
        now = written(now, "labels")
        onward = now.select(F.col("owner").alias("label"), F.col("label").alias("_next"))
        after = written(spread_join(now, onward, "label").select("owner", "was", F.col("_next").alias("label")), "labels")
        changed = after.filter("was <> label").count()
        labels = after.drop("was")
    owners = forms.select("owner").distinct().join(labels, "owner", "left")
    return owners.select("owner", F.coalesce("label", "owner").alias("unit"))


def fold_of(unit: Column, salt: str, folds: int) -> Column:
    """The fold of a unit by FNV-1a of its text and a salt."""
    return F.pmod(fnv1a(F.concat(unit.cast("string"), F.lit(salt))), F.lit(folds).cast("long"))


def in_holdout(unit: Column, salt: str, rate: float) -> Column:
    """Whether a unit is in the share ``rate`` that is held out, in steps of 1/100,000."""
    return F.pmod(fnv1a(F.concat(unit.cast("string"), F.lit(salt))), F.lit(100_000).cast("long")) < F.lit(round(rate * 100_000))


def leak_free_folds(forms: DataFrame, folds: int = 5, holdout: float = 0.2, fold_salt: str = "|fold", holdout_salt: str = "|holdout") -> DataFrame:
    """owner, unit, fold and holdout: owners that share a form, directly or over others, are in one fold and on one side."""
    return shared_units(forms).withColumns({"fold": fold_of(F.col("unit"), fold_salt, folds), "holdout": in_holdout(F.col("unit"), holdout_salt, holdout)})
