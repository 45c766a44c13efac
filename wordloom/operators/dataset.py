"""A labelled dataset of mistyped forms: what a matcher should accept and what it must reject, in folds that don't leak.

Every form (owner, form) gives at most ``slots`` mistypings, of the kinds that its hash starts with in the ring of kinds, each the
variant of least hash that isn't one of the owner's own forms. A mistyping is rejected if it is another owner's form (veto), if
another owner's form is as near to it as the nearest own one (ambiguous), or if it is a word of the lexicon (real-word); else it
is accepted. Further rejected rows are neighbours at distance 1 of other owners, and strings of as many letters for forms without
any. A pair of form and text that is labelled both ways is rejected (cross-owner). All labels come from joins on forms and
deletion variants; nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions.text import fnv1a
from wordloom.operators.fuzzy import near_words
from wordloom.operators.units import leak_free_folds
from wordloom.plans.shared import written

#: Kinds of mistypings, in ring order.
KINDS = {"drop": S.dropped, "swap": S.swapped, "double": S.doubled, "neighbour": S.neighbour_typed}

#: Letters of a form at least, and of one whose accepted mistypings need no check by others.
LEAST_LETTERS, TRUSTED_LETTERS = 4, 5

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def mistypings(forms: DataFrame, slots: int) -> DataFrame:
    """(owner, form, kind, typed): one variant for each of the ``slots`` kinds from a form's place in the ring on."""
    first = F.pmod(fnv1a(F.concat("form", F.lit("|rot"))), F.lit(len(KINDS)).cast("long"))
    turn = {k: F.pmod(F.lit(i).cast("long") - first, F.lit(len(KINDS)).cast("long")) < slots for i, k in enumerate(KINDS)}
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(turn[k], f(F.col("form"))).alias("typed")) for k, f in KINDS.items()])
    every = forms.filter(F.length("form") >= LEAST_LETTERS).select("owner", "form", F.inline(made)).select("owner", "form", "kind", F.explode("typed").alias("typed"))
    every = every.filter("typed <> form AND typed <> ''").join(forms.select("owner", F.col("form").alias("typed")), ["owner", "typed"], "left_anti")
    return every.groupBy("owner", "form", "kind").agg(F.min_by("typed", F.struct(_hash(F.col("form"), F.col("kind"), F.col("typed")), "typed")).alias("typed"))


def _labels(rows: DataFrame, forms: DataFrame, lexicon: DataFrame, radius: int) -> DataFrame:
    """``rows`` (owner, form, kind, typed) with label and why."""
    near = near_words(rows, "typed", forms, radius).select(F.col("word").alias("typed"), F.col("owner").alias("_whose"), "raw")
    met = rows.select("owner", "typed").distinct().join(near, "typed")
    by = met.groupBy("owner", "typed").agg(F.min(F.when(F.col("_whose") == F.col("owner"), F.col("raw"))).alias("_own"), F.min(F.when(F.col("_whose") != F.col("owner"), F.col("raw"))).alias("_other"))
    known = lexicon.select(F.col("word").alias("typed")).distinct().withColumn("_real", F.lit(True))
    rows = rows.join(by, ["owner", "typed"], "left").join(known, "typed", "left")
    why = F.when(F.col("_other") == 0, "veto").when(F.col("_other") <= F.col("_own"), "ambiguous").when(F.col("_real"), "real-word").otherwise("novel")
    return rows.withColumn("why", why).withColumn("label", F.when(F.col("why") == "novel", "accept").otherwise("reject")).drop("_own", "_other", "_real")


def labelled_dataset(forms: DataFrame, lexicon: DataFrame, slots: int = 2, partners: int = 2, folds: int = 5, holdout: float = 0.2) -> DataFrame:
    """owner, form, typed, kind, label, why, trusted, fold and holdout of forms (owner, form) and a lexicon (word)."""
    forms = written(forms.filter("owner IS NOT NULL AND form <> ''").select("owner", "form").distinct(), "forms")
    rows = written(_labels(mistypings(forms, slots), forms, lexicon, 2), "mistypings")
    # real words that differ from a form by one edit and belong to others
    own = forms.filter(F.length("form") >= LEAST_LETTERS)
    pairs = near_words(own, "form", forms, 1).filter("raw = 1").select(F.col("word").alias("form"), F.col("form").alias("typed"), F.col("owner").alias("_whose"))
    pairs = own.join(pairs, "form").filter("owner <> _whose").select("owner", "form", "typed").distinct()
    pairs = pairs.join(forms.select("owner", F.col("form").alias("typed")), ["owner", "typed"], "left_anti")
    # a form has a bounded number of neighbours at distance 1: its length times the alphabet
    rank = F.row_number().over(Window.partitionBy("owner", "form").orderBy("typed"))
    pairs = written(pairs.withColumn("_k", rank).filter(F.col("_k") <= partners).select("owner", "form", "typed").withColumn("kind", F.lit("neg/partner")), "partners")
    lone = own.join(pairs.select("owner", "form").distinct(), ["owner", "form"], "left_anti")
    letters = F.transform(F.sequence(F.lit(1), F.length("form")), lambda i: F.substring(F.lit(LETTERS), (F.conv(F.substring(_hash(F.col("form"), i.cast("string")), 1, 4), 16, 10).cast("long") % len(LETTERS) + 1).cast("int"), F.lit(1)))
    garbage = lone.select("owner", "form", F.array_join(letters, "").alias("typed"), F.lit("neg/garbage").alias("kind"))
    garbage = garbage.join(forms.select(F.col("form").alias("typed")).distinct(), "typed", "left_anti")
    negative = pairs.unionByName(garbage).withColumns({"label": F.lit("reject"), "why": F.substring("kind", 5, 20)})
    rows = rows.unionByName(negative).groupBy("owner", "form", "typed").agg(F.min_by(F.struct("kind", "label", "why"), F.struct(F.col("label") != "reject", "kind")).alias("_x")).select("owner", "form", "typed", "_x.*")
    strict = rows.groupBy("form", "typed").agg(F.bool_or(F.col("label") == "reject").alias("_any"), F.bool_or(F.col("label") == "accept").alias("_other")).filter("_any AND _other").select("form", "typed", F.lit(True).alias("_turned"))
    rows = rows.join(strict, ["form", "typed"], "left").withColumn("_turned", F.coalesce("_turned", F.lit(False)) & (F.col("label") == "accept"))
    rows = rows.withColumns({"label": F.when(F.col("_turned"), "reject").otherwise(F.col("label")), "why": F.when(F.col("_turned"), "cross-owner").otherwise(F.col("why"))}).drop("_turned")
    split = leak_free_folds(forms, folds, holdout).drop("unit")
    return rows.withColumn("trusted", (F.col("label") == "reject") | (F.length("form") >= TRUSTED_LETTERS)).join(split, "owner")
