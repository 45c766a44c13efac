"""Items matched to a vocabulary in tiers: as they are, without affixes, folded, by their words, by a root inside a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.scalars import folded, pointed_key
from wordloom.plans.joins import spread_join

#: A letter that joins sentences, letters of use that a word may start with, endings of plurals.
CONJUNCTION, PREFIXES, PLURALS = "ו", "הל", ("יימ", "ות", "ימ")

LEAST_ROOT = 3


def prefix_variants(w: Column) -> Column:
    """The word, without the conjunction, and either without one letter of use."""
    plain = F.when(F.startswith(w, F.lit(CONJUNCTION)) & (F.length(w) > 2), F.substring(w, F.lit(2), F.length(w)))
    forms = F.array_compact(F.array(w, plain))
    shorter = F.transform(forms, lambda f: F.when(F.left(f, F.lit(1)).isin(list(PREFIXES)) & (F.length(f) > 2), F.substring(f, F.lit(2), F.length(f))))
    return F.array_distinct(F.array_compact(F.concat(F.array(w), shorter)))


def singular_variants(w: Column) -> Column:
    """The word without each plural ending that it has, if two letters are left."""
    return F.array_compact(F.array(*[F.when(F.endswith(w, F.lit(e)) & (F.length(w) - len(e) >= 2), F.left(w, F.length(w) - len(e))) for e in PLURALS]))


def _inside(w: Column) -> Column:
    """All substrings of at least ``LEAST_ROOT`` letters."""
    n = F.length(w)
    starts = F.when(n >= LEAST_ROOT, F.sequence(F.lit(1), F.greatest(n - LEAST_ROOT + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(LEAST_ROOT), F.greatest(n - i + 1, F.lit(LEAST_ROOT))), lambda k: F.substring(w, i, k)))))


def match_items(items: DataFrame, bank: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """id, tier (full, close, miss) and hit of items (id, item) against a vocabulary (word, roots: array of strings).

    An item of one word is tried with and without its prefixes and plural ending: as a word, folded, then by the roots
    inside its folded forms (close). One of several words is tried as it is and without a conjunction, as it is and folded;
    then its words in turn, each as a word or folded, then by a root (close). Words in parentheses may be there or not in
    the vocabulary. Of several hits of one step the least counts. An item without words is a miss.
    """
    bare = lambda with_: F.regexp_replace("word", r"\(([^)]*)\)", "$1" if with_ else "")
    forms = bank.select("word", F.explode(F.array_distinct(F.array(F.col("word"), bare(True), bare(False)))).alias("form"))
    forms = forms.select("word", pointed_key(F.col("form")).alias("key"), folded(F.col("form")).alias("fold")).filter("key <> ''")
    kind = lambda name, c: F.concat(F.lit(f"{name}:"), c).alias("key")
    roots = bank.select(F.explode("roots").alias("r")).select(F.translate("r", "ךםןףץ", "כמנפצ").alias("r")).filter(F.length("r") >= LEAST_ROOT)
    known = forms.select(kind("exact", F.col("key")), "word").unionByName(forms.select(kind("fold", F.col("fold")), "word")).unionByName(roots.select(kind("root", F.col("r")), F.col("r").alias("word")))
    known = known.groupBy("key").agg(F.min("word").alias("word"))
    w = F.filter(F.split("_k", " "), lambda x: x != "")
    step = lambda rank, name, c, told: F.struct(rank.cast("int").alias("rank"), kind(name, c), told.alias("told"))
    none = F.lit(None).cast("string")
    one = F.array_distinct(F.flatten(F.transform(prefix_variants(F.get(w, F.lit(0))), lambda c: F.concat(F.array(c), singular_variants(c)))))
    single = F.concat(
        F.transform(one, lambda c: step(F.lit(0), "exact", c, none)),
        F.transform(one, lambda c: step(F.lit(1), "fold", folded(c), none)),
        F.flatten(F.transform(one, lambda c: F.transform(_inside(folded(c)), lambda r: step(F.lit(2), "root", r, none)))),
    )
    head = F.get(w, F.lit(0))
    whole = F.array_compact(F.array(F.col("_k"), F.when(F.startswith(head, F.lit(CONJUNCTION)) & (F.length(head) > 2), F.substring("_k", 2, 1 << 20))))
    told = F.filter(F.transform(w, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: (F.length(x["t"]) >= 3) & (~x["t"].isin(list(stop)) if stop else F.lit(True)))
    several = F.concat(
        F.transform(whole, lambda v: step(F.lit(0), "exact", v, none)),
        F.transform(whole, lambda v: step(F.lit(1), "fold", folded(v), none)),
        F.transform(told, lambda x: step(2 + 2 * x["i"], "exact", x["t"], x["t"])),
        F.transform(told, lambda x: step(2 + 2 * x["i"], "fold", folded(x["t"]), x["t"])),
        F.flatten(F.transform(told, lambda x: F.transform(_inside(folded(x["t"])), lambda r: step(3 + 2 * x["i"], "root", r, none)))),
    )
    rows = items.select("id", pointed_key(F.col("item")).alias("_k"))
    tried = rows.select("id", F.inline(F.when(F.size(w) == 1, single).when(F.size(w) > 1, several)))
    best = spread_join(tried.distinct(), known, "key").groupBy("id").agg(F.min(F.struct("rank", F.coalesce("told", "word").alias("hit"))).alias("b"))
    return items.select("id").join(best, "id", "left").select("id", F.when(F.col("b.rank") < 2, "full").when(F.col("b.rank") >= 2, "close").otherwise("miss").alias("tier"), F.col("b.hit").alias("hit"))


def tier_shares(matched: DataFrame, by: str) -> DataFrame:
    """Items, full and full or close in hundredths of a percent, by group."""
    n = F.count("*")
    share = lambda c: F.floor(10_000 * F.count_if(c) / n + 0.5).cast("long")
    return matched.groupBy(by).agg(n.alias("items"), share(F.col("tier") == "full").alias("full"), share(F.col("tier") != "miss").alias("covered"))
