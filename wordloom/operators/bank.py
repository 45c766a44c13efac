"""Operators on a bank of items, its learners' records and their answers: joins with guards, grades, orders, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.plans.joins import sifted
from wordloom.plans.ordinals import with_ordinal


def checked(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """``rows``; the job fails with ``message`` at the first one that isn't ok."""
    return rows.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def positional_zip(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables by their place in each one's order; a place that one lacks has nulls there."""
    x = with_ordinal(a, F.col(order_a), name="place").select("place", F.struct(*a.columns).alias("a"))
    y = with_ordinal(b, F.col(order_b), name="place").select("place", F.struct(*b.columns).alias("b"))
    return x.join(y, "place", "full_outer")


def complete_join(answers: DataFrame, key: DataFrame, on: str) -> DataFrame:
    """Answers with their key; the job fails if either side lacks an item of the other."""
    both = answers.withColumn("_a", F.lit(1)).join(key.withColumn("_k", F.lit(1)), on, "full_outer")
    return checked(both, F.col("_a").isNotNull() & F.col("_k").isNotNull(), "answers and key don't hold the same items").drop("_a", "_k")


def without(rows: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    for o in others:
        rows = rows.join(o.select(*on).distinct(), on, "left_anti")
    return rows


def grades(ranks: DataFrame, item: str, rank: str, solvers: str = "n") -> DataFrame:
    """item and grade: TOP1 if more than half of the solvers have it first, TOP3 if any has it, else MISS (rank 0: no hit)."""
    g = ranks.groupBy(item).agg(F.count("*").alias(solvers), F.count_if(F.col(rank) == 1).alias("top1"), F.count_if(F.col(rank) > 0).alias("hits"))
    return g.select(item, F.when(2 * F.col("top1") > F.col(solvers), "TOP1").when(F.col("hits") > 0, "TOP3").otherwise("MISS").alias("grade"))


def monotone_verdict(bands: DataFrame, band: str, share: str, ceiling: float = 0.95) -> DataFrame:
    """Of shares by ordered band (a few rows): their span, whether all reach the ceiling, whether they fall strictly."""
    # one row a band: a constant number
    b = bands.withColumn("_last", F.lag(share).over(Window.orderBy(band)))
    return b.agg(F.round(F.max(share) - F.min(share), 6).alias("span"), F.bool_and(F.col(share) >= ceiling).alias("saturated"), F.bool_and(F.col("_last").isNull() | (F.col(share) < F.col("_last"))).alias("falling"))


def cards(rows: DataFrame, group: str, ident: str, allowed: DataFrame | None = None) -> DataFrame:
    """(ident, groups, n): idents that stand more than once, inside a group or across groups, but for allowed ones."""
    d = rows.groupBy(ident, group).agg(F.count("*").alias("_k")).groupBy(ident).agg(F.count("*").alias("groups"), F.sum("_k").alias("n")).filter("n > 1")
    return d if allowed is None else without(d, allowed, on=[ident])


def distractors(bank: DataFrame, id_: str, form: str, kind: str, most: int = 3) -> DataFrame:
    """(id, place, other): for each item ``most`` others that differ in form, of its kind first, then of any kind; by id
    distance in a ring of items, so that a bank of any size needs one join by place and no product of all pairs.

    Items are placed in id order within their kind, and in the whole bank; an item's candidates are the places that follow.
    """
    reach = 4 * most
    out = None
    for tier, by in ((0, [kind]), (1, [])):
        ring = with_ordinal(bank.select(id_, form, kind), *[F.col(c) for c in (*by, id_)], name="_spot")
        if by:
            first = ring.groupBy(kind).agg(F.min("_spot").alias("_first"), F.count("*").alias("_n"))
        else:
            first = ring.agg(F.min("_spot").alias("_first"), F.count("*").alias("_n"))
        ring = ring.join(F.broadcast(first), by) if by else ring.join(F.broadcast(first))
        ring = ring.withColumn("_spot", F.col("_spot") - F.col("_first"))
        steps = ring.select(F.col(id_), F.col(form).alias("_form"), *by, F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.struct(k.alias("step"), ((F.col("_spot") + k) % F.col("_n")).alias("_spot")))).alias("x")).select(id_, "_form", *by, "x.*")
        others = ring.select(F.col(id_).alias("other"), F.col(form).alias("_other_form"), *by, "_spot")
        found = steps.join(others, [*by, "_spot"]).filter((F.col("other") != F.col(id_)) & (F.col("_other_form") != F.col("_form"))).select(id_, "other", "_other_form", F.lit(tier).alias("tier"), "step")
        out = found if out is None else out.unionByName(found)
    once = out.groupBy(id_, "_other_form").agg(F.min(F.struct("tier", "step", "other")).alias("m"))
    picked = once.groupBy(id_).agg(F.slice(F.array_sort(F.collect_list("m")), 1, most).alias("ms"))
    return picked.select(id_, F.posexplode("ms").alias("place", "m")).select(id_, (F.col("place") + 1).alias("place"), F.col("m.other").alias("other"), F.col("m.tier").alias("tier"))


def phrases(texts: DataFrame, id_: str, words: str, lexicon: DataFrame, most: int = 3) -> DataFrame:
    """(id, at, n, phrase): phrases of up to ``most`` words that the lexicon (phrase) holds, leftmost first, the longest at
    each place, without overlaps. Windows are sifted by a filter of the
    lexicon and join by equality; only the hits of a text meet in its row."""
    sizes = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + n - 1 <= F.size(words)), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(words, i, n), " ").alias("phrase")))))
    windows = texts.select(id_, F.explode(sizes).alias("w")).select(id_, "w.*")
    known = lexicon.select("phrase").distinct()
    # only windows that may be in the lexicon are shuffled to meet it
    hits = sifted(windows, "phrase", known).join(known, "phrase").groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "phrase"))).alias("hs"))
    empty = F.array().cast("array<struct<at:int,n:int,phrase:string>>")
    start = F.struct(F.lit(1).alias("next"), empty.alias("found"))

    def step(acc: Column, h: Column) -> Column:
        hit = F.array(F.struct(h["at"].alias("at"), (-h["m"]).alias("n"), h["phrase"].alias("phrase")))
        return F.when(h["at"] >= acc["next"], F.struct((h["at"] - h["m"]).alias("next"), F.concat(acc["found"], hit).alias("found"))).otherwise(acc)

    return hits.select(id_, F.inline(F.aggregate("hs", start, step, lambda acc: acc["found"])))


def endorsed(votes: DataFrame, stored: DataFrame, keys: list[str], judges: int = 2) -> DataFrame:
    """Candidates that all judges accept and that aren't stored yet."""
    yes = votes.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_and("yes").alias("_yes")).filter((F.col("_n") == judges) & F.col("_yes")).select(*keys)
    return without(yes, stored, on=keys)


def pruned(state: DataFrame, bank: DataFrame, key: str, least: int = 50) -> DataFrame:
    """State rows whose key is in the bank; with fewer than ``least`` live keys in the bank all of ``state`` stays, for then
    the bank is broken rather than the state orphaned."""
    live = bank.select(key).distinct()
    enough = live.agg((F.count("*") >= least).alias("_enough"))
    marked = state.join(live.withColumn("_live", F.lit(True)), key, "left").join(F.broadcast(enough))
    return marked.filter(F.col("_live") | ~F.col("_enough")).drop("_live", "_enough")


def remapped(state: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """``state`` with old keys as new ones, but never over a row that already has the new key (that one stays, the old goes)."""
    moved = state.join(mapping.select(F.col("old").alias(key), "new"), key, "left")
    taken = state.select(F.col(key).alias("new")).distinct().withColumn("_taken", F.lit(True))
    moved = moved.join(taken, "new", "left").filter(F.col("new").isNull() | F.col("_taken").isNull())
    return moved.withColumn(key, F.coalesce("new", key)).drop("new", "_taken")


def bag_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Of two tables of items, the size of their multiset intersection by key."""
    n = lambda x, c: x.groupBy(*keys, item).agg(F.count("*").alias(c))
    return n(a, "_a").join(n(b, "_b"), [*keys, item]).groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("common"))


def mixed(rows: DataFrame, tier: str, order: str, shares: dict[str, int]) -> DataFrame:
    """``turn``: rows in cycles with so many of each tier; what a tier lacks leaves gaps that close up."""
    n = F.lit(None).cast("long")
    for name, k in shares.items():
        n = F.when(F.col(tier) == name, F.lit(k)).otherwise(n)
    at = with_ordinal(rows.filter(F.col(tier).isin(list(shares))), F.col(tier), F.col(order), name="_spot")
    at = at.join(F.broadcast(at.groupBy(tier).agg(F.min("_spot").alias("_first"))), tier)
    rank = {name: i for i, name in enumerate(shares)}
    place = F.lit(0)
    for name, i in rank.items():
        place = F.when(F.col(tier) == name, F.lit(i)).otherwise(place)
    at = at.withColumn("_cycle", F.floor((F.col("_spot") - F.col("_first")) / n)).withColumn("_place", place)
    return with_ordinal(at, F.col("_cycle"), F.col("_place"), F.col("_spot"), name="turn").drop("_spot", "_first", "_cycle", "_place")


def filled_up(rows: DataFrame, tier: Column, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by tier and order: a later tier's come only when those before are too few. A top-k."""
    return rows.withColumn("tier", tier).filter(F.col("tier").isNotNull()).orderBy("tier", order).limit(n)


def representatives(groups: DataFrame, place: str, words: str) -> DataFrame:
    """w and rep: the first word of the last group (by ``place``) that holds the word."""
    return groups.select(place, F.get(words, F.lit(0)).alias("rep"), F.explode(words).alias("w")).groupBy("w").agg(F.max_by("rep", place).alias("rep"))


def entitled(asked: DataFrame, grants: DataFrame, user: str, holds: Column) -> DataFrame:
    """Each asking user once and ``entitled``: whether a grant of theirs holds; without any, no."""
    found = grants.join(asked.select(user).distinct(), user, "left_semi").groupBy(user).agg(F.bool_or(holds).alias("_any"))
    return asked.select(user).distinct().join(found, user, "left").select(user, F.coalesce("_any", F.lit(False)).alias("entitled"))
