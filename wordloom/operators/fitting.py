"""Fitting of accept decisions: closed-form thresholds, coordinate descent under a guard, clamping, what-if curves, acquisition.

An item (a typed text) has pairs: candidates with a cell (a number from 0 for gap regime and length band) and a vector of
integer features ``x`` (edits by kind, first letter, missing letters). A pair costs the product of its features with integer
weights; an item is accepted if one of its pairs costs at most its cell's threshold, and a threshold of 0 accepts nothing.
All is integer, in whatever unit the weights have, so results depend on no order.

The tables that the loops read are sufficient statistics, written once: distinct (cell, x) of rejected items, and classes of
accepted items with the same length and pairs, with their number. A step of a loop is one job over them for all values of an axis.
What comes to the driver is a number for each cell or length and value of the axis.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.sampling import weave
from wordloom.plans.shared import written

FREE = 1 << 60


def snapped_below(cost: int, grid: int) -> int:
    """The largest multiple of ``grid`` below a cost, at least 0."""
    return max(0, (cost - 1) // grid * grid)


def cost_of(x: Column, weights: list[int]) -> Column:
    terms = [F.get(x, F.lit(k)) * F.lit(w).cast("long") for k, w in enumerate(weights) if w]
    out = terms[0] if terms else F.lit(0).cast("long")
    for t in terms[1:]:
        out = out + t
    return out


def _limit(cell: Column, limits: list[int]) -> Column:
    return F.get(F.array(*[F.lit(t).cast("long") for t in limits]), cell)


@dataclass
class Statistics:
    """What fitting needs of items (item, good, length, pairs: array<struct<cell, x>>); items without pairs count as never accepted."""

    bad: DataFrame  # cell, x
    good: DataFrame  # length, pairs, n
    cells: int
    grid: int

    @classmethod
    def of(cls, items: DataFrame, cells: int, grid: int) -> Statistics:
        pairs = F.array_sort(F.array_distinct(F.coalesce("pairs", F.array().cast(items.schema["pairs"].dataType))))
        bad = items.filter("NOT good").select(F.inline("pairs")).select("cell", "x").distinct()
        good = items.filter("good").groupBy("length", pairs.alias("pairs")).agg(F.count("*").alias("n"))
        return cls(written(bad, "rejected-pairs"), written(good, "accepted-classes"), cells, grid)


@dataclass
class Score:
    """Thresholds by cell, accepted items by length, and their sums."""

    thresholds: list[int]
    by_length: dict[int, int]
    taken: int = field(init=False)
    complexity: int = field(init=False)

    def __post_init__(self) -> None:
        self.taken, self.complexity = sum(self.by_length.values()), sum(self.thresholds)

    def better(self, other: Score | None) -> bool:
        """More items accepted, then lower thresholds."""
        return other is None or (-self.taken, self.complexity) < (-other.taken, other.complexity)

    def loses_to(self, other: Score | None) -> bool:
        """Whether a length has fewer accepted items than in ``other``."""
        return other is not None and any(self.by_length.get(n, 0) < k for n, k in other.by_length.items())


def _columns(pairs: DataFrame, aggregate, cells: int, n: int) -> list[list[int | None]]:
    """For each of ``n`` aggregates of pairs (cell, x) its values by cell."""
    out: list[list[int | None]] = [[None] * cells for _ in range(n)]
    for row in pairs.groupBy("cell").agg(*[aggregate(g).alias(f"_{g}") for g in range(n)]).collect():
        for g in range(n):
            out[g][row["cell"]] = row[f"_{g}"]
    return out


def accepted_by_length(stats: Statistics, models: list[tuple[list[int], list[int]]]) -> list[dict[int, int]]:
    """Accepted good items by length for each (weights, thresholds)."""

    def ok(weights: list[int], limits: list[int]) -> Column:
        return F.exists("pairs", lambda p: (_limit(p["cell"], limits) > 0) & (cost_of(p["x"], weights) <= _limit(p["cell"], limits)))

    rows = stats.good.groupBy("length").agg(*[F.sum(F.when(ok(*m), F.col("n")).otherwise(0)).alias(f"_{g}") for g, m in enumerate(models)]).collect()
    return [{r["length"]: r[f"_{g}"] for r in rows} for g in range(len(models))]


def solved(stats: Statistics, candidates: list[list[int]]) -> list[Score]:
    """For each candidate's weights the highest thresholds that accept no rejected item, and what they accept.

    A cell's threshold is the largest grid value below the cheapest rejected pair, but no more than the dearest good pair under
    it needs, and 0 without any.
    """
    n = range(len(candidates))
    cheapest = _columns(stats.bad, lambda g: F.min(cost_of(F.col("x"), candidates[g])), stats.cells, len(candidates))
    free = [[FREE if c is None else snapped_below(c, stats.grid) for c in cheapest[g]] for g in n]
    pairs = stats.good.select(F.inline("pairs"))

    def dearest(g: int) -> Column:
        c = cost_of(F.col("x"), candidates[g])
        return F.max(F.when(c <= _limit(F.col("cell"), free[g]), c))

    top = _columns(pairs, dearest, stats.cells, len(candidates))
    limits = [[0 if c is None else min(t, snapped_below(c + stats.grid, stats.grid)) for t, c in zip(free[g], top[g], strict=True)] for g in n]
    return [Score(t, by) for t, by in zip(limits, accepted_by_length(stats, list(zip(candidates, limits, strict=True))), strict=True)]


@dataclass
class Fitted:
    weights: list[int]
    score: Score
    steps: int


def fit(stats: Statistics, seeds: list[list[int]], grids: list[list[int]], rounds: int = 5, reference: Score | None = None) -> Fitted:
    """Coordinate descent from every seed: an axis takes the grid value that scores best, in the order of axes, until a round
    moves nothing. Candidates that lose an accepted item of any length against ``reference`` don't count. The best seed's
    result; an error if no candidate passes."""
    best: Fitted | None = None
    steps = 0
    for seed in seeds:
        now, score = list(seed), solved(stats, [seed])[0]
        held = None if score.loses_to(reference) else score
        for _ in range(rounds):
            moved = False
            for axis, grid in enumerate(grids):
                values = [v for v in grid if v != now[axis]]
                if not values:
                    continue
                steps += 1
                pick = now[axis]
                for v, s in zip(values, solved(stats, [[*now[:axis], v, *now[axis + 1 :]] for v in values]), strict=True):
                    if not s.loses_to(reference) and s.better(held):
                        held, pick = s, v
                moved |= pick != now[axis]
                now[axis] = pick
            if not moved:
                break
        if held is not None and (best is None or held.better(best.score)):
            best = Fitted(now, held, 0)
    if best is None:
        raise ValueError("no candidate keeps every length's accepted items")
    best.steps = steps
    return best


def decisions(items: DataFrame, weights: list[int], limits: list[int]) -> DataFrame:
    """item and accepted."""
    ok = F.exists("pairs", lambda p: (_limit(p["cell"], limits) > 0) & (cost_of(p["x"], weights) <= _limit(p["cell"], limits)))
    return items.select("item", F.coalesce(ok, F.lit(False)).alias("accepted"))


def clamped(items: DataFrame, weights: list[int], limits: list[int], grid: int) -> list[int]:
    """The thresholds lowered one cell after another to the smallest grid value that changes no decision of any item.

    An accepted item needs a cell only if no other cell, earlier ones as lowered and later ones as they are, accepts it. Items
    are first reduced to the grid values by which each cell would accept them, and equal ones to one row; then there is one
    aggregate for each cell that binds an item which earlier cells might still accept, and one for all other cells.
    """
    step = lambda c: F.greatest(F.ceil(c / grid).cast("long") * grid, F.lit(grid).cast("long"))
    open_ = items.select("item", F.inline("pairs")).withColumn("cost", cost_of(F.col("x"), weights)).withColumn("limit", _limit(F.col("cell"), limits)).filter("limit > 0 AND cost <= limit")
    by = open_.groupBy("item", "cell").agg(F.min(step(F.col("cost"))).alias("need"))
    held = by.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("cell", "need"))).alias("cells")).select("cells").distinct()
    held = written(held.withColumn("last", F.element_at("cells", -1)), "needs")
    out = [0 if t > 0 else t for t in limits]
    alone = held.filter("size(cells) = 1").groupBy("last.cell").agg(F.max("last.need").alias("need"))
    for cell, need in alone.collect():
        out[cell] = need
    several = held.filter("size(cells) > 1")
    for (cell,) in sorted(several.select("last.cell").distinct().collect()):
        earlier = F.exists(F.slice("cells", 1, F.size("cells") - 1), lambda p: p["need"] <= _limit(p["cell"], out))
        need = several.filter((F.col("last.cell") == cell) & ~earlier).agg(F.max("last.need")).first()[0]
        out[cell] = max(out[cell], need or 0)
    # a threshold that was no grid value is kept where all of it is needed
    out = [min(a, b) for a, b in zip(out, limits, strict=True)]
    one, two = (decisions(items, weights, t).withColumnRenamed("accepted", name) for t, name in ((limits, "before"), (out, "after")))
    if (changed := one.join(two, "item").filter("before <> after").count()) > 0:
        raise AssertionError(f"clamping changed {changed} decisions")
    return out


def slacks(items: DataFrame, weights: list[int], limits: list[int]) -> DataFrame:
    """item, slack, cell: by how much the pair nearest to its threshold exceeds it (negative: under it); null without an
    open cell, then ``cell`` is the cheapest pair's and ``least`` its cost."""
    p = items.select("item", F.inline("pairs")).withColumn("cost", cost_of(F.col("x"), weights)).withColumn("limit", _limit(F.col("cell"), limits))
    near = F.min(F.when(F.col("limit") > 0, F.struct((F.col("cost") - F.col("limit")).alias("slack"), "cell")))
    found = p.groupBy("item").agg(near.alias("_near"), F.min(F.struct("cost", "cell")).alias("_least"))
    return found.select("item", "_near.slack", F.coalesce("_near.cell", "_least.cell").alias("cell"), F.col("_least.cost").alias("least"))


def counterfactual(stats: Statistics, doubted: DataFrame, weights: list[int], limits: list[int], shares: list[float]) -> list[tuple[int, Score]]:
    """(k, score) for each share: what would be accepted if the k most binding ``doubted`` items (item, pairs) weren't rejected.

    ``stats.bad`` holds all other rejected pairs. Doubted items are ranked by slack under the given thresholds, ties by item; an
    item's place decides from which k on it is gone, so one aggregate by cell and interval gives the cheapest
    pair left for every k, by running minima from the last interval on.
    """
    from wordloom.plans.ordinals import with_ordinal

    ranked = with_ordinal(slacks(doubted, weights, limits).filter("slack IS NOT NULL").select("item", "slack"), F.col("slack"), F.col("item"), name="place")
    total = doubted.count()
    cuts = [int(s * total + 0.5) for s in shares]
    order = sorted(set(cuts))
    # interval: how many of the cuts leave the item in
    within = doubted.join(ranked, "item", "left").select(F.inline("pairs"), sum((F.when(F.col("place") <= c, 0).otherwise(1) for c in order), F.lit(0)).alias("interval"))
    rows = within.groupBy("cell", "interval").agg(F.min(cost_of(F.col("x"), weights)).alias("least")).collect()
    base = _columns(stats.bad, lambda _: F.min(cost_of(F.col("x"), weights)), stats.cells, 1)[0]
    free = []
    for i, _ in enumerate(order):  # gone under order[i] unless more than len(order) - 1 - i cuts ... leave it in
        left = list(base)
        for cell, interval, least in rows:
            if interval > i and (left[cell] is None or least < left[cell]):
                left[cell] = least
        free.append([FREE if c is None else snapped_below(c, stats.grid) for c in left])
    cost = cost_of(F.col("x"), weights)
    top = _columns(stats.good.select(F.inline("pairs")), lambda g: F.max(F.when(cost <= _limit(F.col("cell"), free[g]), cost)), stats.cells, len(order))
    found = [[0 if c is None else min(t, snapped_below(c + stats.grid, stats.grid)) for t, c in zip(f, p, strict=True)] for f, p in zip(free, top, strict=True)]
    scores = dict(zip(order, (Score(t, by) for t, by in zip(found, accepted_by_length(stats, [(weights, t) for t in found]), strict=True)), strict=True))
    return [(k, scores[k]) for k in cuts]


def acquired(items: DataFrame, labelled: DataFrame, weights: list[int], limits: list[int], k: int) -> DataFrame:
    """item, cell, tier and distance of the ``k`` items to label next, and ``turn``.

    Tier 0 is accepted without a label, 1 isn't but has an open cell, 2 has none (by its cheapest pair). Cells take turns, each with
    its most urgent item: lowest tier, then nearest to the threshold, then least item. Labelled items don't count.
    """
    rows = slacks(items.join(labelled.select("item").distinct(), "item", "left_anti"), weights, limits)
    tier = F.when(F.col("slack").isNull(), 2).when(F.col("slack") <= 0, 0).otherwise(1)
    rows = rows.select("item", "cell", tier.alias("tier"), F.when(F.col("slack").isNull(), F.col("least")).otherwise(F.abs("slack")).alias("distance"))
    urgent = rows.withColumn("_key", F.struct("tier", "distance", "item"))
    return weave(urgent, "cell", "_key").drop("_key").filter(F.col("turn") <= k)
