"""Answer decisions: nearest target, weighted edits, and the gated near match with its reasons.

Distances of candidates found by equi-joins on deletion variants are Spark's; only the alignments of a pair of short strings
(all ways to turn one into the other by at most three edits of eight kinds) are worked out in Arrow batches: one by one where
their counts are wanted, by a banded table over many pairs at once where the least cost is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.scalars import KEY_NEIGHBOURS, bound, inflects, shared_letters
from wordloom.functions.text import deletions
from wordloom.plans.joins import spread_join
from wordloom.plans.shared import written

#: Kinds of edits, in the order of cost sums.
KINDS = ("sub", "adjSub", "transpose", "ins", "del", "doubleLetter", "materVI", "homophone")
MOST_EDITS, MOST_CANDIDATES, RADIUS = 3, 8, 2

#: Letters that stand for one another in Hebrew by sound, and the two that full spelling adds.
HOMOPHONES = {"א": "עה", "ע": "א", "ה": "א", "ב": "ו", "ו": "ב", "ח": "כ", "כ": "חק", "ט": "ת", "ת": "ט", "ק": "כ", "ס": "ש", "ש": "ס"}
MATRES = frozenset("וי")

#: Endings that make an inflected form of an English word.
ENDINGS = ("s", "es", "ed", "ing", "ly")


def _hebrew(*texts: str) -> bool:
    return any("֐" <= c <= "׿" for t in texts for c in t)


def alignments(a: str, b: str, most: int = MOST_EDITS) -> list[tuple[tuple[int, ...], int]]:
    """(counts by kind, first edited place of ``a`` or -1) of all alignments of ``a`` to ``b`` by at most ``most`` edits
    that no other alignment's counts undercut. Equal letters always match. Partial alignments advance in rounds of one edit,
    merged by place and counts."""
    hebrew = _hebrew(a, b)
    m, n = len(a), len(b)

    def matched(i: int, j: int) -> tuple[int, int]:
        while i < m and j < n and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i, j

    def single(s: str, i: int, kind: int) -> int:
        """The kind of an added or missing letter ``s[i]``."""
        if hebrew and s[i] in MATRES:
            return 6
        return 5 if (i > 0 and s[i - 1] == s[i]) or (i + 1 < len(s) and s[i + 1] == s[i]) else kind

    def replaced(x: str, y: str) -> int:
        if hebrew:
            return 7 if y in HOMOPHONES.get(x, "") else 0
        return 1 if y in KEY_NEIGHBOURS.get(x, "") else 0

    none = (0,) * len(KINDS)
    front: dict[tuple[int, int, tuple[int, ...]], int] = {(*matched(0, 0), none): -1}
    done: dict[tuple[int, ...], int] = {}
    for left in range(most, -1, -1):
        onward: dict[tuple[int, int, tuple[int, ...]], int] = {}
        for (i, j, counts), first in front.items():
            if i == m and j == n:
                if counts not in done or 0 <= first < done[counts]:
                    done[counts] = first
                continue
            if not left or abs((m - i) - (n - j)) > left:
                continue
            moves = []
            if i + 1 < m and j + 1 < n and a[i] == b[j + 1] and a[i + 1] == b[j]:
                moves.append((2, i + 2, j + 2))
            if i < m and j < n:
                moves.append((replaced(a[i], b[j]), i + 1, j + 1))
            if i < m:
                moves.append((single(a, i, 4), i + 1, j))
            if j < n:
                moves.append((single(b, j, 3), i, j + 1))
            at = i if first < 0 else first
            for kind, x, y in moves:
                key = (*matched(x, y), (*counts[:kind], counts[kind] + 1, *counts[kind + 1 :]))
                onward[key] = min(at, onward.get(key, at))
        front = onward
    under = lambda u, v: u != v and all(x <= y for x, y in zip(u, v, strict=True))
    return sorted((v, p) for v, p in done.items() if not any(under(u, v) for u in done))


def edit_vectors(pairs: DataFrame, a: str, b: str, most: int = MOST_EDITS) -> DataFrame:
    """``pairs`` and ``vectors``: array<struct<counts array<int>, first int>> of ``alignments``; a null text gives none."""

    @F.pandas_udf("array<struct<counts:array<int>,first:int>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], list] = {}
        for x, y in batches:
            out = []
            for p in zip(x, y, strict=True):
                if p not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[p] = [] if None in p else [{"counts": list(v), "first": f} for v, f in alignments(*p, most)]
                out.append(known[p])
            yield pd.Series(out)

    return pairs.withColumn("vectors", found(F.col(a), F.col(b)))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one row each, zeros behind their ends, and their lengths."""
    n = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), int(n.max(initial=0)) + 2), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, n


def _swaps(table: dict[str, str]) -> np.ndarray:
    """The letter pairs of a table as numbers."""
    return np.array([(ord(x) << 32) + ord(y) for x, ys in table.items() for y in ys], np.int64)


def banded_costs(a: list[str], b: list[str], weights: np.ndarray, start: np.ndarray, limit: np.ndarray, most: int = MOST_EDITS) -> np.ndarray:
    """The least cost of an alignment of each pair by at most ``most`` edits, ``start`` included; NaN beyond ``limit``.

    ``weights``: a row of costs in the order of ``KINDS`` for each pair. One table for all pairs: a cell for each place of
    ``a``, offset of ``b`` within ``most`` and number of edits; pairs whose every cell is beyond their limit leave it.
    """
    out = np.full(len(a), np.nan)
    if not len(a):
        return out
    (x, m), (y, n) = _codes(a), _codes(b)
    inside = lambda z: ((z >= 0x590) & (z <= 0x5FF))
    hebrew = inside(x).any(1) | inside(y).any(1)
    sound, keys, matres = _swaps(HOMOPHONES), _swaps(KEY_NEIGHBOURS), np.array([ord(c) for c in MATRES])

    def singles(z: np.ndarray, kind: int) -> np.ndarray:
        """The cost of each letter added or missing."""
        before, after = np.zeros_like(z), np.zeros_like(z)
        before[:, 1:], after[:, :-1] = z[:, :-1], z[:, 1:]
        kinds = np.where((z == before) | (z == after), 5, kind)
        kinds[hebrew[:, None] & np.isin(z, matres)] = 6
        return np.take_along_axis(weights, kinds, 1)

    gone, added = singles(x, 4), singles(y, 3)
    wide, at = 2 * most + 1, np.arange(len(a))
    row, after, beyond = (np.full((len(a), wide, most + 1), np.inf) for _ in range(3))
    row[:, most, 0] = start
    bound = limit + 1e-9
    for i in range(x.shape[1] - 1):
        for d in range(wide):
            j = i + d - most
            if j < 0 or j > y.shape[1] - 2:
                continue
            here = row[:, d]
            in_a, in_b = i < m[at], j < n[at]
            u, v, u2, v2 = x[at, i], y[at, j], x[at, i + 1], y[at, j + 1]
            same = in_a & in_b & (u == v)
            np.minimum(after[:, d], np.where(same[:, None], here, np.inf), out=after[:, d])
            onward = np.full_like(here, np.inf)
            onward[:, 1:] = np.where(same[:, None], np.inf, here)[:, :-1]
            if not np.isfinite(onward).any():
                continue
            w, pair = weights[at], (u << 32) + v
            replaced = np.where(hebrew[at], np.where(np.isin(pair, sound), w[:, 7], w[:, 0]), np.where(np.isin(pair, keys), w[:, 1], w[:, 0]))
            np.minimum(after[:, d], onward + np.where(in_a & in_b, replaced, np.inf)[:, None], out=after[:, d])
            if d:
                np.minimum(after[:, d - 1], onward + np.where(in_a, gone[at, i], np.inf)[:, None], out=after[:, d - 1])
            if d + 1 < wide:
                np.minimum(row[:, d + 1], onward + np.where(in_b, added[at, j], np.inf)[:, None], out=row[:, d + 1])
            crossed = (i + 1 < m[at]) & (j + 1 < n[at]) & (u == v2) & (u2 == v)
            np.minimum(beyond[:, d], onward + np.where(crossed, w[:, 2], np.inf)[:, None], out=beyond[:, d])
        ends = np.flatnonzero((m[at] == i) & (abs(n[at] - i) <= most))
        out[at[ends]] = row[ends, n[at[ends]] - i + most].min(1)
        live = (m[at] > i) & ((after.min((1, 2)) <= bound[at]) | (beyond.min((1, 2)) <= bound[at]))
        if not live.any():
            break
        at, row, after = at[live], after[live], beyond[live]
        beyond = np.full_like(row, np.inf)
    return np.where(out <= bound, np.round(out, 9), np.nan)


def banded_cost(a: Column, b: Column, which: Column, start: Column, limit: Column, weights: list[dict[str, float]], most: int = MOST_EDITS) -> Column:
    """The least cost within ``limit`` (compared at nine decimals) of turning ``a`` into ``b``, by the weights of number
    ``which``; else null. Pairs of a batch are taken in order of length, so that those of a table end together."""
    table = np.array([[float(w[k]) for k in KINDS] for w in weights])

    @F.pandas_udf("double")
    def f(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, k, s, t in batches:
            out = np.full(len(x), np.nan)
            usable = np.flatnonzero((x.notna() & y.notna() & k.notna() & s.notna() & t.notna()).to_numpy())
            order = usable[np.argsort(x.iloc[usable].str.len().to_numpy(dtype=np.int64), kind="stable")] if len(usable) else usable
            for part in (order[i : i + 2048] for i in range(0, len(order), 2048)):
                out[part] = banded_costs(x.iloc[part].tolist(), y.iloc[part].tolist(), table[k.iloc[part].to_numpy(dtype=np.int64)], s.iloc[part].to_numpy(dtype=float), t.iloc[part].to_numpy(dtype=float), most)
            yield pd.Series(out).astype("Float64").mask(np.isnan(out))

    return f(a, b, which, start, limit)


def weighted_cost(vectors: Column, weights: Column, first_cost: Column | float = 0.0, offset: Column | float = 0.0) -> Column:
    """The least cost of all alignments; null if there is none. ``weights``: array<double> in the order of ``KINDS``."""
    first, off = F.lit(first_cost) if isinstance(first_cost, float) else first_cost, F.lit(offset) if isinstance(offset, float) else offset

    def cost(v: Column) -> Column:
        start = off + F.when(v["first"] == 0, first).otherwise(0.0)
        return F.aggregate(F.zip_with(v["counts"], weights, lambda n, w: n * w), start, lambda s, x: s + x)

    return F.array_min(F.transform(vectors, cost))


def nearest_target(typed: Column, targets: Column) -> Column:
    """struct<dist, place (from 0), near> of the nearest target, the first of equally near ones; null without targets."""
    return F.array_min(F.transform(targets, lambda t, i: F.struct(F.levenshtein(typed, t).alias("dist"), i.alias("place"), t.alias("near"))))


def tolerance(near: Column) -> Column:
    """A third of the target's length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(near) / 3))


def why_rejected(typed: Column, raw: Column, targets: Column, whole: Column | None = None) -> Column:
    """struct<why, near, dist> of a rejected answer: empty, no-target, exact, typo, in-gloss (``whole`` holds the raw text)
    or other. ``typed`` and ``targets`` are keys."""

    def told(n: Column) -> Column:
        why = F.when(typed == "", "empty").when(n.isNull(), "no-target").when(n["dist"] == 0, "exact").when(n["dist"] <= tolerance(n["near"]), "typo")
        if whole is not None:
            why = why.when(F.contains(whole, F.trim(raw)), "in-gloss")
        known = (typed != "") & n.isNotNull()
        return F.struct(why.otherwise("other").alias("why"), F.when(known, n["near"]).alias("near"), F.when(known, n["dist"]).alias("dist"))

    return bound(nearest_target(typed, F.filter(targets, lambda t: t != "")), told)


def credited(typed: Column, targets: Column) -> Column:
    """The place (from 0) of the sense that an answer is credited to: an equal one, else the nearest within tolerance."""
    return F.when((F.size(targets) >= 2) & (typed != ""), bound(nearest_target(typed, targets), lambda n: F.when((n["dist"] == 0) | (n["dist"] <= tolerance(n["near"])), n["place"])))


def near_words(typed: DataFrame, word: str, forms: DataFrame, most: int = RADIUS) -> DataFrame:
    """(word, form, owner, raw): forms (form, owner) within ``most`` edits of the distinct typed words, by an equi-join on
    deletion variants."""
    v = typed.select(F.col(word).alias("word")).distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("v"))
    f = forms.select("form").distinct().select("form", F.explode(deletions(F.col("form"), most)).alias("v"))
    pairs = v.join(f, "v").select("word", "form").distinct().withColumn("raw", F.levenshtein("word", "form")).filter(F.col("raw") <= most)
    return pairs.join(forms.distinct(), "form").select("word", "form", "owner", "raw")


def nearest_words(rows: DataFrame, word: str, words: DataFrame, candidate: str, most: int = RADIUS, keep: int = MOST_CANDIDATES) -> DataFrame:
    """``rows`` and ``nearest``: the nearest candidates within ``most`` edits, by distance, length and letters, ``keep`` at most.

    Each distinct word is looked up once, by deletion variants; rows without a near word are left out."""
    near = near_words(rows, word, words.select(F.col(candidate).alias("form"), F.lit(0).alias("owner")), most)
    found = near.groupBy(F.col("word").alias("_w")).agg(F.slice(F.array_sort(F.collect_set(F.struct("raw", F.length("form").alias("n"), "form"))), 1, keep).alias("x"))
    return spread_join(rows.withColumnRenamed(word, "_w"), found.select("_w", F.col("x.form").alias("nearest")), "_w").withColumnRenamed("_w", word)


def near_match(answers: DataFrame, forms: DataFrame, lexicon: DataFrame, rules: dict) -> DataFrame:
    """id, ok, why and dist of answers (id, typed, owner, candidates) against forms (form, owner) and a lexicon (word).

    Gates in their order: ``collision`` (the typed form is another owner's), ``real-word`` (words that differ from a
    candidate's are all real), ``short``, ``far`` (no candidate), ``inflection``, ``far`` (none within three edits); the gap
    between the nearest form of another owner and the nearest own one chooses the strict or the plain bands and weights; then
    the least weighted distance within its length's band decides, else ``far``; last, too small a gap is a ``collision``.

    Equal answers (typed, owner, candidates) are decided once, and what is known of a typed form is one row of it, so an
    answer that very many give costs no more than its last join, which is spread.

    ``rules``: min_len, margin_hard, margin_soft, word (whether inflections are rejected), bands and bands_tight (lists of
    (most letters, threshold)), weights and weights_tight (by kind), first, share, first_tight, share_tight.
    """
    letters = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    given = answers.select(F.col("id").alias("_id"), "typed", "owner", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    given = given.withColumn("id", F.sha2(F.to_json(F.struct("typed", "owner", "candidates")), 256))
    rows = written(given.select("id", "typed", "owner", "candidates").distinct(), "decisions")
    # of a form's owners two differ from any third, so two stand for all
    holders = forms.groupBy("form").agg(F.min("owner").alias("one"), F.max("owner").alias("two"))
    held = holders.select(F.col("form").alias("typed"), "one", "two")
    rows = spread_join(rows, held, "typed", how="left")
    own = F.array_contains("candidates", F.col("typed"))
    foreign = ((F.col("one") != F.col("owner")) | (F.col("two") != F.col("owner"))) & ~own
    # words to look up, by candidate: only those that differ when word counts match
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    t = split(F.col("typed"))
    own_words = F.array_distinct(F.flatten(F.transform("candidates", split)))
    differing = F.transform("candidates", lambda c: F.when(F.size(split(c)) == F.size(t), F.filter(t, lambda x, i: x != F.get(split(c), i))).otherwise(t))
    asked = rows.filter(~own).select("id", own_words.alias("own"), F.explode(differing).alias("ws")).filter((F.size("ws") > 0) & ~F.arrays_overlap("ws", "own") & F.forall("ws", lambda w: F.length(w) >= 2))
    asked = asked.withColumn("k", F.xxhash64("ws")).select("id", "k", F.explode("ws").alias("word"))
    known = spread_join(asked, lexicon.select("word", F.lit(1).alias("known")).distinct(), "word", how="left")
    real = known.groupBy("id", "k").agg(F.count("*").alias("n"), F.count("known").alias("m")).filter("n = m").select("id").distinct().withColumn("real", F.lit(True))
    # gaps: the nearest form of another owner, up to RADIUS edits away (further ones are RADIUS + 1): the nearest owner's, and
    # for that owner the nearest one's but them
    two = holders.select("form", F.explode(F.array_distinct(F.array("one", "two"))).alias("owner")).filter("owner IS NOT NULL")
    near = written(near_words(rows, "typed", two).select(F.col("word").alias("typed"), F.col("owner").alias("other"), "raw"), "near-owners")
    best = near.groupBy("typed").agg(F.min(F.struct("raw", "other")).alias("b"))
    second = near.join(best, "typed").filter(F.col("other") != F.col("b.other")).groupBy("typed").agg(F.min("raw").alias("second"))
    rows = spread_join(rows, best.join(second, "typed", "left"), "typed", how="left")
    other_raw = F.when(F.col("b.other") != F.col("owner"), F.col("b.raw")).when(F.col("owner").isNotNull(), F.col("second"))
    # candidates within three edits, the nearest eight
    scored = F.filter(F.transform("candidates", lambda c: F.struct(F.levenshtein(F.col("typed"), c).alias("raw"), letters(c).alias("n"), c.alias("c"))), lambda x: x["raw"] <= MOST_EDITS)
    rows = rows.join(real, "id", "left").withColumn("foreign", foreign).withColumn("scored", F.slice(F.array_sort(scored), 1, MOST_CANDIDATES))
    rows = rows.withColumn("gap", F.coalesce(other_raw, F.lit(RADIUS + 1)) - F.array_min(F.transform("candidates", lambda c: F.levenshtein(F.col("typed"), c))))
    inflected = F.lit(False) if not rules["word"] else F.exists("candidates", lambda c: (F.length("typed") > F.length(c)) & inflects(F.col("typed"), c, ENDINGS))
    why = F.when(F.col("foreign"), "collision").when(F.col("real"), "real-word").when(letters(F.col("typed")) < rules["min_len"], "short").when(F.size("candidates") == 0, "far").when(inflected, "inflection").when(F.size("scored") == 0, "far")
    rows = written(rows.withColumn("why", why).select("id", "typed", "gap", "scored", "why"), "gated")
    pairs = rows.filter("why IS NULL").select("id", "typed", "gap", F.explode("scored").alias("x")).select("id", "typed", "gap", "x.*")
    tight = F.col("gap") < rules["margin_soft"] if rules["margin_soft"] > rules["margin_hard"] else F.lit(False)
    pairs = pairs.withColumn("tight", tight).withColumn("t", F.when(F.col("tight"), _step(F.col("n"), rules["bands_tight"])).otherwise(_step(F.col("n"), rules["bands"]))).filter("t > 0")
    pick = lambda a, b: F.when(F.col("tight"), F.lit(float(rules[a]))).otherwise(F.lit(float(rules[b])))
    # equal letters always match, so the first edit is at the first letter just when those differ
    start = pick("share_tight", "share") * (1 - shared_letters(F.col("typed"), F.col("c"))) + F.when(F.left("typed", F.lit(1)) != F.left("c", F.lit(1)), pick("first_tight", "first")).otherwise(0.0)
    cost = banded_cost(F.col("typed"), F.col("c"), F.when(F.col("tight"), 1).otherwise(0), start, F.col("t"), [rules["weights"], rules["weights_tight"]])
    least = pairs.select("id", cost.alias("cost")).filter("cost IS NOT NULL").groupBy("id").agg(F.min("cost").alias("best"))
    out = rows.join(least, "id", "left")
    why = F.coalesce("why", F.when(F.col("best").isNull(), "far").when((F.lit(rules["margin_hard"]) > 0) & (F.col("gap") < rules["margin_hard"]), "collision"))
    decided = out.select("id", why.alias("why"), F.when(why.isNull(), F.col("best")).alias("dist"))
    return spread_join(given.select("_id", "id"), decided, "id").select(F.col("_id").alias("id"), F.col("why").isNull().alias("ok"), "why", "dist")


def _step(n: Column, bands: list[tuple[int, float]]) -> Column:
    """The threshold of the first band with ``n`` letters or more; the last one's beyond all."""
    out = F.lit(float(bands[-1][1]))
    for most, t in reversed(bands):
        out = F.when(n <= most, F.lit(float(t))).otherwise(out)
    return out


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, none of which is edited again."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def osa(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa_distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return f(a, b)
