"""Ordered picks, lexicon filters, leak-free units and fitting against plain walks, with hot keys and odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import bloom, dataset, fitting, picks, units

# ---- picks


def walk(items):
    """(id, picked) of (id, keys) in order."""
    held, out = set(), []
    for i, keys in items:
        keys = {k for k in keys or [] if k is not None}
        out.append((i, held.isdisjoint(keys)))
        if out[-1][1]:
            held |= keys
    return out


@pytest.mark.parametrize("most_local", [0, 50, 10**6])
def test_picks_equal_a_walk(spark, most_local):
    rng = random.Random(7)
    items = [(i, [rng.choice(["hot", None, *[f"k{rng.randint(0, 150)}" for _ in range(3)]]) for _ in range(rng.randint(0, 3))] if i % 11 else None) for i in range(400)]
    rng.shuffle(items)
    rows = spark.createDataFrame([(i, keys, at, "x") for at, (i, keys) in enumerate(items)], "id long, keys array<string>, at long, round string").drop("round")
    got = picks.greedy_picks(rows, F.col("keys"), F.col("at"), most_local=most_local)
    assert [(r["id"], r["picked"]) for r in got.orderBy("place").collect()] == walk(items)
    assert all((r["round"] is None) == (not r["picked"]) for r in got.collect())


def test_rounds_are_few_with_a_hot_key_and_a_chain_ends_in_one_task(spark):
    rng = random.Random(3)
    items = [(i, [f"k{rng.randint(0, 700)}", "hot" if i % 3 == 0 else f"j{rng.randint(0, 700)}"]) for i in range(2000)]
    rows = spark.createDataFrame(items, "id long, keys array<string>")
    got = picks.greedy_picks(rows, F.col("keys"), F.col("id"), most_local=0).collect()
    assert sorted((r["id"], r["picked"]) for r in got) == walk(items) and max(r["round"] or 0 for r in got) <= 12
    chain = [(i, [f"c{i}", f"c{i + 1}"]) for i in range(300)]
    got = picks.greedy_picks(spark.createDataFrame(chain, "id long, keys array<string>"), F.col("keys"), F.col("id"), most_local=700).collect()
    assert sorted((r["id"], r["picked"]) for r in got) == walk(chain) and max(r["round"] or 0 for r in got) == 1


def test_picks_of_nothing(spark):
    assert picks.greedy_picks(spark.createDataFrame([], "id long, keys array<string>"), F.col("keys"), F.col("id")).count() == 0


def test_exam_items_fall_back_when_conflicts_leave_too_few(spark):
    pool = spark.createDataFrame([(1, "evaluate", "judge"), (2, "evaluation", "judging"), (3, "ox", "cattle"), (4, "oak", "Cattle."), (5, "run", "x")], "id int, term string, meaning string")
    keys = picks.relative_keys(F.col("term"), F.col("meaning"))
    assert [r["id"] for r in picks.exam_items(pool, 3, keys, F.col("id")).orderBy("place").collect()] == [1, 3, 5]
    assert [r["id"] for r in picks.exam_items(pool, 4, keys, F.col("id")).orderBy("place").collect()] == [1, 2, 3, 4]


def test_flipped_directions(spark):
    cards = spark.createDataFrame([(1, "m2w", ["big"]), (2, "w2m", ["vast"]), (3, "m2w", ["vast", "big"]), (4, "m2w", ["vast"]), (5, "m2w", []), (6, "m2w", None)], "id int, dir string, senses array<string>")
    got = picks.flipped_directions(cards, "dir", F.col("senses"), F.col("id")).collect()
    assert {r["id"]: r["dir"] for r in got} == {1: "m2w", 2: "w2m", 3: "w2m", 4: "m2w", 5: "m2w", 6: "m2w"}


# ---- filters


def plain_hash(s, seed):
    h = seed
    for c in s:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * by) & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_addresses_and_sizes(spark):
    size = bloom.Size(1000, 0.005)
    assert size.bits % 8 == 0 and size.addresses == 8 and bloom.Size(0, 0.01).bits == 8
    words = ["", "a", "naïve", "日本", "x" * 300]
    rows = spark.createDataFrame([(w, "en") for w in words], "word string, lang string")
    got = {r[0]: r[1] for r in rows.select("word", bloom.addresses(F.col("word"), F.col("lang"), size)).collect()}
    for w in words:
        one, two = plain_hash(f"en\x1f{w}", 0x811C9DC5), plain_hash(f"en\x1f{w}", 0x9E3779B1) | 1
        assert got[w] == [(one + i * two) % size.bits for i in range(8)]


def test_filter_loses_nothing_and_has_its_rate(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.split("text", r"\s+")).alias("word")).filter("word <> ''").distinct().cache()
    size = bloom.Size(words.count(), 0.02)
    halves = [words.filter(F.crc32("word") % 2 == k) for k in (0, 1)]
    filter_ = bloom.merged(*[bloom.built(h, size) for h in halves]).cache()
    assert sorted(filter_.collect()) == sorted(bloom.built(words, size).collect())
    assert bloom.probed(words, filter_, size).filter("NOT maybe").count() == 0
    sample = bloom.lettered(words, "abcdefghijklmnopqrstuvwxyz", 4)
    assert sample.join(words, ["lang", "word"]).count() == 0
    n, hits = bloom.measured(sample, filter_, size).agg(F.sum("n"), F.sum("hits")).first()
    assert n > 10_000 and abs(hits / n - size.expected) < 0.2 * size.expected
    none = bloom.probed(words, spark.createDataFrame([], "piece long, bits binary"), size)
    assert none.filter("maybe").count() == 0


def test_lexicon_hits(spark):
    known = spark.createDataFrame([("en", "the"), ("en", "cat"), ("en", "x")], "lang string, word string")
    rows = spark.createDataFrame([(1, "the bat", "the cat"), (2, "the cat", "a cat"), (3, "the", "one two"), (4, "", "a"), (5, "the cat", "the cat"), (6, "x cat", "y cat"), (7, None, None), (8, "cat dog", "cat")], "id int, typed string, source string")
    got = bloom.lexicon_hits(rows, "id", F.col("typed"), F.col("source"), F.lit("en"), known).collect()
    assert dict(got) == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False}


# ---- units


def union(forms):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    by = {}
    for owner, form in forms:
        if owner is not None:
            find(owner)
            if form is not None:
                a, b = find(owner), find(by.setdefault(form, owner))
                root[max(a, b)] = min(a, b)
    return {o: find(o) for o in root}


def test_units_equal_union_find(spark):
    rng = random.Random(5)
    chain = [(1000 + i, f"c{(i * 37) % 101 + d}") for i in range(101) for d in (0, 1)]
    forms = [(rng.randint(0, 300), f"f{rng.randint(0, 350)}") for _ in range(350)] + chain + [(rng.randint(2000, 2999), "hot") for _ in range(300)] + [(None, "hot"), (5000, None), (5001, None), (5000, None)]
    rows = spark.createDataFrame(forms, "owner long, form string").withColumn("unit", F.lit(1))
    assert dict(units.shared_units(rows).collect()) == union(forms)
    assert units.shared_units(rows.limit(0)).count() == 0


def test_no_form_in_two_folds(spark):
    rng = random.Random(6)
    forms = [(rng.randint(0, 400), f"f{rng.randint(0, 600)}") for _ in range(500)]
    rows = spark.createDataFrame(forms, "owner long, form string")
    split = units.leak_free_folds(rows, 4, 0.3)
    met = rows.join(split, "owner").groupBy("form").agg(F.count_distinct("fold", "holdout").alias("n"))
    assert met.filter("n > 1").count() == 0
    assert split.select("fold").distinct().count() == 4 and 0.15 < split.filter("holdout").count() / split.count() < 0.45


def test_dataset_labels(spark):
    forms = spark.createDataFrame([("a", "stone"), ("a", "stones"), ("b", "store"), ("c", "planet"), ("d", "zq"), (None, "ghost"), ("e", None)], "owner string, form string")
    lexicon = spark.createDataFrame([("plane",), ("stoe",)], "word string")
    rows = dataset.labelled_dataset(forms, lexicon, slots=4).collect()
    own = {"a": ["stone", "stones"], "b": ["store"], "c": ["planet"]}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    made = [r for r in rows if not r["kind"].startswith("neg/")]
    assert {r["form"] for r in made} == {"stone", "stones", "store", "planet"} and len(made) >= 12
    for r in made:
        mine = min(distance(r["typed"], f) for f in own[r["owner"]])
        other = min(distance(r["typed"], f) for o, fs in own.items() if o != r["owner"] for f in fs)
        why = "veto" if other == 0 else "ambiguous" if other <= mine and other <= 2 else "real-word" if r["typed"] in ("plane", "stoe") else "novel"
        assert r["why"] in (why, "cross-owner") and r["typed"] not in own[r["owner"]] and (r["label"] == "accept") == (r["why"] == "novel")
    assert ("stone", "store") in {(r["form"], r["typed"]) for r in rows if r["kind"] == "neg/partner"}
    assert {r["form"] for r in rows if r["kind"] == "neg/garbage"} == {"stones", "planet"}


# ---- fitting


def random_items(rng, n, cells=4, axes=3):
    return [(i, rng.random() < 0.6, rng.randint(1, 3), [(rng.randrange(cells), [rng.randint(0, 3) for _ in range(axes)]) for _ in range(rng.randint(0, 3))]) for i in range(n)]


def frame(spark, items):
    return spark.createDataFrame(items, "item long, good boolean, length int, pairs array<struct<cell:int,x:array<long>>>")


def cost(x, w):
    return sum(a * b for a, b in zip(x, w, strict=True))


def brute_score(items, w, grid, cells=4):
    t = []
    for c in range(cells):
        bad = [cost(x, w) for _, good, _, ps in items for cell, x in ps if not good and cell == c]
        free = fitting.FREE if not bad else fitting.snapped_below(min(bad), grid)
        under = [cost(x, w) for _, good, _, ps in items for cell, x in ps if good and cell == c and cost(x, w) <= free]
        t.append(min(free, fitting.snapped_below(max(under) + grid, grid)) if under else 0)
    return t, brute_taken(items, w, t)


def accepts(ps, w, t):
    return any(t[c] > 0 and cost(x, w) <= t[c] for c, x in ps)


def brute_taken(items, w, t):
    out = {}
    for _, good, length, ps in items:
        if good:
            out[length] = out.get(length, 0) + accepts(ps, w, t)
    return out


def test_thresholds_equal_brute_force(spark):
    items = random_items(random.Random(1), 80)
    stats = fitting.Statistics.of(frame(spark, items), 4, 2)
    for w, s in zip(ws := [[1, 1, 1], [0, 3, 1], [5, 0, 0], [0, 0, 0]], fitting.solved(stats, ws), strict=True):
        assert (s.thresholds, s.by_length) == brute_score(items, w, 2)
    none = fitting.Statistics.of(frame(spark, [(1, True, 1, None), (2, True, 1, [])]), 4, 2)
    assert fitting.solved(none, [[1, 1, 1]])[0].thresholds == [0] * 4 and fitting.solved(none, [[1, 1, 1]])[0].taken == 0


def plain_descent(items, seed, grids, rounds, reference=None):
    score = lambda w: fitting.Score(*brute_score(items, w, 2))
    now, held = list(seed), score(seed)
    held = None if held.loses_to(reference) else held
    for _ in range(rounds):
        before = list(now)
        for axis, grid in enumerate(grids):
            pick = now[axis]
            for v in grid:
                if v != now[axis]:
                    s = score([*now[:axis], v, *now[axis + 1 :]])
                    if not s.loses_to(reference) and s.better(held):
                        held, pick = s, v
            now[axis] = pick
        if now == before:
            break
    return now, held


def test_descent_equals_a_plain_walk_and_reaches_the_best_of_a_small_grid(spark):
    rng = random.Random(11)
    items = random_items(rng, 60)
    stats = fitting.Statistics.of(frame(spark, items), 4, 2)
    grids = [[0, 1, 4], [0, 2, 5], [1, 3]]
    got = fitting.fit(stats, [[1, 2, 1]], grids)
    assert (got.weights, got.score) == plain_descent(items, [1, 2, 1], grids, 5)
    # from every point of the grid, the best is that of exhaustive search
    every = list(map(list, itertools.product(*grids)))
    best = max((fitting.Score(*brute_score(items, w, 2)) for w in every), key=lambda s: (s.taken, -s.complexity))
    found = fitting.fit(stats, every[::3], grids).score
    assert (found.taken, found.complexity) == (best.taken, best.complexity)


def test_guard_keeps_every_length(spark):
    rng = random.Random(4)
    items = random_items(rng, 60)
    stats = fitting.Statistics.of(frame(spark, items), 4, 2)
    reference = fitting.Score(*brute_score(items, [1, 1, 1], 2))
    grids = [[0, 1, 4], [0, 1, 5], [0, 1, 3]]
    got = fitting.fit(stats, [[1, 1, 1]], grids, reference=reference)
    assert (got.weights, got.score) == plain_descent(items, [1, 1, 1], grids, 5, reference) and not got.score.loses_to(reference)
    with pytest.raises(ValueError, match="every length"):
        fitting.fit(stats, [[1, 1, 1]], [[], [], []], reference=fitting.Score([0] * 4, {1: 10**6}))


def test_clamping_is_minimal_and_changes_nothing(spark):
    rng = random.Random(9)
    for seed in range(3):
        items = [(i, g, n, ps * (1 if i % 7 else 2)) for i, g, n, ps in random_items(random.Random(seed), 70)]
        w, limits = [1, 2, 1], [rng.choice([0, 4, 6, 8, 10]) for _ in range(4)]
        got = fitting.clamped(frame(spark, items), w, limits, 2)
        expected, before = list(limits), [accepts(ps, w, limits) for *_, ps in items]
        for c in range(4):
            for t in range(0, limits[c] + 1, 2):
                if [accepts(ps, w, [*expected[:c], t, *expected[c + 1 :]]) for *_, ps in items] == before:
                    expected[c] = t
                    break
        assert got == expected


def test_curve_equals_refits(spark):
    items = random_items(random.Random(21), 120)
    w, (limits, _) = [1, 2, 1], brute_score(items, [1, 2, 1], 2)
    doubted = [r for r in items if not r[1] and r[0] % 2]
    rest = [r for r in items if r not in doubted]
    slack = {}
    for i, _, _, ps in doubted:
        open_ = [cost(x, w) - limits[c] for c, x in ps if limits[c] > 0]
        if open_:
            slack[i] = min(open_)
    ranked = sorted(slack, key=lambda i: (slack[i], i))
    shares = [0, 0.1, 0.3, 0.3, 0.7, 1]
    got = fitting.counterfactual(fitting.Statistics.of(frame(spark, rest), 4, 2), frame(spark, doubted), w, limits, shares)
    for share, (k, score) in zip(shares, got, strict=True):
        assert k == int(share * len(doubted) + 0.5)
        left = rest + [r for r in doubted if r[0] not in ranked[:k]]
        assert (score.thresholds, score.by_length) == brute_score(left, w, 2)


def test_acquisition_equals_turns(spark):
    items = random_items(random.Random(31), 100)
    w, limits = [1, 2, 1], [4, 0, 6, 2]
    labelled = [i for i in range(100) if i % 4 == 0]
    cells = {}
    for i, _, _, ps in items:
        if i in labelled or not ps:
            continue
        open_ = [(cost(x, w) - limits[c], c) for c, x in ps if limits[c] > 0]
        least, cell = min((cost(x, w), c) for c, x in ps)
        key = (2, least, i) if not open_ else (int(min(open_)[0] > 0), abs(min(open_)[0]), i)
        cells.setdefault(cell if not open_ else min(open_)[1], []).append(key)
    turns = [k for row in itertools.zip_longest(*[sorted(cells[c]) for c in sorted(cells)]) for k in row if k]
    got = fitting.acquired(frame(spark, items), spark.createDataFrame([(i,) for i in labelled], "item long"), w, limits, 30)
    assert [(r["tier"], r["distance"], r["item"]) for r in got.orderBy("turn").collect()] == turns[:30]


# ---- places within hot keys


def test_rounds_and_ladder_with_a_hot_key(spark):
    from wordloom.operators import progress

    rng = random.Random(17)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"]), i, rng.randint(0, 2), rng.random() < 0.6, rng.random() < 0.5, rng.random() < 0.2) for i in range(900)]
    events = spark.createDataFrame(rows, "u string, t long, attempts int, mastered boolean, first_try boolean, retry boolean")
    got = {r["u"]: r for r in progress.committed(events, ["u"], "t", run=7).collect()}
    for u in {r[0] for r in rows}:
        level, seen, t0, answered = 0, 0, None, False
        for k, (_, t, attempts, mastered, first, retry) in enumerate(x for x in rows if x[0] == u):
            seen += 1
            if attempts > 0:
                right = mastered and first
                if not answered:
                    answered, t0 = True, None if right else t
                if right and not retry:
                    level = 3 if k == 0 else min(level + 1, 3)
                elif not right:
                    level = max(level - 1, 0)
        assert (got[u]["seen"], got[u]["level"], got[u]["t0"]) == (seen, level, t0), u
    bands = {r["u"]: r["band"] for r in progress.ladder(events.withColumn("right", F.col("mastered")), "u", "right", "t", run=5).collect()}
    for u in bands:
        band = 3
        for r in rows:
            if r[0] == u:
                band = min(max(band + (1 if r[3] else -1), 1), 6)
        assert bands[u] == band


def test_nearest_words(spark):
    from wordloom.operators import fuzzy

    words = spark.createDataFrame([("cat",), ("cot",), ("coat",), ("dog",), ("cats",)], "w string")
    rows = spark.createDataFrame([(1, "cat"), (2, "cat"), (3, "zzzzz"), (4, None)], "id int, q string")
    got = {r["id"]: r["nearest"] for r in fuzzy.nearest_words(rows, "q", words, "w", keep=3).collect()}
    assert got == {1: ["cat", "cot", "cats"], 2: ["cat", "cot", "cats"]}
