"""The answer matcher against plain walks, and records of progress against plain folds."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.operators import bank, fuzzy, progress
from wordloom.queries_match import RULES


def walk(a, b, left=3):
    """All alignments, by trying every edit at every place: {counts: earliest edited place}."""
    hebrew = any("֐" <= c <= "׿" for c in a + b)
    found = {}

    def kind(s, i, plain):
        if hebrew and s[i] in "וי":
            return "materVI"
        return "doubleLetter" if s[i] in (s[i - 1 : i] + s[i + 1 : i + 2]) else plain

    def go(i, j, left, used, first):
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if (i, j) == (len(a), len(b)):
            v = tuple(used.count(k) for k in fuzzy.KINDS)
            found[v] = min(first, found.get(v, first)) if first >= 0 else first
            return
        if not left:
            return
        at = i if first < 0 else first
        if a[i : i + 2] == b[j : j + 2][::-1] and len(a[i : i + 2]) == 2:
            go(i + 2, j + 2, left - 1, [*used, "transpose"], at)
        if i < len(a) and j < len(b):
            k = "homophone" if hebrew and b[j] in fuzzy.HOMOPHONES.get(a[i], "") else "adjSub" if not hebrew and b[j] in S.KEY_NEIGHBOURS.get(a[i], "") else "sub"
            go(i + 1, j + 1, left - 1, [*used, k], at)
        if i < len(a):
            go(i + 1, j, left - 1, [*used, kind(a, i, "del")], at)
        if j < len(b):
            go(i, j + 1, left - 1, [*used, kind(b, j, "ins")], at)

    go(0, 0, left, [], -1)
    return sorted((v, p) for v, p in found.items() if not any(u != v and all(x <= y for x, y in zip(u, v, strict=True)) for u in found))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_alignments_equal_a_plain_walk():
    rng = random.Random(1)
    words = ["", "late", "fought", "bought", "teenth", "tenth", "difference", "differejce", "kqvv", "uuuf", "unit", "שלום", "שולם", "תוכוחה", "תוכחה", "טוב", "תוב"]
    words += ["".join(rng.choice("abqw") for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    for a, b in itertools.product(words, repeat=2):
        assert fuzzy.alignments(a, b) == walk(a, b), (a, b)


def test_costs_of_known_pairs(spark):
    w = F.array(*[F.lit(float(RULES["weights"][k])) for k in fuzzy.KINDS])
    rows = spark.createDataFrame([("teh", "the"), ("thee", "the"), ("kqvv", "late"), ("the", "the"), (None, "a")], "a string, b string")
    out = {r["a"]: r["c"] for r in fuzzy.edit_vectors(rows, "a", "b").select("a", fuzzy.weighted_cost(F.col("vectors"), w).alias("c")).collect()}
    assert out == {"teh": 1.0, "thee": 0.3, "kqvv": None, "the": 0.0, None: None}


def brute_match(typed, owner, candidates, forms, lexicon, r):
    letters = lambda s: len(s.replace(" ", ""))
    owners = {o for f, o in forms if f == typed}
    if owners - {owner} and typed not in candidates:
        return False, "collision", None
    own = {p for c in candidates for p in c.split(" ") if p}
    if typed not in candidates:
        for c in candidates:
            t, s = ([x for x in y.split(" ") if x] for y in (typed, c))
            ask = [x for x, y in zip(t, s, strict=True) if x != y] if len(t) == len(s) else t
            if ask and not any(x in own for x in ask) and all(len(x) >= 2 and x in lexicon for x in ask):
                return False, "real-word", None
    if letters(typed) < r["min_len"]:
        return False, "short", None
    if not candidates:
        return False, "far", None
    if r["word"] and any(typed.startswith(c) and len(typed) > len(c) and typed[len(c) :] in fuzzy.ENDINGS for c in candidates):
        return False, "inflection", None
    scored = sorted((edits(typed, c), letters(c), c) for c in candidates if edits(typed, c) <= 3)
    if not scored:
        return False, "far", None
    others = [edits(typed, f) for f, o in forms if o != owner]
    gap = min([x for x in others if x <= fuzzy.RADIUS], default=fuzzy.RADIUS + 1) - min(edits(typed, c) for c in candidates)
    tight = r["margin_soft"] > r["margin_hard"] and gap < r["margin_soft"]
    bands, weights = (r["bands_tight"], r["weights_tight"]) if tight else (r["bands"], r["weights"])
    first, share = (r["first_tight"], r["share_tight"]) if tight else (r["first"], r["share"])
    best = None
    for _, n, c in scored[:8]:
        t = next((t for most, t in bands if n <= most), bands[-1][1])
        if t > 0:
            common = sum(min(typed.count(x), c.count(x)) for x in set(typed)) / max(len(typed), len(c), 1)
            costs = [share * (1 - common) + (first if p == 0 else 0) + sum(k * weights[o] for k, o in zip(v, fuzzy.KINDS, strict=True)) for v, p in walk(typed, c)]
            d = min(costs, default=99)
            if d <= t and (best is None or d < best):
                best = d
    if best is None:
        return False, "far", None
    if r["margin_hard"] > 0 and gap < r["margin_hard"]:
        return False, "collision", None
    return True, None, round(best, 6)


def test_near_match_equals_brute_force(spark):
    rng = random.Random(2)
    names = ["bought", "fought", "tenth", "tent", "speak", "speck", "difference", "large widget", "small widget", "in part", "on part", "house"]
    forms = [(n, f"o{i % 7}") for i, n in enumerate(names)]
    lexicon = {"on", "in", "part", "spear", "houses", "widget", "small", "rough"}
    rows = []
    for n, o in forms:
        for typed in {n, n[1:], n + n[-1], n[:2] + n[1:], n + "s", n.replace("e", "r"), n[1] + n[0] + n[2:], "spear", "", "zzz", "on part", rng.choice(names)}:
            rows.append((len(rows), typed, o, [n]))
    rows += [(len(rows), "tenht", "o2", ["tenth", "tent"]), (len(rows) + 1, "x", "o1", None)]
    df = spark.createDataFrame(rows, "id long, typed string, owner string, candidates array<string>")
    out = fuzzy.near_match(df, spark.createDataFrame(forms, "form string, owner string"), spark.createDataFrame([(w,) for w in lexicon], "word string"), RULES)
    got = {r["id"]: (r["ok"], r["why"], None if r["dist"] is None else round(r["dist"], 6)) for r in out.collect()}
    want = {i: brute_match(t, o, c or [], forms, lexicon, RULES) for i, t, o, c in rows}
    assert got == want
    assert {x[1] for x in want.values()} >= {None, "collision", "real-word", "far", "inflection"}


@pytest.mark.parametrize(("a", "b", "d"), [("ca", "abc", 3), ("ab", "ba", 1), ("", "abc", 3), ("abc", "abc", 0), ("abcd", "acbd", 1)])
def test_osa(a, b, d):
    assert fuzzy.osa_distance(a, b) == d


def test_why_rejected(spark):
    rows = spark.createDataFrame([("", "x"), ("widgett", "widget, tool"), ("tool", "a widget, tool"), ("case", "a widget (in a case)"), ("zzzz", "")], "t string, m string")
    out = [r["w"]["why"] for r in rows.select(fuzzy.why_rejected(F.col("t"), F.col("t"), S.senses(F.col("m")), F.col("m")).alias("w")).collect()]
    assert out == ["empty", "typo", "exact", "in-gloss", "no-target"]


def one(spark, f, *values):
    kinds = {str: "string", int: "int", list: "array<string>"}
    df = spark.createDataFrame([values], ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values)))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, S.pointed_key, "  בְּאִיבּוֹ־שָׁלוֹם ") == "באיבו שלומ"
    assert one(spark, S.folded, "תיקוון") == "תקנ"
    assert one(spark, S.senses, "hollow, empty (not: full). also: vain... and - thin") == ["hollow", "empty", "also", "vain... and", "thin"]
    assert one(spark, lambda c: S.senses(c, ["also"]), "also") == ["also"]
    assert one(spark, lambda a, b: S.subsequence_share(a, b), "abc", "xaybz") == pytest.approx(2 / 3)
    assert one(spark, S.wiki_text, "{{a|{{b}}}} [[x|y]] ''z''") == "y z"
    assert one(spark, lambda c: S.edit_ball(c, "ab"), "ab") == sorted({"b", "a", "ba", "bb", "aa", "aab", "bab", "abb", "aba"})
    assert one(spark, lambda c: S.clamped(c, 7), "-3") == 0 and one(spark, lambda c: S.clamped(c, 7), "9.9") == 7 and one(spark, S.clamped, "x") == 0
    assert one(spark, lambda t, w: S.filled(t, w), "a ____ b ____ c ____", ["1", "2"]) == "a 1 b 2 c ____"


def test_commit_of_a_long_history_equals_a_fold(spark):
    rng = random.Random(3)
    rows = [("k" if i % 3 else "hot", i, rng.randrange(3), rng.random() < 0.6, rng.random() < 0.5, rng.random() < 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, attempts int, mastered boolean, first_try boolean, retry boolean")
    out = {r["k"]: r.asDict() for r in progress.committed(df, ["k"], "t", run=7).collect()}
    for k in ("k", "hot"):
        s = {"seen": 0, "first": 0, "ever": 0, "wrong": 0, "level": 0, "last": None, "t0": None}
        for _, t, attempts, mastered, first_try, retry in (r for r in rows if r[0] == k):
            new = s["seen"] == 0
            s["seen"], s["last"] = s["seen"] + 1, t
            if not attempts:
                continue
            if s["t0"] is None and s["first"] + s["ever"] + s["wrong"] == 0 and not (mastered and first_try):
                s["t0"] = t
            if mastered and first_try:
                s["first"], s["ever"] = s["first"] + 1, s["ever"] + 1
                s["level"] = s["level"] if retry else 3 if new else min(3, s["level"] + 1)
            else:
                s["ever"] += mastered
                s["wrong"] += max(0, attempts - 1) if mastered else 1
                s["level"] = max(0, s["level"] - 1)
        assert {c: out[k][c] for c in s} == s


def test_merge_takes_the_later_side_and_caps_clocks(spark):
    schema = "k string, seen int, first int, ever int, wrong int, level int, last timestamp, t0 timestamp, src string, sens array<int>, k0 int"
    from datetime import datetime, timedelta

    now = datetime(2024, 1, 10)
    rec = lambda k, level, last, t0=None, src=None, sens=None: (k, level, 1, 1, 1, level, last, t0, src, sens, None)
    local = spark.createDataFrame([rec("a", 1, now), rec("b", 3, now + timedelta(days=2)), rec("c", 2, now, now, None, [3, 1])], schema)
    remote = spark.createDataFrame([rec("a", 2, now), rec("b", 1, now + timedelta(days=1)), rec("c", 1, now - timedelta(days=1), now - timedelta(days=3), None, [2]), rec("d", 0, now, None, "lv"), rec("e", 0, now, None, "lv")], schema)
    out = {r["k"]: r for r in progress.merged(local, remote, ["k"], F.lit(now), spark.createDataFrame([("d",)], "k string")).collect()}
    assert set(out) == {"a", "b", "c", "e"} and out["a"]["level"] == 1 and out["a"]["seen"] == 2
    assert out["b"]["level"] == 3 and out["b"]["last"] == now + timedelta(minutes=5)
    assert out["c"]["t0"] == now - timedelta(days=3) and out["c"]["sens"] == [1, 2, 3] and out["e"]["src"] == "lv" and out["e"]["last"] == now


def test_guards(spark):
    key = spark.createDataFrame([(1, "a"), (2, "b")], "q int, k string")
    with pytest.raises(Exception, match="same items"):
        bank.complete_join(key.limit(1).select("q"), key, "q").collect()
    state = spark.createDataFrame([("x",), ("gone",)], "k string")
    assert bank.pruned(state, spark.createDataFrame([("x",)], "k string"), "k").count() == 2  # a bank of one item is broken
    assert [r[0] for r in bank.pruned(state, spark.createDataFrame([("x",)], "k string"), "k", 1).collect()] == ["x"]


@pytest.mark.parametrize("letters", ["abs", "אעבוי"])
def test_banded_costs_equal_all_alignments(letters):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(0, 9)))
    pairs = [(word(), word()) for _ in range(1500)] + [("", ""), ("abc", "abc"), ("a" * 40, "a" * 42), ("x" * 30, "y")]
    weights = np.array([[rng.choice([0.1, 0.5, 1.0, 2.5]) for _ in fuzzy.KINDS] for _ in pairs])
    start = np.array([rng.random() for _ in pairs])
    want = [min((s + sum(k * x for k, x in zip(v, w, strict=True)) for v, _ in fuzzy.alignments(a, b)), default=np.nan) for (a, b), w, s in zip(pairs, weights, start, strict=True)]
    a, b = map(list, zip(*pairs, strict=True))
    every = fuzzy.banded_costs(a, b, weights, start, np.full(len(a), 99.0))
    assert np.allclose(every, want, equal_nan=True)
    limited = fuzzy.banded_costs(a, b, weights, start, np.full(len(a), 2.0))
    assert np.allclose(limited, [x if x <= 2.0 else np.nan for x in want], equal_nan=True)


def test_near_match_of_hot_answers(spark):
    """A third of all answers are one word, another third are null or empty; each gets what it gets alone."""
    rows = [(i, ["tenht", "house", None, "", "hous", "fought"][i % 6] if i % 3 else "size", f"o{i % 3}" if i % 7 else None, ["tenth", None, "house"] if i % 5 else None) for i in range(300)]
    forms = spark.createDataFrame([("tenth", "o1"), ("house", "o2"), ("fought", "o2"), ("fought", "o0"), ("sizes", None)], "form string, owner string")
    df = spark.createDataFrame(rows, "id long, typed string, owner string, candidates array<string>")
    out = {r["id"]: tuple(r)[1:] for r in fuzzy.near_match(df, forms, spark.createDataFrame([("size",)], "word string"), RULES).collect()}
    assert sorted(out) == list(range(300))
    by_key = {}
    for i, t, o, c in rows:
        by_key.setdefault((t, o, str(c)), set()).add(out[i])
    assert all(len(x) == 1 for x in by_key.values())
    assert fuzzy.near_match(df.limit(0), forms, forms.select(F.col("form").alias("word")), RULES).count() == 0


def test_distances_of_an_answer_are_worked_out_once(spark, sf):
    from wordloom.queries import QUERIES

    for name in ("diag_why", "credit_sense"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("levenshtein(") == 1 and plan.count("regexp_replace(") == 1
