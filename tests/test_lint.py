"""The gloss linter on made glosses, one for each fault."""

from wordloom.operators import lint

STOPS, CONJUNCTION = ["אשר"], "^(and) |^ו[א-ת]"

CASES = [
    ("cat", "feli", "a small animal", set()),
    ("cat", None, None, {"empty"}),
    ("cat", None, "  ְ ", {"empty"}),
    ("cat", None, "a Cat that purrs", {"circular"}),
    ("cat", None, "an animal (the cat sat)", set()),
    ("cat nap", None, "a short nap", set()),
    ("cat nap", None, "nap of a cat", {"circular"}),
    ("אשר", None, "מילה אשר באה", set()),
    ("מכאוב", "כאב", "כאבים עזים", {"rootecho"}),
    ("x", "a-b", "a-b", set()),
    ("long", None, "word " * 14, {"toolong", "repeat"}),
    ("open", None, "a way (in", {"parens"}),
    ("all", None, "(for example)", {"parens"}),
    ("two", None, "first (one; other)", {"parens"}),
    ("more", None, "first (one) then (other)", {"parens"}),
    ("fits", None, "first (one); then (other)", set()),
    ("again", None, "to be or not to be or else", {"repeat"}),
    ("stop", None, "ends here.", {"punct"}),
    ("dash", None, "this — that", {"punct"}),
    ("gap", None, "this ,that", {"punct"}),
    ("piece", None, "whole; and part", {"fragment"}),
    ("vav", None, "שלם; וחלק", {"fragment"}),
    ("first", None, "ויכוח; ריב", set()),
    ("points", None, "שָׁלוֹם", {"niqqud"}),
    ("hyphen", None, "אי־נוחות", set()),
]


def test_each_fault(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, word string, root string, gloss string")
    got = {i: set() for i in range(len(CASES))}
    for r in lint.gloss_faults(df, STOPS, CONJUNCTION).collect():
        got[r["id"]].add(r["rule"])
    assert [(CASES[i], x) for i, x in got.items() if x != CASES[i][3]] == []
    assert set().union(*got.values()) == {"empty", "circular", "rootecho", "toolong", "parens", "repeat", "punct", "fragment", "niqqud"}


def test_shared_glosses_on_a_hot_gloss(spark):
    """A third of all rows have one gloss; only the first keeps it. Senses of another word are shared, one's own aren't."""
    rows = [(i, f"w{i % 7}", None, "the same old thing" if i % 3 == 0 else f"gloss of number {i}; {'common sense' if i % 30 == 1 else 'own sense ' + str(i)}") for i in range(300)]
    rows += [(900, "w1", None, "other; common sense"), (901, "z", None, None)]
    df = spark.createDataFrame(rows, "id long, word string, root string, gloss string")
    want, seen, owner = set(), {}, {}
    for i, w, _, g in rows:
        if g is None:
            continue
        parts = [x.strip() for x in g.split(";")]
        if g in seen or any(owner.get(x, w) != w for x in parts if len(x) >= 6):
            want.add(i)
        seen.setdefault(g, i)
        for x in parts:
            owner.setdefault(x, w)
    assert {r["id"] for r in lint.shared_glosses(df).collect()} == want
    assert lint.gloss_problems(df.limit(0), STOPS, CONJUNCTION).count() == 0


def test_shared_glosses_sort_no_senses_to_add_them_up(spark):
    rows = spark.createDataFrame([(1, "a", "old house; long " + "x" * 60), (2, "b", "old house"), (3, "a", "old house"), (4, None, "long " + "x" * 60), (5, "c", "new thing"), (6, None, "new thing; other"), (7, "c", "new thing")], "id long, word string, gloss string")
    found = lint.shared_glosses(rows)
    assert sorted(r["id"] for r in found.collect()) == [2, 3, 4, 6, 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "regexp_replace" not in plan
