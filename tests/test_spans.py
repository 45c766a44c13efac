"""Word forms, templates, transliteration, nested markup and spans against plain walks."""

import re

import pytest
from pyspark.sql import functions as F

from wordloom.functions import morphology as M
from wordloom.functions.scalars import soft_match
from wordloom.operators import spans


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def plain_templates(s, labels):
    found, out, stack, i = [], [], [], 0
    while i < len(s):
        if s.startswith("{{", i):
            stack.append("")
            i += 2
        elif s.startswith("}}", i) and stack:
            parts = [p.strip() for p in stack.pop().split("|")]
            if parts[0] in labels:
                found.append(" ".join(p for p in parts if p))
            i += 2
        else:
            if stack:
                stack[-1] += s[i]
            else:
                out.append(s[i])
            i += 1
    return "".join(out), found


def test_nested_templates(spark):
    deep = "{{lb|" * 50 + "x" + "}}" * 50
    texts = ["", "plain", "a {{lb|en|old}} b", "{{x|{{lb|en| rare }}|y}}z", deep + " end", "open {{lb|never", "}} stray }}} {{", "{{{lb|a}}}", "{{lb}}", "a{{q|b}}c{{lb| |d}}e", "{{lb| x}}"]
    got = column(spark, texts, lambda c: M.without_templates(c, ("lb", "q")))
    assert [(r["text"], list(r["labels"])) for r in got] == [plain_templates(t, ("lb", "q")) for t in texts]
    assert column(spark, [None], M.without_templates)[0]["text"] == ""


def test_nested_templates_take_time_in_proportion(spark):
    """Appending each piece to what stands so far copied a long text's beginning for every piece."""
    import time

    text = "a{b}{{lb|x\u2003}}" * 100_000
    rows = spark.createDataFrame([(text,)], "t string").select(M.without_templates(F.col("t"), ("lb",)).alias("r"))
    rows.select("r.labels").first()
    start = time.time()
    found = rows.first()["r"]
    assert time.time() - start < 30
    assert found["text"] == "a{b}" * 100_000 and found["labels"] == ["lb x"] * 100_000


HEBREW_WORDS = ["פשט", "התפשט", "לפשוט", "להתפשט", "פשיטה", "מרד", "מורד", "מרדנ", "עייפ", "נשבר", "שבר", "הפליג", "הפלגה", "אאא", "שומר", "שמור", "", "ab", "נננ"]


def plain_root(word, template, strict):
    if len(word) != len(template):
        return None
    slot = {}
    for t, c in zip(template, word, strict=True):
        if t in "1234":
            if slot.setdefault(t, c) != c:
                return None
        elif t != c:
            return None
    if strict and any(c in "אהוי" for c in slot.values()):
        return None
    return "".join(slot[k] for k in sorted(slot))


@pytest.mark.parametrize("strict", [False, True])
def test_template_keys_and_partners_equal_matching(spark, strict):
    pairs = (*M.PATTERN_PAIRS, ("twice", "1213", "123"))
    words = [*HEBREW_WORDS, "אבאג"]
    keys = column(spark, words, lambda c: M.template_keys(c, pairs, strict))
    for w, k in zip(words, keys, strict=True):
        assert {(x["pair"], x["side"], x["root"]) for x in k} == {(n, s, r) for n, *both in pairs for s, t in zip("ab", both, strict=True) if (r := plain_root(w, t, strict))}
    partners = column(spark, words, lambda c: M.template_partners(c, pairs, strict))
    fill = lambda t, r: "".join(r[int(c) - 1] if c in "1234" else c for c in t)
    for w, p in zip(words, partners, strict=True):
        want = {fill(y, r) for _, a, b in pairs for x, y in ((a, b), (b, a)) if (r := plain_root(w, x, strict))} - {w}
        assert set(p) == {x for x in want if not set(x) & set("ךםןףץ")}
    with pytest.raises(ValueError, match="from 1 on"):
        M.template_pattern("2a")


def test_transliteration(spark):
    rows = spark.createDataFrame([("דרסטי", "drastic", True), ("אורגני", "organic", True), ("אסטרטגיה", "strategy", True), ("גדול", "big", False), ("בד", "bd", False), (None, "x", False), ("אבבא", "aeiou", False), ("גדולה", None, False)], "m string, t string, want boolean")
    assert all(r[0] == r[1] for r in rows.select(M.transliterates(F.col("m"), F.col("t")), "want").collect())


# ---- graded spans


def test_word_places_need_little_memory():
    """A batch has up to 10,000 texts; as dicts their words' places took some hundred bytes each."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"Word {i} has 'its' place, éx a{i}b " * 20 for i in range(3000)] + [None, ""])
    tracemalloc.start()
    found = spans.placed(texts, re.compile("[A-Za-z']+"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
    for i in (0, 63, 64, 2999):
        assert found[i].as_py() == [{"w": m[0].lower(), "s": m.start(), "e": m.end()} for m in re.finditer("[A-Za-z']+", texts[i].as_py())]
    assert found[3000].as_py() is None and found[3001].as_py() == []


def test_graded_spans_send_no_keys_through_the_driver(spark):
    items = spark.createDataFrame([(1, "old house", "an old house")], "id long, gloss string, text string")
    assert "Broadcast" not in spans.graded_spans(items, M.ENGLISH)._jdf.queryExecution().executedPlan().toString()


def plain_span(gloss, text, m):
    cut = lambda w, affixes, front: [w, *[w[len(a) :] if front else w[: -len(a)] for a in affixes if (w.startswith(a) if front else w.endswith(a)) and len(w) - len(a) >= 3][:1]]
    bare = lambda w: (lambda b: b if len(b) >= 3 else None)("".join(m.finals[1][m.finals[0].index(c)] if c in m.finals[0] else c for c in w if c not in m.weak))

    def level(g, t, inside):
        if not inside and (t in m.stop or (t in m.numbers and g not in m.numbers)):
            return None
        if g == t:
            return 0
        base = [g] + ([g[1:]] if m.lemma_prefix and g.startswith(m.lemma_prefix) and len(g) >= 4 else [])
        gs = {y for x in base for y in cut(x, m.suffixes, False)}
        ts = {y for x in cut(t, m.prefixes, True) for y in cut(x, m.suffixes, False)}
        if any(len(x) >= 3 and x in ts for x in gs):
            return 1
        return 2 if {bare(x) for x in gs} & {bare(x) for x in ts} - {None} else None

    tokens = [(x[0].lower(), x.start(), x.end()) for x in re.finditer(f"{m.letters}+", text or "")]
    cand = []
    for si, sense in enumerate([s.strip(" ") for s in re.split("[;,]", gloss or "") if s.strip(" ")]):
        gw = [g for g in re.split(r"\s+", sense.lower()) if len(g) >= 2 and re.search(m.letters, g)]
        if len(gw) > 1:
            for i in range(len(tokens) - len(gw) + 1):
                lv = [level(g, tokens[i + j][0], True) for j, g in enumerate(gw)]
                if None not in lv:
                    cand.append((-len(gw), max(lv), si, tokens[i][1] - tokens[i + len(gw) - 1][2], tokens[i][1], tokens[i + len(gw) - 1][2]))
        for t, s, e in tokens if gw else ():
            if (lv := level(gw[0], t, False)) is not None:
                cand.append((-1, lv, si, s - e, s, e))
    if not cand:
        return None
    b = min(cand)
    if b[1] and any(c[5] <= b[4] or c[4] >= b[5] for c in cand):
        return None
    return b[4], b[5], spans.GRADES[b[1]], b[2], -b[0]


def test_graded_spans(spark):
    hebrew = [
        ("מסוגל, יכול", "אחרי האימונים, הוא היה מסוגל להרים משקולות כבדות."), ("ליד, בערך; אודות", "הפגישה תתחיל בעוד בערך שעה, אז תתכונן עכשיו."), ("לאחד", "החברה איחדה שלושה משרדים למטה מרכזי אחד."),
        ("שלישי", "בפעם השלישית שהוא התקשר, היא ענתה לטלפון."), ("שני", "השנה הייתה טובה מאוד לכולם ברחבי המדינה."), ("על", "הספר נמצא על השולחן במטבח הקטן שלנו."), ("להוציא כסף", "הוא הוציא כסף על דברים שלא היה צריך בכלל."),
        (None, "x"), ("", ""), ("כל הזמן", None),
    ]
    english = [("spend money; cost", "They were spending money, costs rose and spend"), ("walk", "He walks; she walked"), ("one", "one day"), ("of", "one of us"), ("run fast", "fast run, run fast"), ("paint the house", "repainted the houses"), ("stone", "Unstoned stane"), ("a b; cd", "cd cd")]
    for m, cases in ((M.HEBREW, hebrew), (M.ENGLISH, english)):
        items = spark.createDataFrame([(i, g, t, 1) for i, (g, t) in enumerate(cases)], "id int, gloss string, text string, start int")
        got = {r["id"]: r for r in spans.graded_spans(items, m).collect()}
        assert len(got) == len(cases)
        for i, (g, t) in enumerate(cases):
            r = got[i]
            assert (None if r["start"] is None else (r["start"], r["end"], r["grade"], r["sense"], r["words"])) == plain_span(g, t, m), (g, t)
    found = [None if (s := plain_span(g, t, M.HEBREW)) is None else t[s[0] : s[1]] for g, t in hebrew[:7]]
    assert found == ["מסוגל", "בערך", None, "השלישית", None, None, "הוציא כסף"]


def test_phrase_parts(spark):
    def equal(a, b):
        return soft_match(a, b, {"went": "go"})

    cases = [("look up", "He looked it up, then looks up", [(22, 30)]), ("take (off)", "Off they take", [(9, 13)]), ("give back", "give it right back", [(0, 4), (14, 18)]), ("go", "She went", [(4, 8)]), ("back give", "give back", None), ("x2/give", "give", [(0, 4)]), ("", "a", None), (None, None, None), ("a b c", "a b", None)]
    items = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "id int, phrase string, text string")
    got = {r["id"]: None if r["parts"] is None else [tuple(p) for p in r["parts"]] for r in spans.phrase_parts(items, equal).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_cascade_tiers(spark):
    from wordloom.operators import cascade

    bank = spark.createDataFrame([("ספר", ["ספר"]), ("נק(וד)ה", ["נקד"]), ("שולחן", []), ("בית ספר", []), ("אב", ["אב"]), ("מרד", None)], "word string, roots array<string>")
    cases = [("ספר", "full", "ספר"), ("והספר", "full", "ספר"), ("ספרים", "full", "ספר"), ("הספרות", "full", "ספר"), ("שלחן", "full", "שולחן"), ("נקודה", "full", "נק(וד)ה"), ("מספרה", "close", "ספר"), ("בית ספר", "full", "בית ספר"), ("ובית ספר", "full", "בית ספר"), ("ספר גדול", "close", "ספר"), ("של ספרן", "close", "ספר"), ("xyz", "miss", None), ("", "miss", None), (None, "miss", None), ("אב טוב", "miss", None)]
    items = spark.createDataFrame([(i, x, 1) for i, (x, *_) in enumerate(cases)], "id int, item string, word int")
    got = {r["id"]: (r["tier"], r["hit"]) for r in cascade.match_items(items, bank, ("של",)).collect()}
    assert got == {i: (tier, hit) for i, (_, tier, hit) in enumerate(cases)}
    shares = cascade.tier_shares(cascade.match_items(items, bank).withColumn("exam", F.lit("x")), "exam").first()
    assert (shares["items"], shares["full"], shares["covered"]) == (15, 5333, 7333)
    assert cascade.match_items(items.limit(0), bank).count() == 0
