"""Personal data by candidate spans and boosted trees, in DataFrame functions throughout.

1. *Base spans*: patterns with checks (octets, Luhn, digit counts). They always stay.
2. *Generators* propose further spans, with high recall, from the text outside base spans: written-out or bracketed
   e-mail addresses and IP numbers, card numbers inside longer digit runs or with other separators, phone numbers without
   a plus sign; and with them version numbers, dates, hexadecimal tokens and other digit groups.
3. *Boosted trees* of depth two score proposals from small-integer format and context features. They learn from what is
   certain. Every base span that passes its check is written anew in its own surroundings, the way people hide such data
   ("at" and "dot", brackets, other separators, no plus sign): what the generators propose there, and base spans themselves,
   are positive. Negative are decoys in the same surroundings that pass the check as well: sentences with "at" and "dot", versions,
   dates, hexadecimal tokens. Whether a card number passes is chance, so those that fail, as found or made, stand for what passes
   by chance. Proposals of unknown kind aren't learnt from. As features are small integers, one aggregation counts each
   (features, label), and the trees are fitted on those counts.
4. *Thresholds* are calibrated for each kind on a fifth of the documents that the trees did not see. Shares of positives by
   score are made monotone by pooling neighbours; the threshold is the border below the lowest pool that has at least
   ``PRECISION``. Proposals from there on become spans if they pass the check and overlap no base span.

Scores are SQL expressions (sums of CASE), so text never leaves the JVM, and nothing is shuffled but counts.

Defined results: a null or empty text has no spans; positions are code points; repeated rows get equal rows; overlapping
spans of different kinds all stay; an empty table gives an empty result and fits no trees; with no passed match of a
kind, its proposals are dropped.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: Base patterns. They match what the plain forms match, but start only where a run starts (or the last match ended) and
#: never give back, so long runs cost linear time: no character of a repeated class can begin what follows it.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_AT, _DOT = r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?)", r"(?:\.|\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?)"

#: Wide: version numbers, dates, hexadecimal tokens, parts of longer digit runs and the like are proposed as well.
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}{_HOST}++(?:{_DOT}{_HOST}++)*+|\x20at\x20{_HOST}++(?:\x20dot\x20{_HOST}++)++)",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{2,5}}(?![0-9])",
    "card": r"[0-9](?:[\x20./_-]?[0-9]){11,18}",
    "phone": r"(?<![0-9])(?:\+|00)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20./-]{0,2}(?:\([0-9]{2,4}\)|[0-9]{2,4})){2,5}(?![0-9])",
}

#: Marks around matches; a text's own characters of these kinds are replaced before (positions stay).
_MARK, _PLAIN, _HOLE = "\x01", "\x02", "\x03"

#: Trees, learning rate, share of calibration matches that must have passed; folds, of which one calibrates.
ROUNDS, RATE, PRECISION, FOLDS = 20, 0.4, 0.9, 5

FEATURES = ("digits", "checked", "marks", "before", "after", "length", "groups")

#: What the trees may use: all but whether the check is passed.
USED = tuple(f for f in FEATURES if f != "checked")


def _pieces(text: Column, pattern: str, need: str | None) -> Column:
    """The text split so that the second, fourth, ... piece is a match."""
    wanted = text.contains(need) if need else text.rlike("[0-9][\\x20-]?[0-9]")
    return F.when(wanted, F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)).otherwise(F.array(text))


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _checked(kind: str, s: Column) -> Column:
    """Whether a match passes its kind's check, read from its digits."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_replace(s, "[^0-9]+", ".").rlike(_OCTETS)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def _label(kind: str, s: Column) -> Column:
    """What the trees learn: the check, for e-mail (whose check is the pattern) whether the last label can be a top one."""
    if kind == "email":
        return s.rlike("[^A-Za-z0-9-](?:[A-Za-z]{2,}|[Xx][Nn]--[A-Za-z0-9-]+)$")
    return _checked(kind, s)


def _side(c: Column) -> Column:
    """A neighbouring character's class: 0 none or white space, 1 punctuation, 2 letter, 3 digit."""
    return F.when(c.rlike("^[0-9]$"), 3).when(c.rlike("^\\p{L}$"), 2).when(c.rlike("^[^\\s\\x01-\\x03]$"), 1).otherwise(0)


_MATCH = "array<struct<start:int,end:int,digits:int,checked:int,label:int,marks:int,before:int,after:int,length:int,groups:int>>"


def _matches(pieces: Column, kind: str) -> Column:
    """array<struct<start,end,features...>> of the even pieces. One pass sums lengths, so positions are code points."""
    lengths = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    zipped = F.arrays_zip(pieces.alias("s"), lengths.alias("start"), F.array_append(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.lit("")).alias("next"), F.array_prepend(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.lit("")).alias("last"))
    odd = F.filter(zipped, lambda x, i: (i % 2 == 1) & x["s"].isNotNull())  # there is one length more than pieces

    def features(x: Column) -> Column:
        s = x["s"]
        n = F.length(F.regexp_replace(s, "[^0-9]", ""))
        return F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(s)).alias("end"),
            F.least(n, F.lit(24)).alias("digits"),
            F.coalesce(_checked(kind, s), F.lit(False)).cast("int").alias("checked"),
            F.coalesce(_label(kind, s), F.lit(False)).cast("int").alias("label"),
            F.least(F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")), F.lit(9)).alias("marks"),
            _side(F.right(x["last"], F.lit(1))).alias("before"),
            _side(F.left(x["next"], F.lit(1))).alias("after"),
            F.least(F.floor(F.length(s) / 4).cast("int"), F.lit(9)).alias("length"),
            F.least(F.size(F.split(s, "[^A-Za-z0-9]+")), F.lit(9)).alias("groups"),
        )

    return F.when(F.size(pieces) > 1, F.transform(odd, features)).otherwise(F.array().cast(_MATCH))


def _hidden(kind: str, s: Column, turn: Column) -> Column:
    """A passed match as people hide it, one of three ways."""
    host = F.substring_index(s, "@", -1)
    local = F.substring_index(s, "@", 1)
    digits = F.regexp_replace(s, "[^0-9]", "")
    in_fours = lambda mark: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{mark}")
    rest = F.substring(s, F.lit(2), F.length(s))
    ways = {
        "email": (F.concat(local, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))), F.concat(local, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot "))), F.concat(local, F.lit("(at)"), host)),
        "ip": tuple(F.replace(s, F.lit("."), F.lit(x)) for x in ("[.]", "(.)", " [dot] ")),
        "card": tuple(in_fours(x) for x in ("./_")),
        "phone": (rest, F.concat(F.lit("00"), rest), F.regexp_replace(rest, "[^0-9]+", ".")),
    }[kind]
    return F.when(turn == 0, ways[0]).when(turn == 1, ways[1]).otherwise(ways[2])


def _decoy(kind: str, s: Column, turn: Column) -> Column:
    """Something like a passed match that is no personal data, one of three ways."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    at = lambda i: F.substring(F.concat(digits, F.lit("4071")), F.lit(i), F.lit(1))
    plain = F.concat(F.lit("so"), F.regexp_replace(F.substring_index(s, "@", 1), "[^A-Za-z]", ""))
    wrong = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 5, F.lit(10)).cast("string"))
    ways = {
        "email": (F.concat(plain, F.lit(" at the dot "), plain), F.concat(plain, F.lit("(at) the dot")), F.concat(F.left(plain, F.lit(4)), F.lit(" at a dot in"))),
        "ip": tuple(F.replace(x, F.lit("."), F.lit("[.]")) for x in (F.concat(F.lit("v"), s), F.concat(s, F.lit("-rc1")), F.concat(F.lit("build"), s, F.lit("b")))),
        "card": (F.concat(F.lit("#"), wrong), F.concat(F.lit("no."), wrong), F.concat(F.lit("ID"), F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1-"))),
        "phone": (F.concat(F.lit("20"), at(1), at(2), F.lit("-0"), at(3), F.lit("-1"), at(4), F.lit(" 1"), at(1), F.lit(".3"), at(2)), F.concat(F.lit("7e"), at(2), F.lit("b"), F.left(F.concat(digits, digits), F.lit(11)), F.lit("c"), at(1), F.lit("f")), F.concat(F.lit("v"), F.left(digits, F.lit(2)), F.lit("."), F.right(digits, F.lit(2)), F.lit(".10."), F.right(digits, F.lit(3)))),
    }[kind]
    return F.when(turn == 0, ways[0]).when(turn == 1, ways[1]).otherwise(ways[2])


#: Characters on either side of a span that go with it when it is written anew.
SURROUNDINGS = 12


def _made(pieces: Column, kind: str) -> Column:
    """What the generators propose where passed matches are written anew: hidden (label 1, if it passes) and as decoys (label 0)."""
    padded = F.concat(F.array(F.lit("")), pieces, F.array(F.lit("")))
    around = F.filter(F.transform(pieces, lambda s, i: F.struct(s.alias("s"), F.right(F.get(padded, i), F.lit(SURROUNDINGS)).alias("last"), F.left(F.get(padded, i + 2), F.lit(SURROUNDINGS)).alias("next"), (i % 2 == 1).alias("odd"))), lambda x: x["odd"] & _checked(kind, x["s"]))

    def found(x: Column, text: Column, label: int) -> Column:
        cut = F.split(F.regexp_replace(F.concat(x["last"], text, x["next"]), f"({GENERATORS[kind]})", f"{_MARK}$1{_MARK}"), _MARK, -1)
        start, end = F.length(x["last"]), F.length(x["last"]) + F.length(text)
        hit = lambda m: (m["start"] < end) & (m["end"] > start) & (F.lit(True) if kind == "card" and not label else (m["checked"] == 1) & (m["label"] == 1))
        every = F.flatten(F.transform(F.array(cut), lambda c: _matches(c, kind)))
        return F.transform(F.filter(every, hit), lambda m: m.withField("label", F.lit(label)))

    turn = lambda x: F.pmod(F.xxhash64(x["s"], x["last"]), F.lit(3))
    both = lambda x: F.concat(found(x, _hidden(kind, x["s"], turn(x)), 1), found(x, _decoy(kind, x["s"], turn(x)), 0))
    return F.when(F.size(pieces) > 1, F.flatten(F.transform(around, both))).otherwise(F.array().cast(_MATCH))


def _masked(kind: str):
    """For ``transform``: a passed match becomes a hole of its length."""
    return lambda x, i: F.when((i % 2 == 1) & _checked(kind, x), F.repeat(F.lit(_HOLE), F.length(x))).otherwise(x)


def _span(number: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("k"), x["end"].alias("end"))


def _selected(model: "Model"):
    return lambda x: (x["checked"] == 1) & (x["label"] == 1) & (model.sql(x) >= model.threshold)


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, for each kind ``base_K`` (all matches of the base pattern), ``made_K`` (passed ones written anew) and ``more_K``
    (proposals outside passed ones)."""
    rows = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), _MARK + _PLAIN + _HOLE, "\x04\x04\x04").alias("t"))
    rows = rows.select("doc_id", "t", *[_pieces(F.col("t"), BASE[k], NEEDS[k]).alias(f"p_{k}") for k in KINDS])
    # what base spans of the kind cover is masked for its generator
    rows = rows.select("doc_id", *[_matches(F.col(f"p_{k}"), k).alias(f"base_{k}") for k in KINDS], *[_made(F.col(f"p_{k}"), k).alias(f"made_{k}") for k in KINDS], *[
        F.when(F.size(f"p_{k}") > 1, F.array_join(F.transform(F.col(f"p_{k}"), _masked(k)), "")).otherwise(F.col("t")).alias(f"t_{k}")
        for k in KINDS
    ])
    kept = [f"{x}_{k}" for k in KINDS for x in ("base", "made")]
    rows = rows.select("doc_id", *kept, *[
        F.when(F.col(f"t_{k}").rlike("[0-9][\\x20().\\[\\]/_-]{0,3}[0-9]" if k != "email" else "@|[(\\[{]\\x20?at\\x20?[)\\]}]|\\x20dot\\x20"), F.split(F.regexp_replace(f"t_{k}", f"({GENERATORS[k]})", f"{_MARK}$1{_MARK}"), _MARK, -1)).otherwise(F.array(f"t_{k}")).alias(f"g_{k}")
        for k in KINDS
    ])
    return rows.select("doc_id", *kept, *[_matches(F.col(f"g_{k}"), k).alias(f"more_{k}") for k in KINDS])


class Split(NamedTuple):
    """A tree of depth two: a first split and one for either side; leaves in order."""

    root: tuple[int, int]
    left: tuple[int, int]
    right: tuple[int, int]
    leaves: tuple[float, float, float, float]

    def value(self, x: tuple[int, ...]) -> float:
        f, t = self.root
        second, at = (self.left, 0) if x[f] <= t else (self.right, 2)
        return self.leaves[at + (x[second[0]] > second[1])]

    def sql(self, row: Column) -> Column:
        def test(s: tuple[int, int]) -> Column:
            return row[FEATURES[s[0]]] <= s[1]

        a, b, c, d = self.leaves
        return F.when(test(self.root), F.when(test(self.left), a).otherwise(b)).otherwise(F.when(test(self.right), c).otherwise(d))


class Model(NamedTuple):
    base: float
    trees: tuple[Split, ...]
    threshold: float | None

    def score(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-(self.base + sum(t.value(x) for t in self.trees))))

    def sql(self, row: Column) -> Column:
        z = F.lit(self.base)
        for t in self.trees:
            z = z + t.sql(row)
        return 1 / (1 + F.exp(-z))


def _best(rows: list, grad: list[float], hess: list[float], among: list[int], used: list[int]) -> tuple[float, tuple[int, int], float, float]:
    """The split of the largest gain: (gain, (feature, cut), left value, right value)."""
    g_all, h_all = sum(grad[i] for i in among), sum(hess[i] for i in among)
    value = lambda g, h: g / (h + 1.0)
    best = (0.0, (0, 99), value(g_all, h_all), value(g_all, h_all))
    for f in used:
        sums: dict[int, list[float]] = {}
        for i in among:
            s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += hess[i]
        g = h = 0.0
        for cut in sorted(sums)[:-1]:
            g, h = g + sums[cut][0], h + sums[cut][1]
            gain = g * value(g, h) + (g_all - g) * value(g_all - g, h_all - h) - g_all * value(g_all, h_all)
            if gain > best[0] + 1e-12:
                best = (gain, (f, cut), value(g, h), value(g_all - g, h_all - h))
    return best


def calibrated(scored: list[tuple[float, int, float]]) -> float | None:
    """The border below the lowest pool of neighbouring scores (score, label, count) that has at least ``PRECISION``: halfway
    to the next lower score. None: there is no such pool."""
    pools: list[list[float]] = []  # lowest score, passed, all; shares fall from pool to pool
    last = None
    for s, y, k in sorted(scored, reverse=True):
        if s == last:
            pools[-1][1:] = pools[-1][1] + y * k, pools[-1][2] + k
        else:
            while len(pools) > 1 and pools[-1][1] * pools[-2][2] >= pools[-2][1] * pools[-1][2]:
                low, good, all_ = pools.pop()
                pools[-1] = [low, pools[-1][1] + good, pools[-1][2] + all_]
            pools.append([s, y * k, k])
        last = s
    while len(pools) > 1 and pools[-1][1] * pools[-2][2] >= pools[-2][1] * pools[-1][2]:
        low, good, all_ = pools.pop()
        pools[-1] = [low, pools[-1][1] + good, pools[-1][2] + all_]
    low = min((low for low, good, all_ in pools if good >= PRECISION * all_), default=None)
    below = [s for s, *_ in scored if low is not None and s < low]
    return (low + max(below)) / 2 if below else low


def boosted(rows: list[tuple[tuple[int, ...], int, float]], held: list[tuple[tuple[int, ...], int, float]], used: tuple[str, ...] = FEATURES) -> Model:
    """Newton boosting on counted rows (features, label, count) by the features ``used``; the threshold comes from ``held``."""
    among = [FEATURES.index(x) for x in used]
    n, ones = sum(r[2] for r in rows), sum(r[1] * r[2] for r in rows)
    if not ones:
        return Model(0.0, (), None)
    base = math.log((ones + 0.5) / (n - ones + 0.5))
    z, trees = [base] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-x)) for x in z]
        grad, hess = [(r[1] - q) * r[2] for r, q in zip(rows, p, strict=True)], [q * (1 - q) * r[2] for r, q in zip(rows, p, strict=True)]
        _, root, *_ = _best(rows, grad, hess, list(range(len(rows))), among)
        sides = [[i for i, r in enumerate(rows) if (r[0][root[0]] <= root[1]) == left] for left in (True, False)]
        (_, ls, a, b), (_, rs, c, d) = (_best(rows, grad, hess, s, among) for s in sides)
        trees.append(Split(root, ls, rs, tuple(max(-4.0, min(4.0, x)) * RATE for x in (a, b, c, d))))
        z = [x + trees[-1].value(r[0]) for x, r in zip(z, rows, strict=True)]
    model = Model(base, tuple(trees), None)
    return model._replace(threshold=calibrated([(model.score(x), y, k) for x, y, k in held or rows]))


def fit(found: DataFrame) -> dict[str, Model]:
    """A model of each kind from counts by features, label and fold: of base matches, of what was written anew, and of card
    numbers that fail."""
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).cast("int").alias("fold")
    parts = None
    for k in KINDS:
        part = found.select(fold, F.lit(k).alias("kind"), F.explode(f"base_{k}").alias("m")).select("fold", "kind", "m.*")
        part = part.filter(F.col("digits").between(12, 19) if k == "card" else (F.col("checked") == 1) & (F.col("label") == 1))
        more = found.select(fold, F.lit(k).alias("kind"), F.explode(f"more_{k}").alias("m")).select("fold", "kind", "m.*")
        made = found.select(fold, F.lit(k).alias("kind"), F.explode(f"made_{k}").alias("m")).select("fold", "kind", "m.*")
        part = part.unionByName(made)
        if k == "card":
            part = part.unionByName(more.filter("checked = 0").withColumn("label", F.lit(0)))
        parts = part if parts is None else parts.unionByName(part)
    counted = parts.groupBy("kind", "fold", "label", *FEATURES).agg(F.count("*").alias("n")).collect()
    out = {}
    for k in KINDS:
        rows = {f: [(tuple(r[c] for c in FEATURES), r["label"], float(r["n"])) for r in counted if r["kind"] == k and r["fold"] == f] for f in (0, 1)}
        out[k] = boosted(rows[0], rows[1], USED)
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans (base and selected) of every document (columns doc_id, text)."""
    found = written(proposals(docs), "proposals")
    models = fit(found)
    base, more = [], []
    plain = F.concat(*[F.transform(F.filter(f"base_{k}", lambda x: x["checked"] == 1), _span(i)) for i, k in enumerate(KINDS, 1)])
    alone = lambda x: ~F.exists(F.col("plain"), lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    found = found.withColumn("plain", plain)
    for i, k in enumerate(KINDS, 1):
        base.append(F.transform(F.filter(f"base_{k}", lambda x: x["checked"] == 1), _span(i)))
        if (m := models[k]).threshold is not None:
            more.append(F.transform(F.filter(F.filter(f"more_{k}", _selected(m)), alone), _span(i)))
    rows = found.select("doc_id", *[F.size(x).cast("long").alias(f"n_{k}") for x, k in zip(base, KINDS, strict=True)], F.concat(*base).alias("base"), F.concat(*base, *more).alias("all"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
