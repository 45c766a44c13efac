"""Word forms by peeled affixes, weak letters and root templates as built-in expressions; nested templates of markup in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.scalars import subsequence_share


@dataclass(frozen=True)
class Morphology:
    """How a language's words vary: affixes in the order they are tried (one each is peeled, at least ``keep`` letters stay), a
    letter that a lemma may start with, weak letters that roots do without, final letters and what they stand for, words that
    mean nothing by themselves, number words, and the letters words are made of."""

    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    lemma_prefix: str = ""
    weak: str = ""
    finals: tuple[str, str] = ("", "")
    stop: frozenset[str] = field(default_factory=frozenset)
    numbers: frozenset[str] = field(default_factory=frozenset)
    letters: str = "[A-Za-z]"
    keep: int = 3


ENGLISH = Morphology(
    prefixes=("un", "re"), suffixes=("ings", "ing", "ies", "ed", "es", "ly", "s"), weak="aeiou",
    stop=frozenset("a an and are as at be by for from in is it of on or that the this to was with".split()), numbers=frozenset("one two three four five six seven eight nine ten".split()),
)

#: Hebrew letters of use before a word, endings of inflection, function words and number words.
HEBREW = Morphology(
    prefixes=tuple("כשה שה וה לה מה בה כה ול וב ומ וש ה ו ב ל כ מ ש".split()),
    suffixes=tuple("ותיה ותיו יהם יהן תיים ים ות יה יו נו תי תם תן כם כן הם הן ה ת י ו ם ן".split()),
    lemma_prefix="ל",
    weak="אוי",
    finals=("ךםןףץ", "כמנפצ"),
    stop=frozenset("של את על זה זו הוא היא הם הן אני אתה לא כל יש אין גם אבל או כי אם עם כמו אחרי לפני בין מאוד רק כבר עוד היה הייתה היו להיות אז שם כאן מה מי איך למה שלו שלה שלי שלהם ולא".split()),
    numbers=frozenset("אחד אחת שני שתי שניים שתיים שלוש שלושה ארבע ארבעה חמש חמישה שש שישה שבע שבעה שמונה תשע תשעה עשר עשרה עשרים שלושים מאה אלף מיליון".split()),
    letters="[א-ת]",
)


def _peeled(x: Column, affixes: tuple[str, ...], front: bool, keep: int) -> Column:
    """The word, and without the first of the affixes that it has and can lose."""
    if not affixes:
        return F.array(x)
    out = None
    for a in affixes:
        n = len(a)
        has = (F.startswith(x, F.lit(a)) if front else F.endswith(x, F.lit(a))) & (F.length(x) - n >= keep)
        rest = F.substring(x, F.lit(n + 1), F.length(x)) if front else F.left(x, F.length(x) - n)
        out = F.when(has, rest) if out is None else out.when(has, rest)
    return F.array_compact(F.array(x, out))


def token_forms(word: Column, m: Morphology) -> Column:
    """Forms of a word in a text: prefixes and suffixes may go."""
    return F.array_distinct(F.flatten(F.transform(_peeled(word, m.prefixes, True, m.keep), lambda x: _peeled(x, m.suffixes, False, m.keep))))


def lemma_forms(word: Column, m: Morphology) -> Column:
    """Forms of a word in a gloss: its suffix may go, and a prefix that only lemmas have."""
    base = F.array(word)
    if m.lemma_prefix:
        base = F.array_compact(F.array(word, F.when(F.startswith(word, F.lit(m.lemma_prefix)) & (F.length(word) >= m.keep + 1), F.substring(word, F.lit(len(m.lemma_prefix) + 1), F.length(word)))))
    return F.array_distinct(F.flatten(F.transform(base, lambda x: _peeled(x, m.suffixes, False, m.keep))))


def bare_root(form: Column, m: Morphology) -> Column:
    """The form without weak letters, final letters as others; null if fewer than ``keep`` letters are left."""
    x = F.translate(form, m.finals[0] + m.weak, m.finals[1])
    return F.when(F.length(x) >= m.keep, x)


# ---- root templates: digits are the letters of the root, all else stands for itself

#: Pairs of Hebrew word patterns that one root may fill.
PATTERN_PAIRS = (
    ("pa-hit", "123", "הת123"), ("pa-inf", "123", "ל12ו3"), ("hit-inf", "הת123", "להת123"), ("act-inf", "1י23ה", "ל12ו3"), ("act-pa", "1י23ה", "123"), ("act-pass", "1ו23", "12ו3"),
    ("act-agent", "1ו23", "123נ"), ("pa-act", "123", "1ו23"), ("adj-abs", "1י23", "1י23ות"), ("hif-act", "ה12י3", "ה123ה"), ("nif-pa", "נ123", "123"),
)

#: Letters that may be no letters of a root, and final letters, which no template makes.
MATRES, FINAL_LETTERS = "אהוי", "ךםןףץ"


def template_pattern(template: str) -> tuple[str, str]:
    """A template as a regular expression and the replacement that makes the root: each digit's first place is a group, further
    ones refer back to it."""
    groups: dict[str, int] = {}
    out = []
    for c in template:
        if c not in "1234":
            out.append(c if c.isalnum() else f"\\{c}")
        elif c in groups:
            out.append(f"\\{groups[c]}")
        else:
            groups[c] = len(groups) + 1
            out.append("(.)")
    digits = sorted(groups)
    if digits != [str(i + 1) for i in range(len(digits))]:
        raise ValueError("a template's digits must go from 1 on")
    return f"^{''.join(out)}$", "".join(f"${groups[d]}" for d in digits)


def template_root(word: Column, template: str, strict: bool = False) -> Column:
    """The root with which a word fills a template, else null; ``strict``: nor if one of its letters may be none."""
    pattern, root = template_pattern(template)
    found = F.when(F.regexp_like(word, F.lit(pattern)), F.regexp_replace(word, pattern, root))
    return F.when(~F.regexp_like(found, F.lit(f"[{MATRES}]")), found) if strict else found


def template_filled(root: Column, template: str) -> Column:
    """The word that a root makes of a template; null if the root is too short."""
    parts = [F.substring(root, int(c), 1) if c in "1234" else F.lit(c) for c in template]
    most = max((int(c) for c in template if c in "1234"), default=0)
    return F.when(F.length(root) >= most, F.concat(*parts))


def template_keys(word: Column, pairs=PATTERN_PAIRS, strict: bool = False) -> Column:
    """array<struct<pair, side, root>>: every side of a pair of templates that a word fills, with its root.

    Two words are related by a pair if they have the pair and the root in common: an equi-join, instead of all templates on all
    pairs of words."""
    sides = [F.struct(F.lit(name).alias("pair"), F.lit(side).alias("side"), template_root(word, t, strict).alias("root")) for name, *both in pairs for side, t in zip("ab", both, strict=True)]
    return F.filter(F.array(*sides), lambda s: s["root"].isNotNull())


def template_partners(word: Column, pairs=PATTERN_PAIRS, strict: bool = False) -> Column:
    """All words on the other side of a pair, by the word's root; none with a final letter."""
    out = [template_filled(template_root(word, x, strict), y) for _, a, b in pairs for x, y in ((a, b), (b, a))]
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull() & ~F.regexp_like(x, F.lit(f"[{FINAL_LETTERS}]")) & (x != word)))


# ---- transliteration

#: Hebrew letters and the Latin ones that they are heard as.
HEARD = ("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "abgdhvzhtikklmmnnsapfcckrst")

#: Letters and marks that a consonant skeleton does without.
SOFT = "aeiouhwy'’- "


def consonants(c: Column) -> Column:
    return F.translate(F.lower(c), SOFT, "")


def transliterates(meaning: Column, term: Column, least_letters: int = 4, share: float = 0.7) -> Column:
    """Whether a meaning in Hebrew letters spells the term: at least ``share`` of the term's consonants are found in order among the
    meaning's. Meanings of fewer than ``least_letters`` Hebrew letters and empty skeletons never do."""
    hebrew = F.regexp_replace(meaning, "[^א-ת]", "")
    a, b = consonants(F.translate(hebrew, *HEARD)), consonants(term)
    found = subsequence_share(b, a) >= share - 1e-12
    return F.coalesce((F.length(hebrew) >= least_letters) & (a != "") & (b != "") & found, F.lit(False))


# ---- nested templates of markup


#: White space as Java's (?U)\\s has it, and the pieces that nested templates are made of.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(r"\{\{|\}\}|[^{}]+|[{}]")

#: Texts of a batch that are Python objects at once.
_PART = 64


def split_templates(text: str | None, labels: frozenset[str]) -> tuple[str, list[str]]:
    """The text outside of templates and the labels, in one walk: pieces are joined once, not copied for each further one."""
    out: list[str] = []
    found: list[str] = []
    stack: list[list[str]] = []
    for p in _PIECES.findall(text or ""):
        if p == "{{":
            stack.append([])
        elif p == "}}" and stack:
            parts = [x.strip(_BLANKS) for x in "".join(stack.pop()).split("|")]
            if parts[0] in labels:
                found.append(" ".join(x for x in parts if x))
        else:
            (stack[-1] if stack else out).append(p)
    return "".join(out), found


def without_templates(text: Column, labels: tuple[str, ...] = ()) -> Column:
    """struct<text, labels>: the text outside ``{{...}}`` of any depth, and the parts of templates whose first part is in ``labels``,
    joined by spaces. A template's own text only is looked at, not what is nested in it; one that isn't closed hides all that follows;
    closing braces outside stay."""
    known = frozenset(labels)
    kind = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string()))])

    @F.arrow_udf("struct<text:string,labels:array<string>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for i in range(0, len(texts), _PART):
                rows = [split_templates(t, known) for t in texts[i : i + _PART].to_pylist()]
                parts.append(pa.StructArray.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.list_(pa.string()))], fields=list(kind)))
            yield pa.concat_arrays(parts or [pa.array([], kind)])

    return split(text)
