"""Scalars on strings, dates, numbers, arrays, maps and JSON, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The neighbours of each key on a QWERTY keyboard.
KEY_NEIGHBOURS = {
    "a": "qswz", "b": "ghnv", "c": "dfvx", "d": "cefrsx", "e": "drsw", "f": "cdgrtv", "g": "bfhtvy", "h": "bgjnuy", "i": "jkou",
    "j": "hikmnu", "k": "ijlmo", "l": "kop", "m": "jkn", "n": "bhjm", "o": "iklp", "p": "lo", "q": "aw", "r": "deft", "s": "adewxz",
    "t": "fgry", "u": "hijy", "v": "bcfg", "w": "aeqs", "x": "cdsz", "y": "ghtu", "z": "asx",
}

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def lit_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def chars(c: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def places(n: Column, f: Callable[[Column], Column], kind: str = "array<string>") -> Column:
    """``f`` of 1 to ``n``; nothing where ``n`` is below 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast(kind))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# ---- keys


def pointed_key(c: Column) -> Column:
    """Key of a vocalised word: points and direction marks off (but not the hyphen among them), hyphens as spaces, quotes and
    punctuation off, single spaces, final letters as the others."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), "[֑-ֽֿ-ׇ‎‏]", "")
    x = F.regexp_replace(x, "[-–—/|־]", " ")
    x = F.regexp_replace(x, "[\"'`׳״.,;:!?()\\[\\]{}]", "")
    return F.translate(F.trim(F.regexp_replace(x, "[ \t\n\r]+", " ")), "ךםןףץ", "כמנפצ")


def folded(c: Column) -> Column:
    """A lossy key of a pointed key: doubled vowel letters as one, single ones inside a word off."""
    one = F.regexp_replace(F.regexp_replace(pointed_key(c), "ו+", "ו"), "י+", "י")
    inner = lambda w: F.when(F.length(w) > 2, F.concat(F.left(w, F.lit(1)), F.regexp_replace(F.substring(w, F.lit(2), F.length(w) - 2), "[וי]", ""), F.right(w, F.lit(1)))).otherwise(w)
    return F.array_join(F.transform(F.split(one, " "), inner), " ")


def canonical(c: Column) -> Column:
    """Lower case, quotes inside words off, other punctuation as single spaces."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "([a-z0-9])['\"]([a-z0-9])", "$1$2")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def root_key(words: Column, stop: Iterable[str], prefixes: str) -> Column:
    """Words without stop words, leading one-letter prefixes peeled while three letters stay, as a sorted bag."""
    rest = F.filter(words, lambda w: ~w.isin(list(stop)))
    return F.array_join(F.array_sort(F.transform(rest, lambda w: F.regexp_replace(w, f"^[{prefixes}]+(?=.{{3}})", ""))), " ")


def peeled(c: Column, prefixes: list[str], suffixes: list[str], least: int = 3) -> Column:
    """Distinct stems of at least ``least`` letters: the word without any of the prefixes and suffixes (empty: as it is)."""
    cut = []
    for p in prefixes:
        for s in suffixes:
            whole = F.startswith(c, F.lit(p)) & F.endswith(c, F.lit(s)) & (F.length(c) - len(p) - len(s) >= least)
            cut.append(F.when(whole, F.substring(c, F.lit(len(p) + 1), F.length(c) - len(p) - len(s))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*cut))))


# ---- meanings


def senses(c: Column, markers: Iterable[str] = ()) -> Column:
    """Parts of a meaning between , ; / | : lone dots and spaced hyphens, without parentheses; marker words alone go unless
    nothing else is left."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")
    parts = F.filter(F.transform(F.split(x, r"[,;/|:]|\s-\s|(?<!\.)\.(?!\.)"), lambda p: F.trim(p)), lambda p: p != "")
    if not (known := list(markers)):
        return parts
    # the parts themselves where all of them are markers
    return bound(parts, lambda ps: bound(F.filter(ps, lambda p: ~p.isin(known)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(ps)))


def other_senses(parts: Column, typed: Column, most: int = 4) -> Column:
    return F.slice(F.filter(parts, lambda p: p != typed), 1, most)


def joined_senses(parts: Column, first: int = 5) -> Column:
    """Contiguous runs of two or more of the first parts, but not all of the parts."""

    def runs(ps: Column) -> Column:
        return bound(F.slice(ps, 1, first), lambda head: bound(F.array_join(ps, " "), lambda whole: F.filter(F.flatten(F.transform(head, lambda _, i: F.when(F.size(head) - i >= 2, F.transform(F.sequence(F.lit(2), F.greatest(F.size(head) - i, F.lit(2))), lambda n: F.array_join(F.slice(head, i + 1, n), " "))).otherwise(strings()))), lambda x: x != whole)))

    return bound(parts, runs)


def replaced_words(c: Column, representative: dict[str, str]) -> Column:
    """Every word that has a representative as that one."""
    m = lit_map(representative)
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")


# ---- comparing two strings


def common_prefix(a: Column, b: Column) -> Column:
    return F.size(F.filter(places(F.least(F.length(a), F.length(b)), lambda i: i, "array<int>"), lambda i: F.left(a, i) == F.left(b, i)))


def shared_letters(a: Column, b: Column) -> Column:
    """Letters of the two multisets in common, over the longer length (0 for two empty strings)."""
    count = lambda s, x: F.length(s) - F.length(F.replace(s, x, F.lit("")))
    n = F.aggregate(F.array_distinct(chars(a)), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return F.coalesce(F.try_divide(n, F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def inflects(typed: Column, word: Column, suffixes: Iterable[str]) -> Column:
    """Whether ``typed`` is ``word`` and one of the suffixes."""
    return F.startswith(typed, word) & F.substring(typed, F.length(word) + 1, F.length(typed)).isin(list(suffixes))


def soft_match(a: Column, b: Column, irregular: dict[str, str]) -> Column:
    """Equal, irregular forms of one another, or three letters in common at the start and lengths that differ by at most 3."""
    m = lit_map(irregular)
    near = (F.left(a, F.lit(3)) == F.left(b, F.lit(3))) & (F.length(a) >= 3) & (F.length(b) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 3)
    return (a == b) | F.coalesce(F.try_element_at(m, a) == b, F.lit(False)) | F.coalesce(F.try_element_at(m, b) == a, F.lit(False)) | near


def single_difference(a: Column, b: Column) -> Column:
    """The place of the only differing item of two arrays of one size, from 1; else null."""
    at = F.filter(places(F.size(a), lambda i: i, "array<int>"), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.when((F.size(a) == F.size(b)) & (F.size(at) == 1), F.get(at, F.lit(0)))


def subsequence_share(a: Column, b: Column) -> Column:
    """The share of ``a``'s letters found, greedily and in order, in ``b``."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        p = F.call_function("locate", x, b, s["at"] + 1)
        return F.when(p > 0, F.struct(p.alias("at"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.coalesce(F.try_divide(F.aggregate(chars(a), start, step, lambda s: s["n"]), F.length(a)), F.lit(0.0))


# ---- wrong spellings


def dropped(c: Column) -> Column:
    return F.array_distinct(places(F.length(c), lambda i: F.concat(F.left(c, i - 1), F.substring(c, i + 1, F.length(c)))))


def swapped(c: Column) -> Column:
    swap = lambda i: F.concat(F.left(c, i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, F.length(c)))
    return F.filter(F.array_distinct(places(F.length(c) - 1, swap)), lambda x: x != c)


def doubled(c: Column) -> Column:
    return F.array_distinct(places(F.length(c), lambda i: F.concat(F.left(c, i), F.substring(c, i, F.length(c)))))


def neighbour_typed(c: Column) -> Column:
    """Each letter replaced by each of its neighbours on the keyboard."""
    m = lit_map(KEY_NEIGHBOURS)
    at = lambda i: F.transform(chars(F.coalesce(F.try_element_at(m, F.substring(c, i, F.lit(1))), F.lit(""))), lambda x: F.concat(F.left(c, i - 1), x, F.substring(c, i + 1, F.length(c))))
    return F.flatten(places(F.length(c), at, "array<array<string>>"))


def edit_ball(c: Column, alphabet: str = LETTERS) -> Column:
    """All strings at one deletion, swap, replacement or insertion, sorted, without the string itself."""
    letters = strings(*alphabet)
    put = lambda skip: lambda i: F.transform(letters, lambda x: F.concat(F.left(c, i - 1), x, F.substring(c, i + skip, F.length(c))))
    every = F.concat(dropped(c), swapped(c), F.flatten(places(F.length(c), put(1), "array<array<string>>")), F.flatten(places(F.length(c) + 1, put(0), "array<array<string>>")))
    return F.array_sort(F.filter(F.array_distinct(every), lambda x: x != c))


# ---- markup


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def wiki_text(c: Column, depth: int = 4) -> Column:
    """Wiki markup off: templates nested up to ``depth``, link targets, quotes of emphasis, references."""
    x = F.coalesce(c, F.lit(""))
    for _ in range(depth):
        x = F.regexp_replace(x, r"\{\{[^{}]*\}\}", "")
    x = F.regexp_replace(x, r"<ref[^>]*>[^<]*</ref>", "")
    x = F.regexp_replace(x, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
    x = F.regexp_replace(x, r"\[\[([^\[\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "'{2,}", ""), "[ \t\n\r]+", " "))


def masked_mail(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(3)), F.lit("***@"), F.substring_index(c, "@", -1))


# ---- numbers


def clamped(c: Column, most: int | None = None) -> Column:
    """A whole number from 0 to ``most``; what is no number or negative is 0."""
    x = F.greatest(F.coalesce(F.try_cast(F.lit(None), "bigint") if c is None else c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    x = F.floor(F.when(F.isnan(x), 0.0).otherwise(x))
    return x if most is None else F.least(x, F.lit(most).cast("long"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.coalesce(F.floor(F.try_divide(part * 100, whole) + 0.5), F.lit(0).cast("long"))


def snapped_below(c: Column, grid: float = 0.05) -> Column:
    """The largest multiple of the grid that is below ``c``."""
    return F.floor((c - 1e-9) / grid) * grid


# ---- arrays, maps, JSON


def permuted(items: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(items, i))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def skyline(vectors: Column) -> Column:
    """The vectors that no other one is below or equal to in all places and below in one."""

    def below(u: Column, v: Column) -> Column:
        pairs = F.arrays_zip(u.alias("u"), v.alias("v"))
        return F.forall(pairs, lambda p: p["u"] <= p["v"]) & F.exists(pairs, lambda p: p["u"] < p["v"])

    return F.filter(vectors, lambda v: ~F.exists(vectors, lambda u: below(u, v)))


def filled(template: Column, words: Column, blank: str = "____") -> Column:
    """Each blank replaced by the next word; words beyond the blanks are left out, blanks beyond the words stay."""
    parts = F.split(template, blank)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").otherwise(F.coalesce(F.get(words, i - 1), F.lit(blank))), p)), "")


def merged_maps(base: Column, over: Column) -> Column:
    """Both maps' keys; ``over`` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def json_first(c: Column, *paths: str) -> Column:
    """The first path whose value is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(c, f"$.{p}"), F.lit("")) for p in paths])


def json_unwrapped(c: Column) -> Column:
    """A JSON text that was written as a JSON string once more, as itself."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
    return F.when(F.startswith(F.trim(c), F.lit('"')), inner).otherwise(c)


def parsed_instant(c: Column) -> Column:
    """A timestamp of an ISO text with any number of fractional digits, T or a space, and Z, an offset or none (UTC)."""
    x = F.regexp_replace(F.trim(c), "[Zz]$", "+00:00")
    return F.try_to_timestamp(F.regexp_replace(x, r"(\.\d{6})\d+", "$1"))


def days_since(now: Column, then: Column) -> Column:
    """Whole days between two instants, rounded down."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000)
