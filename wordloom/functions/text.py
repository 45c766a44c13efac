"""Keys and slices of strings, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def english_key(c: Column) -> Column:
    """Lower case, white space around and one leading article or "to" off, hyphens as spaces, only a-z, 0-9 and single spaces. Null: empty."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^[\s\x0B\u00A0]*+(?:(?:to|a|an|the)[\s\x0B\u00A0]+)?", "")
    x = F.regexp_replace(F.translate(x, "-–—/|", "     "), "[^a-z0-9 ]+", "")
    return F.trim(F.regexp_replace(x, " {2,}", " "))


def gloss_key(c: Column) -> Column:
    """Parentheses with their content off, white space collapsed, trailing punctuation off, lower case."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.lower(F.regexp_replace(x, r"[.,;:!? ]+$", ""))


def skeleton(c: Column) -> Column:
    """Consonants of an English key."""
    return F.regexp_replace(english_key(c), "[aeiou ]", "")


def bag_key(c: Column) -> Column:
    """The words of a key in order of the alphabet, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(english_key(c), " "))), " ")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def grams(words: Column, n: int) -> Column:
    """Windows of ``n`` items, joined by spaces; none if there are fewer."""
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def char_slices(c: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    last = F.length(c) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def deletions(c: Column, depth: int = 1) -> Column:
    """The string itself and all strings with up to ``depth`` characters removed."""

    def once(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    out = F.array(c)
    for _ in range(depth):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))
    return out


def clean_markup(c: Column) -> Column:
    """Text of simple markup: scripts, styles, comments and tags off, five entities decoded, white space collapsed."""
    x = F.coalesce(c, F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        x = F.regexp_replace(x, pattern, " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, "[ \t\n\r]+", " "))


def json_pick(c: Column, *paths: str) -> Column:
    """The first path that a JSON text has."""
    return F.coalesce(*[F.get_json_object(c, f"$.{p}") for p in paths])


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a string's code points below 256, bit for bit, as a number."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(2166136261).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(16777619).cast("long"), F.lit(1 << 32)))
