"""A lexicon as a Bloom filter: built and merged by OR, probed and measured with built-in expressions.

The filter is a table of (piece, bits): pieces of 32,768 bits, put together map-side and merged by OR in the JVM; it is never
gathered on the driver, so it may be of any size. Two hashes of a word (FNV-1a with different seeds and a finaliser that
mixes the low bits) give all its addresses. Probing is an equi-join of addresses with pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The seeds of the two hashes, the prime of FNV-1a and the multipliers of the finaliser.
SEEDS, PRIME, MIXERS = (0x811C9DC5, 0x9E3779B1), 0x01000193, (0x85EBCA6B, 0xC2B2AE35)

#: Between a word's language and the word, so that both are hashed.
SEPARATOR = "\x1f"

MOST_ADDRESSES, PIECE = 20, 1 << 15
_MASK = (1 << 32) - 1


@dataclass(frozen=True)
class Size:
    """Bits (whole bytes) and addresses a word of a filter for ``words`` words at a false-positive rate of ``rate``."""

    words: int
    rate: float

    @property
    def bits(self) -> int:
        raw = math.ceil(-self.words * math.log(self.rate) / math.log(2) ** 2)
        return 8 * max(1, math.ceil(raw / 8))

    @property
    def addresses(self) -> int:
        return max(1, min(MOST_ADDRESSES, math.floor(self.bits / max(1, self.words) * math.log(2) + 0.5)))

    @property
    def expected(self) -> float:
        """The rate that a filter with these rounded numbers has."""
        return (1 - math.exp(-self.addresses * self.words / self.bits)) ** self.addresses


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def _times(a: Column, b: int) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers, in two steps that fit a long."""
    high = F.shiftleft((a * _long(b >> 16)).bitwiseAND(_long(0xFFFF)), 16)
    return (a * _long(b & 0xFFFF) + high).bitwiseAND(_long(_MASK))


def hash32(text: Column, seed: int) -> Column:
    """FNV-1a of the code points, then the finaliser: a number of 32 bits."""
    codes = F.filter(F.transform(F.split(text, ""), lambda x: F.ascii(x).cast("long")), lambda x: x > 0)
    h = F.aggregate(codes, _long(seed), lambda h, x: (h.bitwiseXOR(x) * _long(PRIME)).bitwiseAND(_long(_MASK)))
    fold = lambda x, n: _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))
    h = _let(fold(h, 16), lambda v: _times(v, MIXERS[0]))
    h = _let(fold(h, 13), lambda v: _times(v, MIXERS[1]))
    return fold(h, 16)


def addresses(word: Column, lang: Column, size: Size) -> Column:
    """array<long>: the bits of a word."""
    key = F.concat(F.coalesce(lang, F.lit("")), F.lit(SEPARATOR), word)
    one = hash32(key, SEEDS[0]).alias("one")
    two = hash32(key, SEEDS[1]).bitwiseOR(_long(1)).alias("two")  # odd: no short cycles
    return _let(F.struct(one, two), lambda h: F.array(*[(h["one"] + _long(i) * h["two"]) % _long(size.bits) for i in range(size.addresses)]))


def built(words: DataFrame, size: Size) -> DataFrame:
    """The filter (piece, bits) of words (lang, word)."""
    at = words.select(F.explode(addresses(F.col("word"), F.col("lang"), size)).alias("at"))
    return at.groupBy(F.shiftright("at", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(_long(PIECE - 1))).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all words of filters of one size."""
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits"))


def probed(words: DataFrame, filter_: DataFrame, size: Size) -> DataFrame:
    """(lang, word, maybe) of distinct words (lang, word): ``maybe`` is true for all words of the filter and few others."""
    asked = words.select("lang", "word").distinct()
    at = asked.select("lang", "word", F.explode(addresses(F.col("word"), F.col("lang"), size)).alias("at")).withColumns({"piece": F.shiftright("at", 15), "place": F.col("at").bitwiseAND(_long(PIECE - 1)).cast("int")})
    at = at.join(filter_, "piece", "left")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.getbit(byte, F.col("place") % 8) == 1, F.lit(False))
    return at.groupBy("lang", "word").agg(F.bool_and(set_).alias("maybe"))


def lettered(words: DataFrame, letters: str, each: int, least: int = 3, most: int = 8) -> DataFrame:
    """Strings (lang, word) of ``least`` to ``most`` letters drawn by hash, ``each`` for every word of ``words``, that aren't words."""
    h = F.sha2(F.concat_ws("|", "lang", "word", F.col("_k").cast("string")), 256)
    at = lambda i: F.conv(F.substring(F.col("_h"), 3 + 4 * i, 4), 16, 10).cast("long")
    drawn = words.select("lang", "word", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_k")).withColumn("_h", h)
    size = F.conv(F.substring("_h", 1, 2), 16, 10).cast("long") % (most - least + 1) + least
    word = F.concat(*[F.when(F.lit(i) < size, F.substring(F.lit(letters), (at(i) % len(letters) + 1).cast("int"), F.lit(1))).otherwise("") for i in range(most)])
    return drawn.select("lang", word.alias("word")).distinct().join(words.select("lang", "word"), ["lang", "word"], "left_anti")


def measured(sample: DataFrame, filter_: DataFrame, size: Size) -> DataFrame:
    """lang, n and hits: how many of the words of ``sample`` the filter lets through."""
    return probed(sample, filter_, size).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("maybe").alias("hits"))


def lexicon_hits(rows: DataFrame, id_: str, typed: Column, source: Column, lang: Column, known: DataFrame, least_letters: int = 2) -> DataFrame:
    """(id, hit): whether all words that count of a typed text are in ``known`` (lang, word).

    If the source has as many words, those that differ from it by place count, else all; no such word, or one of fewer
    than ``least_letters``, is no hit. Words are looked up once each, whatever many rows type them.
    """
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")
    t, u = parts(typed), parts(source)
    asked = F.when(F.size(t) == F.size(u), F.filter(t, lambda x, i: x != F.get(u, i))).otherwise(t)
    words = rows.select(F.col(id_), lang.alias("lang"), F.explode_outer(asked).alias("word"))
    found = words.filter(F.length("word") >= least_letters).select("lang", "word").distinct().join(known.select("lang", "word").distinct().withColumn("_in", F.lit(True)), ["lang", "word"])
    seen = words.join(found, ["lang", "word"], "left")
    return seen.groupBy(id_).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("hit"))
