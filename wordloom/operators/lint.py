"""Text rules: flags, repeated windows, reasons in order."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.scalars import bound, folded, strings
from wordloom.functions.text import grams
from wordloom.plans.joins import spread_join
from wordloom.plans.shared import written


def broken_rules(rows: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule): one row for each rule that a row breaks."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(id_, F.explode(names).alias("rule"))


def repeated_grams(rows: DataFrame, id_: str, text: str, n: int = 3) -> DataFrame:
    """id, grams that occur at least twice in the text, and the most occurrences of one; texts without such grams have no
    row. A text is one row, so its grams are counted there, in Arrow batches, and nothing is shuffled."""

    @F.pandas_udf("repeated long, most long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = re.findall("[a-z0-9]+", (t or "").lower())
            k = Counter(zip(*[words[i:] for i in range(n)], strict=False)).values()
            out.append((sum(x > 1 for x in k), max(k, default=0)))
        return pd.DataFrame(out, columns=["repeated", "most"])

    found = rows.select(id_, counted(F.col(text)).alias("s"))
    return found.select(id_, "s.repeated", "s.most").filter("repeated > 0")


def first_reason(rows: DataFrame, reasons: dict[str, Column], default: str = "ok") -> DataFrame:
    """Counts of the first reason that holds, in the order given."""
    out = F.lit(default)
    for name, c in reversed(reasons.items()):
        out = F.when(c, name).otherwise(out)
    return rows.select(out.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


#: Points and cantillation marks of Hebrew letters, without the hyphen among them.
POINTS = "[\u0591-\u05bd\u05bf-\u05c7]"
_BLANKS = "[ \t\n\f\r]+"

#: All kinds of rules of ``gloss_problems``.
GLOSS_RULES = ("empty", "circular", "rootecho", "toolong", "parens", "repeat", "punct", "fragment", "niqqud", "shared")

#: Letters that ``folded`` changes.
FOLDED = "[ךםןףץוי]"


def _short(key: Column) -> Column:
    """A key to be shuffled: long ones by their digests."""
    return F.when(F.length(key) > 40, F.concat(F.lit("\0"), F.md5(key))).otherwise(key)


def plain_gloss(gloss: Column) -> Column:
    """Without points, with simple hyphens and single blanks."""
    marked = F.when(gloss.rlike("[\u0591-\u05c7]"), F.regexp_replace(F.replace(gloss, F.lit("\u05be"), F.lit("-")), POINTS, "")).otherwise(gloss)
    return F.trim(F.regexp_replace(marked, _BLANKS, " "))


def bare_gloss(plain: Column) -> Column:
    """A plain gloss without what stands in brackets."""
    return F.when(F.contains(plain, F.lit("(")), F.trim(F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", " "), _BLANKS, " "))).otherwise(plain)


def gloss_senses(bare: Column) -> Column:
    """The senses of a gloss without brackets."""
    return F.filter(F.transform(F.split(bare, "[;:.]"), lambda x: F.trim(x)), lambda x: x != "")


def gloss_faults(rows: DataFrame, stops: list[str], conjunction: str, most: int = 60) -> DataFrame:
    """(id, rule) of what is wrong with a row's (id, word, root, gloss) gloss by itself; an empty (or null) one breaks ``empty``
    alone.

    ``circular``: it repeats the word, or all words of a phrase, folded and outside of brackets, ``stops`` aside; else
    ``rootecho``: it has a word that is the root with at most two letters more; ``toolong``; ``parens``: brackets that don't
    match, hold everything, hold two examples, or are more than the senses; ``repeat``: three words stand twice; ``punct``:
    stops, dashes and blanks where none belong; ``fragment``: a later sense of at most four words that starts with a
    ``conjunction``; ``niqqud``: points.

    What several rules read is a column of its own, in steps that the optimizer keeps apart, so it is worked out once a row.
    """
    x = rows.select("id", F.lower(F.coalesce("word", F.lit(""))).alias("word"), F.coalesce("root", F.lit("")).alias("root"), F.coalesce("gloss", F.lit("")).alias("raw"))
    x = x.withColumn("g", plain_gloss(F.col("raw"))).withColumn("bare", bare_gloss(F.col("g"))).withColumn("words", F.regexp_extract_all("g", F.lit('[\\p{L}"׳]+'), F.lit(0)))
    # three words stand twice only if three words at least aren't the first of their kind
    x = x.withColumn("repeat", (F.size("words") - F.size(F.array_distinct("words")) >= 3) & bound(grams(F.col("words"), 3), lambda three: F.size(three) > F.size(F.array_distinct(three))))
    known = F.filter(F.split("word", " "), lambda w: (F.length(w) >= 3) & ~w.isin(stops))
    x = x.withColumns({
        "low": F.lower("bare"), "known": F.array_distinct(F.transform(known, lambda w: folded(w))), "key": folded(F.lower("root")), "senses": gloss_senses(F.col("bare")),
        "opened": F.length("g") - F.length(F.replace("g", F.lit("("), F.lit(""))), "closed": F.length("g") - F.length(F.replace("g", F.lit(")"), F.lit(""))),
    })
    # folding changes a run of letters only if it has one of these; where the gloss has none, a word or root that it repeats stands in it
    # as it is, and most glosses need no list of words
    lossy = F.col("low").rlike(FOLDED)
    maybe = lossy | F.exists("known", lambda w: F.contains("low", w)) | ((F.length("root") >= 3) & F.contains("low", "key"))
    listed = F.regexp_extract_all("low", F.lit(r"(\p{L}{3,})"), F.lit(1))
    found = F.when(lossy, F.array_distinct(F.transform(F.array_distinct(listed), lambda w: folded(w)))).when(maybe, F.array_distinct(listed)).otherwise(strings())
    x = x.withColumn("found", found)
    x = x.withColumn("circular", F.size(F.array_intersect("found", "known")) >= F.greatest(F.lit(1), F.size("known")))
    echo = (F.length("root") >= 3) & ~F.contains("root", F.lit("-")) & F.exists("found", lambda w: F.contains(w, F.col("key")) & (F.length(w) <= F.length("key") + 2))
    odd = (F.col("bare") == "") | (F.col("opened") > F.greatest(F.lit(1), F.size("senses"))) | F.col("g").rlike(r"\([^)]*;[^)]*\)")
    later = F.filter("senses", lambda w, i: i > 0)
    rules = {
        "circular": F.col("circular"), "rootecho": ~F.col("circular") & echo, "toolong": F.length("g") > most, "parens": (F.col("opened") != F.col("closed")) | ((F.col("opened") > 0) & odd),
        "repeat": F.col("repeat"), "punct": F.endswith("g", F.lit(".")) | F.col("g").rlike("[—–·]") | F.col("raw").rlike("[ \t\n\f\r][,;:]|[,;:]{2}|  "),
        "fragment": F.exists(later, lambda w: w.rlike(conjunction) & (F.size(F.split(w, " ")) <= 4)), "niqqud": F.col("raw").rlike(POINTS),
    }
    return broken_rules(x, "id", {"empty": F.col("g") == ""} | {name: (F.col("g") != "") & c for name, c in rules.items()})


def shared_glosses(rows: DataFrame, least: int = 6) -> DataFrame:
    """Ids of rows (id, word, gloss) with a gloss that an earlier row has, or a sense of at least ``least`` letters that first
    stood at another word. Who is first is aggregated before anything is joined, and the joins spread what many share."""
    g = rows.select("id", "word", plain_gloss(F.coalesce("gloss", F.lit(""))).alias("g"))
    parts = F.array_distinct(F.filter(gloss_senses(bare_gloss(F.col("g"))), lambda x: F.length(x) >= least))
    lines = written(g.filter("g <> ''").select("id", "word", _short(F.col("g")).alias("g"), F.transform(parts, _short).alias("ks")), "gloss-lines")
    first_id = lines.groupBy("g").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("g", "first")
    same = spread_join(lines.select("id", "g"), first_id, "g").filter("id <> first").select("id")
    # sums of numbers only, which are hashed: of each sense and word the first id, of each sense the first word's
    senses = lines.select("id", "word", F.explode("ks").alias("k"))
    pairs = written(senses.groupBy("k", "word").agg(F.min("id").alias("id")), "gloss-pairs")
    first = pairs.groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("k", "first")
    later = spread_join(pairs, first, "k").filter("id <> first").select(_sense_at(F.col("k"), F.col("word")).alias("at"))
    shared = spread_join(senses.select("id", _sense_at(F.col("k"), F.col("word")).alias("at")), later, "at").select("id")
    return same.unionByName(shared).distinct()


def _sense_at(sense: Column, word: Column) -> Column:
    """A sense at a word, which may be null, as one key."""
    return F.concat_ws("\0", sense, word)


def gloss_problems(rows: DataFrame, stops: list[str], conjunction: str, most: int = 60) -> DataFrame:
    """(id, rule) of rows (id, word, root, gloss): all that ``gloss_faults`` and ``shared_glosses`` find, each once.

    ``id`` is unique and gives the order. An empty table gives an empty result; a null word or root breaks no rule by itself."""
    return gloss_faults(rows, stops, conjunction, most).unionByName(shared_glosses(rows).withColumn("rule", F.lit("shared")))
