"""Quality rules whose cutoffs adapt to each language and source.

Per document, text statistics are computed once. Per (language, source) they go into mergeable quantile sketches: counts in
bins of ``ERROR`` relative width, at most about 4,000 of them a metric, counted map-side and summed after the shuffle, so a
source that holds a third of all rows costs its tasks one sketch each. Sums of counts depend on no order and no chance:
reruns, retries and other partitionings give the same cutoffs. Rows with the same statistics, such as copies, count once.

A rule's metric has spread in clean text (marks a word, variety of words, mean word length), so a cutoff is read off the
sketches alone: the edge of a group's body plus a multiple of its spread, the distance from a lower quantile to that edge. Junk
raises marks and lowers variety, so their body is the lowest 30 % of a group and holds with up to 60 % of junk in it. The
spread is at least the median of those of the language's sources: a source full of near copies doesn't cut off all
else. Sources of fewer than ``LEAST_GROUP`` texts have the language's edge, languages without larger ones the
corpus's spread. A text's own sampling noise widens its cutoff, for a short text varies more. Word lengths go wrong both ways,
so their edges are those of the whole language, whose other sources tell what its words are like; a source that lies
beyond them in nine of ten texts is of its own kind and has its own. A join brings each document its group's cutoffs.

Defined results: a null or empty text has no words and fails; null languages and sources form groups of their own; in a corpus
without any group of ``LEAST_GROUP`` texts only the base rule decides; repeated rows are judged one by one; an empty table gives
an empty result; input columns named as result columns are replaced by them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import SPACES, arrow_map, as_bytes, tune, written

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: The base rule: fewer words than this, or a larger percentage of words in repeated 3-word windows, fails.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50

#: Relative error of a quantile, and the bin of the value 1: bins of smaller values down to 1e-8 have positive numbers.
ERROR, ONE = 0.005, 2000
_GAMMA = (1 + ERROR) / (1 - ERROR)

#: Groups whose cutoffs are broadcast at most (about 100 bytes each); more are joined by shuffle.
MOST_BROADCAST_GROUPS = 20_000

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_distinct long"

#: Texts that a source needs for cutoffs of its own, and how many deviations of a text's own noise are let through.
LEAST_GROUP, NOISE = 10, 4.0

#: Each adaptive rule: name, metric, quantile at the body's edge, a lower one, reach, the noise of one text at the edge, whether
#: the language decides. A value is rejected beyond edge + max(reach * (edge - lower), NOISE * noise). For normal values
#: the reaches put the limit 10 (marks), 7 (sameness) and 8 (lengths) standard deviations above the body's edge at least.
RULES = (
    ("marks", lambda: F.col("n_marks") / F.col("n_words"), 0.3, 0.1, 14.0, lambda e: F.sqrt((e + 1 / F.col("n_words")) / F.col("n_words")), False),
    ("sameness", lambda: 1 - F.log(F.col("n_distinct") + 1) / F.log(F.col("n_words") + 2), 0.3, 0.1, 9.0, lambda e: 0.1 / F.log(F.col("n_words") + 2), False),
    ("long_words", lambda: F.col("word_chars") / F.col("n_words"), 0.5, 0.25, 12.0, lambda e: 0.5 * F.abs(e) / F.sqrt("n_words"), True),
    ("short_words", lambda: -(F.col("word_chars") / F.col("n_words")), 0.5, 0.25, 12.0, lambda e: 0.5 * F.abs(e) / F.sqrt("n_words"), True),
)

#: Bytes that are no marks: letters and digits, anything beyond ASCII, white space and control characters.
_UNMARKED = bytes(i for i in range(256) if i <= 32 or i >= 127 or chr(i).isalnum())


def text_features(text: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows, marks, distinct words)."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, SPACES).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(words), len(text.translate(None, _UNMARKED)), len(set(words))


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:  # a text of three words has one window
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) < 2_000_000:
        key = pair[:-1] * len(number) + ids[2:]
    else:  # the product of three numbers would not fit
        key = np.unique(pair[:-1], return_inverse=True)[1] * len(number) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` and the statistics of each text."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    docs = docs.drop(*names)

    def run(batch: pa.RecordBatch) -> dict:
        rows = np.array([text_features(x) for x in as_bytes(batch.column("text"))], np.int64).reshape(-1, len(names))
        return {c: batch.column(c) for c in batch.schema.names} | dict(zip(names, rows.T, strict=True))

    return arrow_map(docs, "text", run, f"{docs._jdf.schema().toDDL()}, {FEATURES}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def _bin(x: Column) -> Column:
    """The bin of a value: 0 for 0, negative for negative ones; bins are in the order of values."""
    i = F.greatest(F.ceil(F.log(F.abs(x)) / math.log(_GAMMA)) + ONE, F.lit(1).cast("long"))
    return F.when(F.abs(x) < 1e-8, F.lit(0).cast("long")).otherwise((F.signum(x) * i).cast("long"))


def _middle(bin_: Column) -> Column:
    """A value within ``ERROR`` of all in the bin."""
    return F.signum(bin_) * F.pow(F.lit(_GAMMA), F.abs(bin_) - ONE) * (2 / (_GAMMA + 1)) * (bin_ != 0).cast("int")


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n) of all texts with words; those with the same statistics count once."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    features = features.select("lang", "source", *names).distinct()
    bins = F.array(*[F.struct(F.lit(name).alias("rule"), _bin(metric()).alias("bin")) for name, metric, *_ in RULES])
    return features.filter("n_words > 0").select("lang", "source", F.inline(bins)).groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, and for each rule and share ``rule_percent``: the least value that so many are at most as large as. A sketch has
    a bounded number of rows."""
    by = Window.partitionBy(*keys, "rule")
    runs = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    runs = runs.withColumns({"_upto": F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(by)})
    at = [F.min(F.when((F.col("rule") == name) & (100 * F.col("_upto") >= round(100 * q) * F.col("_all")), F.col("bin"))).alias(f"{name}_{round(100 * q)}") for name, *_ in RULES for q in shares]
    found = runs.groupBy(*keys).agg(*at)
    return found.select(*keys, *[_middle(F.col(c)).alias(c) for c in found.columns if c not in keys])


def cutoffs(features: DataFrame) -> DataFrame:
    """Per (lang, source): each rule's edge and the reach beyond it, from quantile sketches of all texts with words; null edges
    decide nothing."""
    sketch = written(sketches(features), "quality-sketches")
    shares = sorted({x for _, _, q, low, *_ in RULES for x in (0.1, q, low)})
    names = [x[0] for x in RULES]

    def bodies(keys: list[str]) -> DataFrame:
        """Keys, texts, and each rule's edge, spread and lowest tenth; nulls where there are too few texts."""
        size = sketch.filter(F.col("rule") == names[0]).groupBy(*keys).agg(F.sum("n").alias("_n"))
        found = quantiles(sketch, keys, shares)
        for k in keys:
            size = size.withColumnRenamed(k, f"_{k}")
        found = found.join(size, [found[k].eqNullSafe(size[f"_{k}"]) for k in keys])
        enough = lambda c: F.when(F.col("_n") >= LEAST_GROUP, c)
        columns = []
        for name, _, q, low, *_ in RULES:
            edge, lower, tenth = (F.col(f"{name}_{round(100 * x)}") for x in (q, low, 0.1))
            columns += [enough(edge).alias(f"edge_{name}"), enough(edge - lower).alias(f"spread_{name}"), enough(tenth).alias(f"tenth_{name}")]
        return found.select(*keys, *columns)

    groups = written(bodies(["lang", "source"]), "quality-bodies")
    middle = lambda prefix: [F.percentile_approx(f"spread_{x}", 0.5, 10_000).alias(f"{prefix}_{x}") for x in names]
    languages = bodies(["lang"]).select(F.col("lang").alias("_of"), *[F.col(f"edge_{x}").alias(f"_edge_{x}") for x in names])
    typical = groups.groupBy(F.col("lang").alias("_in")).agg(*middle("_typical"))
    rows = groups.join(languages, groups["lang"].eqNullSafe(languages["_of"])).join(typical, groups["lang"].eqNullSafe(typical["_in"])).join(F.broadcast(groups.agg(*middle("_corpus"))))
    out = [F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    for name, _, _, _, reach, _, pooled in RULES:
        usual = F.coalesce(f"_typical_{name}", f"_corpus_{name}")
        spread = F.greatest(F.coalesce(f"spread_{name}", usual), usual)
        edge = F.coalesce(f"edge_{name}", f"_edge_{name}")
        if pooled:  # unless nine of ten texts of the source lie beyond the language's limit
            own = F.coalesce(F.col(f"tenth_{name}") > F.col(f"_edge_{name}") + reach * usual, F.lit(False))
            edge, spread = F.when(own, edge).otherwise(F.coalesce(f"_edge_{name}", edge)), F.when(own, spread).otherwise(usual)
        out += [F.when(usual.isNotNull(), edge).alias(f"_edge_{name}"), (reach * spread).alias(f"_reach_{name}")]
    return rows.select(*out)


def judged(features: DataFrame, limits: DataFrame) -> DataFrame:
    """``features`` with base_failed, kept and the first adaptive rule that a row breaks (null: none)."""
    rows = features.drop("base_failed", "kept", "broken_rule")
    if limits.limit(MOST_BROADCAST_GROUPS + 1).count() <= MOST_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    rows = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")

    def beyond(name: str, metric, noise) -> Column:
        edge = F.col(f"_edge_{name}")
        # a bin's middle stands for all of its values
        return metric() > edge + 2 * ERROR * F.abs(edge) + F.greatest(F.col(f"_reach_{name}"), NOISE * noise(edge))

    broken = F.coalesce(*[F.when((F.col("n_words") > 0) & beyond(name, metric, noise), F.lit(name)) for name, metric, *_, noise, _ in RULES])
    rows = rows.withColumns({"base_failed": base_failed(), "broken_rule": broken})
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull()).drop("_lang", "_source", *[f"_{x}_{name}" for name, *_ in RULES for x in ("edge", "reach")])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, broken_rule and kept of every document (columns doc_id, text, lang, source)."""
    tune(docs.sparkSession)
    features = written(with_features(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-features")
    return judged(features, written(cutoffs(features), "quality-cutoffs")).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass. The statistics are computed twice rather than joined to the texts by shuffle."""
    tune(docs.sparkSession)
    features = with_features(docs.select("text", "lang", "source")).drop("text")
    limits = written(cutoffs(features), "quality-cutoffs")
    packed = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    return judged(with_features(packed), limits).filter("kept").select("_row.*")
