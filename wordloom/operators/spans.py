"""Where a text says what a gloss or a phrase says: graded equality of words, whole phrases before single words, no guesses.

Words of a gloss and of its text meet by equi-joins on keys of three grades (the word, its forms, its root), so that no word is
compared with all words of a text. A phrase is a run of hits on one diagonal: word j of the phrase at place at + j of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.morphology import Morphology, bare_root, lemma_forms, token_forms

GRADES = ("exact", "form", "root")

#: Texts of a batch whose words are Python objects at once.
PART = 64


_PLACE = pa.struct([("w", pa.string()), ("s", pa.int32()), ("e", pa.int32())])


def placed(texts: pa.Array, pattern: re.Pattern) -> pa.Array:
    """The lower-cased matches in each text with their places. ``PART`` texts at a time become Python objects, the rest stays in Arrow's
    buffers."""

    def part(some: list[str | None]) -> pa.Array:
        words, places, ends = [], [], [0]
        for t in some:
            for m in pattern.finditer(t or ""):
                words.append(m[0].lower())
                places += m.span()
            ends.append(len(words))
        at = np.array(places, np.int32).reshape(-1, 2)
        rows = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(at[:, 0]), pa.array(at[:, 1])], fields=list(_PLACE))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=pa.array([t is None for t in some], pa.bool_()))

    return pa.concat_arrays([part(texts[i : i + PART].to_pylist()) for i in range(0, len(texts), PART)] or [pa.array([], pa.list_(_PLACE))])


def word_places(text: Column, letters: str) -> Column:
    """array<struct<w, s, e>>: runs of ``letters``, lower-cased, with their places (from 0, end exclusive)."""
    pattern = re.compile(f"{letters}+")

    @F.arrow_udf("array<struct<w:string,s:int,e:int>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield placed(texts, pattern)

    return found(text)


def _keys(word: Column, forms: Column, m: Morphology) -> Column:
    """array<struct<grade, key>>."""
    long = F.filter(forms, lambda x: F.length(x) >= m.keep)
    roots = F.filter(F.transform(forms, lambda x: bare_root(x, m)), lambda x: x.isNotNull())
    pair = lambda grade: lambda x: F.struct(F.lit(grade).alias("grade"), x.alias("key"))
    return F.array_distinct(F.concat(F.array(pair(0)(word)), F.transform(long, pair(1)), F.transform(roots, pair(2))))


def graded_spans(items: DataFrame, m: Morphology) -> DataFrame:
    """id, start, end, grade, sense and words of the span of ``text`` that says what ``gloss`` says; nulls where there is none.

    ``items``: id, gloss (senses apart by ``;`` or ``,``), text. Candidates are whole senses of several words in a row, and the first
    word of each sense by itself, if it isn't a stop word, nor a number that the gloss doesn't mean. More words go first, then the
    better grade (a phrase has its worst word's), the earlier sense, the longer and the earlier span. If the best isn't exact and
    another candidate lies elsewhere, nothing is decided.
    """
    senses = F.filter(F.transform(F.split(F.coalesce("gloss", F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda s: F.filter(F.split(F.lower(s), r"\s+"), lambda x: (F.length(x) >= 2) & F.regexp_like(x, F.lit(m.letters)))
    asked = F.flatten(F.transform(senses, lambda s, k: F.transform(words(s), lambda g, j: F.struct(k.cast("int").alias("sense"), j.cast("int").alias("j"), F.size(words(s)).alias("n"), g.alias("g")))))
    gloss = items.select("id", F.inline(asked)).withColumn("_k", F.explode(_keys(F.col("g"), lemma_forms(F.col("g"), m), m))).select("id", "sense", "j", "n", "g", "_k.*")
    text = items.select("id", F.posexplode(word_places(F.col("text"), m.letters)).alias("i", "_t")).select("id", "i", "_t.*")
    text = text.withColumn("_k", F.explode(_keys(F.col("w"), token_forms(F.col("w"), m), m))).select("id", "i", "w", "s", "e", "_k.*")
    # a merge join: the size of exploded keys isn't known when it is planned, and neither side is small enough to be sent through the driver
    hits = text.join(gloss.hint("merge"), ["id", "grade", "key"]).groupBy("id", "sense", "n", "j", "g", "i", "w", "s", "e").agg(F.min("grade").alias("grade"))
    runs = hits.filter("n > 1").groupBy("id", "sense", "n", (F.col("i") - F.col("j")).alias("_at")).agg(F.count("*").alias("_n"), F.max("grade").alias("grade"), F.min("s").alias("s"), F.max("e").alias("e"))
    runs = runs.filter("_n = n").select("id", "sense", F.col("n").alias("words"), "grade", "s", "e")
    own = lambda c, words_: F.col(c).isin(sorted(words_)) if words_ else F.lit(False)
    single = hits.filter((F.col("j") == 0) & ~own("w", m.stop) & ~(own("w", m.numbers) & ~own("g", m.numbers))).select("id", "sense", F.lit(1).alias("words"), "grade", "s", "e")
    order = F.struct((-F.col("words")).alias("words"), "grade", "sense", (F.col("s") - F.col("e")).alias("length"), "s", "e")
    best = runs.unionByName(single).groupBy("id").agg(F.min(order).alias("b"), F.max("s").alias("_last"), F.min("e").alias("_first"))
    sure = (F.col("b.grade") == 0) | ~((F.col("_first") <= F.col("b.s")) | (F.col("_last") >= F.col("b.e")))
    best = best.filter(sure).select("id", F.col("b.s").alias("start"), F.col("b.e").alias("end"), F.get(F.array(*map(F.lit, GRADES)), F.col("b.grade")).alias("grade"), F.col("b.sense").alias("sense"), (-F.col("b.words")).alias("words"))
    return items.select("id").join(best.hint("merge"), "id", "left")


def phrase_parts(items: DataFrame, equal) -> DataFrame:
    """id and parts (array<struct<start, end>>) of the words of ``text`` that are a form of ``phrase``: one part for a run in a row, else
    a part for each word, found in order from the left; null where there is neither.

    ``items``: id, phrase (forms apart by ``-/,()``, those with digits aside), text. ``equal(a, b)`` tells whether two words are
    equal. A run of an earlier or a later form goes before words apart; among either, the earlier form.
    """
    letters = "[A-Za-z']"
    forms = F.filter(F.transform(F.split(F.lower(F.coalesce("phrase", F.lit(""))), "[-/,()]"), lambda f: F.when(~F.regexp_like(f, F.lit(r"\d")), F.regexp_extract_all(f, F.lit("([a-z']+)"), F.lit(1)))), lambda w: F.size(w) > 0)
    rows = items.select("id", forms.alias("forms"), word_places(F.col("text"), letters).alias("words"))
    t, n = F.col("words"), F.size("words")
    # the first place of a run, from 1; 0: none
    run = lambda f: F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(n - F.size(f) + 1, F.lit(1))), lambda i: (n >= F.size(f)) & F.forall(F.sequence(F.lit(1), F.size(f)), lambda j: equal(F.element_at(f, j), F.get(t, i + j - 2)["w"]))), F.lit(1))

    def apart(f: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

        def step(s: Column, w: Column) -> Column:
            hit = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > s["at"]) & (i <= n) & equal(w, F.get(t, i - 1)["w"])), F.lit(1))
            return F.when(hit.isNull() | (s["at"] < 0), F.struct(F.lit(-1).alias("at"), s["hits"].alias("hits"))).otherwise(F.struct(hit.alias("at"), F.concat(s["hits"], F.array(hit)).alias("hits")))

        return F.aggregate(f, start, step, lambda s: F.when(s["at"] > 0, s["hits"]))

    whole = F.filter(F.transform("forms", lambda f: F.when(run(f).isNotNull(), F.array(F.struct(F.get(t, run(f) - 1)["s"].alias("start"), F.get(t, run(f) + F.size(f) - 2)["e"].alias("end"))))), lambda p: p.isNotNull())
    words = F.filter(F.transform("forms", lambda f: F.transform(apart(f), lambda i: F.struct(F.get(t, i - 1)["s"].alias("start"), F.get(t, i - 1)["e"].alias("end")))), lambda p: p.isNotNull())
    return rows.select("id", F.coalesce(F.get(whole, F.lit(0)), F.get(words, F.lit(0))).alias("parts"))
