"""Phrase mining, vector codes and the quality discriminant against brute force, and all SQL of the subpackage."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_operators import EDGES, docs, prose, rows_of
from tests.test_queries import plain
from wordloom.llm import phrase_lists, quality_qda, queries, vector_va

# ---- SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


# ---- 11


def brute_phrases(rows, most_words, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every slice of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(x[0] == lang and len(x[1]) > len(w) and 100 * b >= 100 * a and any(x[1][i : i + len(w)] == w for i in range(len(x[1]) - len(w) + 1)) for x, b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rank, found = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return found


def phrase_rows(rng):
    words = ["Ab", "b", "c", "dé", "日", "e\x85f", "#"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "! "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return [(rng.choice(["en", "en", "en", None, "und", "日"]), t) for t in [*texts, *EDGES, "a b c d e a b c d e", "x " * 3000, ".,;" * 50]]


@pytest.mark.parametrize(("block_words", "most_sent"), [(50, 1 << 20), (1 << 20, 1 << 20), (50, 0)])
def test_phrases_equal_brute_force(spark, block_words, most_sent):
    rows = phrase_rows(random.Random(1))
    rows += rows[:20]
    table = spark.createDataFrame([(i, t, lang, 1, 2) for i, (lang, t) in enumerate(rows)], "n long, text string, lang string, id int, phrase int").repartition(3)
    for most_words, least, top in ((5, 4, 1000), (3, 2, 7), (2, 30, 3)):
        got = phrase_lists.collocations(table, most_words, least, top, block_words, most_sent)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, most_words, least, top))


def test_phrases_of_nothing(spark):
    nothing = spark.createDataFrame([], "text string, lang string")
    assert phrase_lists.collocations(nothing).count() == 0
    assert phrase_lists.collocations(spark.createDataFrame([(None, None), ("", "en"), (" \n", "en")], "text string, lang string"), least=1).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([(1, "en", b"a b", b"b", big, [big + 7], [big + 9], 0, 0)], "id long, lang string, phrase binary, last binary, f long, starts array<long>, ends array<long>, prefix long, suffix long")
    totals = spark.createDataFrame([("en", 10**15 + 3)], "lang string, n long")
    assert phrase_lists.scored(phrases, totals).collect()[0]["score"] == 1000 * big * (10**15 + 3) // ((big + 7) * (big + 9))


def test_positions_never_cross_pieces():
    words, at = phrase_lists.words_and_places(b"A b,c\t d\n\n e")
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e"] and at.tolist() == [0, 1, 3, 4, 6]
    text = b"w " * 10 + b"." + b"v " * 3
    assert b"".join(phrase_lists._slices(text)) == text
    long = (b"word " * 300_000 + b". ") * 5
    assert b"".join(phrase_lists._slices(long)) == long and all(x.endswith(b".") for x in list(phrase_lists._slices(long))[:-1])


def test_pairs_survive_packing_and_are_found():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2**40, (3, 500))
    rows[0, :300] = rows[0, 0]
    prefix, suffix, n = phrase_lists._summed(*np.concatenate([rows, rows[:, :50]], axis=1))
    assert n.sum() == rows[2].sum() + rows[2, :50].sum()
    assert (phrase_lists._unpack_pairs(len(n), phrase_lists._pack_pairs(prefix, suffix, n)) == np.stack([prefix, suffix, n])).all()
    assert (phrase_lists._find_pairs(prefix, suffix, prefix, suffix) == np.arange(len(n))).all()
    assert (phrase_lists._find_pairs(prefix, suffix, prefix, suffix + 1)[prefix == prefix[0]] < len(n)).all()
    assert (phrase_lists._find_pairs(prefix, suffix, np.array([-1, prefix[0]]), np.array([3, 2**41])) == -1).all()
    assert (phrase_lists._find_pairs(prefix[:0], suffix[:0], prefix, suffix) == -1).all()


# ---- 12


def brute_codes(rows, entries=256, rounds=4):
    kept = sorted(((i is None, i or 0, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:3])
    data = [[math.floor(1024 * x) for x in v] for _, _, v, _ in kept]
    w = len(data[0]) // 4
    parts = [[x[p * w : (p + 1) * w] for p in range(4)] for x in data]
    books = [[x[p] for x in parts[:entries]] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(4)] for x in parts]

    for _ in range(rounds):
        near = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [x[p] for x, n in zip(parts, near, strict=True) if n[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = assign()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in n) for n in near]
    by = Counter()
    for (*_, lab), e in zip(kept, error, strict=True):
        by[lab] += e
    return [(None if none else i, "".join(f"{k:02x}" for _, k in n), e, by[lab], sha) for (none, i, _, lab), n, e in zip(kept, near, error, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, code int, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)


def random_vectors(seed, n, width=8, steps=5):
    rng = random.Random(seed)
    return [(i if i % 17 else None, [rng.randint(-steps, steps) / 7 for _ in range(width)], rng.choice([None, 0, 1])) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = random_vectors(3, 400)
    odd = [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [float("nan")] + [0.0] * 7, 2), (4, [float("inf")] * 8, None)]
    got = vector_va.vector_codes(vectors(spark, rows + rows[:60] + odd))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(got) == sorted(brute_codes(rows + rows[:60] + odd), key=str)


def test_codes_of_few_equal_and_no_rows(spark):
    few = [(5, [0.1, -0.2, 0.3, 4.0], None), (5, [0.1, -0.2, 0.3, 4.0], None), (6, [0.1, 0.2, -0.3, 4.0], 1)]
    assert rows_of(vector_va.vector_codes(vectors(spark, few))) == sorted(brute_codes(few), key=str)
    for rows in ([], [(1, None, 1)], [(1, [None] * 4, 1)]):
        out = vector_va.vector_codes(vectors(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_ragged_and_huge_vectors_are_refused(spark):
    for v in ([1.0] * 8, [3e38] * 4, [1.0] * 3):
        with pytest.raises(Exception, match="vectors must have|components are too large"):
            vector_va.vector_codes(vectors(spark, [(1, [0.5] * 4, 1), (2, v, 1)])).collect()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 16))
    entries = centres[rng.integers(0, 40, 256)] + rng.integers(-30, 30, (256, 16))
    parts = centres[rng.integers(0, 40, 500)] + rng.integers(-30, 30, (500, 16))
    va = vector_va.Approximation(entries)
    lower, upper = va.bounds(parts)
    exact = ((parts[None] - entries[:, None]) ** 2).sum(2)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(0)).mean() < 0.1  # few candidates are refined
    number, distance = va.nearest(parts)
    assert (number == exact.argmin(0)).all() and (distance == exact.min(0)).all()


# ---- 13


def test_quality_on_held_out_rows(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_qda.quality(docs_, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good = [r["score"] for r in rows if r["quality"]]
    bad = [r["score"] for r in rows if not r["quality"]]
    assert len(bad) > 5 and sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good) and sum(s < 0.3 for s in bad) >= 0.9 * len(bad)


def test_held_out_labels_are_never_read(spark):
    docs_, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = rows_of(quality_qda.quality(docs_, labels))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs_.withColumns({"lang": F.lit("zz"), "source": F.lit(None), "n_chars": F.lit(1)})
    assert rows_of(quality_qda.quality(renamed.repartition(7), flipped)) == out


def test_discriminant_equals_formula(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 80)) for _ in range(60)] + [" ".join(w + "!!" for w in prose(rng, 40).upper().split()) for _ in range(40)]
    table = docs(spark, texts, first=1)
    rows = quality_qda.labelled(quality_qda.with_statistics(table), spark.createDataFrame([(i, int(i <= 60)) for i in range(1, 101)], "doc_id long, quality int"))
    model, sums = quality_qda.fit(rows), quality_qda.moments(rows)
    x = [np.array([np.rint(np.array(quality_qda.statistics(t.encode())) * 1024) / 1024 for i, t in enumerate(texts, 1) if zlib.crc32(str(i).encode()) % 5 and (i <= 60) == k]) for k in (False, True)]
    assert [sum(sums[f, k][0, 0] for f in (0, 1)) for k in (0, 1)] == [len(v) for v in x]
    pooled, diagonal = next((p, d) for p in quality_qda.POOLED for d in quality_qda.DIAGONAL for t in quality_qda.TEMPERATURES if np.allclose(quality_qda.Discriminant([sums[0, k] + sums[1, k] for k in (0, 1)], p, d, t).difference(np.rint(x[0] * 1024)), model.difference(np.rint(x[0] * 1024))))
    spread = [np.cov(v.T, bias=True) for v in x]
    both = sum(s * len(v) for s, v in zip(spread, x, strict=True)) / sum(map(len, x))
    both = (1 - diagonal) * both + diagonal * np.diag(np.diag(both)) + np.eye(len(both)) / 1024
    logs = []
    for s, v in zip(spread, x, strict=True):
        c = (1 - pooled) * s + pooled * both
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", x[0] - v.mean(0), np.linalg.inv(c), x[0] - v.mean(0)) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.difference(np.rint(x[0] * 1024)), math.log(len(x[1]) / len(x[0])) + model.temperature * (logs[1] - logs[0]), rtol=1e-4)


def test_quality_of_odd_rows(spark):
    table = docs(spark, [*EDGES, "word " * 400_000]).withColumns({"score": F.lit("x"), "x": F.lit(1), "quality": F.lit(9)})
    table = table.unionByName(table.filter("doc_id < 3")).unionByName(table.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, share in ((none, 0.5), (spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int"), 1.0)):
        out = quality_qda.quality(table, labels).collect()
        assert len(out) == 15 and {r["score"] for r in out} == {share} and {r["predicted"] for r in out} == {1}
    mixed = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (6, 0), (8, 1), (9, 1), (None, 0)], "doc_id long, quality int")
    out = quality_qda.quality(table, mixed).collect()
    assert len(out) == 15 and all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert quality_qda.quality(table.limit(0), mixed).count() == 0


def test_held_pairs_are_added_up_in_little_memory():
    import tracemalloc

    import numpy as np

    from wordloom.llm import phrase_lists as P

    rng = np.random.default_rng(3)
    held = [[] for _ in range(P.HELD_PARTS)]
    total = 0
    tracemalloc.start()
    for _ in range(4):
        prefix, suffix, n = rng.integers(0, 2000, 400_000), rng.integers(0, 500, 400_000), rng.integers(1, 9, 400_000)
        P.hold(held, prefix, suffix, n, 500)
        total += int(n.sum())
    del prefix, suffix, n
    tracemalloc.reset_peak()
    start, seen, summed = tracemalloc.get_traced_memory()[0], set(), 0
    for batch in P.sent_pairs(held, 500):
        for bucket, n, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "pairs")), strict=True):
            a, b, k = P._unpack_pairs(n, packed)
            assert bucket not in seen and len(set(zip(a.tolist(), b.tolist(), strict=True))) == n
            seen.add(bucket)
            summed += int(k.sum())
    peak = tracemalloc.get_traced_memory()[1] - start
    tracemalloc.stop()
    assert summed == total and not any(held)
    assert peak < 12 << 20  # all at once took several times what is held, 32 MB


def test_a_block_of_phrases_needs_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from wordloom.llm import phrase_lists as P

    rng = np.random.default_rng(5)
    words = [b"w%d" % i for i in range(3000)]
    texts = [b" ".join(words[i] + b"," * int(i % 7 == 0) for i in rng.zipf(1.3, 300_000) % 3000) for _ in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array([t.decode() for t in texts])], ["lang", "text"])
    tracemalloc.start()
    P.words_and_places(texts[0])
    cut = tracemalloc.get_traced_memory()[1]
    peaks, n = [], 0
    for ((_, found, places),) in P._blocks(iter([batch])):
        coded = found.dictionary_encode()
        sizes, lists = P._grouped(coded.indices.to_numpy(), len(coded.dictionary), places)
        n += len(found)
        tracemalloc.reset_peak()
        start = tracemalloc.get_traced_memory()[0]
        first, second, at = P.merged(np.arange(len(sizes)), sizes, lists.values.to_numpy())
        peaks.append(tracemalloc.get_traced_memory()[1] - start)
        del first, second, at
    tracemalloc.stop()
    assert n == sum(len(t.replace(b",", b"").split()) for t in texts)
    assert cut < 16 * len(texts[0]) and max(peaks) < 24 << 20


def test_blocks_batches_are_bounded_by_bytes_and_settings_come_back(spark):
    from wordloom.llm import phrase_lists as P

    docs = spark.createDataFrame([("a b a b a b", "en")] * 60, "text string, lang string")
    names = list(P.BATCHES)
    spark.conf.set(names[0], "321")
    found = P.collocations(docs, block_words=50, most_sent=0)
    assert {r["phrase"] for r in found.collect()} == {"a b", "a b a b"}
    assert names[1].endswith("maxBytesPerBatch") and spark.conf.get(names[1]) != P.BATCHES[names[1]]
    assert spark.conf.get(names[0]) == "500"  # what ``tune`` sets
