"""Operators on literal tables: edge cases, ties, properties."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import dedup, matching, sampling, scoring, state
from wordloom.plans.ordinals import with_ordinal, with_running_sum
from wordloom.queries import ORACLE_SQL, QUERIES
from wordloom.sources import files
from wordloom.streaming import events as streams


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("x", "key"), [("The  Well-known Fact!", "well known fact"), (None, ""), ("", ""), ("To a", "a"), ("É!", "")])
def test_english_key(spark, x, key):
    assert one(spark, x, T.english_key) == key


def test_deletions_and_grams(spark):
    assert set(one(spark, "abc", T.deletions)) == {"abc", "ab", "ac", "bc"}
    assert one(spark, "abcd", lambda c: T.char_slices(c, 3)) == ["abc", "bcd"]
    assert one(spark, "ab", lambda c: T.char_slices(c, 3)) == []
    assert one(spark, "a b c", lambda c: T.grams(T.tokens(c), 2)) == ["a b", "b c"]


def test_fnv1a(spark):
    h = 2166136261
    for b in b"wordloom":
        h = (h ^ b) * 16777619 % 2**32
    assert one(spark, "wordloom", T.fnv1a) == h


def test_merge_meanings_keeps_arrival_order(spark):
    rows = spark.createDataFrame([("a", "y", 2), ("a", "x", 3), ("a", "y", 5), ("", "z", 1)], "k string, v string, o int")
    assert [tuple(r) for r in dedup.merge_meanings(rows, F.col("k"), "v", "o").collect()] == [("a", 2, "y; x")]


def test_replica_merge_is_idempotent_and_takes_the_later_level(spark):
    a = spark.createDataFrame([("k", 5, 1, 10), ("l", 1, 3, 1)], "key string, seen int, level int, last int")
    b = spark.createDataFrame([("k", 3, 2, 11), ("r", 2, 0, 4)], "key string, seen int, level int, last int")
    merge = lambda x, y: dedup.replica_merge(x, y, ["key"], ["seen"], "level", "last")
    out = {tuple(r) for r in merge(a, b).collect()}
    assert out == {("k", 5, 2, 11), ("l", 1, 3, 1), ("r", 2, 0, 4)}
    assert {tuple(r) for r in merge(a, a).collect()} == {tuple(r) for r in a.collect()}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 5), (2, "d", 6), (3, "e", 1)], "k int, v string, at int")
    assert sorted(map(tuple, dedup.upsert(old, new, ["k"], "at").select("k", "v").collect())) == [(1, "a"), (2, "d"), (3, "e")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12))
def test_levenshtein_pairs_equal_all_pairs(spark, words):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    found = {tuple(r) for r in matching.levenshtein_pairs(spark.createDataFrame([(w,) for w in words], "w string"), "w", 2).collect()}
    assert found == {(a, b, distance(a, b)) for a in set(words) for b in set(words) if a < b and distance(a, b) <= 2}


def test_similarity_join_covers_the_words_of_documents(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("ab1", k=rng.randrange(1, 8))) for _ in range(6)) for _ in range(12)] + ["Unlikely unlikly", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = {w for x in texts if x for w in x.lower().split()}
    want = {(a, b, k) for a in words for b in words if a < b and (k := distance(a, b)) <= 2}
    found = {tuple(r) for r in QUERIES["similarity_join_lev_documents"](spark, str(tmp_path)).collect()}
    assert found == want and ("unlikely", "unlikly", 1) in found


def test_overlap_pairs_in_groups_of_many_copies(spark):
    # every word is in more than 14 sets: a cut by frequency finds no pair at all
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    sets = [frozenset(words)] * 20 + [frozenset(rng.sample(words, rng.randrange(1, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(i, w) for i, x in enumerate(sets) for w in x], "id int, w string")
    want = {(i, j, len(x & y), len(x), len(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 10 * len(x & y) >= 6 * min(len(x), len(y))}
    assert {tuple(r) for r in matching.overlap_pairs(rows, "id", "w", (6, 10)).collect()} == want
    assert len(want) > 190
    assert matching.rare_word_pairs(rows, "id", "w", 14).count() == 0


def test_pairs_of_sets_carry_no_words(spark, monkeypatch):
    """Pairs go as ids to tasks that read the sets in blocks; results are those of brute force over several blocks and columns."""
    for name, value in {"BLOCK_WORDS": 100, "BLOCK_SETS": 16, "COLUMNS": 3, "HELD": 50, "DENSE": 0.2}.items():
        monkeypatch.setattr(matching, name, value, raising=False)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    sets = [frozenset(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 25))) for _ in range(90)]
    rows = spark.createDataFrame([(f"d{i}", w) for i, x in enumerate(sets) for w in x] + [(None, "w1"), ("d1", None)], "id string, w string")
    held = {w: sum(w in x for x in sets) for w in words}
    pair = lambda i, j: (f"d{i}", f"d{j}", len(sets[i] & sets[j]), len(sets[i]), len(sets[j]))
    pairs = [pair(i, j) for i in range(90) for j in range(90) if f"d{i}" < f"d{j}"]
    rare = {(f"d{i}", f"d{j}") for w in words if 2 <= held[w] <= 5 for i in range(90) for j in range(90) if w in sets[i] and w in sets[j]}
    overlapping, sharing = matching.overlap_pairs(rows, "id", "w", (6, 10)), matching.rare_word_pairs(rows, "id", "w", 5)
    assert sorted(map(tuple, overlapping.collect())) == sorted(p for p in pairs if 10 * p[2] >= 6 * min(p[3:]))
    assert sorted(map(tuple, sharing.collect())) == sorted(p for p in pairs if p[:2] in rare) and rare
    for df in (overlapping, sharing):
        assert "array_intersect" not in df._jdf.queryExecution().toString()


def test_jaccard_window_finds_pairs_that_share_frequent_words_only(spark, tmp_path):
    """Words of more than 14 texts count as others do, texts of one id are one, and what has over 255 frequent words is counted right."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(rng.sample(words[:30], rng.randrange(1, 25)))) for i in range(60)] + [(60 + i, " ".join(rng.sample(words, 390 - 60 * (i % 4)))) for i in range(20)]
    texts += [(3, "w0 w1 Extra"), (90, None), (91, ""), (None, "w0 w1")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets: dict[int, set[str]] = {}
    for i, x in texts:
        if i is not None and x:
            sets.setdefault(i, set()).update(x.lower().split())
    want = set()
    for a in sets:
        for b in sets:
            common, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 18 * whole <= 100 * common <= 62 * whole:
                want.add((a, b, common, whole))
    rows = list(map(tuple, QUERIES["jaccard_window"](spark, str(tmp_path)).collect()))
    assert set(rows) == want and len(rows) == len(want) and max(c for *_, c, _ in want) > 200
    assert "14" not in ORACLE_SQL["jaccard_window"]


def test_sets_of_different_kinds_lie_in_different_blocks(spark, monkeypatch):
    """Two kinds with few words in common are parted, so that comparing their blocks is little work; all pairs are those of brute force."""
    monkeypatch.setattr(matching, "BLOCK_SETS", 64, raising=False)
    monkeypatch.setattr(matching, "NEAR_SIZES", 8, raising=False)
    rng = random.Random(9)
    sets = [frozenset({k, *rng.sample(range(k, k + 300), rng.choice([1, 2, 5, 40, 280])), *rng.sample(range(900, 910), 2)}) for k in (0, 400) for _ in range(120)]
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id int, ws array<long>")
    blocks = [set(matching._Sorted(name).ids.to_pylist()) for name in matching._sorted_blocks(rows)]
    assert sorted(i for x in blocks for i in x) == list(range(240)) and max(map(len, blocks)) < 100
    assert sum(min(sum(i < 120 for i in x), sum(i >= 120 for i in x)) for x in blocks) < 12
    want = [(i, j, len(x & y), len(x), len(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 10 * len(x & y) >= 6 * min(len(x), len(y))]
    assert sorted(map(tuple, matching.overlapping(rows, (6, 10)).collect())) == want


def test_nearest_by_overlap_counts_frequent_words(spark):
    targets = spark.createDataFrame([(i, w) for i in range(20) for w in ("a", "b")] + [(20, "rare"), (7, "c")], "id int, w string")
    queries = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "rare"), (2, "b")], "id int, w string")
    assert sorted(map(tuple, matching.nearest_by_overlap(queries, targets).select("id", "best", "common").collect())) == [(1, 7, 3), (2, 0, 1)]


def test_mastery_equals_a_fold(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.random() < 0.6) for u in range(5) for i in range(rng.randrange(1, 12))]
    out = {r["u"]: r["level"] for r in state.mastery(spark.createDataFrame(rows, "u int, i int, ok boolean"), ["u"], F.col("ok"), "i").collect()}
    for u in out:
        level = -1
        for x in rows:
            if x[0] == u:
                level = streams.next_level(level, x[2])
        assert out[u] == level


def test_mastery_of_a_hot_key_is_never_gathered_in_one_row(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.choice([True, False, False, None])) for i in range(3000)] + [(None, 1, True), ("cold", 2, False)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, i int, ok boolean").repartition(4)
    out = state.mastery(df, ["u"], F.col("ok"), "i")
    level, seen, wrong = -1, 0, 0
    for _, _, ok in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1]):
        level, seen, wrong = streams.next_level(level, ok), seen + 1, wrong + (ok is False)
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        assert {tuple(r) for r in out.collect()} == {("hot", seen, wrong, level), (None, 1, 0, 3), ("cold", 1, 1, 0)}
        placed = df.repartitionByRange("u", "i").filter("u = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert "collect_list(struct(part" in out._jdf.queryExecution().analyzed().toString()
    assert placed > 1


def test_votes(spark):
    v = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (2, 1)], "i int, x int")
    assert sorted(map(tuple, scoring.plurality(v, "i", "x").collect())) == [(1, 1, 2), (2, None, 1)]
    assert sorted(map(tuple, scoring.majority(v.withColumn("y", F.col("x") == 1), "i", "y").collect())) == [(1, 2, 3, True), (2, 1, 2, False)]


def test_ordinals_and_running_sums(spark):
    rng = random.Random(1)
    values = rng.sample(range(1000), 200)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    assert {r["v"]: r["ordinal"] for r in with_ordinal(df, F.col("v")).collect()} == {v: i for i, v in enumerate(sorted(values), 1)}
    run, want = 0, {}
    for v in sorted(values):
        want[v] = run = run + v
    assert {r["v"]: r["running"] for r in with_running_sum(df, F.col("v"), F.col("v")).collect()} == want


def test_split_shares(spark):
    n = sampling.hash_split(spark.range(2000), "id", "s", {"a": 80, "b": 20}).groupBy("part").count().collect()
    assert abs({r[0]: r[1] for r in n}["a"] - 1600) < 80


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# note\none\t1\n\t2\ntwo\t3\textra\nshort\n")
    assert sorted(map(tuple, files.lenient_tsv(spark, str(tmp_path / "a.tsv"), ["w", "n"]).collect())) == [("one", "1"), ("two", "3")]
    (tmp_path / "t.md").write_text("| n | w |\n|---|---|\n| 1 | a |\n| 2 | b |\n")
    assert sorted(map(tuple, files.markdown_table(spark, str(tmp_path / "t.md"), ["n", "w"]).collect())) == [("1", "a"), ("2", "b")]
    good = spark.createDataFrame([("k", "y"), ("k", "y")], "k string, v string")
    assert files.ledger(good, ["k"], "v").count() == 1
    with pytest.raises(Exception, match="contradicting"):
        files.ledger(good.unionByName(spark.createDataFrame([("k", "n")], "k string, v string")), ["k"], "v").collect()
    files.write_tsv(spark.createDataFrame([("a\tb", None)], "x string, y int"), str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out")).first()["x"] == "a b"


def test_strict_lines_and_corrupt_lines(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a\tb\tc\none\n")
    with pytest.raises(Exception, match="not 3 fields"):
        files.strict_tsv(spark, str(tmp_path / "s.tsv"), ["x", "y", "z"]).count()
    with pytest.raises(Exception, match="not 3 fields"):
        files.strict_tsv(spark, str(tmp_path / "s.tsv"), ["x", "y", "z"]).select("x").collect()
    (tmp_path / "j.jsonl").write_text('{"k": 1}\n{"k": \n\n{"k": 2, "z": 3}\n')
    good, bad = files.json_lines(spark, str(tmp_path / "j.jsonl"), "k INT")
    assert sorted(r[0] for r in good.collect()) == [1, 2] and good.count() == 2 and [r[0] for r in bad.collect()] == ['{"k": ']


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("big (red) dog\t1\nplain\t2\n")
    assert sorted(r[0] for r in files.lenient_tsv(spark, str(tmp_path / "v.tsv"), ["w", "n"], variants=True).collect()) == ["big dog", "big red dog", "plain"]
    (tmp_path / "x.txt").write_text("# no\nkeep\tbecause\n\nkeep\n")
    assert [r[0] for r in files.exceptions(spark, str(tmp_path / "x.txt")).collect()] == ["keep"]
    (tmp_path / "w.txt").write_text(" one \n#c\n\none\ntwo\n")
    assert sorted(r[0] for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["one", "two"]
    for k in (1, 2):
        (tmp_path / f"unit-{k}-words.tsv").write_text(f"w{k}\n")
    assert [tuple(r) for r in files.other_files(spark, str(tmp_path / "unit-*-words.tsv"), "unit-2-words.tsv").collect()] == [("unit-1-words.tsv", "w1")]
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "a.md").write_text("One two")
    (tmp_path / "c" / "d" / "b.md").write_text("two two")
    assert sorted(map(tuple, files.corpus_tokens(spark, str(tmp_path / "c"), "md").collect())) == [("one", 1, 1), ("two", 2, 3)]
    (tmp_path / "dump.xml").write_text("<page><title>A</title><text>x\n# a [[b|c]] {{d}}\n## no\n</text></page><page><title>B</title><redirect title=\"A\" /><text></text></page>")
    assert sorted(map(tuple, files.dump_entries(spark, str(tmp_path / "dump.xml")).collect())) == [("A", None, ["a c"]), ("B", "A", [])]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_tsv(rows.coalesce(1), str(tmp_path / "t"), "made by hand")
    assert next((tmp_path / "t").glob("part-*")).read_text() == "# made by hand\nk\tv\n1\ta\n2\tb\n"
    files.write_json(rows, str(tmp_path / "j"))
    files.write_json(rows, str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    lines = spark.createDataFrame([("a",), ("b",), ("a",)], "value string")
    assert files.fingerprint(lines).first() == files.fingerprint(lines.orderBy(F.desc("value")).repartition(3)).first() != files.fingerprint(lines.distinct()).first()


def test_short_passages_are_found(spark):
    texts = spark.createDataFrame([(1, "the big red dog ran"), (2, "bigger"), (3, None)], "id long, text string")
    passages = spark.createDataFrame([(1, "big red dog"), (2, "big"), (3, "e big red dog ra"), (4, ""), (5, "red dog")], "id long, text string")
    assert sorted(map(tuple, matching.contained(passages, texts).collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (5, 1)]


def test_ordinals_hold_on_many_rows(spark):
    """More rows than range bounds are sampled from: both sides of the numbering must see one partitioning."""
    df = spark.range(0, 200_000, 1, 7).select(F.xxhash64("id").alias("v"), F.lit("x").alias("wide"))
    out = with_ordinal(df, F.col("v")).agg(F.count_distinct("ordinal"), F.max("ordinal")).first()
    assert tuple(out) == (200_000, 200_000)


def test_streams_equal_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.withColumn("p", F.col("event_id") % 3).repartition(3, "p").drop("p").write.parquet(str(tmp_path / "in"))
    stream = streams.once(streams.event_stream(spark, str(tmp_path / "in")), "60 days")
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == e.count()


def test_mastery_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.mastery_stream(streams.event_stream(spark, str(tmp_path / "in")).withColumn("ok", F.col("value") >= 20))
    q = stream.writeStream.format("memory").queryName("mastery").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    batch = state.mastery(e, ["user_id", "event_type"], F.col("value") >= 20, "ts", "event_id")
    assert {tuple(r) for r in spark.table("mastery").collect()} == {tuple(r) for r in batch.select("user_id", "event_type", "seen", "wrong", "level").collect()}


def test_windowed_counts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(streams.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    want = {(str(r[0]), r[1]): r[2] for r in e.groupBy(F.to_date("ts"), "event_type").count().collect()}
    assert {(str(r["start"])[:10], r["event_type"]): r["n"] for r in spark.table("windows").collect()} == want


def test_senses_are_split_once_and_parts_dealt_out(spark, sf):
    from wordloom.functions import scalars as S
    from wordloom.sources.files import table

    x = S.joined_senses(S.senses(F.col("m"), ("also",)))
    rows = spark.createDataFrame([(0, "a, b; c (x); also: d"), (1, "also; also"), (2, "one"), (3, ""), (4, None), (5, "a,b,c,d,e,f")], "i int, m string")
    out = rows.repartition(1).select("i", x.alias("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    runs = lambda w: [" ".join(w[i : i + n]) for i in range(min(len(w), 5)) for n in range(2, min(len(w), 5) - i + 1) if w[i : i + n] != w]
    want = [runs(list("abcd")), [], [], [], [], runs(list("abcdef"))]
    assert [r["x"] for r in out.orderBy("i").collect()] == want
    assert table(spark, sf, "part", deal=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nearest_by_overlap_shuffles_no_words_of_targets(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    docs = [(i % 55, " ".join(rng.choices("abcdefghij", k=rng.randrange(6)))) for i in range(60)] + [(99, None)]
    items = [(f"q{i}", " ".join(rng.choices("abcdefgxyz", k=rng.randrange(1, 7)))) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sets = {i: {w for j, t in docs if i == j for w in (t or "").split()} for i, _ in docs}
    want = set()
    for q, text in items:
        common, t = max((len(x & set(text.split())), -i) for i, x in sets.items())
        if common:
            want.add((q, -t, common, round(common / len(set(text.split())), 6)))
    for most, held in ((400_000, 1 << 21), (9, 36)):  # one pass and several; all targets of a batch at once and a few
        monkeypatch.setattr(matching, "MOST_QUERY_WORDS", most)
        monkeypatch.setattr(matching, "HELD_COUNTS", held)
        found = QUERIES["nearest_by_overlap"](spark, str(tmp_path))
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]


def test_sifted_keeps_all_known_keys_and_few_others(spark):
    from wordloom.plans.joins import sifted

    rows = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    table = spark.range(0, 20_000, 100).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    left = {r["k"] for r in sifted(rows, "k", table).collect()}
    assert left >= {f"k{i}" for i in range(0, 20_000, 100)} and len(left) < 300
    assert sifted(rows, "k", table.filter("false")).count() == 0


def test_levenshtein_pairs_are_checked_before_they_are_made_distinct(spark):
    words = spark.createDataFrame([("kitten",), ("sitten",), ("sittin",), (None,)], "w string")
    found = matching.levenshtein_pairs(words, "w", 2)
    assert sorted(map(tuple, found.collect())) == [("kitten", "sitten", 1), ("kitten", "sittin", 2), ("sitten", "sittin", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate") and "xxhash64(" in plan  # variants meet as numbers, and pairs are checked below the last sum
