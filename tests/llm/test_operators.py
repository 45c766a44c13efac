"""Training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import decontam_sam, gumbel_pieces, html_template, line_bloom, minhash_cps, pii_boost, quality_sketch, token_orc, toxic_nbsvm, warc_zip
from wordloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts, first)], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


EDGES = [None, "", " \n\t", "one", "One two three", "a\x85b c\x1cd é İ Σ 日本", "x" * 50_000, "\n\n\n", "same text here for all of us", "same text here for all of us"]


# ---- 1


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é"), (2, "u\r\nv", "<p>é"), (3, None, None), (4, "w", ""), (5, "x", "y" * 100_000), (None, "z", "alone")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    out = {r["page_id"]: r for r in warc_zip.archived(pages).collect()}
    assert len(out) == 6 and out[1]["record_type"] == "revisit" and out[1]["refers_to"] == 2 and out[2]["record_type"] == "response"
    assert out[3]["refers_to"] == 4 and out[3]["payload_bytes"] == 0 and out[5]["payload_bytes"] == 100_000 and out[None]["record_type"] == "response"
    assert out[1]["payload_digest"] == warc_zip.payload_digest("<p>é".encode())
    assert warc_zip.archived(pages.limit(0)).count() == 0


def test_warc_small_payloads_stay_responses(spark):
    from wordloom.llm.common import work_dir

    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    warc_zip.write_packages(pages, path := work_dir(spark, "t"), least_bytes=3)
    out = {r["page_id"]: (r["record_type"], r["payload"] and bytes(r["payload"])) for r in warc_zip.read_packages(spark, path).collect()}
    assert out == {1: ("response", b"aa"), 2: ("response", b"aa"), 3: ("revisit", None), 4: ("response", b"bbbb")}


def test_rows_alike_have_one_response(spark):
    pages = spark.createDataFrame([(5, "u", "same"), (5, "u", "same"), (5, "u", "same"), (3, "u", "same"), (7, "v", "own")], "page_id long, url string, html string")
    out = rows_of(warc_zip.archived(pages).select("page_id", "record_type", "refers_to"))
    assert out == sorted([(5, "response", None), (5, "revisit", 5), (5, "revisit", 5), (3, "revisit", 5), (7, "response", None)], key=str)


def test_zip64_directories(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("archive/data.warc.gz", "indexes/index.cdx"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(name.encode() * 3)
    data = (tmp_path / "a.zip").read_bytes()
    m = warc_zip.Members(lambda at, n: data[at : at + n], len(data))
    at, n = m.place("indexes/index.cdx")
    assert data[at : at + n] == b"indexes/index.cdx" * 3
    # the same with a ZIP64 end record and a directory whose offsets stand in extra fields
    end = data.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    directory = b""
    for name, (_, header, packed) in m.entries.items():
        extra = struct.pack("<HHQQQ", 1, 24, packed, packed, header)
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
    wide = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(directory), start)
    locator = struct.pack("<IIQI", 0x07064B50, 0, start + len(directory), 1)
    big = data[:start] + directory + wide + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.Members(lambda a, k: big[a : a + k], len(big)).entries == m.entries
    with pytest.raises(ValueError):
        warc_zip.Members(lambda a, k: b"no zip"[a : a + k], 6)


# ---- 2


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 120).split() for _ in range(6)]
    texts = list(EDGES)
    for k in range(150):  # copies with a few changed words, so that similarities lie on both sides of the threshold
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"w{k}"
        texts.append(" ".join(w).upper() if k % 7 == 0 else " ".join(w))
    df = docs(spark, texts).withColumn("node", F.lit("clash"))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_cps.near_duplicates(df).collect()}
    assert out == brute_components(list(enumerate(texts)))
    assert minhash_cps.near_duplicates(df.limit(0)).count() == 0
    kept = minhash_cps.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in out.items() if i == c}


def test_star_steps_equal_local_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a != b] + [(100 + k, 101 + k) for k in range(20)]
    links = spark.createDataFrame(edges, "a long, b long")
    local = rows_of(minhash_cps.components(links).filter("id <> label"))
    monkeypatch.setattr(minhash_cps, "MOST_LOCAL", 0)
    assert rows_of(minhash_cps.components(links).filter("id <> label").select("id", "label")) == local


def test_pairs_inside_a_dense_group_are_found(spark):
    """Texts of 300 common and 60 own words overlap by 71 % and aren't linked; pairs that share 11 of the own ones overlap by
    76 %. Little but chance tells the pairs from the rest, and each must be found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    common, texts = [word() for _ in range(300)], []
    for k in range(1000):
        shared = [word() for _ in range(11)]
        for _ in range(2 if k < 500 else 1):
            texts.append(" ".join(common + (shared if k < 500 else []) + [word() for _ in range(49 if k < 500 else 60)]))
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["component_id"] for r in minhash_cps.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    want = {i: i - i % 2 if i < 1000 else i for i in range(1500)}
    assert [i for i in want if out[i] < want[i]] == []
    assert sum(out[i] != want[i] for i in want) <= 5


def test_pairs_of_a_dense_group_without_rare_shared_shingles_are_found(spark):
    """Texts of 296 common shingles and four of twelve blocks, each in a third of the texts: those of the same four overlap by
    76 %, those of three by less than 75 %. What tells pairs from the rest is frequent, and none may be missed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    common, blocks = [word() for _ in range(300)], [[word() for _ in range(9)] for _ in range(12)]
    chosen = list(itertools.combinations(range(12), 4))
    chosen += rng.sample(chosen, 105)
    rng.shuffle(chosen)
    texts = [" ".join(common + [w for b in c for w in [word(), *blocks[b]]] + [word() for _ in range(30)]) for c in chosen]
    first = {}
    want = {i: first.setdefault(c, i) for i, c in enumerate(chosen)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r["doc_id"]: r["component_id"] for r in minhash_cps.near_duplicates(rows).collect()} == want


def test_dense_group_keeps_its_components(spark, monkeypatch):
    """Hundreds of loose copies of one text, below the threshold to most others, among them near pairs: no component is lost."""
    rng = random.Random(1)
    base = prose(rng, 150).split()
    texts = []
    for k in range(500):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(1, 9)):
            w[at] = f"w{k}x{at}"
        texts.append(" ".join(w))
        if k % 5 == 0:
            texts.append(" ".join([*w[:-1], f"end{k}"]))
    monkeypatch.setattr(minhash_cps, "SMALL", 20)
    want = brute_components(list(enumerate(texts)))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_cps.near_duplicates(docs(spark, texts)).collect()}
    wrong = sum(out[i] != want[i] for i in want)
    assert 1 < len({c for _, c in want.values()}) < len(texts) - 100 and wrong <= 0.01 * len(texts)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    text, other = prose(rng, 40), prose(rng, 40)
    rows = spark.createDataFrame([(1, text), (1, other), (2, text), (None, text), (3, other), (None, None)], "doc_id long, text string")
    out = rows_of(minhash_cps.near_duplicates(rows).select("doc_id", "component_id").filter("doc_id IS NOT NULL"))
    assert sorted(out) == [(1, 1), (1, 1), (2, 1), (3, 1)]


# ---- 3


@pytest.fixture(scope="module")
def vocabulary():
    return gumbel_pieces.Vocabulary(tokenizer_file("piece_bpe_32k.model"))


def all_paths(text, v):
    distinct, unit, _ = gumbel_pieces.units_of([text])
    units = [distinct[int(i)].as_py() for i in unit]
    x = gumbel_pieces.Lattices(units, v)

    def go(w, p):
        if p == x.start[w + 1] - 1:
            yield from (go(w + 1, x.start[w + 1]) if w + 1 < len(units) else [((), 0.0)])
            return
        for e in range(x.first[p], x.first[p] + x.many[p]):
            for rest, log in go(w, p + x.size[e]):
                yield (int(x.ids[e]), *rest), log + math.log(x.prob[e])

    return dict(go(0, 0))


def test_samples_follow_the_distribution(vocabulary):
    text = "the cat"
    paths = all_paths(text, vocabulary)
    assert abs(sum(map(math.exp, paths.values())) - 1) < 1e-9
    first, weight, n = Counter(), 0.0, 4000
    for s in gumbel_pieces.sample_texts([text] * n, list(range(n)), vocabulary, 3):
        first[tuple(s[0]["ids"].tolist())] += 1
        assert len({tuple(x["ids"].tolist()) for x in s}) == 3
        assert [x["perturbed"] for x in s] == sorted((x["perturbed"] for x in s), reverse=True)
        weight += sum(math.exp(x["log_prob"]) / x["inclusion"] for x in s)
    assert abs(weight / n - 1) < 0.03  # unbiased estimate of a sum over all paths
    for p, log in sorted(paths.items(), key=lambda x: -x[1])[:3]:
        assert abs(first[p] / n - math.exp(log)) < 0.03


def test_more_samples_than_paths_give_all(vocabulary):
    s = gumbel_pieces.sample_texts(["a b"], [1], vocabulary, 1000)[0]
    assert len(s) == len(all_paths("a b", vocabulary)) and all(x["inclusion"] == 1 for x in s)


def test_pieces_round_trip(spark, vocabulary):
    texts = [*EDGES, "  two  spaces ", "  　x", "🙂 naïve\r\n", "é" * 3000]
    df = docs(spark, texts).withColumn("samples", F.lit(0))
    out = gumbel_pieces.sample_pieces(df, tokenizer_file("piece_bpe_32k.model"), 2)
    assert out.columns == df.columns
    rows = gumbel_pieces.decode_pieces(out.select("doc_id", F.expr("inline_outer(samples)")), tokenizer_file("piece_bpe_32k.model")).collect()
    for r in rows:
        assert r["decoded"] == texts[r["doc_id"]] or r["ids"] is None and texts[r["doc_id"]] is None or r["ids"] == [] and texts[r["doc_id"]] == ""
    again = {(r["doc_id"], r["sample_rank"]): r["ids_crc32"] for r in gumbel_pieces.sample_digests(docs(spark, texts).repartition(3), tokenizer_file("piece_bpe_32k.model")).collect()}
    for r in rows:
        if r["ids"]:
            assert again[r["doc_id"], r["sample_rank"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert gumbel_pieces.sample_digests(df.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


# ---- 4


def test_tokens_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x24F)] + ["'s", "'re", "'", "<|endoftext|>", "̇", "Σ", "日"]
    texts = [*EDGES, *["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, block int").repartition(5)
    token_orc.write_tokens(df, path := f"file://{tmp_path}/tokens", tokenizer_file("word_bpe_49k.json"), file_bytes=20_000)
    start = 0
    for r in token_orc.located(spark, path).orderBy("doc_id").collect():
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r["doc_id"]]
        start += len(ids)
    assert [r["doc_id"] for r in token_orc.read_tokens(spark, path, doc_ids=[7, 200]).orderBy("doc_id").collect()] == [7, 200]
    plan = token_orc.read_tokens(spark, path, between=(3, 9))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3), LessThanOrEqual(doc_id,9)]" in plan
    assert token_orc.token_positions(df.limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_words_of_any_script_equal_the_library():
    encoder = token_orc.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(6)
    letters = [*"abc  ssttrevmlld019.,_\n\t", *("'" * 3), *map(chr, range(0x80, 0x280)), *"Σσς日　éΑ\u0301\u2028Ⱥ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["x\x1cy", "a<|endoftext|>b", "", None, "'", "don't'", "'s's", "y" * 3_000_000 + " é"]
    for at in range(0, len(texts), 101):
        part = texts[at : at + 101]
        ids, ends = encoder.texts(part)
        for t, a, z in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if t is None or len(t) < 1000:
                assert ids[a:z].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], t


def test_token_files_have_indexes_and_skip_by_them(spark, tmp_path):
    df = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_orc.write_tokens(df, path := f"file://{tmp_path}/tokens", tokenizer_file("word_bpe_49k.json"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    orc, (file,) = jvm.org.apache.orc.OrcFile, list((tmp_path / "tokens").glob("*.orc"))
    reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{file}"), orc.readerOptions(conf))
    column = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
    streams = [(str(x.getKind()), x.getColumn()) for stripe in reader.getStripes() for x in reader.rows().readStripeFooter(stripe).getStreamsList()]
    assert ("ROW_INDEX", column) in streams and ("BLOOM_FILTER_UTF8", column) in streams
    assert reader.rows().readStripeFooter(reader.getStripes()[0]).getColumns(column).getKind().toString() == "DIRECT_V2"  # run lengths of integers

    def scanned(rows):
        rows = rows.select("doc_id")
        rows.collect()
        return rows._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert scanned(token_orc.read_tokens(spark, path)) == 20_000
    assert scanned(token_orc.read_tokens(spark, path, doc_ids=[20_000])) <= 1000  # one row group, by statistics
    assert scanned(token_orc.read_tokens(spark, path, doc_ids=[20_001])) == 0  # within a group's range: only its Bloom filter knows


# ---- 5


def brute_lines(rows, least=5):
    spaces = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(spaces).translate(low)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= least}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    pool = [prose(rng, 12)[:n] for n in (39, 40, 41, 60, 60)] + ["é" * 39, "É" * 40, "é" * 40]
    texts = list(EDGES)
    for _ in range(60):
        texts.append("\n".join(rng.choice(["", " \t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  "]) for x in rng.choices(pool, k=rng.randrange(1, 5))))
    df = docs(spark, texts).repartition(4).withColumn("gone", F.lit(1))
    out = {r["doc_id"]: tuple(r)[1:] for r in line_bloom.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert out == brute_lines(list(enumerate(texts)))
    kept = {r["doc_id"]: r for r in line_bloom.remove_lines(df).collect()}
    for i, (_, dropped, sha) in out.items():
        assert hashlib.sha256((kept[i]["text"] or "").encode()).hexdigest() == sha and (not dropped or kept[i]["n_chars"] == len(kept[i]["text"]))
    assert line_bloom.line_dedup(df.limit(0)).count() == 0


def test_merged_filters_lose_no_key_of_two_partitions():
    rng = random.Random(0)
    keys = [rng.randbytes(16) for _ in range(300)]
    parts = [line_bloom.TwoFilters(4) for _ in range(3)]
    for k, x in enumerate(keys):
        for p in rng.sample(range(3), 2):
            parts[p].add([x])
    once, twice = (np.stack([getattr(p, n) for p in parts]) for n in ("once", "twice"))
    _, again = line_bloom.merge(once, twice)
    block, at = line_bloom.positions(line_bloom._halves(keys), 4)
    assert (again[block[:, None] * line_bloom.BLOCK + (at >> 3)] >> (at & 7) & 1).all()


# ---- 6


def test_toxicity_generalises(spark):
    rng = random.Random(7)
    bad = ["vilescum", "rottrash", "foulmoron"]
    texts, toxic = [], []
    for _ in range(900):
        w = prose(rng, 40).split()
        toxic.append(int(rng.random() < 0.3))
        if toxic[-1]:
            w.insert(rng.randrange(40), rng.choice(bad))
        texts.append(" ".join(w))
    df = docs(spark, [*texts, None, ""]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxic_nbsvm.toxicity(df, labels).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (i in set(held)) for i in range(900))
    assert sum(out[i]["predicted"] == toxic[i] for i in held) >= 0.97 * len(held)
    assert 0 <= out[900]["score"] == out[901]["score"] <= 1
    assert toxic_nbsvm.toxicity(df, labels.limit(0)).filter("score = 0.5").count() == df.count()
    assert toxic_nbsvm.toxicity(df.limit(0), labels).count() == 0


# ---- 7


def brute_spans(text):
    text = text or ""

    def luhn(d):
        s = 0
        for k, c in enumerate(reversed(d)):
            n = int(c) * (1 + k % 2)
            s += n - 9 if n > 9 else n
        return s % 10 == 0

    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub(r"\D", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m.group(0))] for k, (p, ok) in checks.items()}


def test_spans_equal_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a.b%c@d-e.com", "@", "a@b", "x@y.z@w.v", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-7713", "+1", "00123456789012", " ", "é🙂", "\x01\x02", "\n", "-", ".", "79927398713", "0", "me (at) host (dot) org"]
    texts = [*EDGES, "1 " * 6000, *["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(300)]]
    df = docs(spark, texts).withColumn("spans", F.lit("clash"))
    for r in pii_boost.personal_data(df).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii_boost.KINDS] == [len(want[k]) for k in pii_boost.KINDS], texts[r["doc_id"]]
        flat = sorted((a, n, b) for n, k in enumerate(pii_boost.KINDS) for a, b in want[k])
        joined = ",".join(f"{pii_boost.KINDS[n]}:{a}:{b}" for a, n, b in flat)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
    assert pii_boost.personal_data(df.limit(0)).count() == 0


def test_boosted_trees_separate():
    rows = [((d, c, 0, 0, 0, 4, 1), int(d >= 12 and c == 1), 5.0) for d in range(5, 24) for c in (0, 1)]
    model = pii_boost.boosted(rows, rows)
    assert model.threshold is not None and all((model.score(x) >= model.threshold) == bool(y) for x, y, _ in rows)
    assert pii_boost.boosted([((1,) * 7, 0, 3.0)], []).threshold is None


def test_context_and_format_decide_cards(spark):
    # runs of digits behind a letter are order numbers, of which a tenth passes Luhn by chance; grouped ones are cards
    def full(stem):
        return next(stem + str(x) for x in range(10) if brute_spans(stem + str(x))["card"])

    rng = random.Random(18)
    stems = ["4" + "".join(rng.choices("0123456789", k=14)) for _ in range(400)]
    texts = [f"card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} end" for c in map(full, stems[:200])] + [f"order Q{s}{rng.randrange(10)} end" for s in stems[200:]]
    a, b = full("411122223333444"), full("411155556666777")
    texts += [f"see {a[:4]}/{a[4:8]}/{a[8:12]}/{a[12:]} now", f"ref Q{b[:4]}/{b[4:8]}/{b[8:12]}/{b[12:]} now"]
    models = pii_boost.fit(pii_boost.proposals(docs(spark, texts)))
    at = pii_boost.FEATURES.index
    seen = {f for t in models["card"].trees for f, cut in t[:3] if cut != 99}
    assert seen and at("checked") not in seen
    row = lambda before, groups: tuple({"digits": 16, "checked": 1, "marks": 3 * groups, "before": before, "after": 0, "length": 4, "groups": 1 + 3 * groups}[f] for f in pii_boost.FEATURES)
    card = models["card"]
    assert card.score(row(0, 1)) >= card.threshold > card.score(row(2, 0))


def test_context_flips_a_proposal(spark):
    """One phone number without its plus sign: between spaces it is taken, between letters it isn't; digits agree."""
    rng = random.Random(19)
    tail = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    plain = [lambda x: f"+1 {x}", lambda x: f"+1 {x[1:4]}-{x[6:]}", lambda x: f"+1{x[1:4]}{x[6:9]}{x[10:]}"]
    texts = [f"call {plain[k % 3](tail())} now" for k in range(200)] + [f"part a{tail()}b of it, v1.{k}.7 and 1.2.{k}.4.5" for k in range(200)]
    texts += ["call (212)555-77-13 now", "call a(212)555-77-13b now"]
    df = docs(spark, texts)
    out = {r["doc_id"]: r["spans"] for r in pii_boost.personal_data(df).collect()}
    assert out[400] == "phone:5:19" and out[401] == "" and not any("phone" in out[i] for i in range(200, 400))
    models = pii_boost.fit(pii_boost.proposals(df))
    at = pii_boost.FEATURES.index
    used = {pii_boost.FEATURES[f] for t in models["phone"].trees for f, cut in t[:3] if cut != 99}
    assert used & {"before", "after"} and "checked" not in used and at("before") >= 0


def test_threshold_is_marginal():
    # 100 passed at the top hide that only 1 in 10 passes below: together 101 of 110 is more than PRECISION
    assert pii_boost.calibrated([(0.9, 1, 100.0), (0.3, 1, 1.0), (0.3, 0, 9.0)]) == pytest.approx(0.6)
    assert pii_boost.calibrated([(0.9, 0, 1.0), (0.8, 1, 99.0), (0.1, 0, 5.0)]) == pytest.approx(0.45)
    assert pii_boost.calibrated([(0.9, 0, 3.0)]) is None


def hidden_and_decoys(rng, n):
    """(text, base spans, hidden spans): base data in plain form, hidden data and decoys in the same kinds of sentences."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))

    def luhn(digits):
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return "".join(map(str, [*digits, -total % 10])) if len(digits) % 2 else luhn(digits[:-1])

    out = []
    for i in range(n):
        kind = pii_boost.KINDS[i % 4]
        mail, host = f"{word()}.{word()}", f"{word()}.org"
        ip = [str(rng.randint(1, 254)) for _ in range(4)]
        card = luhn([rng.randint(1, 9), *(rng.randint(0, 9) for _ in range(14))])
        phone = f"1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        plain = {"email": f"{mail}@{host}", "ip": ".".join(ip), "card": card, "phone": f"+{phone}"}[kind]
        fours = [card[j : j + 4] for j in range(0, 16, 4)]
        hide = {"email": [f"{mail} [at] {host.replace('.', ' [dot] ')}", f"{mail} at {host.replace('.', ' dot ')}"], "ip": ["[.]".join(ip), " [dot] ".join(ip)], "card": ["/".join(fours), "_".join(fours)], "phone": [phone, phone.replace(" ", ".").replace("-", ".").replace("(", "").replace(")", "")]}[kind]
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        decoy = {"email": [f"{mail}@{word()}", f"{word()} at 12 dot 45"], "ip": ["v" + "[.]".join(ip), "[.]".join([*ip, "3", "9"])], "card": [f"#{wrong}", f"ID{wrong[:4]}-{wrong[4:8]}-{wrong[8:12]}-{wrong[12:]}"], "phone": [f"2021-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 1{rng.randint(0, 9)}.3{rng.randint(0, 9)}", f"v1.{rng.randint(10, 99)}.{rng.randint(100, 999)}.{rng.randint(100, 999)}"]}[kind]
        what = i // 4 % 4
        said = plain if what < 2 else rng.choice(hide if what == 2 else decoy)
        before = f"{word()} {word()} "
        out.append((f"{before}{said} {word()} {word()}", kind, what, (len(before), len(before) + len(said))))
    return out


def test_hidden_spans_are_found_and_decoys_left_alone(spark):
    cases = hidden_and_decoys(random.Random(41), 1600)
    df = docs(spark, [t for t, *_ in cases])
    found = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii_boost.personal_data(df).collect()}
    right, wrong, all_ = Counter(), Counter(), Counter()
    for i, (_, kind, what, (a, b)) in enumerate(cases):
        base = what < 2
        all_[kind] += what == 2
        hits = [s for s in found[i] if not base]
        if base:
            assert (kind, a, b) in found[i] and len(found[i]) == 1
        ok = what == 2 and any(k == kind and min(b, y) - max(a, x) >= 0.8 * (b - a) for k, x, y in hits)
        right[kind] += ok
        wrong[kind] += len(hits) - ok
    for kind in pii_boost.KINDS:
        assert right[kind] >= 0.9 * (right[kind] + wrong[kind]) and right[kind] >= 0.8 * all_[kind], (kind, right[kind], wrong[kind], all_[kind])
    models = pii_boost.fit(pii_boost.proposals(df))
    for kind in pii_boost.KINDS:
        used = {pii_boost.FEATURES[f] for t in models[kind].trees for f, cut in t[:3] if cut != 99}
        assert used & {"before", "after"} and used - {"before", "after"} or len(used) > 1, (kind, used)


# ---- 8


def test_html_blocks():
    page = """<html><head><title>T</title><script>var x = "</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First<br><p>Second&nbsp;<i>in</i>line  text<aside>Also</aside><section id=comments><p>Nice!</section><p>a &lt; b < c</article><footer>End</footer>"""
    assert html_template.main_blocks(page, frozenset()) == ["Head & line", "First", "Second inline text", "a < b < c"]
    assert html_template.main_blocks(None, frozenset()) == html_template.main_blocks("", frozenset()) == []
    assert html_template.main_blocks("<p>x<p>y<div class=sidebar>z", frozenset()) == ["x", "y"]


@pytest.mark.parametrize("wrapper", ['div class="content-sidebar-wrap"', 'div class="no-sidebar"', 'div id="sidebar widget"', "form action=x", 'div class="layout comments-open"'])
@pytest.mark.parametrize("inner", ['main', 'article class="post comments-open"', "div"])
def test_wrappers_are_not_page_furniture(wrapper, inner):
    page = f"<body><nav>Menu</nav><{wrapper}><{inner}><p>Body text</p><div class='ad'>Buy</div></{inner.split()[0]}></{wrapper.split()[0]}><footer>End</footer></body>"
    blocks = html_template.main_blocks(page, frozenset())
    assert blocks[0] == "Body text" and not {"Menu", "End"} & set(blocks)


def test_articles_among_comments_stay_out():
    page = "<article><p>Body</p></article><div class=comments><article><p>Nice!</p></article></div><aside><article>Also</article></aside>"
    assert html_template.main_blocks(page, frozenset()) == ["Body"]
    assert html_template.main_blocks("<aside><article>Also</article></aside><p>Body</p>", frozenset()) == ["Body"]


def test_html_template_is_deduced(spark):
    rng = random.Random(9)
    page = lambda i: f"<html><body><div><p>Welcome to our site</p><p>Read us daily</p><p>{prose(rng, 9)} {i}</p><p>All rights are ours</p></div></body></html>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(40)] + [(99, None, None), (100, "http://other.example", "<p>Welcome to our site")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    out = {r["page_id"]: r for r in html_template.extracted(pages).collect()}
    for i in range(40):
        assert out[i]["text"].split("\n")[0].endswith(f" {i}") and "\n" not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"])
    assert out[99]["text"] == "" and out[100]["text"] == "Welcome to our site"
    assert html_template.extracted(pages.limit(0)).count() == 0


def unnamed(rng, i):
    """A page of plain div elements: a menu of links and a shop window beside the text, whose words all vary."""
    links = "".join(f"<div><a href='/{k}'>{prose(rng, 2)}</a></div>" for k in range(rng.randrange(2, 6)))
    body = "".join(f"<p>{prose(rng, 20)}</p>" for _ in range(rng.randrange(2, 6)))
    return f"<html><body><div>{links}</div><div><div>{prose(rng, 6)}</div></div><section><h1>head {i}</h1>{body}</section><div><div>{prose(rng, 5)}</div></div></body></html>"


def test_the_template_decides_on_unnamed_pages(spark):
    """Menus, windows and foot lines vary and bear no names: only the deduced main slot tells the text from them."""
    rng = random.Random(10)
    rows = [(i, "http://h.example/x", unnamed(rng, i)) for i in range(30)] + [(30 + i, f"http://h{i}.example/x", unnamed(rng, i)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"].split("\n") for r in html_template.extracted(pages).collect()}
    for i, _, page in rows:
        want = re.findall("<h1>(.*?)</h1>|<p>(.*?)</p>", page)
        alone = html_template.main_blocks(page, frozenset())
        assert len(alone) > len(want), "without a template, the rest of the page is taken for text"
        assert out[i] == ([a or b for a, b in want] if i < 30 else alone)


def test_templates_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(f"h{i % 2}", unnamed(rng, i) if i % 7 else "<html><body><p>other</p></body></html>") for i in range(60)]
    rows += [rows[0], ("few", rows[1][1])]
    found = {r["host"]: (set(r["template"]), r["slot"]) for r in html_template.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    for host in ("h0", "h1", "few"):
        pages = list({html_template.tokens_of(x)[0]: {t: (p, n, d, own) for t, p, n, d, own in html_template.tokens_of(x)[1]} for h, x in rows if h == host}.values())
        if len(pages) < html_template.LEAST_PAGES:
            assert host not in found
            continue
        parent = {t: x[0] for page in pages for t, x in page.items()}
        vector = {t: tuple(page[t][1] if t in page else 0 for page in pages) for t in parent}
        support = {t: sum(n > 0 for n in v) for t, v in vector.items()}
        often = {t for t in parent if support[t] >= html_template.SUPPORT * len(pages)}
        classes = {}
        for t in often:
            classes.setdefault(vector[t], set()).add(t)
        valid = {t for c in classes.values() if len(c) >= html_template.LEAST_TOKENS for t in c if parent[t] == html_template.ROOT or (parent[t] in often and support[parent[t]] >= support[t])}
        own = {t: sum(page[t][3] for page in pages if t in page) for t in often if all(page[t][3] >= 0 for page in pages if t in page) and max(vector[t]) == 1}
        slots = [t for t in valid & own.keys() if t != html_template.ROOT and own[t] >= html_template.SLOT_SHARE * own[html_template.ROOT]]
        depth = {t: x[2] for page in pages for t, x in page.items()}
        assert found[host] == (valid, max(slots, key=depth.get, default=None))


@pytest.mark.parametrize("page", ["<div>{}</foo>", "<b><div>{}</b>", "<a \"{}", "<p>{}</p>", "<div class='a'>{}</div>"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    left, _, right = page.partition("{}")
    html_template.tokens_of(left * 50_000 + right * 50_000)
    assert time.process_time() - began < 10


# ---- 9


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_features_equal_brute_force(spark):
    rng = random.Random(10)
    texts = [*EDGES, "a b\na b\n\n \na b", *["\n".join(" ".join(rng.choices(["a", "b", "é|", "##"], k=rng.randrange(6))) for _ in range(5)) for _ in range(80)]]
    df = docs(spark, texts).withColumn("n_words", F.lit("clash"))
    for r in quality_sketch.quality(df).collect():
        n, *rest = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality_sketch.quality(df.limit(0)).count() == 0


def test_quality_cutoffs_adapt(spark):
    rng = random.Random(11)
    odd = prose(rng, 80).replace(" ", " #% ")
    rows = [(i, odd if i % 20 == 0 else prose(rng, 80), "en", "plain", i) for i in range(200)] + [(1000 + i, prose(rng, 80).replace(" ", " #% "), "en", "math", i) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in quality_sketch.quality(df).collect()}
    assert all(out[i]["kept"] == (i % 20 != 0) for i in range(200)) and all(out[1000 + i]["kept"] for i in range(200))
    assert {r["doc_id"] for r in quality_sketch.keep_good(df).collect()} == {i for i, r in out.items() if r["kept"]}
    assert quality_sketch.keep_good(df).columns == df.columns


def test_no_constant_cutoffs_give_the_same_decisions(spark):
    """Sources that differ in marks, each with junk that would be plain text elsewhere; one is full of copies."""
    rng = random.Random(31)

    def text(per_word, n=None):
        words = prose(rng, n or rng.randint(60, 400)).split()
        return " ".join(w[:-1] + ("," if rng.random() < per_word else w[-1]) for w in words)

    one = text(0.1, 80)
    rows = [(i, text(0.1), "en", "plain", 0) for i in range(150)] + [(1000 + i, text(0.9), "en", "plain", 0) for i in range(10)]
    rows += [(2000 + i, text(0.9), "en", "code", 0) for i in range(150)] + [(3000 + i, text(1.0).replace(",", ";;;"), "en", "code", 0) for i in range(10)]
    rows += [(4000 + i, one, "en", "copies", 0) for i in range(300)] + [(5000 + i, text(0.15), "en", "copies", 0) for i in range(20)]
    rows += [(6000 + i, text(0.12), "en", f"few{i}", 0) for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in quality_sketch.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in out.items() if not kept} == {r[0] for r in rows if r[0] // 1000 in (1, 3)}


def test_without_a_group_only_the_base_rule_decides(spark):
    rows = [(1, "word " * 60, "en", "a", 0), (2, prose(random.Random(1), 60), "en", "a", 0), (3, "#! " * 80 + prose(random.Random(2), 900), None, None, 0)]
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_sketch.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: (True, False), 2: (False, True), 3: (False, True)}


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_a_source_full_of_junk_keeps_its_good_documents_only(spark, share):
    rng = random.Random(12)
    junk = (
        lambda k: prose(rng, 80).replace(" ", " " + "#%|" * (1 + k % 5) + " "),
        lambda k: "\n".join([*(f"{prose(rng, 8)} {k}" for _ in range(9)), *[prose(random.Random(k), 8)] * (8 + k % 9)]),
        lambda k: " ".join(x * 3 for x in prose(rng, 80).split()),
    )
    rows = [(1000 * j + i, f(i) if i < 200 * share else prose(rng, 80), "en", f"s{j}", 0) for j, f in enumerate(junk) for i in range(200)]
    rows += [(10_000 + i, prose(rng, 80), "en", f"plain{i % 3}", 0) for i in range(600)]
    out = {r["doc_id"]: r["kept"] for r in quality_sketch.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in out.items() if not kept} == {r[0] for r in rows if r[0] < 10_000 and r[0] % 1000 < 200 * share}


# ---- 10


def test_cutoffs_depend_on_no_partitioning(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(prose(rng, rng.randrange(60, 90)).split() + ["#"] * rng.randrange(9)), "en", f"s{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    first, second = (rows_of(quality_sketch.quality(x).select("doc_id", "kept", "broken_rule")) for x in (df.repartition(7), df.orderBy(F.rand(3)).coalesce(1)))
    assert first == second
    # and quantiles are those of the values, within the sketch's error
    got = quality_sketch.quantiles(quality_sketch.sketches(quality_sketch.with_features(df)), ["lang"], [0.3]).first()
    symbols = sorted(quality_sketch.text_features(t.encode())[5] / quality_sketch.text_features(t.encode())[0] for _, t, *_ in rows)
    assert got["marks_30"] == pytest.approx(symbols[119], rel=0.006, abs=1e-9)


def brute_hits(text, items, window=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, found = cut(text), set(), set()
    for i, t in items:
        x = cut(t)
        n = min(len(x), window)
        for a in range(len(x) - n + 1 if x else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[a : a + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard", [8, 10_000])
def test_decontamination_equals_brute_force(spark, shard):
    rng = random.Random(12)
    words = ["a", "b", "c", "É1"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, ""), (52, "a, B!"), (53, "a b")]
    texts = [*EDGES, *[" ".join([*rng.choices([*words, "zz"], k=rng.randrange(25)), (rng.choice(items)[1] or ""), *rng.choices(["q", "r"], k=rng.randrange(300))]) for _ in range(80)]]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts).withColumn("n_hit", F.lit("clash"))
    for r in decontam_sam.decontaminate(df, b, shard_words=shard).collect():
        n, hit, ids = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, hit, ids), texts[r["doc_id"]]
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest() and r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontam_sam.decontaminate(df.limit(0), b).count() == 0
    assert decontam_sam.decontaminate(df, b.limit(0)).filter("n_hit > 0").count() == 0


def test_contamination_is_removed(spark):
    item = " ".join(f"k{i}" for i in range(13))
    long_ = " ".join(f"w{i}" for i in range(400))
    df = docs(spark, [item, f"{long_}, {item.upper()}! {long_}", "clean text", None])
    out = {r["doc_id"]: r for r in decontam_sam.remove_contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 3} and out[1]["text"] == f"{long_}, ! {long_}" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean text" and out[3]["text"] is None
