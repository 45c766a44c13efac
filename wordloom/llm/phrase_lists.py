"""Collocations from vertical positional inverted lists.

Texts are cut into pieces at punctuation and line ends, pieces into words. Whole documents are gathered into blocks of about
``BLOCK_WORDS`` words. In a block every word has an ascending list of its positions; pieces are set apart by a gap, so
that neighbours in position are neighbours in a piece. A phrase of k words has the list of the positions where it begins.
It is extended by merging its list with the postings of the words that follow: those that end a frequent phrase of k
words which begins one place later, for a phrase can't be frequent unless both are. The merged list's length is
the exact number of occurrences in the block; Spark adds up the blocks' lengths, and only frequent phrases keep lists.

Each level is one pass over the blocks for the lengths, a count by Spark, and one pass for the lists of what proved
frequent. Lengths travel sorted and compressed, in as many buckets of phrases as the corpus needs for each to fit a task. For
the lists, tasks get the frequent phrases' numbers if they are at most ``MOST_SENT`` (and words of ``MOST_SENT_BYTES``);
if they are more, candidates pass a bitmap of the frequent phrases' hashes (8 MB, whatever there is; fuller bitmaps only let
more through), then an exact join keeps the frequent ones, and lists meet by block. Frequencies of all beginnings
and ends of a phrase come along from level to level, so that its cuts are scored without another join.

Defined results: a null or empty text has no words, a null language is ``und``; rows are counted one by one, repeated or not;
a piece is never split, however long; an empty table gives an empty result; other columns are ignored. Scores are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import CHUNK_BYTES, as_bytes, chunks, drop, mix64, tune, work_dir, written
from wordloom.plans.ordinals import with_ordinal

#: Words of a phrase at most, occurrences at least, phrases of a language in the result.
MOST_WORDS, LEAST, TOP = 5, 100, 2000

#: Words of a block (a document is in one block), bits of the bitmap of frequent phrases.
BLOCK_WORDS, FILTER_BITS = 1 << 19, 1 << 26

#: Frequent phrases whose numbers are sent to all tasks at most (24 bytes each), and bytes of words so sent.
MOST_SENT, MOST_SENT_BYTES = 1 << 20, 32 << 20

#: Words of the corpus for each bucket of phrases, pairs that a task holds before it sends them.
BUCKET_WORDS, HELD_PAIRS = 1 << 17, 1 << 21

#: Parts in which held pairs are added up, one after another.
HELD_PARTS = 32

#: Arrow batches while rows are whole blocks, or the many short lists of a block: by bytes, for a fixed number of rows is too many of
#: the former or too few of the latter.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

NO_LANG = "und"

_ENDS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.array([2 if i in _ENDS else 1 if i in b" \t" else 0 for i in range(256)], np.uint8)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


def words_and_places(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of ``data`` in order, and their positions: one more than the last word's, or two more in another piece."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    del kind
    places = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    del piece
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = _LOWER[raw[inside]]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), places


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut where pieces end."""
    at = 0
    while len(text) - at > CHUNK_BYTES and (m := _END.search(text, at + CHUNK_BYTES)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, pa.Array, np.ndarray]]]:
    """Blocks as (language, words, positions), a language once each; positions are those of the whole block."""
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    at = n = 0

    def block() -> list[tuple[str, pa.Array, np.ndarray]]:
        return [(lang, pa.concat_arrays([w for w, _ in x]), np.concatenate([p for _, p in x])) for lang, x in held.items()]

    for batch in batches:
        for part in chunks(batch, "text"):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text")), strict=True):
                if text:
                    texts.setdefault(NO_LANG if lang is None else lang, []).append(text)
            for lang, some in texts.items():
                for data in _slices(b"\n".join(some)):
                    words, places = words_and_places(data)
                    if len(words):
                        held.setdefault(lang, []).append((words, (places + at).astype(np.int32)))
                        at += int(places[-1]) + 2
                        n += len(words)
            if n >= most:
                whole, held, at, n = block(), {}, 0, 0
                yield whole
                del whole
                pa.default_memory_pool().release_unused()
    if held:
        whole, held = block(), {}
        yield whole


def word_counts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_words):
            for lang, words, _ in block:
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.field("values"), found.field("counts")], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _word_bits(lang: str, words: list[bytes]) -> np.ndarray:
    end = b"\x00" + lang.encode()
    return np.fromiter((xxhash.xxh64_intdigest(w + end) for w in words), np.uint64, len(words)).astype(np.int64) & (FILTER_BITS - 1)


def _pair_bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix64(mix64(first) + second.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _bitmap(bits: DataFrame) -> Broadcast:
    """A bitmap of column ``bit``, put together by Spark in pieces of 4,096 bytes: FILTER_BITS / 8 bytes at most."""
    pieces = bits.groupBy(F.shiftright("bit", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    whole = np.zeros(FILTER_BITS >> 3, np.uint8)
    for piece, b in pieces:
        whole[piece * 4096 : (piece + 1) * 4096] = np.frombuffer(bytes(b), np.uint8)
    return bits.sparkSession.sparkContext.broadcast(whole)


def _in(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def _grouped(group: np.ndarray, n: int, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Lists of the places of each group 0 .. n-1, and their lengths."""
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=n)
    return sizes, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(places[order], pa.int32()))


def word_lists(docs: DataFrame, words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, id, places) of the frequent ``words`` (id, lang, phrase)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [int(_word_bits(lang, [w])[0]) for lang, w in zip(b.column("lang").to_pylist(), as_bytes(b.column("phrase")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])

    sent = _bitmap(words.select("lang", "phrase").mapInArrow(hashed, "bit long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        for block in _blocks(batches, block_words):
            for lang, found, places in block:
                coded = found.dictionary_encode()
                hit = _in(sent.value, _word_bits(lang, coded.dictionary.to_pylist()))
                number = np.cumsum(hit) - 1
                which = coded.indices.to_numpy()
                kept = hit[which]
                _, lists = _grouped(number[which[kept]], int(hit.sum()), places[kept])
                word = coded.dictionary.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), own), pa.int64()), pa.array([lang] * len(word), pa.string()), word, lists], ["block", "lang", "phrase", "places"])
            own += 1

    lists = docs.select("lang", "text").mapInArrow(run, "block long, lang string, phrase binary, places array<int>")
    return lists.join(words.select("id", "lang", "phrase"), ["lang", "phrase"]).select("block", "id", "places")


_BLOCK = "block long, ids array<long>, sizes array<int>, places array<int>"


def _block_row(block: int, ids: pa.Array, sizes: np.ndarray, places: pa.Array) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one(ids), one(pa.array(sizes, pa.int32())), one(places)], ["block", "ids", "sizes", "places"])


def packed(lists: DataFrame) -> DataFrame:
    """Block rows from (block, id, places): ids, lengths and positions of a block's lists. A block has a bounded number of words."""
    import pyarrow.compute as pc

    def pack(t: pa.Table) -> pa.Table:
        ids, places = (t.column(c).combine_chunks() for c in ("id", "places"))
        return pa.Table.from_batches([_block_row(t.column("block")[0].as_py(), ids, pc.list_value_length(places).to_numpy(), places.flatten())])

    return lists.groupBy("block").applyInArrow(pack, _BLOCK)


def written_blocks(blocks: DataFrame) -> DataFrame:
    """Block rows in the shared folder, in small row groups, for readers hold whole ones."""
    spark = blocks.sparkSession
    blocks.write.option("parquet.block.size", str(8 << 20)).parquet(path := work_dir(spark, "phrase-blocks"))
    found = spark.read.schema(blocks.schema).parquet(path)
    found.path = path
    return found


def word_blocks(docs: DataFrame, words: DataFrame, block_words: int, most_sent: int = MOST_SENT) -> DataFrame:
    """Block rows of the frequent ``words`` (id, lang, phrase)."""
    import pyarrow.compute as pc

    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.length("lang") + 8), F.lit(0))).first()
    if n > most_sent or size > MOST_SENT_BYTES:
        return packed(word_lists(docs, words, block_words))
    table = words.select("lang", "phrase", "id").toArrow()
    known = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        known[lang] = own["phrase"].combine_chunks(), own["id"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        for block in _blocks(batches, block_words):
            ids, groups, at, n = [], [], [], 0
            for lang, found, places in block:
                if lang not in sent.value:
                    continue
                coded = found.dictionary_encode()
                phrases, numbers = sent.value[lang]
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=phrases), -1).to_numpy()
                seen = place >= 0
                which = np.where(seen, np.cumsum(seen) - 1 + n, -1).astype(np.int32)[coded.indices.to_numpy()]
                ids.append(numbers[place[seen]])
                groups.append(which[which >= 0])
                at.append(places[which >= 0])
                n += len(ids[-1])
                del coded, which
            del block
            if n:
                sizes, lists = _grouped(np.concatenate(groups), n, np.concatenate(at))
                del groups, at
                yield _block_row(own, pa.array(np.concatenate(ids)), sizes, lists.values)
                del lists
            own += 1

    return docs.select("lang", "text").mapInArrow(run, _BLOCK)


def merged(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's lists merged with those one place later: numbers (within ``ids``) of the former and the latter, and positions."""
    order = np.argsort(places, kind="stable")
    places, owner = places[order], np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
    del order
    meets = places[1:] == places[:-1] + 1  # a position is in one list at most
    return owner[:-1][meets], owner[1:][meets], places[:-1][meets]


def _block_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's number, ids, and the merged lists' first and second owners and positions."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, sizes, places = (batch.column(c)[row].values.to_numpy() for c in ("ids", "sizes", "places"))
            whole = batch.column("block")[row].as_py(), ids, *merged(ids, sizes, places)
            del sizes, places
            yield whole
            del whole
            pa.default_memory_pool().release_unused()


def _pack_pairs(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs and counts, byte by byte of all numbers, compressed: high bytes and equal prefixes take hardly any room."""
    rows = np.stack([np.diff(prefix, prepend=0), suffix, n]).astype("<i8")
    return pa.compress(rows.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def _unpack_pairs(n: int, packed: bytes) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, 24 * n, codec="zstd", asbytes=True), np.uint8)
    rows = np.ascontiguousarray(raw.reshape(3, 8, n).transpose(0, 2, 1)).view("<i8").reshape(3, n)
    return np.stack([np.cumsum(rows[0]), rows[1], rows[2]])


def _summed(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and their sums."""
    order = np.lexsort((suffix, prefix))
    prefix, suffix, n = prefix[order], suffix[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])])) if len(prefix) else np.zeros(0, int)
    return prefix[first], suffix[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n


def _buckets(prefix: np.ndarray, suffix: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(mix64(prefix) + suffix.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def hold(held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]], prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray, buckets: int) -> None:
    """Adds pairs and counts to the parts of ``held``; a part has all pairs of its buckets."""
    part = _buckets(prefix, suffix, buckets) % HELD_PARTS
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(len(held) + 1))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if a < b:
            x = order[a:b]
            held[k].append((prefix[x], suffix[x], n[x].astype(np.int32)))


def sent_pairs(held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, pairs) of all that is held, which is emptied; sums are made a part at a time, so that they need little room."""
    for k in range(len(held)):
        some, held[k] = held[k], []
        if not some:
            continue
        prefix, suffix, n = _summed(*(np.concatenate(x) for x in zip(*some, strict=True)))
        del some
        bucket = _buckets(prefix, suffix, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[x[0]]) for x in parts], pa.int32()), pa.array(list(map(len, parts)), pa.int32()), pa.array([_pack_pairs(prefix[x], suffix[x], n[x]) for x in parts], pa.binary())], ["bucket", "n", "pairs"])


def pair_counts(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """(prefix, suffix, f) of all pairs of phrases that follow one another by one word at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(HELD_PARTS)]
        size = 0
        for _, ids, first, second, places in _block_lists(batches):
            del places
            first = first * np.int64(len(ids))
            first += second
            del second
            keys, n = np.unique(first, return_counts=True)
            del first
            if len(keys):
                hold(held, ids[keys // len(ids)], ids[keys % len(ids)], n, buckets)
                size += len(keys)
            del keys, n
            if size > HELD_PAIRS:
                yield from sent_pairs(held, buckets)
                size = 0
        yield from sent_pairs(held, buckets)

    def add(t: pa.Table) -> pa.Table:
        rows = [_unpack_pairs(n, x) for n, x in zip(t.column("n").to_pylist(), t.column("pairs").to_pylist(), strict=True)]
        prefix, suffix, n = _summed(*np.concatenate(rows, axis=1))
        often = n >= least
        return pa.table({"prefix": prefix[often], "suffix": suffix[often], "f": n[often]})

    return blocks.mapInArrow(run, "bucket int, n int, pairs binary").groupBy("bucket").applyInArrow(add, "prefix long, suffix long, f long")


def pair_lists(blocks: DataFrame, sent: Broadcast) -> DataFrame:
    """(block, prefix, suffix, places) of each block's pairs that are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, first, second, places in _block_lists(batches):
            seen = _in(sent.value, _pair_bits(ids[first], ids[second]))
            first, second, places = first[seen], second[seen], places[seen]
            keys, group = np.unique(first * np.int64(len(ids)) + second, return_inverse=True)
            _, lists = _grouped(group, len(keys), places)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block), pa.int64()), pa.array(ids[keys // max(len(ids), 1)]), pa.array(ids[keys % max(len(ids), 1)]), lists], ["block", "prefix", "suffix", "places"])

    return blocks.mapInArrow(run, "block long, prefix long, suffix long, places array<int>")


#: starts and ends: frequencies of a phrase's beginnings and ends, shortest first.
_FREQUENT = ("id", "lang", "phrase", "last", "f", "starts", "ends", "prefix", "suffix")


def longer(blocks: DataFrame, phrases: DataFrame, least: int, buckets: int) -> DataFrame:
    """Frequent phrases of one word more than ``phrases``, whose lists ``blocks`` holds."""
    counts = pair_counts(blocks, least, buckets)
    one = phrases.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("_start"), F.concat("starts", F.array("f")).alias("starts"))
    two = phrases.select(F.col("id").alias("suffix"), "last", F.concat("ends", F.array("f")).alias("ends"))
    rows = counts.join(one, "prefix").join(two, "suffix").withColumn("phrase", F.concat("_start", F.expr("X'20'"), "last"))
    return written(rows.withColumn("id", F.monotonically_increasing_id()).select(*_FREQUENT), "phrases")


def longer_blocks(blocks: DataFrame, phrases: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Block rows of ``phrases``, from those of phrases of one word less."""
    if phrases.count() > most_sent:
        return packed(longer_lists(blocks, phrases))
    table = phrases.select("prefix", "suffix", "id").toArrow()
    prefix, suffix, ids = (table[c].to_numpy() for c in ("prefix", "suffix", "id"))
    order = np.lexsort((suffix, prefix))
    sent = blocks.sparkSession.sparkContext.broadcast((prefix[order], suffix[order], ids[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, suffix, numbers = sent.value
        for block, ids, first, second, places in _block_lists(batches):
            # positions of the block's ids among the sent ones, then of its pairs within a prefix's run
            keys, group = np.unique(first * np.int64(len(ids)) + second, return_inverse=True)
            a, b = ids[keys // max(len(ids), 1)], ids[keys % max(len(ids), 1)]
            place = _find_pairs(prefix, suffix, a, b)
            del first, second, keys, a, b
            found = place >= 0
            group = np.where(found, np.cumsum(found) - 1, -1).astype(np.int32)[group]
            if found.any():
                sizes, lists = _grouped(group[group >= 0], int(found.sum()), places[group >= 0])
                del group, places
                yield _block_row(block, pa.array(numbers[place[found]]), sizes, lists.values)
                del lists

    return blocks.mapInArrow(run, _BLOCK)


def _find_pairs(prefix: np.ndarray, suffix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each pair (a, b) stands among the pairs sorted by prefix and suffix; -1: nowhere."""
    low, high = np.searchsorted(prefix, a, "left"), np.searchsorted(prefix, a, "right")
    end = high.copy()
    while (open_ := low < high).any():  # the binary searches of all pairs, a step at a time
        mid = (low + high) // 2
        less = open_ & (suffix[np.minimum(mid, len(suffix) - 1)] < b)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    hit = low < end
    hit[hit] = suffix[low[hit]] == b[hit]
    return np.where(hit, low, -1)


def longer_lists(blocks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(block, id, places) of ``phrases``, from the lists of phrases of one word less."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pair_bits(b.column("prefix").to_numpy(), b.column("suffix").to_numpy()))], ["bit"])

    sent = _bitmap(phrases.select("prefix", "suffix").mapInArrow(hashed, "bit long"))
    return pair_lists(blocks, sent).join(phrases.select("id", "prefix", "suffix"), ["prefix", "suffix"]).select("block", "id", "places")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the lowest-scoring cut. Products are decimals of 38 digits."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rows = phrases.join(totals, "lang").withColumn("_top", F.lit(1000).cast("decimal(4,0)") * big("f") * big("n"))
    cut = "transform(sequence(1, size(starts)), k -> named_struct('score', _top div (cast(starts[k - 1] as decimal(19,0)) * cast(ends[size(starts) - k] as decimal(19,0))), 'k', k, 'l', starts[k - 1], 'r', ends[size(starts) - k]))"
    rows = rows.withColumn("_best", F.array_min(F.expr(cut)))
    return rows.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), "_best.l", "_best.r", "n", "_best.score")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, block_words: int = BLOCK_WORDS, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``top`` phrases of each language (columns text, lang)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("lang", "text")
    words = written(word_counts(docs, block_words), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    none = F.array().cast("array<long>")
    level = words.filter(F.col("n") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("f"), none.alias("starts"), none.alias("ends"), F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"))
    level = written(level, "phrases")
    drop(words)
    before_loop = {k: spark.conf.get(k) for k in BATCHES}
    buckets = min(max((totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS, 16), 1 << 24)
    blocks, levels = written_blocks(word_blocks(docs, level, block_words, most_sent)), []
    found = None
    for k in range(2, most_words + 1):
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        above = longer(blocks, level, least, buckets)
        levels.append(level)
        # a phrase inside one more often or as often found is told by the phrases of one word more
        inside = above.select(F.explode(F.array("prefix", "suffix")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("_within"))
        if k > 2:
            kept = level.join(inside, "id", "left").filter(F.col("_within").isNull() | (F.col("_within") < F.col("f")))
            found = kept.select(*_FREQUENT) if found is None else found.unionByName(kept.select(*_FREQUENT))
        level = above
        if k < most_words:
            before, blocks = blocks, written_blocks(longer_blocks(blocks, level, most_sent))
            drop(before)
    drop(blocks)
    for name, value in before_loop.items():
        spark.conf.set(name, value)
    found = level if found is None else found.unionByName(level)
    order = [F.col("lang").asc(), F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = with_ordinal(scored(found, totals), *order)
    drop(*levels, level, totals)
    first = ranked.groupBy("lang").agg(F.min("ordinal").alias("_first"))
    ranked = ranked.join(first, "lang").withColumn("rank", F.col("ordinal") - F.col("_first") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
