"""Joins by similarity, containment, tiers and steps: equi-joins on blocking keys with a check behind, or a small side sent to all tasks."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import deletions, grams, tokens
from wordloom.plans.shared import work_dir, written


def levenshtein_pairs(words: DataFrame, word: str, most: int) -> DataFrame:
    """(a, b, distance), a < b, of distinct words at most ``most`` edits apart.

    Two words that near share a string that either reaches by ``most`` deletions: the equi-join is on those strings' hashes, for
    every pair is checked anyway. It is checked before pairs are made distinct, so that only true ones are shuffled once more.
    """
    w = words.select(F.col(word).alias("w")).distinct()
    v = w.select("w", F.explode(deletions(F.col("w"), most)).alias("v")).select("w", F.xxhash64("v").alias("v"))
    pairs = v.select(F.col("w").alias("a"), "v").join(v.select(F.col("w").alias("b"), "v"), "v").filter("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b", most).alias("distance")).filter("distance >= 0").distinct()


#: Words and sets of a block: a task holds two blocks. A word that more than this share of a block's sets have is a bit of each set there, up to
#: so many bits; other words are lists of places. Words that tell sets of different kinds apart.
BLOCK_WORDS, BLOCK_SETS, COLUMNS, DENSE, KINDS = 4 << 20, 1 << 14, 4096, 1 / 14, 16

#: Neighbours in size that are ruled out together, tiles at least, pairs that are sent on at once; bounds are reckoned in floats and give way by this.
NEAR_SIZES, LEAST_TILES, SENT_PAIRS, SLACK = 256, 64, 1 << 16, 0.5


def _in_blocks(sets: DataFrame, most_sets: int) -> tuple[str, int, DataFrame]:
    """The folder of the sets' blocks (id, ws: sorted hashes of the words), a subfolder each, how many there are, and the sets' table.

    Tasks read the two blocks that they compare from the shared folder, so that no pair of sets carries its words through a shuffle.
    """
    spark = sets.sparkSession
    words, ids = sets.agg(F.count("*"), F.approx_count_distinct("id")).first()
    n = max(-(-words // BLOCK_WORDS), -(-ids // most_sets), 1)
    full = sets.groupBy("id").agg(F.array_sort(F.collect_set(F.xxhash64("w"))).alias("ws"))
    path = work_dir(spark, "blocks")
    full.withColumn("block", _block("id", n)).repartition("block").write.partitionBy("block").parquet(path)
    return path, n, full


def _block(id_: str, n: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(n))


class _Block:
    """Sets of a block: ``ids``, ``n`` (their sizes), ``words`` of all in a row and where each set's ``start``."""

    def __init__(self, path: str, block: int):
        folder, name = fs.FileSystem.from_uri(f"{path}/block={block}")
        if folder.get_file_info(name).type == fs.FileType.NotFound:
            self.ids, self.n, self.words = pa.nulls(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            rows = pq.read_table(name, columns=["id", "ws"], filesystem=folder, partitioning=None).combine_chunks()
            self.ids, ws = rows["id"].combine_chunks(), rows["ws"].combine_chunks()
            self.n, self.words = pc.list_value_length(ws).to_numpy().astype(np.int64), pc.list_flatten(ws).to_numpy()
        self.start = np.concatenate(([0], np.cumsum(self.n)))


class _Sorted:
    """Sets of a block by size: ``ids``, ``n`` (their sizes), ``start`` of each in ``word`` (places in ``vocabulary``, which is sorted), and for
    each word of that from ``at`` on the sets that have it, ``post``."""

    FIELDS = ("ids", "n", "word", "vocabulary", "at", "post")

    def __init__(self, name: str):
        folder, name = fs.FileSystem.from_uri(name)
        with folder.open_input_stream(name) as f:
            row = pa.ipc.open_stream(f).read_all().combine_chunks()
        self.ids, *numbers = (row.column(c).chunk(0).flatten() for c in self.FIELDS)
        self.n, self.word, self.vocabulary, self.at, self.post = (x.to_numpy() for x in numbers)
        self.start = np.concatenate(([0], np.cumsum(self.n)))

    @classmethod
    def write(cls, name: str, ids: pa.Array, ws: pa.Array) -> None:
        order = pc.array_sort_indices(pc.list_value_length(ws))
        ids, ws = ids.take(order), ws.take(order)
        n, words = pc.list_value_length(ws).to_numpy().astype(np.int64), ws.flatten().to_numpy()
        order = np.argsort(words, kind="stable")
        at = np.flatnonzero(np.diff(words[order], prepend=words[order[:1]] ^ 1))
        word = np.empty(len(words), np.int32)
        word[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(at, append=len(words)))
        post = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        fields = (ids, n, word, words[order[at]], np.append(at, len(words)), post)
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in fields]
        row = pa.RecordBatch.from_arrays(one, cls.FIELDS)
        folder, name = fs.FileSystem.from_uri(name)
        folder.create_dir(name.rpartition("/")[0])
        with folder.open_output_stream(name) as f, pa.ipc.new_stream(f, row.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(row)


def _sorted_blocks(sets: DataFrame) -> list[str]:
    """Blocks of sets (id, ws: distinct hashes of the words) in files of the shared folder, and their names.

    Sets go by the most frequent word that they have, for what has another one is mostly in another language, and two blocks
    of different kinds have few words in common. That only saves work: each two blocks are compared.
    """
    spark = sets.sparkSession
    sets = written(sets.filter("id IS NOT NULL AND size(ws) > 0"), "sets")
    top = [w for w, _ in sets.select(F.explode("ws").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(KINDS).collect()]
    kind = F.lit(len(top))
    for k in range(len(top) - 1, -1, -1):
        kind = F.when(F.array_contains("ws", F.lit(top[k]).cast("long")), k).otherwise(kind)
    counts = {k: (n, words) for k, n, words in sets.groupBy(kind.alias("kind")).agg(F.count("*"), F.sum(F.size("ws"))).collect()}
    if not counts:
        return []
    most = min(BLOCK_SETS, max(BLOCK_WORDS * sum(n for n, _ in counts.values()) // sum(words for _, words in counts.values()), 1))
    blocks, held, places = 0, most, []
    for k in range(len(top) + 1):
        n = counts.get(k, (0, 0))[0]
        if held + n > most:  # else with the kinds before
            first, own = blocks, max(-(-n // most), 1)
            blocks += own
            held = n if own == 1 else most
        else:
            first, own, held = blocks - 1, 1, held + n
        places.append((first, own))
    first, own = (F.element_at(F.array(*[F.lit(p[i]) for p in places]), kind + 1) for i in (0, 1))
    path = work_dir(spark, "blocks")

    def pack(t: pa.Table) -> pa.Table:
        name = f"{path}/{uuid.uuid4().hex}"  # an attempt's own
        _Sorted.write(name, t.column("id").combine_chunks(), t.column("ws").combine_chunks())
        return pa.table({"name": [name]})

    names = sets.select("id", "ws", (first + F.pmod(F.xxhash64("id"), own)).alias("block")).groupBy("block").applyInArrow(pack, "name string").collect()
    return [r["name"] for r in names]


def _matches(x: _Sorted, y: _Sorted, rows: range, low: Callable, right: Callable, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, common): the sets q of ``y`` that are ``right`` for p, one of the ``rows`` of ``x``; q > p in the ``same`` block.

    The rarer words' places are counted, then bits of the frequent ones, where these can make up for what lacks to ``low``.
    """
    place = np.minimum(np.searchsorted(y.vocabulary, x.vocabulary), len(y.vocabulary) - 1)
    place[y.vocabulary[place] != x.vocabulary] = -1
    times = np.diff(y.at)
    often = place[place >= 0]
    often = often[times[often] > DENSE * len(y.n)]
    often = often[np.argsort(-times[often], kind="stable")[:COLUMNS]]
    column = np.full(len(y.vocabulary), -1, np.int32)
    column[often] = np.arange(len(often))
    width = -(-len(often) // 64) * 64
    table = np.zeros((width, len(y.n)), np.uint8)
    for line, v in zip(table, often.tolist()):  # noqa: B905  lines are padded
        line[y.post[y.at[v] : y.at[v + 1]]] = 1
    dense = table.sum(0, dtype=np.int32).astype(np.float32)
    bits = np.ascontiguousarray(np.packbits(table, 0).reshape(width // 64, 8, len(y.n)).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    del table
    post = y.post.astype(np.uint16) if len(y.n) <= 1 << 16 else y.post
    sizes = y.n.astype(np.float32)
    least, most = y.n[::NEAR_SIZES], y.n[np.minimum(np.arange(NEAR_SIZES - 1, len(y.n) + NEAR_SIZES - 1, NEAR_SIZES), len(y.n) - 1)]
    for p in rows:
        n = int(x.n[p])
        slack = SLACK + 1e-6 * n
        v = place[x.word[x.start[p] : x.start[p + 1]]]
        v = v[v >= 0]
        near = np.flatnonzero((low(n, least) <= len(v) + slack) & (low(n, most) <= most + slack))
        if not len(near) or not len(v):
            continue
        a, b = max(int(near[0]) * NEAR_SIZES, p + 1 if same else 0), min((int(near[-1]) + 1) * NEAR_SIZES, len(y.n))
        if a >= b:
            continue
        c = column[v]
        rest, own = v[c < 0], c[c >= 0]
        if len(rest):
            found = np.concatenate([post[i:j] for i, j in zip(y.at[rest].tolist(), y.at[rest + 1].tolist(), strict=True)])
            common = np.bincount(found, minlength=len(y.n))[a:b].astype(np.float32)
        else:
            common = np.zeros(b - a, np.float32)
        short = low(n, sizes[a:b])
        short -= common  # what frequent words must give
        short -= np.float32(slack)
        q = np.flatnonzero(np.minimum(dense[a:b], np.float32(len(own))) >= short)
        if not len(q):
            continue
        if len(own):
            mine = np.zeros(width, np.uint8)
            mine[own] = 1
            mine = np.packbits(mine).view(np.uint64)[:, None]
            if 3 * len(q) < b - a:
                more = np.bitwise_count(np.take(bits, q + a, 1) & mine).sum(0, dtype=np.uint16)
                hit = more >= short[q]
                q, more = q[hit], more[hit]
            else:
                more = np.bitwise_count(bits[:, a:b] & mine).sum(0, dtype=np.uint16)
                q = np.flatnonzero(more >= short)
                more = more[q]
            common = common[q].astype(np.int64) + more
        else:
            common = common[q].astype(np.int64)
        q = q + a
        hit = right(common, n, y.n[q])
        if hit.any():
            yield np.full(np.count_nonzero(hit), p), q[hit], common[hit]


def _set_pairs(sets: DataFrame, low: Callable, right: Callable) -> DataFrame:
    """(a, b, common, size_a, size_b), a < b, of all sets (id, ws: distinct hashes of the words) that are ``right``(common, n, sizes).

    ``low``(n, sizes) is what they have in common at least, grows with the sizes and by less than them. Each two blocks of sets are tasks'
    work, and nothing is shuffled but the sets.
    """
    schema, spark = _pair_schema(sets), sets.sparkSession
    names = _sorted_blocks(sets)
    n = len(names)
    tiles = [(i, j) for i in range(n) for j in range(i, n)]
    parts = max(-(-LEAST_TILES // max(len(tiles), 1)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                (i, j), part = tiles[task // parts], task % parts
                x = _Sorted(names[i])
                y = x if i == j else _Sorted(names[j])
                held, size = [], 0
                for some in itertools.chain(_matches(x, y, range(part, len(x.n), parts), low, right, i == j), [None]):
                    if held and (some is None or size >= SENT_PAIRS):
                        p, q, common = (np.concatenate(v) for v in zip(*held, strict=True))
                        yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(p)), y.ids.take(pa.array(q)), *[pa.array(v, pa.int32()) for v in (common, x.n[p], y.n[q])]], schema.names)
                        held, size = [], 0
                    if some is not None:
                        held.append(some)
                        size += len(some[0])

    # tiles are small tasks, dealt in turn
    tasks = spark.range(0, len(tiles) * parts, 1, max(min(len(tiles) * parts, 4096), 1))
    return _ordered(tasks.mapInArrow(run, schema))


def _pair_schema(full: DataFrame) -> T.StructType:
    kind = full.schema["id"].dataType
    return T.StructType([T.StructField("x", kind), T.StructField("y", kind), *[T.StructField(c, T.IntegerType()) for c in ("common", "n_x", "n_y")]])


def _ordered(pairs: DataFrame) -> DataFrame:
    first = F.col("x") < F.col("y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("size_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("size_b"))


def rare_word_pairs(sets: DataFrame, id_: str, word: str, most_docs: int) -> DataFrame:
    """(a, b, common, size_a, size_b), a < b, of sets that share a word of at most ``most_docs`` sets.

    A rare word's pairs are at most ``most_docs`` squared, so no word can flood the join; ``common`` counts all words. A pair goes
    to the task of its two blocks as ids only; the words are read there, once a block. What shares frequent words only isn't asked
    for here: ``overlapping`` and ``jaccard_pairs`` find all pairs.
    """
    s = sets.select(F.col(id_).alias("id"), F.col(word).alias("w")).filter("id IS NOT NULL AND w IS NOT NULL")
    path, n, full = _in_blocks(s, 1 << 31)
    s = s.distinct()
    df = s.groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df").between(2, most_docs)).select("w")
    rare = s.join(df, "w").select("id", F.xxhash64("w").alias("w"))
    pairs = rare.select(F.col("id").alias("a"), "w").join(rare.select(F.col("id").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    blocks = pairs.select(_block("a", n).alias("i"), _block("b", n).alias("j"), "a", "b")
    turned = F.col("i") > F.col("j")
    tiles = blocks.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        for b in batches:
            tile = b.column("i").to_numpy() * n + b.column("j").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]))
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if at == to:
                    continue
                keys = tuple(int(k) for k in divmod(tile[at], n))
                held = {k: held[k] for k in keys if k in held}
                for k in keys:
                    if k not in held:
                        held[k] = _Block(path, k)
                sides = [held[k] for k in keys]
                names = [b.column(c).slice(at, to - at) for c in ("x", "y")]
                places = [pc.index_in(v, value_set=side.ids).to_numpy() for v, side in zip(names, sides, strict=True)]
                common = []
                for p, q in zip(*places, strict=True):
                    one, two = (side.words[side.start[r] : side.start[r + 1]] for side, r in zip(sides, (p, q), strict=True))
                    if len(one) > len(two):
                        one, two = two, one
                    common.append(np.count_nonzero(two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one))
                sizes = [pa.array(side.n[p], pa.int32()) for side, p in zip(sides, places, strict=True)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(common, pa.int32()), *sizes], ["x", "y", "common", "n_x", "n_y"])

    return _ordered(tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, _pair_schema(full)))


def _hashed(sets: DataFrame, id_: str, word: str) -> DataFrame:
    s = sets.select(F.col(id_).alias("id"), F.col(word).alias("w")).filter("id IS NOT NULL AND w IS NOT NULL")
    return s.groupBy("id").agg(F.collect_set(F.xxhash64("w")).alias("ws"))


def overlap_pairs(sets: DataFrame, id_: str, word: str, share: tuple[int, int]) -> DataFrame:
    """(a, b, common, size_a, size_b), a < b, of all sets that share at least ``share`` (a fraction) of the smaller one's words."""
    return overlapping(_hashed(sets, id_, word), share)


def overlapping(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``overlap_pairs`` of sets that have a row each: (id, ws: distinct hashes of the words).

    Short sets of frequent words lie within very many others, so that pairs to find grow with the square of the sets. Nothing is dropped.
    """
    num, den = share
    return _set_pairs(sets, lambda n, sizes: num / den * np.minimum(n, sizes), lambda common, n, sizes: den * common >= num * np.minimum(n, sizes))


def jaccard_pairs(sets: DataFrame, least: tuple[int, int], most: tuple[int, int]) -> DataFrame:
    """(a, b, common, size_a, size_b), a < b, of all sets (id, ws: distinct hashes of the words) of which the words in common are from
    ``least`` to ``most`` (fractions) of all that both have. Frequent words count as others do."""
    (num, den), (to, of) = least, most

    def right(common: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
        whole = n + sizes - common
        return (den * common >= num * whole) & (of * common <= to * whole)

    return _set_pairs(sets, lambda n, sizes: num / (num + den) * (n + sizes), right)


#: Rows of query words that are sent to the tasks at once; counts that a task holds at once.
MOST_QUERY_WORDS, HELD_COUNTS = 400_000, 1 << 21


def nearest_by_overlap(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, best, common, score): for each query (id, w) the target (id, w) that shares the most words; ties: least id.
    ``score`` is the share of the query's words. Queries are the small side."""
    return nearest_sets(queries, targets.groupBy("id").agg(F.collect_set("w").alias("ws")))


def nearest_sets(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """``nearest_by_overlap`` of targets that have a row each: (id, ws), ids whole numbers, words repeated or not.

    The queries' words go to all tasks, ``MOST_QUERY_WORDS`` at a time with a pass over the targets for each; a task counts the words that
    its targets share with every query and sends on one row a query, so that nothing is shuffled that grows with the targets."""
    q = queries.select("id", "w").distinct()
    size = q.groupBy("id").agg(F.count("*").alias("n"))
    passes = -(-q.count() // MOST_QUERY_WORDS)
    best = None
    for k in range(max(passes, 1)):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) if passes > 1 else q
        found = _nearest(part, sets)
        best = found if best is None else best.unionByName(found)
    best = best.groupBy("id").agg(F.max(F.struct("common", (-F.col("t")).alias("neg"))).alias("m"))
    return best.join(size, "id").select("id", (-F.col("m.neg")).alias("best"), F.col("m.common").alias("common"), F.round(F.col("m.common") / F.col("n"), 6).alias("score"))


def _nearest(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, t, common): of each task, the nearest target of every query that shares a word with one."""
    rows = queries.toArrow().combine_chunks()
    ids = pc.unique(rows["id"])
    item = pc.index_in(rows["id"], value_set=ids).to_numpy()
    words = pc.unique(pc.drop_null(rows["w"]))
    word = pc.fill_null(pc.index_in(rows["w"], value_set=words, skip_nulls=True), len(words)).to_numpy()
    order = np.argsort(word, kind="stable")
    start = np.searchsorted(word[order], np.arange(len(words) + 1))
    sent = sets.sparkSession.sparkContext.broadcast((words.cast(pa.string()), start, item[order], len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, items, n = sent.value
        most, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = max(HELD_COUNTS // max(n, 1), 1)
        for b in batches:
            targets = b.column("t").to_numpy()
            for at in range(0, b.num_rows, step):
                ws = b.column("ws").slice(at, step)
                row = pc.list_parent_indices(ws).to_numpy()
                place = pc.fill_null(pc.index_in(pc.list_flatten(ws), value_set=words, skip_nulls=True), -1).to_numpy()
                # each word of a target once
                row, place = np.divmod(np.unique(row[place >= 0] * np.int64(len(words)) + place[place >= 0]), max(len(words), 1))
                sizes = start[place + 1] - start[place]
                own = np.arange(sizes.sum()) + np.repeat(start[place] - np.cumsum(sizes) + sizes, sizes)
                common = np.bincount(np.repeat(row, sizes) * n + items[own], minlength=len(ws) * n).reshape(len(ws), n)
                top = common.max(0)
                first = np.where(common == top, targets[at : at + step, None], np.iinfo(np.int64).max).min(0)
                better = (top > most) | ((top == most) & (first < least))
                most, least = np.where(better, top, most), np.where(better, first, least)
        hit = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(least[hit]), pa.array(most[hit])], ["q", "t", "common"])

    found = sets.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("t"), "ws").mapInArrow(run, "q int, t long, common long")
    names = sets.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int32()), "id": ids}))
    return found.join(F.broadcast(names), "q").select("id", "t", "common")


def tiered(rows: DataFrame, id_: str, *tiers: tuple[str, DataFrame]) -> DataFrame:
    """The first tier in which a row matches. A tier is a name and a table with the ids that match and what they hit."""
    hits = None
    for n, (name, df) in enumerate(tiers):
        part = df.select(F.col(id_), F.col("hit"), F.lit(n).alias("_n"), F.lit(name).alias("tier"))
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy(id_).agg(F.min(F.struct("_n", "hit", "tier")).alias("m")).select(id_, "m.tier", "m.hit")
    return rows.select(id_).join(best, id_, "left").select(id_, F.coalesce("tier", F.lit("miss")).alias("tier"), "hit")


def contained(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage_id, text_id): whole passages (id, text), empty ones aside, inside texts (id, text).

    Of a passage of five words or more the second to fourth stand in the text as they are, so the equi-join is on windows of
    three words; of three or four words the second one does. Passages of one or two words are a query set that is held
    against each text as it streams by. Then the whole passage is compared.
    """
    p = passages.select(F.col("id").alias("passage_id"), F.col("text").alias("p"), tokens(F.col("text")).alias("w")).filter("p <> ''")
    t = texts.select(F.col("id").alias("text_id"), F.col("text").alias("t"))
    inner = p.filter(F.size("w") >= 3).select("passage_id", F.when(F.size("w") >= 5, F.array_join(F.slice("w", 2, 3), " ")).otherwise(F.element_at("w", 2)).alias("k"))
    w = t.select("text_id", tokens(F.col("t")).alias("w"))
    keys = w.select("text_id", F.explode(F.array_distinct(grams(F.col("w"), 3))).alias("k")).unionByName(w.select("text_id", F.explode(F.array_distinct("w")).alias("k")))
    found = keys.join(inner, "k").select("text_id", "passage_id").distinct()
    checked = found.join(p.select("passage_id", "p"), "passage_id").join(t, "text_id").filter(F.contains("t", "p"))
    brief = t.join(p.filter(F.size("w") < 3).select("passage_id", "p"), F.contains("t", "p"))
    return checked.select("passage_id", "text_id").unionByName(brief.select("passage_id", "text_id"))


def step_lookup(value: Column, steps: list[tuple[float, str]]) -> Column:
    """The label of the first step whose upper bound isn't below ``value``; else null."""
    out = F.lit(None).cast("string")
    for most, label in reversed(steps):
        out = F.when(value <= most, label).otherwise(out)
    return out


def foreign_owners(forms: DataFrame, form: str, owner: str) -> DataFrame:
    """(form, owners): forms of more than one owner."""
    return forms.groupBy(F.col(form).alias("form")).agg(F.count_distinct(owner).alias("owners")).filter("owners > 1")


def collisions(rows: DataFrame, canon: Column, id_: str) -> DataFrame:
    """(canon, members): different ids that one canonical form stands for."""
    return rows.select(canon.alias("canon"), F.col(id_).alias("id")).distinct().groupBy("canon").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("members"), F.count("*").alias("n")).filter("n > 1").drop("n")
