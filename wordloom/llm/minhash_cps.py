"""Near-duplicates by chosen-path set similarity join.

A document is its set of distinct five-word shingles. Documents whose sets overlap by ``PERCENT`` percent or more are
linked, and every document gets the smallest doc_id that links reach.

1. *Sets and signatures.* One pass hashes the shingles and keeps of each set a 128-bit fingerprint and ``COORDINATES``
   minwise tokens. Equal fingerprints are one class from here on, so thousands of copies cost one row.
2. *Chosen paths.* Independent trees branch the classes: a node picks coordinates at random, 100/``PERCENT`` on average,
   and a class enters one child for each, named by its minwise token there. Nodes of one class end; nodes of at most
   ``SMALL`` classes are compared exhaustively; larger ones branch again until they are small or dense. A pair at the
   threshold meets in one tree with a probability of about 0.8 where one branching does (most nodes), and less in nodes of
   many branchings.
3. *Comparison.* In a small node all pairs are sifted by their signatures (at a margin that loses fewer than one pair in
   a million), and those that remain are confirmed on full sets, unless confirmed links connect them already. The first
   trees join most copies to components; later trees compare across components only.
4. *Dense nodes.* A node that keeps more than ``PERCENT`` percent of its parent's classes holds near copies of one text:
   branching on tells them apart no further, so it stops there. The classes are dealt at random to groups of ``SMALL``, compared in
   those, and all trees together connect the bulk.
5. *Exact rest.* What branching and dealing may part are pairs that met in a larger node of the first level. In such nodes of
   at most ``SIFTED`` classes, those go on that pass the sift with a class of another component; in larger ones, all. Of them, a shingle that only one component holds can't be shared by a pair still to find. The
   others are ordered rarest first; a pair that is similar enough shares one among the first few of both sets, where enough
   others follow to make up the overlap. An equi-join on those finds every such pair, and full sets decide. A class with too
   few shared shingles has no such pair.

Full sets are hashed once, for the classes that have a candidate, and reread. Components grow by alternating large-star
and small-star steps on tables in the shared folder; nothing that grows with the corpus reaches the driver.

Defined results: no text or no words: an empty set, linked with nothing; fewer than five words: the whole sequence is one
shingle; rows of equal doc_id are one document, which has all their sets; null doc_ids are kept out of the links, alone;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import SPACES, arrow_map, as_bytes, drop, lasting, mix64, scratch, tune, written

SHINGLE, PERCENT = 5, 75

#: Minwise tokens of a signature; trees; those that are compared before components are known; classes of a node that are
#: compared exhaustively.
COORDINATES, TREES, FIRST_TREES, SMALL = 64, 10, 1, 40

#: Deep levels have few classes and spare further ones: at level k, nodes of k * SMALL classes are compared, up to this k.
MOST_SMALL = 8

#: Classes of a first-level node that are sifted against one another in a task; larger nodes go to the exact join unsifted.
SIFTED = 4096

#: A pair is confirmed on full sets from this share of equal minwise tokens on: five deviations below the threshold.
SIFT = 31

#: Links that one task joins to components (about 40 MB); more are joined by star steps.
MOST_LOCAL = 200_000

#: Parts over which a hot key is spread.
SALTS = 1024

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            grown = np.full(max(n, 2 * len(_powers[0]), 1 << 16), _U(b))
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer((text or b"").translate(_LOWER), np.uint8)
    inside = np.ones(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~np.isin(data, np.frombuffer(SPACES, np.uint8)) if len(data) < 64 else ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out + _SEEDS[k]) + words[k : len(words) - n + 1 + k]
    return np.unique(mix64(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """A minwise token of each coordinate: multiply-and-shift hashes of all shingles, 32 bits of the least."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):  # bounded memory for long texts
        block = hashes[at : at + 4096, None] * _SEEDS
        block ^= block >> _U(29)
        block *= _U(0xBF58476D1CE4E5B9)
        np.minimum(low, block.min(0), out=low)
    return (low >> _U(32)).astype(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (the fingerprint) and mins (the signature) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        n, f, mins = [], [], []
        for text in as_bytes(batch.column("text")):
            h = shingle_hashes(text)
            n.append(len(h))
            f.append((int(np.bitwise_xor.reduce(mix64(h + _U(1)), initial=_U(0)).view(np.int64)), int(mix64(h ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))))
            mins.append(signature(h).tobytes() if len(h) else b"")
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "f1": [x for x, _ in f], "f2": [x for _, x in f], "mins": mins}

    return arrow_map(docs.select("doc_id", "text"), "text", run, "doc_id long, n_shingles long, f1 long, f2 long, mins binary")


#: The order in which a tree's levels pick coordinates: no path picks one twice in its first levels.
_ORDER = np.argsort(mix64(np.arange(TREES * COORDINATES, dtype=np.uint64) + _U(17)).reshape(TREES, COORDINATES), 1)


def _names(seed: np.ndarray, mins: np.ndarray, tree: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Children that rows enter, and the row of each: a node picks its tree's next coordinate, or the next two as often as
    the threshold's branching asks for; a child is named by its node, the coordinate and the row's minwise token there."""
    twice = (mix64(seed) >> _U(40)) % _U(1000) < _U(1000 * (100 - PERCENT) // PERCENT)
    rows, names = [], []
    for k, on in enumerate((np.ones(len(seed), bool), twice)):
        at = np.flatnonzero(on)
        c = _ORDER[tree[at], (2 * level + k) % COORDINATES]
        rows.append(at)
        names.append(mix64(mix64(seed[at] ^ (c.astype(np.uint64) + _U(1))) + mins[at, c].astype(np.uint64) * _U(_BASE)))
    return np.concatenate(names).view(np.int64), np.concatenate(rows)


def _roots(classes: DataFrame) -> DataFrame:
    """(tree, node, id): the nodes of the first level of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mins = np.frombuffer(b"".join(b.column("mins").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            for tree in range(TREES):
                of = np.full(len(mins), tree, np.int16)
                names, rows = _names(mix64(np.full(len(mins), tree + 1, np.uint64)), mins, of, 0)
                yield pa.RecordBatch.from_arrays([pa.array(of[rows]), pa.array(names), b.column("id").take(pa.array(rows))], ["tree", "node", "id"])

    return classes.select("id", "mins").mapInArrow(run, "tree short, node long, id long")


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """The children of nodes: (tree, node, id, sketch) of the same columns, and ``was``, the classes of the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            names, at = _names(mix64(b.column("node").to_numpy().view(np.uint64) + _U(_BASE)), sketch, b.column("tree").to_numpy(), level)
            kept = [b.column(c).take(pa.array(at)) for c in ("tree", "id", "sketch", "n")]
            yield pa.RecordBatch.from_arrays([kept[0], pa.array(names), *kept[1:]], ["tree", "node", "id", "sketch", "was"])

    return rows.select("tree", "node", "id", "sketch", "n").mapInArrow(run, "tree short, node long, id long, sketch binary, was long")


def _counted(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Adds ``n``, the classes of each row's node, and the columns that ``more`` has for an id; rows alone in their node go.

    The totals are a table of their own, so that the join's sides are plain shuffles: Spark splits a hot node there.
    """
    rows = written(rows, "nodes")
    total = written(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node-totals")
    out = written(rows.join(total, "node"), "node-members")
    drop(rows, total)
    if more is None:
        return out
    wide = written(out.join(more, "id"), "node-members")
    drop(out)
    return wide


def _dealt(dense: DataFrame) -> DataFrame:
    """The classes of dense nodes in random groups of about ``SMALL``: ``node`` names the group, ``of`` the node."""
    group = F.xxhash64(F.lit("group"), "node", F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("n") / SMALL)))
    return dense.withColumn("of", F.col("node")).withColumn("node", group)


def leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Of all trees: (tree, node, id, sketch) of nodes to compare exhaustively, (tree, node, of, id, sketch) of the
    dealt groups of dense nodes (None: there are none), and (node, id, n, sketch) of the first level's nodes that branch.

    Below the first level a minwise token's low 8 bits do: in a node of agreeing classes they tell apart as well.
    """
    now = _counted(_roots(classes), classes.select("id", "sketch"))
    small, dense = [now.filter(F.col("n") <= SMALL)], []
    now = large_roots = now.filter(F.col("n") > SMALL)
    level = 1
    while not now.isEmpty():
        children = _counted(_branch(now, level))
        level += 1
        large, stuck = F.col("n") > SMALL * min(level, MOST_SMALL), 100 * F.col("n") > PERCENT * F.col("was")
        small.append(children.filter(~large))
        dense.append(children.filter(large & stuck))
        now = children.filter(large & ~stuck)
    dense = [x for x in dense if not x.isEmpty()]
    dealt = _dealt(_union(dense)).select("tree", "node", "of", "id", "sketch") if dense else None
    return _union([x.select("tree", "node", "id", "sketch") for x in small]), dealt, large_roots.select("node", "id", "n", "sketch")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal nodes of rows that come sorted by node."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        node = rest.column("node").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1)) if len(node) else [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield rest.slice(a, z - a)
        rest = rest.slice(edges[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def candidates(members: DataFrame) -> DataFrame:
    """(tree, node, id) of those members of small nodes whose sketch is close to another member's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        for g in _groups(batches):
            sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            near = np.zeros(len(sketch), bool)
            for i in range(len(sketch) - 1):
                like = (sketch[i + 1 :] == sketch[i]).sum(1) >= SIFT
                if like.any():
                    near[i] = True
                    near[i + 1 :] |= like
            if near.any():
                out.append(g.select(["tree", "node", "id"]).filter(pa.array(near)))
            if len(out) > 500:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    rows = members.select("tree", "node", "id", "sketch")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "tree short, node long, id long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets overlap by PERCENT percent of their union."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def confirmed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b): in every small node, pairs whose full sets are similar enough, but for those that the task's other
    links connect already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for g in _groups(batches):
            ids, label = g.column("id").to_pylist(), g.column("label").to_pylist()
            full = [np.frombuffer(x, np.uint64) for x in g.column("hashes").to_pylist()]
            for i in range(len(ids)):
                for j in range(i):
                    x, y = find(label[i]), find(label[j])
                    if x != y and linked(full[i], full[j]):
                        top[x] = y
                        out.append((max(label[i], label[j]), min(label[i], label[j])))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = members.join(sets, "id").select("node", "id", "label", "hashes")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``m`` of their ``a``: an ``a`` with very many ``b`` is spread by salt over many tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    return salted.join(salted.select("a", "salt").distinct().join(least, "a"), ["a", "salt"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all the links in a task, by union-find."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            top[max(x, y)] = min(x, y)
    ids = sorted(top)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "label"])


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that the links (a, b) reach from each of theirs.

    Few links (``MOST_LOCAL``, a bound on one task's memory) are joined in a task; more by star steps over all tasks.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    if links.count() <= MOST_LOCAL:
        return written(links.coalesce(1).mapInArrow(_joined, "id long, label long"), "labels")
    links = written(links.distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: an id's larger neighbours point to the smallest of its neighbours and itself
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(_with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # small star: an id and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = written(small.filter("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
        before = now


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _crossing(members: DataFrame) -> DataFrame:
    """Rows of nodes that span at least two components (all rows of a small node meet in one task anyway)."""
    spread = members.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("node")
    return members.join(spread, "node", "left_semi")


def _to_settle(nodes: DataFrame) -> DataFrame:
    """(id, label) of ``nodes`` (node, id, n, sketch, label): classes that can be similar to one of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            label, near = g.column("label").to_numpy(), np.zeros(len(sketch), bool)
            for i in range(len(sketch) - 1):
                like = ((sketch[i + 1 :] == sketch[i]).sum(1, dtype=np.uint8) >= SIFT) & (label[i + 1 :] != label[i])
                if like.any():
                    near[i] = True
                    near[i + 1 :] |= like
            if near.any():
                yield from g.select(["id", "label"]).filter(pa.array(near)).combine_chunks().to_batches()

    few = nodes.filter(F.col("n") <= SIFTED).select("node", "id", "label", "sketch")
    few = few.repartition("node").sortWithinPartitions("node").mapInArrow(run, "id long, label long")
    return few.unionByName(nodes.filter(F.col("n") > SIFTED).select("id", "label")).distinct()


def _shared(sets: DataFrame) -> DataFrame:
    """(s, label, n, h, rest): of every set (s, label, hashes) that can be similar to one of another label the shingles, rarest
    first, one of which it shares with each such set. ``rest`` counts the shared ones from this on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                h = np.frombuffer(b.column("hashes")[at].as_buffer(), np.int64)
                s, label, n = (np.full(len(h), x) for x in (b.column("s")[at].as_py(), b.column("label")[at].as_py(), len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, label, n, h)], ["s", "label", "n", "h"])

    rows = sets.select("s", "label", "hashes").mapInArrow(run, "s long, label long, n long, h long")
    held = rows.groupBy("h").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h", "df")
    of = Window.partitionBy("s")
    shared = rows.join(held, "h").withColumn("m", F.count("*").over(of)).withColumn("at", F.row_number().over(of.orderBy("df", "h")))
    return written(shared.withColumn("rest", F.expr("m - at + 1")).filter(100 * F.col("rest") >= PERCENT * F.col("n")).select("s", "label", "n", "h", "rest"), "rest-shared")


def _rest_pairs(shared: DataFrame) -> DataFrame:
    """(x, y): pairs of sets of different labels that can be similar enough, by what follows their first shared shingle."""
    side = lambda c: shared.select("h", *[F.col(k).alias(f"{k}_{c}") for k in ("s", "label", "n", "rest")])
    # an overlap is at least PERCENT of 100 + PERCENT of both sizes, thus twice that of the smaller one's
    small = side("x").filter((100 + PERCENT) * F.col("rest_x") >= 2 * PERCENT * F.col("n_x"))
    able = (100 + PERCENT) * F.least("rest_x", "rest_y") >= PERCENT * (F.col("n_x") + F.col("n_y"))
    pairs = small.join(side("y"), "h").filter("(n_x < n_y OR n_x = n_y AND s_x < s_y) AND label_x <> label_y").filter(able)
    return pairs.select(F.col("s_x").alias("x"), F.col("s_y").alias("y")).distinct()


def exact_rest(sets: DataFrame) -> DataFrame:
    """Links (a, b) of labels: every pair of sets (id, label, hashes) of different labels that are similar enough."""
    sets = written(sets.select(F.xxhash64("id", "hashes").alias("s"), "label", "hashes"), "rest-sets")
    pairs = written(_rest_pairs(_shared(sets)), "rest-pairs")
    side = lambda c: sets.select(F.col("s").alias(c), F.col("label").alias(f"label_{c}"), F.col("hashes").alias(f"hashes_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [[np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(c)] for c in ("hashes_x", "hashes_y")]
            yes = pa.array([linked(x, y) for x, y in zip(*full, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(yes) for c in ("label_x", "label_y")], ["a", "b"])

    return pairs.join(side("x"), "x").join(side("y"), "y").select("label_x", "label_y", "hashes_x", "hashes_y").mapInArrow(run, "a long, b long")


def _labels(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, label): the component of each class that has a link."""
    small, dealt, large = leaves(classes)
    if dealt is not None:
        small = small.unionByName(dealt.drop("of"))
    found = written(candidates(small), "candidates")
    sets = written(_full_sets(docs, found.select("id")), "sets")
    links = written(confirmed(found.filter(F.col("tree") < FIRST_TREES).select("node", "id", F.col("id").alias("label")), sets), "links")
    labels = components(links)
    later = _crossing(written(_labelled(found.filter(F.col("tree") >= FIRST_TREES).select("node", "id"), labels), "later-trees"))
    more = written(confirmed(later, sets), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    large = written(_to_settle(written(_crossing(_labelled(large, labels)), "rest-nodes")), "rest")
    if not large.isEmpty():
        new = _full_sets(docs, large.select("id").join(found.select("id"), "id", "left_anti"))
        more = written(exact_rest(large.join(sets.unionByName(new), "id")), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (columns doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sign = written(signed(docs), "signatures")
    usable = sign.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min("mins").alias("mins"))
    classes = written(_sketched(classes), "classes")
    with scratch(spark):
        labels = _labels(docs, classes)
        with lasting():
            labels = written(labels, "labels")
    class_of = classes.select("f1", "f2", "n_shingles", "id").join(labels, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("label", "id").alias("component_id"))
    out = _by_fingerprint(sign, class_of)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sketched(classes: DataFrame) -> DataFrame:
    """Adds the low 8 bits of every minwise token, to compare and to branch within nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mins = np.frombuffer(b"".join(b.column("mins").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            yield b.append_column("sketch", pa.array([x.tobytes() for x in (mins & np.uint32(255)).astype(np.uint8)], pa.binary()))

    return classes.mapInArrow(run, "f1 long, f2 long, n_shingles long, id long, mins binary, sketch binary")


def _by_fingerprint(sign: DataFrame, class_of: DataFrame) -> DataFrame:
    """Each document's component; a fingerprint that a third of all documents share is spread over many tasks."""
    keys = ["f1", "f2", "n_shingles"]
    salted = sign.select("doc_id", *keys).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = salted.select(*keys, "salt").distinct().join(class_of, keys)
    return salted.join(spread, [*keys, "salt"], "left")


#: Bits of the filter that rules most documents out before their texts are shuffled to the wanted ids (8 MB at most).
FILTER_BITS = 1 << 26


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the documents in ``wanted``."""
    wanted = wanted.select("id").distinct()
    # a bitmap of the wanted ids' hashes: as many rows as it has pieces of 4,096 bytes, whatever is wanted
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.select(at("id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    maybe = docs.withColumn("_h", at("doc_id")).withColumn("_piece", F.bitmap_bucket_number("_h")).join(F.broadcast(bits), "_piece")
    place = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    maybe = maybe.filter(F.getbit(byte, (place % 8).cast("int")) == 1)
    # not a semi-join: Spark would move that before the filter
    rows = maybe.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id"), "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("doc_id"), "hashes": [shingle_hashes(x).tobytes() for x in as_bytes(batch.column("text"))]}

    return arrow_map(rows, "text", run, "id long, hashes binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest doc_id."""
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
