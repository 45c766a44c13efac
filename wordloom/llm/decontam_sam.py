"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton holds every run of words of every item. A document's words stream through it; at each word it knows the
longest run ending there that some item contains. A run of at least ``WINDOW`` words, or one equal to a shorter whole
item, is an occurrence; its words are hit.

Items are read to the driver in shards of at most ``SHARD_WORDS`` words (a longer item stands alone), and driver, broadcast
and tasks hold one shard and its automaton at a time. With a single shard, one pass over the texts gives the results. With
more, each shard is broadcast for a pass of its own, which writes the hit ranges and items of the texts that have some; they
are united by text and joined to the documents at the end. So memory doesn't grow with the benchmark; passes do.

Defined results: a null or empty text has no words and no hits; items without words are skipped; equal items under
several ids all count; items with null ids take part in hits but not in the id list; repeated document rows are judged
one by one; empty tables give empty results, and no items give no hits.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, as_bytes, ascii_lower_table, tune, written

WINDOW = 13

#: Percentage of hit words from which a document counts as contaminated.
LEAST_PERCENT = 5

#: Words of test items in one automaton (about 400 bytes of memory each).
SHARD_WORDS = 400_000

_WORDS = ascii_lower_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def words(text: bytes | None) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and all characters from U+0080 on."""
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """A generalised suffix automaton; letters are numbers of words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        #: Items with an occurrence when a match of sufficient length is in the state.
        self.windows: dict[int, set[int]] = {}
        #: Whole items shorter than a window: length and item, by state.
        self.wholes: dict[int, set[tuple[int, int]]] = {}
        self.ids = [i for i, w in items if w]
        coded = [[self.number.setdefault(x, len(self.number)) for x in w] for _, w in items if w]
        self.shortest = min((min(len(x), window) for x in coded), default=window)
        for x in coded:
            last = 0
            for c in x:
                last = self._extend(last, c)
        for k, x in enumerate(coded):
            v = length = 0
            for c in x:
                v, length = self.next[v][c], length + 1
                if length >= window:
                    self.windows.setdefault(self._up(v, window), set()).add(k)
            if length < window:
                self.wholes.setdefault(self._up(v, length), set()).add((length, k))
        #: By state: the nearest state on the path to the root that ends a short item, itself included.
        self.short_up = [-1] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.short_up[v] = v if v in self.wholes else self.short_up[self.link[v]]

    def _up(self, v: int, length: int) -> int:
        """The state of the last ``length`` words of a match in ``v``."""
        while self.len[self.link[v]] >= length:
            v = self.link[v]
        return v

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        new = len(size)
        nxt.append({}), link.append(0), size.append(size[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, text: list[bytes], hit: np.ndarray) -> set[int]:
        """Marks hit words; returns the items (numbers in ``ids``) that have an occurrence."""
        ids = np.fromiter((self.number.get(w, -1) for w in text), np.int64, len(text))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        found: set[int] = set()
        nxt, link, size, window = self.next, self.link, self.len, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # a run of known words too short for any occurrence
                continue
            v = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in nxt[v]:
                    v = link[v]
                    length = size[v]
                if c not in nxt[v]:
                    continue
                v, length = nxt[v][c], length + 1
                if length >= window:
                    hit[i + 1 - window : i + 1] = True
                    found |= self.windows[self._up(v, window)]
                u = self.short_up[v]
                while u > 0:
                    for n, k in self.wholes[u]:
                        if n <= length:
                            hit[i + 1 - n : i + 1] = True
                            found.add(k)
                    u = self.short_up[link[u]]
        return found


def shards(benchmark: DataFrame, most: int = SHARD_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items, grouped to at most ``most`` words. The driver holds one group at a time."""
    now: list = []
    n = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        w = words((row[1] or "").encode())
        if now and n + len(w) > most:
            yield now
            now, n = [], 0
        now.append((row[0], w))
        n += len(w)
    if now:
        yield now


def _ranges(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"a": a, "z": z} for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


_FOUND = "_ranges array<struct<a:bigint,z:bigint>>, _items array<string>"


def _prepared(docs: DataFrame, text: str, benchmark: DataFrame, window: int, shard_words: int):
    """``docs`` with columns ``_ranges`` and ``_items`` (hits found so far), and what makes the automaton that finds them all
    (None: they are found)."""
    sc = docs.sparkSession.sparkContext
    groups = shards(benchmark, shard_words)
    now, later = next(groups, []), next(groups, None)
    if later is None:
        sent = sc.broadcast(now)
        empty = [F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in _FOUND.split(", ")]
        return docs.select("*", *empty), lambda: Automaton(sent.value, window)
    keyed = docs.select("*", F.xxhash64(text).alias("_h1"), F.md5(text).alias("_h2"))
    texts = keyed.select("_h1", "_h2", F.col(text).alias("_t"))
    found = None
    for group in itertools.chain((now, later), groups):
        sent = sc.broadcast(group)

        def run(batch: pa.RecordBatch, automaton: Automaton) -> dict:
            out: dict[str, list] = {c: [] for c in ("at", "_ranges", "_items")}
            for i, t in enumerate(as_bytes(batch.column("_t"))):
                w = words(t)
                hit = np.zeros(len(w), bool)
                if items := automaton.scan(w, hit):
                    out["at"].append(i), out["_ranges"].append(_ranges(hit)), out["_items"].append([x for k in items if (x := automaton.ids[k]) is not None])
            at = pa.array(out.pop("at"), pa.int64())
            return {c: batch.column(c).take(at) for c in ("_h1", "_h2")} | out

        part = written(arrow_map(texts, "_t", run, f"_h1 long, _h2 string, {_FOUND}", lambda sent=sent: Automaton(sent.value, window)), "shard-hits")
        sent.unpersist()
        part = part.dropDuplicates(["_h1", "_h2"])
        found = part if found is None else found.unionByName(part)
    # a text has at most one row a shard
    united = found.groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    return keyed.join(united, ["_h1", "_h2"], "left").drop("_h1", "_h2"), None


def _hits(batch: pa.RecordBatch, text: str, automaton: Automaton | None) -> Iterator[tuple[list[bytes], np.ndarray, set[str], bytes | None]]:
    """Of each row its words, which of them are hit, the ids of the items, and the text."""
    known = zip(batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist(), strict=True)
    for t, (ranges, items) in zip(as_bytes(batch.column(text)), known, strict=True):
        w = words(t)
        hit = np.zeros(len(w), bool)
        if automaton is not None:
            items = [x for k in automaton.scan(w, hit) if (x := automaton.ids[k]) is not None]
        for r in ranges or ():
            hit[r["a"] : r["z"]] = True
        yield w, hit, set(items or ()), t


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted), items_sha256 and contaminated of every document."""
    tune(docs.sparkSession)
    rows, setup = _prepared(docs.select("doc_id", "text"), "text", benchmark, window, shard_words)

    def run(batch: pa.RecordBatch, automaton: Automaton | None = None) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated")}
        for w, hit, items, _ in _hits(batch, "text", automaton):
            n, ids = int(hit.sum()), sorted(items)
            for c, x in zip(out, (len(w), n, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0 and 100 * n >= LEAST_PERCENT * len(w)), strict=True):
                out[c].append(x)
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(rows, "text", run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, contaminated boolean", setup)


def cut(text: bytes, w: list[bytes], hit: np.ndarray) -> str:
    """``text`` without its hit words; what stands between two of them goes with them."""
    lower, at, end, kept = text.translate(_WORDS), 0, 0, []
    was = False
    for word, h in zip(w, hit.tolist(), strict=True):
        start = lower.index(word, at)
        at = start + len(word)
        if h:
            if not was:
                kept.append(text[end:start])
            end = at
        was = h
    return b"".join([*kept, text[end:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without contaminated documents; occurrences below that share are cut out of the texts of the others.

    Documents without an occurrence come back as they are. A column n_chars, where there is one, follows the text.
    """
    tune(docs.sparkSession)
    packed = docs.select(F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    rows, setup = _prepared(packed, "_text", benchmark, window, shard_words)

    def run(batch: pa.RecordBatch, automaton: Automaton | None = None) -> dict:
        new: list[str | None] = []
        drop: list[bool] = []
        for w, hit, _, text in _hits(batch, "_text", automaton):
            n = int(hit.sum())
            drop.append(n > 0 and 100 * n >= LEAST_PERCENT * len(w))
            new.append(None if not n or drop[-1] else cut(text, w, hit))
        return {"_row": batch.column("_row"), "_drop": drop, "_cut": new}

    out = arrow_map(rows, "_text", run, f"_row {packed.schema['_row'].dataType.simpleString()}, _drop boolean, _cut string", setup).filter("NOT _drop")
    text = F.coalesce("_cut", F.col("_row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("_cut").isNull(), F.col("_row.n_chars")).otherwise(F.length("_cut")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
