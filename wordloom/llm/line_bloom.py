"""Line deduplication behind two Bloom filters.

Every document's distinct long lines go, as 128-bit keys, into two blocked Bloom filters: once-seen, and twice-seen for
what the first one holds already. Filters of two partitions merge by ``(a1 | a2, b1 | b2 | a1 & a2)``, so a key of two
documents is always in the merged twice-seen filter. Only keys found there (repeats and few false ones) are shuffled,
to be counted exactly and to choose the document that keeps the line. The filter's size follows the number of keys up to
``MOST_FILTER_MB``, which bounds what is broadcast; a fuller filter lets more keys through to the exact count and
changes no result.

Defined results: a null or empty text is one empty line and never loses it; rows with equal doc_id count as one document
and all of them keep or lose a line together; a null doc_id is the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import SPACES, arrow_map, as_bytes, chunks, mix64, tune, written

#: Lines whose key has at least this many code points, in at least this many documents, are removed.
LEAST_CHARS, LEAST_DOCS = 40, 5

#: Bits a key, bits set by a key, bytes of a block, and the bound of one filter.
BITS_A_KEY, HASHES, BLOCK = 16, 6, 4096
#: Characters for each key when the filter is sized; more keys only make it let through more.
LINE_CHARS = 300
MOST_FILTER_MB = 64


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The 128-bit key of a line that may be removed, else None."""
    key = line.strip(SPACES).lower()
    if len(key) < least_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def keys_of(text: bytes | None) -> list[bytes | None]:
    return [line_key(x) for x in (text or b"").split(b"\n")]


def positions(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key (n x 2 array of 64-bit halves) and its bits there (n x HASHES)."""
    a, b = keys[:, 0], keys[:, 1] | np.uint64(1)
    at = mix64(a[:, None] + np.arange(1, HASHES + 1, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(BLOCK * 8)
    return (mix64(a ^ b) % np.uint64(blocks)).astype(np.int64), at.astype(np.int64)


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _set(filter_: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(filter_, byte.ravel(), bit.ravel())


class TwoFilters:
    """The once-seen and the twice-seen filter of one partition."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.once, self.twice = (np.zeros(blocks * BLOCK, np.uint8) for _ in range(2))

    def add(self, digests: list[bytes]) -> None:
        """One document at a time brings its distinct keys; keys within a call may repeat between documents."""
        keys = _halves(digests)
        block, at = positions(keys, self.blocks)
        byte, bit = block[:, None] * BLOCK + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8)
        _, first, back = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        again = first[back] != np.arange(len(keys))
        again |= ((self.once[byte] & bit) == bit).all(1)
        _set(self.once, byte, bit)
        _set(self.twice, byte[again], bit[again])

    def parts(self) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
        """Non-empty blocks."""
        for k in np.flatnonzero(self.once.reshape(self.blocks, BLOCK).any(1)).tolist():
            at = slice(k * BLOCK, (k + 1) * BLOCK)
            yield k, (self.once[at].tobytes(), self.twice[at].tobytes())


def merge(once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pair of filters of many, block by block: rows are partitions. A bit of two once-seen filters is seen twice."""
    seen, again = once[0].copy(), twice[0].copy()
    for a, b in zip(once[1:], twice[1:], strict=True):
        again |= b | (seen & a)
        seen |= a
    return seen, again


#: Partitions whose blocks meet first, so that the second merge has few rows however many partitions there are.
FIRST_MERGE = 64


def twice_seen(docs: DataFrame, blocks: int) -> dict[int, bytes]:
    """The merged twice-seen filter, block by block (at most ``MOST_FILTER_MB`` in all)."""
    schema = "part long, block long, once binary, twice binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(blocks)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [k for text in as_bytes(part.column("text")) for k in dict.fromkeys(keys_of(text)) if k]
                if found:
                    filters.add(found)
        own = TaskContext.get().partitionId() // FIRST_MERGE
        for k, (a, b) in filters.parts():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([k], pa.int64()), pa.array([a]), pa.array([b])], ["part", "block", "once", "twice"])

    def meet(t: pa.Table) -> pa.Table:
        once, twice = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, BLOCK) for c in ("once", "twice"))
        a, b = merge(once, twice)
        return pa.table({"part": t.column("part")[:1], "block": t.column("block")[:1], "once": [a.tobytes()], "twice": [b.tobytes()]})

    parts = docs.select("text").mapInArrow(build, schema)
    some = parts.groupBy("part", "block").applyInArrow(meet, schema)
    rows = some.groupBy("block").applyInArrow(meet, schema).select("block", "twice").collect()
    return {r[0]: bytes(r[1]) for r in rows if any(r[1])}


def suspects(docs: DataFrame, blocks: int, filter_: dict[int, bytes]) -> DataFrame:
    """(doc_id, k1, k2) of every document's keys that the twice-seen filter may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def setup() -> np.ndarray:
        whole = np.zeros(blocks * BLOCK, np.uint8)
        for k, x in sent.value.items():
            whole[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x, np.uint8)
        return whole

    def run(batch: pa.RecordBatch, whole: np.ndarray) -> dict:
        row, found = [], []
        for i, text in enumerate(as_bytes(batch.column("text"))):
            own = [k for k in dict.fromkeys(keys_of(text)) if k]
            row += [i] * len(own)
            found += own
        if not found:
            return {"doc_id": batch.column("doc_id").slice(0, 0), "k1": [], "k2": []}
        keys = _halves(found)
        block, at = positions(keys, blocks)
        bit = np.uint8(1) << (at & 7).astype(np.uint8)
        maybe = ((whole[block[:, None] * BLOCK + (at >> 3)] & bit) == bit).all(1)
        signed = keys[maybe].view(np.int64)
        return {"doc_id": batch.column("doc_id").take(pa.array(np.array(row)[maybe])), "k1": signed[:, 0], "k2": signed[:, 1]}

    return arrow_map(docs, "text", run, f"doc_id {kind}, k1 long, k2 long", setup)


def removals(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, gone): the keys of lines that each document loses, packed in one binary value."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(min(MOST_FILTER_MB << 20, max(1 << 16, chars / LINE_CHARS * BITS_A_KEY / 8)) // BLOCK)
    found = written(suspects(docs, blocks, twice_seen(docs, blocks)).distinct(), "line-suspects")
    # two steps: a line that a third of all documents hold is counted by many tasks, and joined the same way
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    parts = salted.groupBy("k1", "k2", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    common = parts.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= least_docs).drop("n")
    common = written(parts.select("k1", "k2", "salt").join(common, ["k1", "k2"]), "line-common")
    lost = salted.join(common, ["k1", "k2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("gone"))


def _apply(docs: DataFrame, gone: DataFrame, f, schema: str) -> DataFrame:
    """``f`` on each row's text (column ``_text``) and its keys to remove (``_gone``)."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("gone").alias("_gone"))
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left").drop("_id")
    return arrow_map(rows, "_text", f, schema)


def kept_lines(text: bytes | None, gone: list[dict] | None) -> tuple[int, bytes]:
    """How many lines go, and the text of the others."""
    text = text or b""
    if not gone:
        return 0, text
    dropped = {(x["k1"] & (1 << 64) - 1).to_bytes(8, "little") + (x["k2"] & (1 << 64) - 1).to_bytes(8, "little") for x in gone}
    lines = text.split(b"\n")
    rest = [x for x in lines if line_key(x) not in dropped]
    return len(lines) - len(rest), b"\n".join(rest)


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the kept text) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("_text"))
        done = [kept_lines(t, g) for t, g in zip(texts, batch.column("_gone").to_pylist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "n_lines": [(t or b"").count(b"\n") + 1 for t in texts], "n_dropped": [n for n, _ in done], "kept_sha256": [hashlib.sha256(x).hexdigest() for _, x in done]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _apply(docs.select("doc_id", F.col("text").alias("_text")), removals(docs, least_docs), run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def remove_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with texts of kept lines only (null texts stay null); a column n_chars, where there is one, follows."""

    def run(batch: pa.RecordBatch) -> dict:
        done = [kept_lines(t, g) if g else (0, b"") for t, g in zip(as_bytes(batch.column("_text")), batch.column("_gone").to_pylist(), strict=True)]
        return {"_row": batch.column("_row"), "_new": [x.decode() if n else None for n, x in done]}

    packed = docs.select("doc_id", F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    out = _apply(packed, removals(docs, least_docs), run, f"_row {packed.schema['_row'].dataType.simpleString()}, _new string")
    changed = {"text": F.coalesce("_new", F.col("_row.text")), "n_chars": F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
