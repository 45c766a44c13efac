"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt to files by ranges of doc_id and sorted there, so file, stripe and row-group statistics on doc_id are
narrow. Readers split files by stripe, skip stripes and row groups by those statistics and Bloom filters, and load only
the columns asked for (counting tokens of a range never touches other stripes).

The range's number is stored with each row (``block``): the position of a document in the whole id stream is its block's
start plus the running count inside it, without a global sort.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows of equal doc_id follow each other
in no fixed order; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, tune, work_dir, written

END_ID = 1

#: Text a file holds, about.
FILE_BYTES = 64 << 20

#: Distinct parts of texts whose ids a task remembers (about 250 bytes each), and text that it cuts at once.
MOST_PARTS, CHUNK = 700_000, 4 << 20

ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.stripe.size": str(16 << 20)}


#: Classes of characters that the file's pre-tokenizer tells apart, up to U+07FF.
_SPACE, _LETTER, _NUMBER, _OTHER, _OWN = range(5)
_CLASS = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(i))[0], _SPACE if chr(i).isspace() else _OTHER) for i in range(0x800)], np.uint8)

#: A word put in for one that the library encodes by itself, and the end of a text: each is a part of its own.
_FAR_MARK, _END_MARK = "\x1c", "\x1d"
_CLASS[[ord(_FAR_MARK), ord(_END_MARK)]] = _OWN

#: Words with characters whose classes, cases and compositions are left to the library, and texts that are.
_FAR = re.compile("[^\x00-\u0239]")
_FAR_WORD = re.compile("\\S*[^\x00-\u0239]\\S*")
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

#: After an apostrophe that begins a part, these letters belong to it.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


class WordEncoder:
    """``tokenizers`` ids of whole texts. Numpy cuts them into the parts that the pre-tokenizer makes, Arrow finds the
    distinct ones, and a table remembers their ids.

    The library encodes each part by itself, so a text's ids are those of its parts in a row; up to U+0239 the
    normaliser only lowers case and unifies white space, which no part holds. New parts are encoded together, with
    spaces between them; the last id of a part is one that ends a word in the vocabulary, and no other is.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        """The table: entry ``k`` has ``self.size[k]`` ids from ``self.first[k]`` on. Entry 0 is the end id."""
        self.known: dict[bytes, int] = {_END_MARK.encode(): 0, _FAR_MARK.encode(): 0}
        self.ids, self.first, self.size = np.array([self.end_id], np.int32), np.zeros(1, np.int32), np.ones(1, np.int32)

    def _add(self, ids: list[np.ndarray]) -> np.ndarray:
        """Numbers of new entries."""
        number = len(self.size) + np.arange(len(ids))
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        return self._add_flat(np.concatenate(ids).astype(np.int32) if len(ids) else self.ids[:0], size) if len(ids) else number

    def _add_flat(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        number = len(self.size) + np.arange(len(size))
        self.first = np.concatenate((self.first, (len(self.ids) + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)))
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
        return number

    def _learn(self, new: list[bytes]) -> np.ndarray:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(new).decode()], add_special_tokens=False)[0].ids, np.int32)
        at = np.flatnonzero(self.ends[ids]) + 1
        assert len(at) == len(new)
        number = self._add_flat(ids, np.diff(at, prepend=0).astype(np.int32))
        self.known.update(zip(new, number.tolist(), strict=True))
        return number

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id last (a null text has it alone), and where each text's end."""
        far: list[str] = []

        def aside(m: re.Match) -> str:
            far.append(m[0])
            return f" {_FAR_MARK} "

        near = []
        for t in texts:
            if t and any(x in t for x in _WHOLE):
                far.append(t)
                t = _FAR_MARK
            elif t and not t.isascii() and _FAR.search(t):
                t = _FAR_WORD.sub(aside, t)
            near.append(t or "")
        parts, own = cut((_END_MARK.join(near) + _END_MARK).lower().encode())
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > MOST_PARTS:
            self._forget()
        entry = np.fromiter((self.known.get(x, -1) for x in distinct), np.int64, len(distinct))
        if len(unknown := np.flatnonzero(entry < 0)):
            entry[unknown] = self._learn([distinct[i] for i in unknown.tolist()])
        entries = entry[coded.indices.to_numpy()]
        end = np.cumsum(self.size[entries], dtype=np.int64)
        if far:
            mark = np.array([x == _FAR_MARK.encode() for x in distinct])
            entries[mark[coded.indices.to_numpy()]] = self._add([self.tokenizer.encode(x, add_special_tokens=False).ids for x in far])
            end = np.cumsum(self.size[entries], dtype=np.int64)
        size = self.size[entries]
        take = np.repeat(self.first[entries] - (end - size).astype(np.int32), size)
        take += np.arange(len(take), dtype=np.int32)
        ids, ends = self.ids[take], end[own]
        if far:  # they aren't remembered
            keep = len(self.size) - len(far)
            self.ids, self.first, self.size = self.ids[: self.first[keep]], self.first[:keep], self.size[:keep]
        return ids, ends


def cut(data: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """The pre-tokenizer's parts of lower-cased UTF-8 up to U+07FF, and which of them are ends of texts."""
    b = np.frombuffer(data, np.uint8)
    kind = _CLASS[b]
    lead = np.flatnonzero(b >= 0xC0)
    wide = _CLASS[(b[lead] & 31).astype(np.int64) << 6 | b[lead + 1] & 63]
    kind[lead] = wide
    kind[lead + 1] = wide
    start = np.empty(len(b), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= (kind == _NUMBER) | (kind == _OWN)
    start[lead + 1] = False
    for i in np.flatnonzero((b == 0x27) & start).tolist():
        n = 2 if data[i + 1 : i + 2] and data[i + 1] in _ONE else 3 if data[i + 1 : i + 3] in _TWO else 0
        if n:
            start[i + 1] = False
            if kind[i + n] == _LETTER:  # data ends with a mark, so there is such a byte
                start[i + n] = True
    inside = kind != _SPACE
    at = np.cumsum(inside, dtype=np.int32)
    begins = np.flatnonzero(start & inside)
    offsets = np.empty(len(begins) + 1, np.int32)
    offsets[:-1] = at[begins] - 1
    offsets[-1] = at[-1]
    parts = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])
    return parts, np.flatnonzero(b[begins] == ord(_END_MARK))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (array of int, the end id last) of every document."""
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch, encoder: WordEncoder) -> dict:
        found, ends = encoder.texts(batch.column("text").to_pylist())
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(found))
        return {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"ids": ids}

    return arrow_map(docs, "text", run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name != "text") + ", ids array<int>", lambda: WordEncoder(tokenizer_path, end_id), CHUNK)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes ids of all ``docs`` (doc_id, text) in ascending doc_id order.

    Texts are shuffled, by range, before they are encoded: they are smaller than their ids.
    """
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    ordered = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // file_bytes)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    encoded(ordered.withColumn("block", F.spark_partition_id()), tokenizer_path, end_id).select("doc_id", "block", "ids").write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, block and ids; wanted documents are found by the files' Bloom filters and statistics."""
    rows = spark.read.orc(path)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    if between is not None:
        rows = rows.filter(F.col("doc_id").between(*between))
    return rows


def located(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column("ids")
        values, at = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        return {"doc_id": batch.column("doc_id"), "block": batch.column("block"), "n_tokens": np.diff(at).astype(np.int64), "ids_crc32": [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}

    rows = read_tokens(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({k: (v if isinstance(v, pa.Array) else pa.array(v, pa.int64())) for k, v in run(b).items()}) for b in batches), f"doc_id {kind}, block int, n_tokens long, ids_crc32 long")
    digests = written(digests, "token-digests")
    # one row a block: bounded by the number of files, so one task may order them
    before = digests.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    digests = digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return digests.join(before, "block").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_positions(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files and reads them back, to ``located``'s rows."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return located(docs.sparkSession, path)
