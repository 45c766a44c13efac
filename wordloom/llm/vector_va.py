"""Vector codes: each of four parts of a vector becomes the number of its nearest codebook entry, found through a VA-file.

Components become integers, ``floor(1024 * x)``, so that all sums and distances are exact and depend on no order. A part's
codebook of 256 entries is kept as a vector approximation: in each dimension the entries' coordinates lie in 2^4 cells. A
query's lookup tables hold, for each dimension and cell, the least and the largest squared difference that an entry in it
can have; their sums bound each entry's distance from both sides. Only entries whose lower bound doesn't exceed the least
upper bound are refined with integer distances.

Codebooks start as the parts of the 256 smallest vec_ids. In each of four rounds tasks keep sums and counts of their own rows
for each entry, Spark adds them up, and the driver gets the new codebooks: at most 256 times the components of a vector,
whatever the table holds. The same bounds what is sent to the tasks.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; null vec_ids come after all
others, rows of equal vec_id are ordered by their vectors; with fewer than 256 rows there are as many entries as rows;
repeated rows are coded one by one; null labels form one group; an empty table gives an empty result. Vectors must have one
length that four divides, and components so small that the largest possible distance fits a long (below 131,072 for 64
components); others raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: Parts of a vector, entries of a codebook, rounds of fitting, integer steps of a unit, bits of a cell's number.
PARTS, ENTRIES, ROUNDS, SCALE, BITS = 4, 256, 4, 1024, 4

#: Rows whose lookup tables and bounds are held at once.
ROWS = 256

#: Labels whose sums are broadcast at most (about 20 bytes each); more are joined by shuffle.
MOST_BROADCAST_LABELS = 20_000


class Approximation:
    """The VA-file of one codebook (entries x components, integers)."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, n = entries, len(entries)
        cells = 1 << bits
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * cells // max(n, 1)
        # the coordinates that a cell's entries have
        self.least, self.most = np.zeros((2, entries.shape[1], cells), np.int64)
        for d in range(entries.shape[1]):
            for c in np.unique(self.cell[:, d]):
                inside = entries[self.cell[:, d] == c, d]
                self.least[d, c], self.most[d, c] = inside.min(), inside.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each distance (entries x rows of ``parts``), from lookup tables."""
        q = parts.T[:, None, :]
        below, above = self.least[:, :, None] - q, q - self.most[:, :, None]
        near = np.maximum(np.maximum(below, above), 0) ** 2
        far = np.maximum(-below, -above) ** 2
        lower, upper = np.zeros((2, len(self.entries), len(parts)), np.int64)
        for d in range(parts.shape[1]):
            lower += near[d][self.cell[:, d]]
            upper += far[d][self.cell[:, d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry, the lowest of several, and its squared distance, for each row of ``parts``."""
        number, distance = np.zeros((2, len(parts)), np.int64)
        for at in range(0, len(parts), ROWS):
            some = parts[at : at + ROWS]
            lower, upper = self.bounds(some)
            row, entry = np.nonzero((lower <= upper.min(0)).T)
            exact = ((some[row] - self.entries[entry]) ** 2).sum(1)
            best = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(some))))
            hit = np.flatnonzero(exact == best[row])[::-1]  # backwards: the lowest entry is set last
            number[at + row[hit]] = entry[hit]
            distance[at : at + ROWS] = best
        return number, distance


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vectors have only finite components."""
    v = F.col("embedding")
    return vectors.withColumn("embedding", v.cast("array<double>")).filter(v.isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(values: np.ndarray, rows: int, width: int | None = None) -> np.ndarray:
    """``floor(SCALE * x)`` as rows of ``width`` components (None: whatever length they have)."""
    if rows == 0:
        return np.zeros((0, width or 0), np.int64)
    if width is None:
        width = len(values) // rows
    if width * rows != len(values) or width % PARTS:
        raise ValueError(f"vectors must have one length that {PARTS} divides")
    scaled = np.floor(values.astype(np.float64).reshape(rows, width) * SCALE)
    if width and float(np.abs(scaled).max()) >= (2.0**61 / width) ** 0.5:
        raise ValueError("components are too large for distances that fit a long")
    return scaled.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    import pyarrow.compute as pc

    if len(column) and not pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        raise ValueError("vectors must have one length")
    return integers(column.flatten().to_numpy(zero_copy_only=False), len(column), width)


def first_codebooks(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The vectors of the smallest vec_ids (entries x components), of ``usable`` rows."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    flat = np.array([x for r in rows for x in r[0]], np.float64)
    if len({len(r[0]) for r in rows}) > 1:
        raise ValueError("vectors must have one length")
    return integers(flat, len(rows))


def _coded(column: pa.Array, books: list[Approximation], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer rows, and numbers and distances of each part (rows x parts)."""
    x = _matrix(column, width)
    found = [b.nearest(part) for b, part in zip(books, np.hsplit(x, PARTS), strict=True)]
    return x, np.stack([n for n, _ in found], 1), np.stack([d for _, d in found], 1)


def refitted(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the componentwise floor of the mean of its parts; unused entries stay."""
    entries, width = codebooks.shape
    step = max(width // PARTS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Approximation(x) for x in np.hsplit(codebooks, PARTS)]
        total, count = np.zeros((entries, width), np.int64), np.zeros((entries, PARTS), np.int64)
        for batch in batches:
            x, number, _ = _coded(batch.column("embedding"), books, width)
            for p in range(PARTS):
                count[:, p] += np.bincount(number[:, p], minlength=entries)
                np.add.at(total[:, p * step : (p + 1) * step], number[:, p], x[:, p * step : (p + 1) * step])
        entry, at = np.nonzero(count[:, np.arange(width) // step]) if width else (np.zeros(0, int), np.zeros(0, int))
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(count[entry, at // step], pa.int64()), pa.array(total[entry, at], pa.int64())], ["entry", "at", "n", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "entry int, at int, n long, total long")
    sums = sums.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = codebooks.copy()
    for entry, at, n, total in sums.collect():  # a row for each component of the codebooks at most
        out[entry, at] = int(total) // n
    return out


def fitted(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (entries x components) of ``usable`` rows."""
    codebooks = first_codebooks(vectors, entries)
    for _ in range(rounds if len(codebooks) else 0):
        codebooks = refitted(vectors, codebooks)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position."""
    parts = np.hsplit(codebooks, PARTS) if codebooks.size else []
    return hashlib.sha256(",".join(str(x) for p in parts for x in p.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of ``usable`` rows."""
    width = codebooks.shape[1]
    kinds = {c: vectors.schema[c].dataType for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Approximation(x) for x in np.hsplit(codebooks, PARTS)]
        for batch in batches:
            _, number, distance = _coded(batch.column("embedding"), books, width)
            codes = [bytes(x).hex() for x in number.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row (columns vec_id, embedding, label)."""
    vectors = usable(vectors.select("vec_id", "embedding", "label"))
    codebooks = fitted(vectors)
    if not len(codebooks):
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = written(encoded(vectors, codebooks), "vector-codes")
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.limit(MOST_BROADCAST_LABELS + 1).count() <= MOST_BROADCAST_LABELS:
        sums = F.broadcast(sums)
    rows = rows.join(sums, rows["label"].eqNullSafe(sums["_label"]))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
