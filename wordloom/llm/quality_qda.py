"""Quality by regularised quadratic discriminant analysis over transformed statistics of whole texts.

One pass over the texts gives each document ``FEATURES`` statistics: sizes as logarithms, shares as logarithms above a small
floor, held as integers of 1/1024. Learning needs counts, sums and sums of products of the labelled rows of each class only: tasks
add up their own rows, Spark adds those up exactly, and the driver gets a number for each pair of statistics. A class's
covariance is shrunk towards the pooled one and that towards its diagonal; both shares and the scores' temperature are chosen by
logarithmic loss on a fold of the labelled rows, all candidates in one pass. Scores are differences of Mahalanobis
log-densities with the classes' Cholesky factors, worked out once.

Labels are learnt only from rows whose ``crc32(doc_id) mod 5`` isn't 0. All such rows are used: no sample is drawn.

Defined results: a null or empty text has the statistics of one without words; a document with several labels has the lowest;
null labels and ids are not learnt from; with labels of one class only, all scores are that class's share (0.5 without
labels); repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import SPACES, arrow_map, as_bytes, tune, written
from wordloom.llm.quality_sketch import SYMBOLS, repeat_words

#: Steps of a statistic's unit, and the floor above which shares have logarithms.
UNIT, FLOOR = 1024, 0.02

#: Candidate shares of the pooled covariance, of its diagonal, and temperatures.
POOLED, DIAGONAL, TEMPERATURES = (0.05, 0.2, 0.5, 0.9), (0.01, 0.1, 0.3), (1.0, 0.5, 0.2, 0.1)

THRESHOLD = 0.3

_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_STOPS, _CALLS, _BARS = b".,;:", b"!?", b"|"

FEATURES = ("words", "word_length", "length_spread", "distinct", "top_word", "again", "repeats", "dup_lines", "line_words", "symbols", "bars", "calls", "stops", "upper", "digits")


def _size(x: float) -> float:
    return math.log1p(x)


def _share(part: float, whole: float) -> float:
    return math.log(FLOOR + min(part / whole, 4.0) if whole else FLOOR)


def statistics(text: bytes | None) -> list[float]:
    """The transformed ``FEATURES`` of one text."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    count = lambda chars: size - len(text.translate(None, chars))
    lengths = np.fromiter(map(len, words), np.float64, n)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    upper, lower = count(_UPPER), count(_LOWER)
    return [
        _size(n),
        _size(lengths.mean() if n else 0),
        _size(lengths.std() if n else 0),
        math.log(len(number) + 1) / math.log(n + 2),
        _share(int(np.bincount(ids).max()) if n else 0, n),
        _share(int((ids[1:] == ids[:-1]).sum()), n),
        _share(repeat_words(words), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _size(n / max(len(lines), 1)),
        _share(count(SYMBOLS), n),
        _share(count(_BARS), n),
        _share(count(_CALLS), n),
        _share(count(_STOPS), n),
        _share(upper, upper + lower),
        _share(count(_DIGITS), n),
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics in steps of 1 / UNIT."""

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([statistics(t) for t in as_bytes(batch.column("text"))], np.float64).reshape(-1, len(FEATURES))
        flat = pa.array(np.rint(x * UNIT).astype(np.int32).ravel(), pa.int32())
        return {"doc_id": batch.column("doc_id"), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)}

    return arrow_map(docs.select("doc_id", "text"), "text", run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<int>")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.int64)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """fold (0 for choosing, 1 for learning), y and x of the labelled rows that aren't held out."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5 != 1).cast("int")
    return rows.join(usable, "doc_id").select(fold.alias("fold"), "y", "x")


def moments(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """For each (fold, y) the sum of the products of (1, x) with itself: exact integers, in whatever order rows come."""
    d = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, d, d), np.int64)
        for b in batches:
            x = np.concatenate([np.ones((b.num_rows, 1), np.int64), _rows(b)], 1)
            fold, y = (b.column(c).to_numpy() for c in ("fold", "y"))
            for f in (0, 1):
                for k in (0, 1):
                    some = x[(fold == f) & (y == k)]
                    total[f, k] += some.T @ some
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in at], pa.array(total[at], pa.int64())], ["fold", "y", "i", "j", "n"])

    found = rows.mapInArrow(run, "fold int, y int, i int, j int, n long").groupBy("fold", "y", "i", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = {(f, k): np.zeros((d, d)) for f in (0, 1) for k in (0, 1)}
    for fold, y, i, j, n in found.collect():  # four times the pairs of statistics at most
        out[fold, y][i, j] = float(n)
    return out


class Discriminant:
    """Two normal densities with shrunk covariances."""

    def __init__(self, sums: list[np.ndarray], pooled: float, diagonal: float, temperature: float = 1.0):
        n = np.array([s[0, 0] for s in sums])
        self.prior, self.temperature = float(np.log(n[1] / n[0])), temperature
        self.means = [s[0, 1:] / s[0, 0] / UNIT for s in sums]
        spread = [s[1:, 1:] / s[0, 0] / UNIT**2 - np.outer(m, m) for s, m in zip(sums, self.means, strict=True)]
        both = sum(s * k for s, k in zip(spread, n, strict=True)) / n.sum()
        # half a step of rounding: no direction is without spread
        both = (1 - diagonal) * both + diagonal * np.diag(np.diag(both)) + np.eye(len(both)) / UNIT
        self.inverse, self.size = [], []
        for s in spread:
            factor = np.linalg.cholesky((1 - pooled) * s + pooled * both)
            self.inverse.append(np.linalg.inv(factor))
            self.size.append(float(np.log(np.diag(factor)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1, of rows in steps of 1 / UNIT."""
        bad, good = (-0.5 * (((x / UNIT - m) @ inverse.T) ** 2).sum(1) - size for m, inverse, size in zip(self.means, self.inverse, self.size, strict=True))
        return self.prior + self.temperature * (good - bad)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x), -500, 500)))


def fit(rows: DataFrame) -> Discriminant | float:
    """The discriminant of ``labelled`` rows, or the share of class 1 where a class is missing."""
    sums = moments(rows)
    whole = [sums[0, k] + sums[1, k] for k in (0, 1)]
    if not (whole[0][0, 0] and whole[1][0, 0]):
        n = whole[0][0, 0] + whole[1][0, 0]
        return float(whole[1][0, 0] / n) if n else 0.5
    choices = [(p, d, t) for p in POOLED for d in DIAGONAL for t in TEMPERATURES]
    best = (0.5, 0.1, 0.5)
    if all(sums[f, k][0, 0] for f in (0, 1) for k in (0, 1)):
        tried = [Discriminant([sums[1, 0], sums[1, 1]], *c) for c in choices]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss = np.zeros(len(tried))
            for b in batches:
                x, sign = _rows(b), 1 - 2 * b.column("y").to_numpy()
                for k, t in enumerate(tried):
                    loss[k] += np.logaddexp(0, sign * t.difference(x)).sum()
            # rounded: sums of integers don't depend on the order
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried)), pa.int32()), pa.array(np.rint(np.minimum(loss, 1e12) * 1e4).astype(np.int64))], ["k", "loss"])

        losses = rows.filter("fold = 0").mapInArrow(run, "k int, loss long").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
        best = choices[min((loss, k) for k, loss in losses)[1]]
    return Discriminant(whole, *best)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Nothing but the text enters the score."""
    tune(docs.sparkSession)
    rows = written(with_statistics(docs), "quality-statistics")
    model = fit(written(labelled(rows, labels), "quality-labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, model) if isinstance(model, float) else model.scores(_rows(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
