"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

Texts, with ASCII letters in lower case and white space as single spaces, give the set of their hashed character n-grams.
For the labelled sample, each n-gram's ratio of smoothed frequencies in toxic and clean texts is its scale; a logistic
model with a quadratic penalty is fitted on the scaled presences of the most telling n-grams. Scoring is one pass over
whole texts; the only thing broadcast is a table of ``1 << BITS`` weights.

Labels are learnt only from rows whose ``crc32(doc_id) mod 4`` isn't 2 (the others are held out), from at most about
``MOST_ROWS`` of them, chosen by hash: that bound covers counts and fit; scoring has none.

Defined results: a null or empty text scores as one without any n-gram; a document with several labels is toxic if one of
them is; null labels and ids are not learnt from; with labels of one class only, all scores are that class's share (0.5
without labels); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, as_bytes, chunks, tune

#: Labelled rows to learn from, n-gram sizes in bytes, bits of their hashes.
MOST_ROWS, SIZES, BITS = 12_000, (4, 6, 8), 20

#: Texts that an n-gram must be in, n-grams in the model, smoothing, penalty, steps of the fit.
LEAST_TEXTS, MOST_FEATURES, SMOOTHING, PENALTY, STEPS = 5, 20_000, 1.0, 0.002, 300

THRESHOLD = 0.3

_PLAIN = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_PAD = b"\x00" * max(SIZES)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first byte of each text in the joined bytes, and for each n-gram size the hash at every byte."""
    plain = [_PAD + b" ".join((t or b"").translate(_PLAIN).split()) for t in texts]
    starts = np.cumsum([0, *map(len, plain)])[:-1]
    data = np.frombuffer(b"".join([*plain, _PAD]), np.uint8).astype(np.uint32)
    n = len(data) - len(_PAD)
    h = np.zeros(n, np.uint32)
    out = []
    for k in range(max(SIZES)):
        h *= np.uint32(0x01000193)
        h ^= data[k : n + k]
        if k + 1 in SIZES:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k)
            out.append(x >> np.uint32(32 - BITS))
    return starts, out


def present(texts: list[bytes | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, hash), each once, of the hashes marked in ``wanted``."""
    starts, hashes = ngrams(texts)
    pairs = []
    for h in hashes:
        at = np.flatnonzero(wanted[h])
        pairs.append((np.searchsorted(starts, at, "right") - 1 << BITS) | h[at])
    both = np.unique(np.concatenate(pairs))
    return both >> BITS, both & ((1 << BITS) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """text and toxic of a bounded sample, by hash, of labelled rows that aren't held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most_rows / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of each class, and in how many of either each n-gram is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, (1 << BITS) + 1), np.int64)
        every = np.ones(1 << BITS, bool)
        for b in batches:
            for part in chunks(b, "text"):
                toxic = np.array(part.column("toxic").to_pylist()) > 0
                text, h = present(as_bytes(part.column("text")), every)
                for k in (0, 1):
                    count[k, :-1] += np.bincount(h[toxic[text] == k], minlength=1 << BITS)
                    count[k, -1] += (toxic == k).sum()
        at = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], ["h", "clean", "toxic"])

    found = rows.mapInArrow(run, "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    count = np.zeros((2, (1 << BITS) + 1), np.int64)
    count[:, found["h"].to_numpy()] = found["clean"].to_numpy(), found["toxic"].to_numpy()
    return count[:, -1], count[0, :-1], count[1, :-1]


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each n-gram hash, and the intercept. ``rows``: text, toxic, as many as ``training_rows`` gives."""
    texts, clean, toxic = _counts(rows)
    weights = np.zeros(1 << BITS, np.float32)
    if not texts.all():
        share = (texts[1] + 0.0) / texts.sum() if texts.any() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return weights, float(np.log(share / (1 - share)))
    p, q = toxic + SMOOTHING, clean + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    rank = np.abs(ratio) * np.sqrt(clean + toxic) * (clean + toxic >= LEAST_TEXTS)
    chosen = np.sort(np.argsort(-rank, kind="stable")[:MOST_FEATURES])
    chosen = chosen[rank[chosen] > 0]
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True

    def run(batch: pa.RecordBatch) -> dict:
        text, h = present(as_bytes(batch.column("text")), wanted)
        cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
        return {"toxic": [int(x > 0) for x in batch.column("toxic").to_pylist()], "hashes": [h[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]}

    sample = arrow_map(rows, "text", run, "toxic int, hashes binary").collect()  # bounded: MOST_ROWS and chosen n-grams
    y = np.array([r[0] for r in sample], float)
    cols = [np.searchsorted(chosen, np.frombuffer(r[1], np.uint32)) for r in sample]
    row, col = np.repeat(np.arange(len(y)), list(map(len, cols))), np.concatenate(cols)
    x = ratio[chosen][col]
    w, b, velocity, slope = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    scale = np.bincount(col, x * x, len(chosen)) / len(y) + PENALTY  # diagonal of the curvature, for even steps
    size = max(1.0, float(np.bincount(row, minlength=len(y)).mean()) ** 0.5)
    for _ in range(STEPS):
        z = b + np.bincount(row, w[col] * x, len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        velocity = 0.9 * velocity - (np.bincount(col, error[row] * x, len(chosen)) + PENALTY * w) / (scale * size)
        slope = 0.9 * slope - error.sum() / 0.25 / size
        w, b = w + velocity, b + slope
    weights[chosen] = w * ratio[chosen]
    return weights, float(b)


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Nothing but the text enters the score."""
    tune(docs.sparkSession)
    weights, b = fit(training_rows(docs, labels, most_rows))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch, wanted: np.ndarray) -> dict:
        text, h = present(as_bytes(batch.column("text")), wanted)
        z = b + np.bincount(text, sent.value[h], batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = arrow_map(docs.select("doc_id", "text"), "text", run, f"doc_id {kind}, score double", lambda: sent.value != 0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
