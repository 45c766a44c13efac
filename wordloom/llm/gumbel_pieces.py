"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text's lattice has one edge for each vocabulary piece at each position (and bytes for a character that no piece has).
An edge weighs ``TEMPERATURE * -log(rank + SHIFT)``, rank being the piece's place in the vocabulary, so the sum over all
paths and each path's probability are exact. Pieces never cross a word start or a line end, so the lattice is a chain of
*units* (words), and backward sums are computed once for each distinct unit of a chunk, by numpy over all units at once.

Samples without replacement come from a best-first search over perturbed log-probabilities. A region of the space is a
prefix and a set of excluded next edges; the largest perturbed value in it is a Gumbel of the region's mass, truncated at
its parent's. Opening the best region draws its best path, which splits the rest of the region by the step at which a
path leaves that one. The first ``k`` opened paths are the ``k`` largest of all perturbed log-probabilities: a sample
without replacement. With the next value as threshold, a path's inclusion probability is known (``inclusion``), so
weighted sums over samples estimate sums over all segmentations without bias.

All random numbers are hashes of (seed, row key, place): a row's samples do not depend on its partition or batch.

Defined results: a null text gives a null result list, an empty one a single sample without pieces; fewer than ``k``
segmentations give all of them, with inclusion 1; a null row key counts as 0; repeated rows give equal samples; the ids
decode to the very text, but for the character U+2581: as the mark of a space it decodes as one.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, as_bytes, mix64, tune

#: Samples of each text, seed, sharpness and shift of the piece weights.
SAMPLES, SEED, TEMPERATURE, SHIFT = 2, 20250101, 1.0, 2.7

#: Text whose lattices are built at once.
CHUNK = 2 << 20

#: Log-weight of one byte piece, below that of any other piece.
BYTE_WEIGHT = -14.0

_U = np.uint64
_GOLD, _ALL = _U(0x9E3779B97F4A7C15), (1 << 64) - 1
SPACE, _TABLE = "▁", 20


def _mix(x: int) -> int:
    """``mix64`` of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def hashed(*parts: np.ndarray | int) -> np.ndarray | int:
    """A hash of numbers, or of arrays element by element."""
    h: np.ndarray | int = 0
    for p in parts:
        if isinstance(h, int) and isinstance(p, int):
            h = _mix(((h ^ (p & _ALL)) + int(_GOLD)) & _ALL)
        else:
            x = p.astype(np.int64, copy=False).view(np.uint64) if isinstance(p, np.ndarray) else _U(p & _ALL)
            h = mix64((x ^ (_U(h) if isinstance(h, int) else h)) + _GOLD)
    return h


def unit_interval(h: np.ndarray | int) -> np.ndarray | float:
    if isinstance(h, int):
        return ((h >> 11) + 0.5) * 2.0**-53
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniforms(*parts: np.ndarray | int) -> np.ndarray | float:
    """Numbers in (0, 1), hashes of the parts."""
    return unit_interval(hashed(*parts))


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(u: np.ndarray, at: np.ndarray, most: float) -> np.ndarray:
    """Gumbels with location ``at``, given that they are at most ``most``."""
    # -log(exp(-most) - log(u) * exp(-at)), without overflow
    return -np.logaddexp(-most, np.log(-np.log(u)) - at)


class Vocabulary:
    """Pieces of a SentencePiece model by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        assert not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.piece.values()), "pieces that cross words aren't supported"
        # the order of merging stands for frequency; pieces without one (runs of spaces) come last
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.longest = max(map(len, self.piece.values()))
        chars = [np.frombuffer(self.piece[i].encode("utf-32-le"), np.uint32) for i in order]
        keys = _prefix_hashes(chars)
        whole = np.array([x[-1] for x in keys], np.uint64)
        at = np.argsort(whole)
        assert len(np.unique(whole)) == len(whole)
        self.keys, self.ids = whole[at], np.array(order, np.int32)[at]
        self.weights = (-TEMPERATURE * np.log(np.arange(len(order)) + SHIFT))[at]
        self.begun = _bits(np.concatenate(keys))
        # where the keys of each first bits stand
        self.bucket = np.searchsorted(self.keys >> _U(64 - _TABLE), np.arange((1 << _TABLE) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these hashes those of pieces: their places, ids and log-weights."""
        first = (keys >> _U(64 - _TABLE)).astype(np.int64)
        at, end = self.bucket[first], self.bucket[first + 1]
        on = np.flatnonzero(at < end)
        at, end = at[on], end[on]
        places, found = [], []
        while len(on):
            hit = self.keys[at] == keys[on]
            places.append(on[hit]), found.append(at[hit])
            more = np.flatnonzero(~hit & (at + 1 < end))
            on, at, end = on[more], at[more] + 1, end[more]
        if len(places) == 1:
            place, at = places[0], found[0]
        else:
            place, at = np.concatenate([*places, on]), np.concatenate([*found, at])
            order = np.argsort(place, kind="stable")
            place, at = place[order], at[order]
        return place, self.ids[at], self.weights[at]


def _bits(keys: np.ndarray) -> np.ndarray:
    """A table of the first bits of hashes, to rule most others out. It fits a processor's cache."""
    out = np.zeros(1 << _TABLE, bool)
    out[keys >> _U(64 - _TABLE)] = True
    return out


def _longer(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of strings that end in one character more."""
    return mix64(h * _U(31) + chars + _GOLD)


def _prefix_hashes(words: list[np.ndarray]) -> list[np.ndarray]:
    out: list[list] = [[] for _ in words]
    h = np.zeros(len(words), np.uint64)
    sizes = np.array([len(w) for w in words])
    for k in range(int(sizes.max())):
        at = np.flatnonzero(sizes > k)
        h[at] = _longer(h[at], np.array([words[i][k] for i in at], np.uint64))
        for i in at:
            out[i].append(h[i])
    return [np.array(x, np.uint64) for x in out]


class Lattices:
    """Edges and backward sums of distinct units.

    Unit ``w`` has positions ``start[w]`` to ``start[w + 1] - 1``, its end. The edges of a position stand in a row from
    ``first[position]`` on, ``many[position]`` of them. Edge ``e`` has the position ``at[e]``, the length ``size[e]``,
    the piece ``ids[e]`` (negative: a character in bytes) and the probability ``prob[e]`` that a path at its position
    goes on with it.
    """

    def __init__(self, units: list[str] | pa.StringArray, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        units = pa.array(units, pa.string())
        sizes = pc.utf8_length(units).to_numpy().astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)))
        n = int(self.start[-1])
        chars = np.zeros(n, np.uint64)
        inside = np.ones(n, bool)
        inside[self.start[1:] - 1] = False
        chars[inside] = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(units)], units), "")[0].as_py().encode("utf-32-le"), np.uint32)
        self.chars = chars
        left = np.repeat(self.start[1:] - 1, sizes + 1) - np.arange(n)
        at, h = np.flatnonzero(inside), np.zeros(int(inside.sum()), np.uint64)
        pos, size, ids, weight = [], [], [], []
        lone = inside.copy()
        for k in range(vocabulary.longest):
            h = _longer(h, chars[at + k])
            found, i, w = vocabulary.find(h)
            pos.append(at[found]), size.append(np.full(len(found), k + 1)), ids.append(i), weight.append(w)
            if k == 0:
                lone[at[found]] = False
            on = np.flatnonzero(vocabulary.begun[h >> _U(64 - _TABLE)] & (left[at] > k + 1))
            at, h = at[on], h[on]
        # a character without a piece of its own goes as bytes
        at = np.flatnonzero(lone)
        c = chars[at]
        width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        pos.append(at), size.append(np.ones(len(at), np.int64)), weight.append(BYTE_WEIGHT * width)
        ids.append(np.where(c <= 0x7F, vocabulary.byte[np.minimum(c, 0x7F).astype(np.int64)], -1).astype(np.int32))
        # a position's edges stay together, longer (and mostly likelier) ones first; positions near their unit's end come first
        order = np.argsort(left.astype(np.uint16) if n == 0 or left.max() < 1 << 16 else left, kind="stable")
        self.many = np.bincount(np.concatenate(pos), minlength=n).astype(np.int32)
        ends = np.cumsum(self.many[order], dtype=np.int32)
        self.first = np.empty(n, np.int32)
        self.first[order] = ends - self.many[order]
        slot, edges = self.first.copy(), int(ends[-1]) if n else 0
        self.at, self.size, self.ids, weight_of = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for k in (*range(len(pos) - 2, -1, -1), len(pos) - 1):
            to = slot[pos[k]]
            self.at[to], self.size[to], self.ids[to], weight_of[to] = pos[k], size[k], ids[k], weight[k]
            slot[pos[k]] += 1
        weight = weight_of
        heads = self.first[order[self.many[order] > 0]]
        back = np.zeros(n)
        self.prob = np.zeros(len(self.at))
        distance = left[self.at[heads]]
        bounds = np.searchsorted(distance, np.arange(1, int(sizes.max(initial=0)) + 2))
        for k in range(len(bounds) - 1):  # all positions that are k + 1 characters before their unit's end
            rows = heads[bounds[k] : bounds[k + 1]]
            if len(rows):
                a, b = rows[0], rows[-1] + self.many[self.at[rows[-1]]]
                x = weight[a:b] + back[self.at[a:b] + self.size[a:b]]
                many = self.many[self.at[rows]]
                top = np.maximum.reduceat(x, rows - a)
                e = np.exp(x - np.repeat(top, many))
                s = np.add.reduceat(e, rows - a)
                back[self.at[rows]] = top + np.log(s)
                self.prob[a:b] = e / np.repeat(s, many)
        self.log = np.log(self.prob)
        self.total = back[self.start[:-1]]

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each position a drawn edge: the first whose probability the rest of ``u`` is within."""
        edge = self.first[at]
        last = edge + self.many[at] - 1
        u = u - self.prob[edge]
        on = np.flatnonzero((u >= 0) & (edge < last))
        left = u[on]
        while len(on):
            edge[on] += 1
            left -= self.prob[edge[on]]
            stay = (left >= 0) & (edge[on] < last[on])
            on, left = on[stay], left[stay]
        return edge


def units_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct units of texts, the number of each unit in the texts, in order, and how many each text has.

    Units are words with the space marks before them; line ends stand alone. A text's units are the marked text.
    """
    data = [(" " + t.replace(SPACE, " ")).encode() for t in texts]
    b = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum([0, *map(len, data)])
    space, line = b == 32, b == 10
    start = line.copy()
    start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    start[begin[:-1]] = True
    at = np.flatnonzero(start)
    units = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(b)).astype(np.int32)), pa.py_buffer(b)]).dictionary_encode()
    return pc.replace_substring(units.dictionary, " ", SPACE), units.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(at, begin))


class Path(NamedTuple):
    """A drawn segmentation: its edges, and the number of each edge's unit in the text."""

    edges: np.ndarray
    unit: np.ndarray


def free_paths(lattices: Lattices, unit: np.ndarray, place: np.ndarray, key: np.ndarray) -> Path:
    """A free draw for every unit of several texts, in order. ``place`` is a unit's number in its text, ``key`` a hash of the text's key and the sample."""
    rows = np.arange(len(unit))
    base = mix64(key + place.astype(np.uint64) * _GOLD)
    at, end = lattices.start[unit], lattices.start[unit + 1] - 1
    out_rows, out = [], []
    step = 0
    while len(rows):
        edge = lattices.draw(at, unit_interval(mix64(base + _U(step * int(_GOLD) & _ALL))))
        out_rows.append(rows)
        out.append(edge)
        at = at + lattices.size[edge]
        on = np.flatnonzero(at < end)
        rows, at, end, base = rows[on], at[on], end[on], base[on]
        step += 1
    steps = np.zeros(len(unit) + 1, np.int64)
    for r in out_rows:
        steps[r + 1] += 1
    start = np.cumsum(steps)
    edges = np.zeros(int(start[-1]), np.int32)
    for k, (r, edge) in enumerate(zip(out_rows, out, strict=True)):
        edges[start[r] + k] = edge
    return Path(edges, np.repeat(np.arange(len(unit)), steps[1:]))


#: Regions whose mass is smaller by this factor's exponent than the largest can't be told from none in 64-bit numbers.
DEEPEST = 80.0


def search(lattices: Lattices, units: np.ndarray, free: list[Path], k: int, key: int, seed: int) -> list[tuple[Path, float, float, float]]:
    """The ``k`` best paths: (path, log-probability, perturbed log-probability, threshold: the next perturbed value)."""
    first = float(gumbel(uniforms(seed, key, -1)))  # the log-sum of all probabilities is 0
    #: Regions: perturbed maximum, path that they leave, step at which they do, edges excluded there.
    queue: list[tuple[float, Path | None, int, tuple[int, ...]]] = [(first, None, 0, ())]
    done: list[tuple[Path, float, float]] = []
    while queue and len(done) < k:
        queue.sort(key=lambda x: x[0])
        value, parent, step, excluded = queue.pop()
        number = len(done)
        path = free[number] if parent is None else _resumed(lattices, units, parent, step, excluded, free[number], key, number, seed)
        logs = lattices.log[path.edges]
        done.append((path, float(logs.sum()), value))
        prefix = np.cumsum(logs)
        reach = min(len(logs), int(np.searchsorted(-prefix, DEEPEST)) + 1)
        near = path.edges[:reach]
        prefix = np.concatenate(([0.0], prefix[: reach - 1]))
        # what is left beside the path at each step from the leaving one on (the steps before are other regions)
        rest, many = 1 - lattices.prob[near], lattices.many[lattices.at[near]]
        if parent is not None and step < reach:
            rest[step] -= lattices.prob[list(excluded)].sum()
            many[step] -= len(excluded)
        live = np.flatnonzero((many > 1) & (rest > 0))
        live = live[live >= step] if parent is not None else live
        if len(live):
            g = truncated(uniforms(seed, key, -2, number, live), prefix[live] + np.log(rest[live]), value)
            best = k + 1 - len(done)
            for i in (np.argpartition(-g, best)[:best] if best < len(g) else np.arange(len(g))).tolist():
                at = int(live[i])
                queue.append((float(g[i]), path, at, (*(excluded if parent is not None and at == step else ()), int(near[at]))))
    threshold = max((x[0] for x in queue), default=-np.inf)
    return [(p, a, b, threshold) for p, a, b in done]


def _resumed(lattices: Lattices, units: np.ndarray, parent: Path, step: int, excluded: tuple[int, ...], free: Path, key: int, number: int, seed: int) -> Path:
    """``parent`` up to ``step``, there another edge than those excluded, the rest of the unit anew, then ``free``."""
    unit = int(parent.unit[step])
    at, end = int(lattices.at[parent.edges[step]]), int(lattices.start[units[unit] + 1]) - 1
    own: list[int] = []
    while at < end:
        first = int(lattices.first[at])
        p = lattices.prob[first : first + int(lattices.many[at])].copy()
        if not own:
            p[np.array(excluded) - first] = 0
        c = np.cumsum(p)
        n = int(np.searchsorted(c, uniforms(seed, key, -3, number, len(own)) * c[-1]))
        own.append(first + n)
        at += int(lattices.size[first + n])
    later = int(np.searchsorted(free.unit, unit, "right"))
    return Path(np.concatenate((parent.edges[:step], own, free.edges[later:])), np.concatenate((parent.unit[:step], [unit] * len(own), free.unit[later:])))


def ids_of(lattices: Lattices, path: Path) -> np.ndarray:
    """Vocabulary ids of a path's pieces."""
    ids = lattices.ids[path.edges]
    if (ids < 0).any():  # characters of several bytes
        parts, at = [], 0
        for i in np.flatnonzero(ids < 0).tolist():
            parts += [ids[at:i], lattices.vocabulary.byte[list(chr(int(lattices.chars[lattices.at[path.edges[i]]])).encode())]]
            at = i + 1
        return np.concatenate([*parts, ids[at:]]).astype(np.int32)
    return ids


def sample_texts(texts: list[str | None], keys: list[int | None], vocabulary: Vocabulary, k: int = SAMPLES, seed: int = SEED) -> list[list[dict] | None]:
    """Of each text its samples: ids, log_prob, perturbed and inclusion, best perturbed first."""
    filled = [i for i, t in enumerate(texts) if t]
    distinct, unit, many = units_of([texts[i] for i in filled]) if filled else (["x"], np.zeros(0, np.int64), [])
    sizes = np.zeros(len(texts), np.int64)
    sizes[filled] = many
    lattices = Lattices(distinct, vocabulary)
    key = np.array([0 if x is None else x for x in keys], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(len(unit)) - np.repeat(first[:-1], sizes)
    drawn = [free_paths(lattices, unit, place, np.repeat(np.array([hashed(seed, x, j) for x in key.tolist()], np.uint64), sizes)) for j in range(k)]
    ends = [np.searchsorted(x.unit, first) for x in drawn]
    out: list[list[dict] | None] = []
    for i, t in enumerate(texts):
        if not t:
            out.append(None if t is None else [{"ids": np.zeros(0, np.int32), "log_prob": 0.0, "perturbed": float(gumbel(uniforms(seed, int(key[i]), -1))), "inclusion": 1.0}])
            continue
        free = [Path(x.edges[e[i] : e[i + 1]], x.unit[e[i] : e[i + 1]] - first[i]) for x, e in zip(drawn, ends, strict=True)]
        found = search(lattices, unit[first[i] : first[i + 1]], free, k, int(key[i]), seed)
        # chance that a Gumbel of this log-probability passes the threshold
        out.append([{"ids": ids_of(lattices, p), "log_prob": a, "perturbed": b, "inclusion": float(-np.expm1(-np.exp(min(a - z, 700.0))))} for p, a, b, z in found])
    return out


def decoded(ids: list[np.ndarray], vocabulary: Vocabulary) -> list[bytes]:
    """The texts, in UTF-8, of lists of pieces: space marks become spaces, byte pieces bytes, the mark put before goes."""
    if not hasattr(vocabulary, "utf8"):
        pieces = {i: p.replace(SPACE, " ").encode() for i, p in vocabulary.piece.items()} | {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte)}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        size = np.fromiter(map(len, table), np.int32, len(table))
        vocabulary.utf8 = np.frombuffer(b"".join(table), np.uint8), np.cumsum(size, dtype=np.int32) - size, size
    flat, first, size = vocabulary.utf8
    every = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    many = size[every]
    end = np.cumsum(many, dtype=np.int64)
    take = np.repeat(first[every] - (end - many).astype(np.int32), many)
    take += np.arange(len(take), dtype=np.int32)
    data = flat[take].tobytes()
    bounds = np.concatenate(([0], end))[np.cumsum([0, *map(len, ids)])].tolist()
    return [data[a + 1 : z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of pieces."""
    return decoded([ids], vocabulary)[0].decode("utf-8", "replace")


SAMPLE = "struct<sample_rank:int,ids:array<int>,log_prob:double,perturbed:double,inclusion:double>"


def sample_pieces(docs: DataFrame, model_path: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, any others) and ``samples``, an array of ``SAMPLE``."""
    tune(docs.sparkSession)
    docs = docs.drop("samples")

    def run(batch: pa.RecordBatch, vocabulary: Vocabulary) -> dict:
        found = sample_texts(batch.column("_text").to_pylist(), batch.column("_key").to_pylist(), vocabulary, k, seed)
        rows = [None if s is None else [{"sample_rank": n, "ids": x["ids"].astype(np.int32), **{c: x[c] for c in ("log_prob", "perturbed", "inclusion")}} for n, x in enumerate(s)] for s in found]
        return {"_row": batch.column("_row"), "samples": rows}

    packed = docs.select(F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("_key"), F.struct(*docs.columns).alias("_row"))
    out = arrow_map(packed, "_text", run, f"_row {packed.schema['_row'].dataType.simpleString()}, samples array<{SAMPLE}>", lambda: Vocabulary(model_path), CHUNK)
    return out.select("_row.*", "samples")


def decode_pieces(rows: DataFrame, model_path: str, column: str = "ids") -> DataFrame:
    """``rows`` and ``decoded``, the text of the ids in ``column``."""
    tune(rows.sparkSession)
    packed = rows.select(F.col(column).alias("_ids"), F.struct(*[c for c in rows.columns if c != "decoded"]).alias("_row"))

    def run(batches):
        vocabulary = Vocabulary(model_path)
        for b in batches:
            texts = [None if x is None else decode(np.asarray(x, np.int64), vocabulary) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string())], ["_row", "decoded"])

    return packed.mapInArrow(run, f"_row {packed.schema['_row'].dataType.simpleString()}, decoded string").select("_row.*", "decoded")


def sample_digests(docs: DataFrame, model_path: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """A row of each sample: doc_id, sample_rank, n_pieces, ids_crc32 (ids as little-endian 32-bit integers), log_prob,
    perturbed, inclusion, and the SHA-256 of the decoded text beside whether it is the input. Null texts give one row of
    nulls, so that every document is there."""
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch, vocabulary: Vocabulary) -> dict:
        found = sample_texts(batch.column("text").to_pylist(), batch.column("_key").to_pylist(), vocabulary, k, seed)
        samples = [(i, n, x) for i, s in enumerate(found) for n, x in enumerate(s or [None])]
        there = [x["ids"] for *_, x in samples if x is not None]
        data, whole = iter(decoded(there, vocabulary)), as_bytes(batch.column("text"))
        out: dict[str, list] = {c: [] for c in ("sample_rank", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded_sha256", "round_trip")}
        for i, n, x in samples:
            if x is None:
                values: tuple = (None,) * len(out)
            else:
                text = next(data)
                values = (n, len(x["ids"]), zlib.crc32(x["ids"].astype("<u4", copy=False)), x["log_prob"], x["perturbed"], x["inclusion"], hashlib.sha256(text).hexdigest(), text == whole[i])
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id").take(pa.array([i for i, *_ in samples], pa.int64()))} | out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("_key"))
    return arrow_map(rows, "text", run, f"doc_id {kind}, sample_rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_sha256 string, round_trip boolean", lambda: Vocabulary(model_path), CHUNK)
