"""Document quality from a linear-chain conditional random field over lines.

Every line gets statistics of its bytes and words. They are cut into bins, and the bins of a
line and of its two neighbours are the features of its state, good or bad; two more weights
score each pair of adjacent states. Forward and backward passes give the probability that a line is
good; their mean over the lines, weighted by bytes and calibrated, is the score of the document.

Labels exist for documents only, so training takes each line to be as its document is. It uses
``SAMPLE`` labelled documents at most, of ``SAMPLE_BYTES`` at most each, picked by a hash of the key:
the bound of what reaches the driver. Scoring reads whole texts of any length.

Empty lines don't count. Texts without lines (null and empty ones too) get the share of good
documents in the sample; without any labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import flat, mixed, steps
from factloom.llm.words import SOLID, Words

SAMPLE = 4000
SAMPLE_BYTES = 1 << 16

BINS = 8
#: Statistics whose bins are features of the neighbouring lines too.
_NEAR = ("log_words", "upper", "symbols", "bars", "marks", "doubled", "distinct")
_OWN = ("log_bytes", *_NEAR, "digits", "stops", "wide", "word_bytes", "repeated")
WIDTH = len(_OWN) + 2 * len(_NEAR)

_ROUNDS, _RATE, _DECAY = 200, 0.2, 3e-6


def _class(letters: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(letters)] = 1
    return out


_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_BYTES = {"digits": _class(b"0123456789"), "symbols": _class(b"#$%&*+/<=>@\\^_`{}~[]()"), "bars": _class(b"|"),
          "marks": _class(b"!?"), "stops": _class(b".,;:"), "wide": _class(bytes(range(128, 256)))}


@dataclass
class Lines:
    """Non-empty lines of some texts: statistics, bytes, and the first line of each text."""

    stats: np.ndarray
    size: np.ndarray
    by_text: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """The lines of UTF-8 texts, cut at line feeds."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))
    ends = stops - (data[stops - 1] == 10) if len(starts) else stops
    words = Words(data, np.append(starts, len(data)), SOLID) if len(starts) else None
    if words is None:
        return Lines(np.zeros((0, len(_OWN)), np.float32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    size, count = (ends - starts).astype(np.float64), np.diff(words.by_text)
    keep = count > 0
    safe = np.maximum(size, 1)

    def total(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[data], starts)

    upper, lower = total(_UPPER), total(_LOWER)
    stat = {name: total(table) / safe for name, table in _BYTES.items()}
    stat["upper"] = upper / np.maximum(upper + lower, 1)
    stat["log_bytes"], stat["log_words"] = np.log2(safe), np.log2(np.maximum(count, 1))
    stat["word_bytes"] = size / np.maximum(count, 1)
    line = np.repeat(np.arange(len(starts)), count)
    again = np.append(False, (words.hashes[1:] == words.hashes[:-1]) & (line[1:] == line[:-1])) if len(line) else np.zeros(0, bool)
    stat["doubled"] = np.bincount(line[again], minlength=len(starts)) / np.maximum(count - 1, 1)
    order = np.lexsort((words.hashes, line))
    new = np.append(True, (words.hashes[order][1:] != words.hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))[: len(order)]
    stat["distinct"] = np.bincount(line[order][new], minlength=len(starts)) / np.maximum(count, 1)
    text = np.searchsorted(offsets, starts, "right") - 1
    whole = np.zeros(len(starts), np.uint64)
    if len(line):
        place = np.arange(len(line)) - words.by_text[:-1][line]
        np.add.at(whole, line, mixed(words.hashes + place.astype(np.uint64)))
    order = np.lexsort((whole, text))
    same = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated = np.zeros(len(starts), bool)
    repeated[order] = np.append(False, same) | np.append(same, False)
    stat["repeated"] = repeated
    stats = np.stack([stat[name] for name in _OWN], 1).astype(np.float32)[keep]
    return Lines(stats, size[keep].astype(np.int64), np.searchsorted(text[keep], np.arange(len(offsets))))


def features(lines: Lines, edges: np.ndarray) -> np.ndarray:
    """One weight index for each line and statistic: the line's own bins, then its neighbours'.

    ``edges``: bin borders of each statistic. The bin after the last means that there is no such line.
    """
    bins = np.stack([np.searchsorted(edges[k], lines.stats[:, k]) for k in range(len(_OWN))], 1)
    near = bins[:, [_OWN.index(name) for name in _NEAR]]
    before, after = np.full_like(near, BINS), np.full_like(near, BINS)
    if len(near) > 1:
        text = np.searchsorted(lines.by_text, np.arange(len(near)), "right")
        joined = (text[1:] == text[:-1])[:, None]
        before[1:] = np.where(joined, near[:-1], BINS)
        after[:-1] = np.where(joined, near[1:], BINS)
    return np.concatenate([bins, before, after], 1) + np.arange(WIDTH) * (BINS + 1)


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray  # of the good state, by feature
    bias: float
    moves: np.ndarray  # 2 x 2: score of a state after another
    slope: float
    shift: float
    prior: float


def _chains(by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with lines, longest first; their first lines and lengths."""
    lengths = np.diff(by_text)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    return order, by_text[:-1][order], lengths[order]


def marginals(score: np.ndarray, by_text: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, expected moves) by forward-backward.

    All texts go through it side by side, the longest first, so that step t works on those
    with more than t lines.
    """
    n = len(score)
    own = np.stack([np.zeros(n), score], 1)
    own -= own.max(1, keepdims=True)
    own, step = np.exp(own), np.exp(moves - moves.max())
    forward, backward, out = np.zeros((n, 2)), np.ones((n, 2)), np.zeros((2, 2))
    _, first, lengths = _chains(by_text)
    if not n:
        return np.zeros(0), out
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    a = own[first]
    forward[first] = a / a.sum(1, keepdims=True)
    for t in range(1, int(lengths[0])):
        at = first[: active[t]] + t
        a = (forward[at - 1] @ step) * own[at]
        forward[at] = a / a.sum(1, keepdims=True)
    for t in range(int(lengths[0]) - 1, 0, -1):
        at = first[: active[t]] + t
        b = (own[at] * backward[at]) @ step.T
        pair = forward[at - 1][:, :, None] * step * (own[at] * backward[at])[:, None, :]
        out += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        backward[at - 1] = b / b.sum(1, keepdims=True)
    good = forward * backward
    return good[:, 1] / good.sum(1), out


def _raw(lines: Lines, model: Model) -> np.ndarray:
    """Mean probability of good lines by bytes, as log-odds; NaN for texts without lines."""
    score = model.weights[features(lines, model.edges)].sum(1) + model.bias
    good, _ = marginals(score, lines.by_text, model.moves)
    size = np.append(0, np.cumsum(lines.size))
    mean = np.append(0, np.cumsum(good * lines.size))
    with np.errstate(invalid="ignore"):
        mean = np.diff(mean[lines.by_text]) / np.diff(size[lines.by_text])
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(lines: Lines, good: np.ndarray) -> Model:
    """Train on texts whose lines all are as ``good`` says of their text."""
    has = np.diff(lines.by_text) > 0
    if not has.any():
        prior = float(good.mean()) if len(good) else 0.5
        return Model(np.zeros((len(_OWN), BINS - 1)), np.zeros(WIDTH * (BINS + 1)), 0.0, np.zeros((2, 2)), 1.0, 0.0, prior)
    edges = []
    for k in range(len(_OWN)):  # equal shares of the values that aren't the least one
        values = lines.stats[:, k]
        rest = values[values > values.min()]
        inner = np.quantile(rest, np.linspace(0, 1, BINS - 1)[:-1]) if len(rest) else np.zeros(BINS - 2)
        edges.append(np.sort(np.append(values.min(), inner)))
    edges = np.array(edges)
    feature = features(lines, edges)
    state = np.repeat(good.astype(np.int64), np.diff(lines.by_text))
    joined = np.append(False, np.searchsorted(lines.by_text, np.arange(1, len(state)), "right") == np.searchsorted(lines.by_text, np.arange(len(state) - 1), "right"))
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[joined.nonzero()[0] - 1], state[joined]), 1)
    weights, bias, moves = np.zeros(WIDTH * (BINS + 1)), 0.0, np.zeros((2, 2))
    place = np.zeros(len(weights) + 5)
    first, second = np.zeros_like(place), np.zeros_like(place)
    for r in range(1, _ROUNDS + 1):  # Adam on the mean log-likelihood
        p, expected = marginals(weights[feature].sum(1) + bias, lines.by_text, moves)
        miss = (state - p) / len(state)
        slope = np.concatenate([np.bincount(feature.ravel(), np.repeat(miss, WIDTH), minlength=len(weights)), [miss.sum()], ((seen - expected) / len(state)).ravel()])
        slope -= _DECAY * place
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        place = place + _RATE * first / (1 - 0.9**r) / (np.sqrt(second / (1 - 0.999**r)) + 1e-8)
        weights, bias, moves = place[: len(weights)], place[len(weights)], place[-4:].reshape(2, 2)
    model = Model(edges, weights, float(bias), moves, 1.0, 0.0, float(good.mean()))
    # calibration: a logistic fit of the labels to the log-odds
    x, y, w = _raw(lines, model)[has], good[has].astype(float), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        v = p * (1 - p) + 1e-6
        hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        w = w + np.linalg.solve(hess, np.array([((y - p) * x).sum() - (w[0] - 1), (y - p).sum() - w[1]]))
    model.slope, model.shift = (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)
    return model


def scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Score of each text, between 0 and 1."""
    raw = _raw(lines_of(data, offsets), model)
    return np.where(np.isnan(raw), model.prior, 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30))))


def train(df: DataFrame, key: str, text: str, labels: DataFrame, label: str, sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` rows of ``df`` at most that have a label (0 or 1) under their key.

    Labels that are null, or whose key is, count as missing. Of several labels for a key the
    commoner one counts, 1 in a tie.
    """
    known = labels.filter(f"`{key}` IS NOT NULL AND `{label}` IS NOT NULL").groupBy(F.col(key).alias("key"))
    known = known.agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("good"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(sample)  # bounded, so it may be broadcast
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    picked = texts.join(F.broadcast(known), "key").orderBy(F.xxhash64("key"), "key", F.xxhash64("text")).limit(sample)
    width = len(_OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                offsets, data = flat(part.column("text"))
                lines = lines_of(data, offsets)
                cuts = [slice(a, b) for a, b in zip(lines.by_text, lines.by_text[1:])]
                yield pa.RecordBatch.from_arrays([part.column("good"), pa.array([lines.stats[c].tobytes() for c in cuts], pa.binary()),
                                                  pa.array([lines.size[c].tobytes() for c in cuts], pa.binary())], names=["good", "stats", "size"])

    rows = picked.select("good", "text").mapInArrow(run, "good boolean, stats binary, size binary").collect()
    stats = np.frombuffer(b"".join(r.stats for r in rows), np.float32).reshape(-1, width)
    size = np.frombuffer(b"".join(r["size"] for r in rows), np.int64)
    by_text = np.append(0, np.cumsum([len(r["size"]) // 8 for r in rows])).astype(np.int64)
    return fit(Lines(stats, size, by_text), np.array([r.good for r in rows], bool))


def scored(df: DataFrame, text: str, model: Model, score: str = "score", keep_text: bool = False) -> DataFrame:
    """``df`` with a column ``score``; its other columns (the text if wanted) and its rows stay."""
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name != score and (keep_text or f.name != text)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                offsets, data = flat(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores(data, offsets, model))], names=[*names, score])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(score, T.DoubleType())]))
