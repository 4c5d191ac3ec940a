"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word shape and
repetition of the line itself and of the lines before and after it. Forward-backward gives each
line's marginal; the length-weighted mean of the marginals is the document's quality, which a
logistic curve fitted on other labelled rows turns into a probability.

Fitting uses all lines of at most ``SAMPLE`` labelled rows (those of least hash), and of fewer rows
where they would hold more than ``FIT_LINES`` lines together; scoring reads whole texts of all rows and is narrow. A line without
characters has features of zero; an empty or null text is one such line and gets a score. Rows
labelled twice count twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, lengths, packed, stored, texts
from .shingles import prefix_hashes, span_hashes

#: Bytes of text whose lines get features together; they take some forty times as much.
BATCH = 512 << 10
SAMPLE = 4_000
FIT_LINES = 1_600_000
MIN_SCORE = 0.3

_CLASSES = {  # characters counted for a line's features
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "stop": b".,;:?'\"()-",
    "shout": b"!", "bar": b"|", "sign": b"#$%&*@+=<>/\\_~^`[]{}", "high": bytes(range(0xC0, 0x100)),
}
N_FEATURES = len(_CLASSES) + 12


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length of every line, and the index of each text's first line (and the end)."""
    raw, bounds = packed(column)
    n_texts = len(column)
    # every text gets a line break of its own at its end, so each has at least one line
    whole = np.insert(raw, bounds[1:], 10) if n_texts else raw
    text_end = bounds[1:] + np.arange(n_texts)
    ends = np.flatnonzero(whole == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    firsts = np.concatenate(([0], np.searchsorted(ends, text_end) + 1))
    n = len(ends)
    count = np.maximum(size, 1)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[ends] - total[starts]).astype(np.float64)

    columns = []
    for chars in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        columns.append(per_line(table[whole]) / count)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    word = ~blank[whole]
    before = np.concatenate(([False], word[:-1]))
    w_start = np.flatnonzero(word & ~before)
    w_end = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
    words = span_hashes(prefix_hashes(whole), w_start, w_end)
    w_line = np.searchsorted(ends, w_start)
    n_words = np.bincount(w_line, minlength=n).astype(np.float64)
    many = np.maximum(n_words, 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (w_line[1:] == w_line[:-1])
    key = np.sort(w_line.astype(np.uint64) << np.uint64(40) | words >> np.uint64(24))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    hashes = span_hashes(prefix_hashes(whole), starts, ends)
    text_of = np.repeat(np.arange(n_texts), np.diff(firsts))
    order = np.lexsort((hashes, text_of))
    seen = np.zeros(n, bool)
    if n:
        same = (hashes[order][1:] == hashes[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
        seen[order[1:][same]] = True
        seen[order[:-1][same]] = True
    # words that the text has had before, and capitals at word starts
    key2 = words ^ (text_of[w_line].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if n_texts else words
    _, first_at = np.unique(key2, return_index=True)
    new = np.zeros(len(words), bool)
    new[first_at] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    caps = np.bincount(w_line, upper[whole[w_start]].astype(np.float64), n) if len(words) else np.zeros(n)
    news = np.bincount(w_line, new.astype(np.float64), n) if len(words) else np.zeros(n)
    repeats = np.bincount(w_line, again.astype(np.float64), n) if len(words) else np.zeros(n)
    long_words = np.bincount(w_line, (w_end - w_start > 20).astype(np.float64), n) if len(words) else np.zeros(n)
    text_words = np.bincount(text_of, n_words, n_texts) if n else np.zeros(n_texts)
    columns += [
        np.log1p(size) / 5, np.log1p(n_words) / 3, (size - n_words) / many / 10, repeats / many,
        1 - distinct / many, seen.astype(np.float64), caps / many, 1 - news / many, long_words / many,
        (n_words <= 3).astype(np.float64), np.log1p(text_words)[text_of] / 5 if n else np.zeros(0),
        (size == 0).astype(np.float64)]
    return np.column_stack(columns), size, firsts


def with_neighbours(own: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A constant, the line's features and those of its neighbours in the same text (else zero)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[firsts[:-1]] = 0
    after[firsts[1:] - 1] = 0
    return np.hstack((np.ones((len(own), 1)), own, before, after))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Chain:
    """Two states (bad, good): weights of the line features and of the transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def run(self, features: np.ndarray, firsts: np.ndarray):
        """Log-partition of each text, marginals of lines and of transitions (by their second line)."""
        emit = np.zeros((len(features), 2))
        emit[:, 1] = features @ self.weights
        n = np.diff(firsts)
        order = np.argsort(-n, kind="stable")
        steps = [order[:k] for k in np.searchsorted(-n[order], -np.arange(1, n.max() if len(n) else 1), side="left")]
        forward, backward = emit.copy(), np.zeros_like(emit)
        for t, docs in enumerate(steps, 1):
            at = firsts[docs] + t
            forward[at] += _logsum(forward[at - 1][:, :, None] + self.moves, 1)
        for t, docs in reversed(list(enumerate(steps, 1))):
            at = firsts[docs] + t
            backward[at - 1] = _logsum(self.moves + (emit[at] + backward[at])[:, None, :], 2)
        total = _logsum(forward[firsts[1:] - 1], 1)
        each = np.repeat(total, n)
        line = np.exp(forward + backward - each[:, None])
        second = np.ones(len(emit), bool)
        second[firsts[:-1]] = False
        at = np.flatnonzero(second)
        pair = np.exp(forward[at - 1][:, :, None] + self.moves + (emit[at] + backward[at])[:, None, :]
                      - each[at][:, None, None])
        return total, line, pair, at

    def fit(self, features, firsts, good, rounds: int = 200, ridge: float = 1e-3) -> "Chain":
        """Maximum likelihood by Adam steps on all lines; a line has its text's label."""
        label = np.repeat(good, np.diff(firsts)).astype(int)
        weight = 1.0 / np.repeat(np.diff(firsts), np.diff(firsts))  # each text counts once
        m = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        v = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for step in range(1, rounds + 1):
            _, line, pair, at = self.run(features, firsts)
            seen = np.zeros_like(pair)
            seen[np.arange(len(at)), label[at - 1], label[at]] = 1
            scale = len(firsts) - 1
            gradients = (features.T @ ((label - line[:, 1]) * weight) / scale - ridge * self.weights,
                         np.tensordot(weight[at], seen - pair, 1) / scale - ridge * self.moves)
            for k, (value, g) in enumerate(zip((self.weights, self.moves), gradients)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                value += 0.05 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


class Model:
    """Scaling, chain and calibration."""

    def __init__(self, mean, spread, chain: Chain, slope: float = 1.0, shift: float = 0.0):
        self.mean, self.spread, self.chain, self.slope, self.shift = mean, spread, chain, slope, shift

    def quality(self, own: np.ndarray, size: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of every text."""
        _, line, _, _ = self.chain.run(with_neighbours((own - self.mean) / self.spread, firsts), firsts)
        weight = size + 1
        mean = np.add.reduceat(line[:, 1] * weight, firsts[:-1]) / np.add.reduceat(weight, firsts[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.quality(*line_features(column)) + self.shift)))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve, by damped Newton steps."""
    slope, shift = 1.0, 0.0
    design = np.column_stack((x, np.ones_like(x)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        g = design.T @ (weight * (y - p)) - np.array([1e-2 * slope, 0])
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        slope, shift = np.array([slope, shift]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return max(slope, 0.05), shift


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fifth."""
    chosen = (labels.where("quality is not null and doc_id is not null")
              .where(~held_out(F.col("doc_id")))
              .select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
              .orderBy(F.xxhash64("doc_id"), "quality").limit(sample))

    most = FIT_LINES

    def features(batches):
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                own, size, firsts = line_features(b.column(1).slice(i, j - i))
                # a text of more lines than are wanted together cannot be chosen
                packs = [np.column_stack((own[a:z], size[a:z])).astype("<f4").tobytes() if z - a <= most else b""
                         for a, z in zip(firsts, firsts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(packs, pa.binary()),
                     pa.array(np.diff(firsts), pa.int64())], ["doc_id", "quality", "lines", "n_lines"])
    # at most ``sample`` small rows are broadcast
    found = stored(texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
                   .mapInArrow(features, "doc_id long, quality int, lines binary, n_lines long"), "labelled")
    order = [F.xxhash64("doc_id"), "quality", "mark"]
    found = found.withColumn("mark", F.xxhash64("lines"))
    left, keys = most, set()
    for r in found.select("doc_id", "quality", "mark", "n_lines").orderBy(*order).limit(sample).collect():
        if r["n_lines"] <= left:
            left -= r["n_lines"]
            keys.add((r["doc_id"], r["quality"], r["mark"]))
    keys = docs.sparkSession.createDataFrame(list(keys), "doc_id long, quality int, mark long")
    rows = (found.join(F.broadcast(keys), ["doc_id", "quality", "mark"], "left_semi")
            .orderBy(*order).limit(sample).collect())
    arrays = [np.frombuffer(r["lines"], "<f4").reshape(-1, N_FEATURES + 1).astype(np.float64) for r in rows]
    good = np.array([r["quality"] for r in rows], float)
    width = N_FEATURES
    if not rows or good.min() == good.max():
        base = 8.0 if rows and good.min() == 1 else -8.0 if rows else 8.0
        return Model(np.zeros(width), np.ones(width), Chain(np.zeros(1 + 3 * width), np.zeros((2, 2))), 0.05, base)
    fit, rest = [], []
    for k in range(len(rows)):
        (rest if k % 4 == 3 else fit).append(k)

    def joined(which):
        stack = np.vstack([arrays[k] for k in which])
        firsts = np.concatenate(([0], np.cumsum([len(arrays[k]) for k in which])))
        return stack[:, :-1], stack[:, -1], firsts
    own, size, firsts = joined(fit)
    mean, spread = own.mean(0), own.std(0) + 0.05
    chain = Chain(np.zeros(1 + 3 * width), np.zeros((2, 2)))
    chain.fit(with_neighbours((own - mean) / spread, firsts), firsts, good[fit])
    model = Model(mean, spread, chain)
    if rest:
        model.slope, model.shift = _calibrated(model.quality(*joined(rest)), good[rest])
    return model


def held_out(doc_id):
    """The fifth of identifiers that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    def run(batches):
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(model.score(b.column(1).slice(i, j - i)))],
                    ["doc_id", "score"])
    return texts(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = MIN_SCORE) -> DataFrame:
    """The rows whose score is at least ``least``, all their columns; only texts leave the JVM."""
    def score(text: pa.Array) -> pa.Array:
        found = [model.score(text.slice(i, j - i)) for i, j in chunks(text, BATCH)]
        pa.default_memory_pool().release_unused()  # the worker lives on through later steps
        return pa.array(np.concatenate([np.zeros(0), *found]))
    scored_by = F.arrow_udf(score, "double")
    return docs.where(scored_by(F.coalesce(docs["text"], F.lit(""))) >= least)
