"""Secret scan: patterns, and a character convolutional network over every candidate.

Patterns give base findings, which always stay. Candidates are all runs of at least ``LEAST``
characters of a token alphabet, with or without digits, that no base finding touches, and of the
runs that one touches every part it leaves uncovered, however short. A small convolutional network
in numpy reads each candidate with the characters around it; a candidate becomes a finding (kind
``model``) when its calibrated probability reaches a threshold. Base findings get theirs from it too.

The network learns from all runs labelled by rule: runs that hold the value of a base finding are
secrets; numbers, ordinarily written words, dotted names of short parts and words with a short
number are not; others have no label. Secrets count by distinct windows, other runs as often as
they stand. Most secrets stand under another key word, shortened or of other characters, as the
spans to be added do. A quarter of the windows, by hash, is learnt nothing from: all of it
calibrates the score and sets the threshold, the highest one that keeps ``RECALL`` of the labelled
secrets.

A fit to at most ``SAMPLE`` runs, those of least hash of each class, is where learning starts.
``ROUNDS`` rounds go on from there, each over another part of the documents and of the secrets,
so that every run is scored once: the gradient of a squared hinge, summed over the tasks, moves the
weights. A run beyond the margin has none, so few need more than their score. Scores are counted
in steps of 1 / ``STEPS``; the driver holds weights and these counts alone.

Whole texts are scanned in narrow passes: once for the labelled secrets, once in the rounds
together, and once to score all candidates; a round picks its documents from the table, so the
frame given should be a stored one. Null and empty texts have no findings; repeated rows are scanned
each. A candidate longer than the window is read in several windows, and learnt from by its first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, packed, ragged, stored, texts

BATCH = 2 << 20
BLOCK = 4 << 10
SAMPLE = 4_000
ROUNDS, RATE = 8, 0.003
#: Disguises of a labelled secret; secrets that a task holds at most before it hands them on.
COPIES, HELD = 4, 20_000
#: One window of so many, by hash, is held out; a power of two.
APART = 4
#: Scores are counted in such parts of a unit, as far as MOST units from 0; tasks that add up gradients.
STEPS, MOST, ADDERS, UNIT = 64, 64, 16, 1 << 20
RECALL = 0.98
LEAST = 8
BEFORE, INSIDE, AFTER = 24, 40, 8
LENGTH = BEFORE + INSIDE + AFTER
KINDS = ("assign", "access", "hex", "model")

# fixed patterns of the base findings
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = ("password", "passwd", "secret", "token", "api")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-!@#$%^&*~?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_WORD = r"(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,24})"
#: Of a candidate without base finding: certainly no secret.
_PLAIN = re.compile(rf"[^A-Za-z]+|[^A-Za-z0-9]*{_WORD}(?:[^A-Za-z0-9=]+{_WORD})*[^A-Za-z0-9]*")
#: The same unless it stands after a colon or an equals sign.
_NAME = re.compile(r"[A-Za-z]{3,}[0-9]{1,4}|(?:[A-Za-z0-9]{1,12}[./_-])+[A-Za-z0-9]{1,8}")
_KEY = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE)


def runs(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray, least: int):
    """Maximal runs (start, end) of a byte class within each text, of at least so many bytes."""
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(stop) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of assign and access findings."""
    lower = text.lower()
    found = []
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found


_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 +/_.=-:\"'\n,;#@!$%^&*~?"
_CODES = len(_ALPHABET) + 2
#: Code of a first byte: 0 is outside the text, 1 any other character.
_CODE = np.ones(256, np.uint8)
_CODE[list(_ALPHABET.encode())] = np.arange(2, _CODES)
_SHOWN = "\0\x01" + _ALPHABET
_ALNUM = "".join(c for c in _ALPHABET if c.isalnum())


def coded(views: list[str]) -> np.ndarray:
    """Character codes of windows."""
    return np.array([[_SHOWN.find(c) if c in _SHOWN else 1 for c in v] for v in views], np.uint8).reshape(-1, LENGTH)


class Scanned:
    """Base findings and candidates of a text column without nulls; offsets count characters."""

    def __init__(self, column: pa.Array):
        raw, bounds = packed(column)
        lead = (raw & 0xC0) != 0x80
        self.chars = chars = raw[lead]
        self.bounds = bounds = np.concatenate(([0], np.cumsum(lead)))[bounds]
        self.texts = column.to_pylist()
        self.base = [base_spans(t) for t in self.texts]
        starts, ends = runs(chars, bounds, _HEX, 32)
        rows = self.row(starts)
        for k, s, e in zip(rows.tolist(), (starts - bounds[rows]).tolist(), (ends - bounds[rows]).tolist()):
            self.base[k].append((s, 2, e, s))
        covered = np.zeros(len(chars), bool)
        self.value = np.zeros(len(chars), bool)
        for k, found in enumerate(self.base):
            found.sort()
            for s, _, e, v in found:
                covered[bounds[k] + s:bounds[k] + e] = True
                self.value[bounds[k] + v:bounds[k] + e] = True
        starts, ends = runs(np.where(covered, 0, chars), bounds, _TOKEN, 1)
        edge = np.zeros(len(chars) + 1, bool)
        edge[bounds] = True
        near = np.concatenate(([False], covered, [False]))
        beside = near[starts] & ~edge[starts] | near[ends + 1] & ~edge[ends]
        keep = beside | (ends - starts >= LEAST)
        self.starts, self.ends, self.beside = starts[keep], ends[keep], beside[keep]
        # codes of all texts with room for a window between them
        at = np.repeat(np.arange(1, len(bounds)) * LENGTH, np.diff(bounds))
        self.codes = np.zeros(len(chars) + LENGTH * (len(bounds) + 1), np.uint8)
        self.codes[np.arange(len(chars)) + at] = _CODE[chars]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def place(self, starts: np.ndarray) -> np.ndarray:
        """Where in the codes the windows begin whose inner part begins at these characters."""
        return starts + (self.row(starts) + 1) * LENGTH - BEFORE

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.codes, LENGTH)[self.place(starts)]

    def scores(self, network: "Network", starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logit of every span, the greatest of its windows."""
        if not len(starts):
            return np.zeros(0)
        count = -(-(ends - starts) // INSIDE)
        firsts = np.cumsum(count) - count
        at = np.repeat(starts, count) + INSIDE * ragged(np.zeros_like(count), count)
        sizes = np.repeat(ends, count) - at
        order = np.argsort(at, kind="stable")
        logits = np.empty(len(at))
        logits[order] = network.logits(self.codes, self.place(at[order]), sizes[order])
        return np.maximum.reduceat(logits, firsts)

    def judged(self, network: "Network", counts: np.ndarray | None = None) -> list[list[tuple[int, int, int, float]]]:
        """(start, kind, end, probability) of all findings of every text. With ``counts``, logits in
        place of probabilities, and those of the held-out runs that are no secrets are counted there."""
        shown = network.probability if counts is None else lambda z: z
        flat = [(self.bounds[k] + v, self.bounds[k] + e) for k, found in enumerate(self.base) for _, _, e, v in found]
        spans = np.array(flat, np.int64).reshape(-1, 2)
        p = iter(shown(self.scores(network, spans[:, 0], spans[:, 1])).tolist())
        out = [[(s, kind, e, next(p)) for s, kind, e, _ in found] for found in self.base]
        z = self.scores(network, self.starts, self.ends)
        if counts is not None:
            some = np.flatnonzero(~self.beside)
            some = some[hashes(self.windows(self.starts[some])) % APART == 0]
            np.add.at(counts, bins(z[some[self.plain(self.starts[some], self.ends[some])]]), 1)
        good = np.flatnonzero(z >= network.cut)
        p = shown(z)
        rows = self.row(self.starts[good])
        for k, s, e, x in zip(rows.tolist(), (self.starts[good] - self.bounds[rows]).tolist(),
                              (self.ends[good] - self.bounds[rows]).tolist(), p[good].tolist()):
            out[k].append((s, 3, e, x))
        return [sorted(x) for x in out]

    def plain(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which candidates are none by rule."""
        rows = self.row(starts)
        first = self.bounds[rows]
        return np.array([rule_label(self.texts[k][s:e], self.texts[k][max(0, s - BEFORE):s]) == 0
                         for k, s, e in zip(rows.tolist(), (starts - first).tolist(), (ends - first).tolist())], bool)


def bins(logits: np.ndarray) -> np.ndarray:
    """Place of each logit among the counts."""
    return (np.clip(np.floor(logits * STEPS), -MOST * STEPS, MOST * STEPS) + MOST * STEPS).astype(np.int64)


def rule_label(token: str, before: str = "") -> int | None:
    """0 for a candidate that certainly is no secret, else none."""
    after_mark = before.rstrip(" \"'").endswith((":", "="))
    return 0 if _PLAIN.fullmatch(token) or not after_mark and _NAME.fullmatch(token) else None


_MIX = np.random.default_rng(2).integers(1, 1 << 63, LENGTH // 8, np.uint64) | np.uint64(1)


def hashes(views: np.ndarray) -> np.ndarray:
    h = (np.ascontiguousarray(views).view(np.uint64) * _MIX).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return (h ^ (h >> np.uint64(29))) >> np.uint64(1)


#: Classes of labelled runs: secrets, runs with digits and runs without that are none.
SECRET, FIGURE, LETTERS = range(3)


class Least:
    """The distinct windows of least hash."""

    def __init__(self, most: int):
        self.most, self.held, self.bound = most, {}, 1 << 63

    def add(self, hashed: int, view: bytes, size: int) -> None:
        self.held[hashed, view, size] = None
        if len(self.held) >= 2 * self.most + 64:
            self.held = dict.fromkeys(sorted(self.held)[:self.most])
            self.bound = max(self.held)[0]


def labelled(scanned: Scanned, kept: list[Least]) -> None:
    """Hand the labelled runs on."""
    starts, ends = runs(scanned.chars, scanned.bounds, _TOKEN, LEAST)
    valued = np.concatenate(([0], np.cumsum(scanned.value)))
    some = valued[ends] > valued[starts]
    _offer(scanned, starts[some], ends[some], kept[SECRET], False)
    starts, ends = scanned.starts[~scanned.beside], scanned.ends[~scanned.beside]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[scanned.chars])))
    some = digits[ends] > digits[starts]
    _offer(scanned, starts[some], ends[some], kept[FIGURE], True)
    _offer(scanned, starts[~some], ends[~some], kept[LETTERS], True)


def _offer(scanned: Scanned, starts: np.ndarray, ends: np.ndarray, kept: Least, by_rule: bool) -> None:
    if not len(starts):
        return
    views = scanned.windows(starts)
    hashed = hashes(views)
    rows = scanned.row(starts)
    for i in np.flatnonzero(hashed <= kept.bound).tolist():
        if hashed[i] > kept.bound:
            continue
        k = int(rows[i])
        s, e = int(starts[i] - scanned.bounds[k]), int(ends[i] - scanned.bounds[k])
        text = scanned.texts[k]
        if not by_rule or rule_label(text[s:e], text[max(0, s - BEFORE):s]) == 0:
            kept.add(int(hashed[i]), views[i].tobytes(), min(e - s, LENGTH))


LABELLED = "class int, hashed long, view binary, size int"


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled runs with the characters around them: all secrets, and of the others those of least
    hash of each task, with which learning starts."""
    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
            (pa.int32(), pa.int64(), pa.binary(), pa.int32()))], ["class", "hashed", "view", "size"])

    def run(batches):
        kept = [Least(1 << 62), Least(sample // 4), Least(sample // 4)]
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                labelled(Scanned(b.column(1).slice(i, j - i)), kept)
                if len(kept[SECRET].held) >= HELD:
                    yield table([(SECRET, *x) for x in kept[SECRET].held])
                    kept[SECRET].held = {}
        yield table([(c, *x) for c, own in enumerate(kept) for x in sorted(own.held)[:own.most]])
    return texts(docs).mapInArrow(run, LABELLED)


def disguised(view: str, size: int, other: str, rng: np.random.Generator) -> tuple[str, int]:
    """A labelled secret as an added span would look: by chance under another key word, and its
    value shortened, of other characters, a word with a number or with a mark in it. ``other`` is
    the window of a run that is no secret."""
    before, token = view[:BEFORE], view[BEFORE:BEFORE + size]
    after = view[BEFORE + size:] or " " + other[:BEFORE]
    key = list(_KEY.finditer(before + token))
    if not key or rng.random() < 0.25:
        return view, size
    some = lambda table, n: "".join(rng.choice(list(table), n))
    word = lambda: "".join(re.findall("[A-Za-z]+", other[BEFORE:]))[:int(rng.integers(3, 13))]
    name = some(_ALNUM[:26], rng.integers(3, 11)) if rng.random() < 0.5 else word().lower()
    mark = str(rng.choice(["=", ":", ": ", " = ", '="', ": '"]))
    after = mark[-1] + after.lstrip("\"'") if mark[-1] in "\"'" else " " + after.lstrip(" \"'")
    value = token[token.rfind("=", 0, -1) + 1:]
    kind = rng.random()
    if kind < 0.25:
        value = word().title() + some("0123456789", rng.integers(1, 5))
        value += some("0123456789", max(0, LEAST - len(value)))
    else:
        value = value[:int(rng.integers(LEAST, 17))] if rng.random() < 0.7 else value
        if kind < 0.75:
            value = some(_ALNUM[:52] if kind < 0.45 else _ALNUM, len(value))
        if rng.random() < 0.3 and len(value) > 1:
            k = int(rng.integers(1, len(value)))
            value = value[:k] + some("!@#$%^&*~?", 1) + value[k + 1:]
    before = (before + token)[:key[-1].start()]
    token = name + mark + value if mark == "=" else value
    before = before if mark == "=" else before + name + mark
    return (before[-BEFORE:].rjust(BEFORE, "\0") + (token + after)[:LENGTH - BEFORE].ljust(LENGTH - BEFORE, "\0"),
            min(len(token), LENGTH))


class Network:
    """Embedding, two widths of convolution, maximum over positions, one logistic unit."""

    WIDTH, FILTERS, EMBED = 5, 24, 10

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (_CODES, self.EMBED))
        # one more input channel: does the position lie in the candidate's part of the window
        self.kernel = rng.normal(0, 0.15, (self.WIDTH * (self.EMBED + 1), self.FILTERS))
        self.bias = np.zeros(self.FILTERS)
        self.out = rng.normal(0, 0.1, 2 * self.FILTERS)
        self.shift = np.zeros(1)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 1.0
        self.cut = np.inf  # the threshold as a logit
        self.recall = 0.0  # of the labelled secrets that set the threshold
        self.others = np.zeros((0, LENGTH), np.uint8)  # windows of runs that are no secrets, for disguises

    def parameters(self):
        return [self.embed, self.kernel, self.bias, self.out, self.shift]

    def forward(self, codes: np.ndarray, sizes: np.ndarray):
        n, steps = len(codes), LENGTH - self.WIDTH + 1
        place = np.arange(LENGTH) - BEFORE
        inside = ((place >= 0) & (place < np.minimum(sizes, INSIDE)[:, None])).astype(float)
        x = np.concatenate((self.embed[codes], inside[:, :, None]), 2)
        cols = np.concatenate([x[:, k:k + steps] for k in range(self.WIDTH)], 2)
        act = np.maximum(cols @ self.kernel + self.bias, 0)
        top = act.argmax(1)
        pooled = np.concatenate((np.take_along_axis(act, top[:, None, :], 1)[:, 0], act.mean(1)), 1)
        return cols, act, top, pooled, pooled @ self.out + self.shift[0]

    def logits(self, codes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last of ``forward`` for windows that begin at ascending places of a row of codes.

        The convolution runs once over the row. Steps that do not touch the candidate need no
        input of their own: their maximum is that of two runs of a power of two, and their part of
        the mean, one number a step, a difference of running sums. Only the steps that touch it are
        worked out for each window.
        """
        steps, left = LENGTH - self.WIDTH + 1, BEFORE - self.WIDTH + 1
        kernel = self.kernel.reshape(self.WIDTH, self.EMBED + 1, self.FILTERS)
        one = [(self.embed @ kernel[k, :-1]).astype(np.float32) for k in range(self.WIDTH)]
        first, second = ((one[k][:, None] + one[k + 1]).reshape(-1, self.FILTERS) for k in (0, 2))
        one[4] = one[4] + self.bias.astype(np.float32)
        place = np.arange(LENGTH) - BEFORE
        inside = (place >= 0) & (place < np.arange(INSIDE + 1)[:, None])
        edge = sum(inside[:, k:k + steps, None] * kernel[k, -1] for k in range(self.WIDTH)).astype(np.float32)
        edge = edge.reshape(-1, self.FILTERS)
        z, room = np.empty(len(at)), np.empty((7, BLOCK + LENGTH, self.FILTERS), np.float32)
        levels = room[1:].reshape(-1, self.FILTERS)
        share = (self.out[self.FILTERS:] / steps).astype(np.float32)
        sizes = np.minimum(sizes, INSIDE)
        a = 0
        while a < len(at):
            b = int(np.searchsorted(at, at[a] + BLOCK, "right"))
            c = codes[at[a]:at[b - 1] + LENGTH].astype(np.intp)
            pair = c[:-1] * _CODES + c[1:]
            m = len(c) - self.WIDTH + 1
            conv, more = room[0, :m], room[1, :m]
            first.take(pair[:m], 0, out=conv, mode="clip")
            conv += second.take(pair[2:m + 2], 0, out=more, mode="clip")
            conv += one[4].take(c[4:], 0, out=more, mode="clip")
            np.maximum(conv, 0, out=more)
            running = np.concatenate((np.zeros(1), np.cumsum(more @ share, dtype=np.float64)))
            for k in range(5):
                np.maximum(room[1 + k, :m - (1 << k)], room[1 + k, 1 << k:m], out=room[2 + k, :m - (1 << k)])
                m -= 1 << k
            w, n = at[a:b] - at[a], sizes[a:b]
            # steps of the candidate
            count = n + BEFORE - left
            step = ragged(np.full(len(n), left), count)
            own = conv.take(np.repeat(w, count) + step, 0)
            own += edge.take(np.repeat(n, count) * steps + step, 0)
            np.maximum(own, 0, out=own)
            firsts = np.cumsum(count) - count
            top, mean = np.maximum.reduceat(own, firsts), np.add.reduceat((own @ share).astype(np.float64), firsts)
            # steps before and behind it
            for at_run, size_run in ((w, np.full(len(w), left)), (w + BEFORE + n, steps - BEFORE - n)):
                mean += running[at_run + size_run] - running[at_run]
                level = np.frexp(size_run)[1] - 1
                here = at_run + level * room.shape[1]
                np.maximum(top, levels.take(here, 0), out=top)
                np.maximum(top, levels.take(here + size_run - (1 << level), 0), out=top)
            z[a:b] = top @ self.out[:self.FILTERS] + mean
            a = b
        return z + self.shift[0]

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logits + self.offset)))

    def gradients(self, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        cols, act, top, pooled, z = self.forward(codes, sizes)
        return self.backward(codes, cols, act, top, pooled, (1 / (1 + np.exp(-z)) - labels) / len(labels))

    def pull(self, codes: np.ndarray, sizes: np.ndarray, secret: bool) -> np.ndarray:
        """Sum of the gradients of a squared hinge, all weights as one row."""
        total, sign = np.zeros(sum(p.size for p in self.parameters())), 1 if secret else -1
        for k in range(0, len(codes), 256):
            some = codes[k:k + 256]
            cols, act, top, pooled, z = self.forward(some, sizes[k:k + 256])
            d = -2 * sign * np.maximum(0, 1 - sign * z)
            total += np.concatenate([g.ravel() for g in self.backward(some, cols, act, top, pooled, d)])
        return total

    def backward(self, codes, cols, act, top, pooled, d):
        """Gradients, given those of the logits."""
        steps = act.shape[1]
        d_pool = d[:, None] * self.out
        d_act = np.repeat(d_pool[:, None, self.FILTERS:] / steps, steps, 1)
        rows = np.arange(len(codes))[:, None]
        d_act[rows, top, np.arange(self.FILTERS)] += d_pool[:, :self.FILTERS]
        d_act *= act > 0
        d_kernel = np.tensordot(cols, d_act, ((0, 1), (0, 1)))
        d_cols = d_act @ self.kernel.T
        d_x = np.zeros((self.EMBED, *codes.shape))
        wide = self.EMBED + 1
        for k in range(self.WIDTH):
            d_x[:, :, k:k + steps] += np.moveaxis(d_cols[:, :, k * wide:k * wide + self.EMBED], 2, 0)
        d_embed = np.column_stack([np.bincount(codes.ravel(), x.ravel(), _CODES) for x in d_x])
        return [d_embed, d_kernel, d_act.sum((0, 1)), pooled.T @ d, np.array([d.sum()])]

    def fit(self, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 6,
            batch: int = 64) -> "Network":
        rng = np.random.default_rng(11)
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(order), batch):
                some = order[k:k + batch]
                step += 1
                for i, (p, g) in enumerate(zip(self.parameters(), self.gradients(codes[some], sizes[some], labels[some]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= 0.01 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        return self


def trained(scanned: DataFrame, sample: int = SAMPLE, recall: float = RECALL) -> Network:
    """Fit, calibrate and set the threshold on at most ``sample`` labelled runs, to start with."""
    from .quality import _calibrated
    rows = [r for c, most in ((SECRET, sample // 2), (FIGURE, sample // 4), (LETTERS, sample // 4))
            for r in scanned.where(F.col("class") == c).distinct()
            .orderBy("hashed", "view", "size").limit(most).collect()]
    own = Network()
    labels = np.array([r["class"] == SECRET for r in rows], float)
    if not rows or labels.min() == labels.max():
        return own  # nothing to tell apart: the threshold of 1 adds no findings
    rng = np.random.default_rng(3)
    views = [("".join(_SHOWN[c] for c in r["view"]), r["size"]) for r in rows]
    others = [v for (v, _), y in zip(views, labels) if not y]
    own.others = np.array([np.frombuffer(r["view"], np.uint8) for r in rows if r["class"] != SECRET])
    order = rng.permutation(len(rows))
    apart = np.array([r["hashed"] % APART == 0 for r in rows])[order]
    drawn = []
    for some in (order[apart], order[~apart]):
        n = int(labels[some].sum())
        copies = max(1, len(some) // 2 // n) if n else 1
        drawn.append([(*(disguised(*views[i], others[int(rng.integers(len(others)))], rng) if labels[i] else views[i]), labels[i])
                      for i in some for _ in range(copies if labels[i] else 1)])
    (rest, rest_size, rest_label), (fit, *known) = [
        (coded([x[0] for x in part]), np.array([x[1] for x in part], np.int64), np.array([x[2] for x in part]))
        for part in drawn]
    own.fit(fit, *known)
    z = np.concatenate([np.zeros(0), *(own.forward(rest[k:k + 512], rest_size[k:k + 512])[-1]
                                       for k in range(0, len(rest), 512))])
    if len(rest) and rest_label.min() < rest_label.max():
        own.slope, own.offset = _calibrated(z, rest_label)
        kept = np.sort(own.probability(z[rest_label == 1]))
        own.threshold = float(kept[int((1 - recall) * len(kept))])
        own.cut = float(np.sort(z[rest_label == 1])[int((1 - recall) * len(kept))])
        own.recall = float((kept >= own.threshold).mean())
    return own


PULLED = "class int, seen long, pull binary"


def _summed(class_: int, seen: int, pull: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([class_], pa.int32()), pa.array([seen], pa.int64()), pa.array([pull.tobytes()], pa.binary())],
        ["class", "seen", "pull"])


def _whole(pull: np.ndarray) -> np.ndarray:
    """Whole numbers, whose sum does not depend on the order of tasks."""
    return np.rint(pull * UNIT).astype(np.int64)


def pulls(docs: DataFrame, network: Network) -> DataFrame:
    """For each task and class of runs that are no secrets: how many were scored, and their gradients."""
    def run(batches):
        seen = {c: 0 for c in (FIGURE, LETTERS)}
        pull = {c: 0.0 for c in seen}
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                scanned = Scanned(b.column(1).slice(i, j - i))
                starts, ends = scanned.starts[~scanned.beside], scanned.ends[~scanned.beside]
                digits = np.concatenate(([0], np.cumsum(_DIGIT[scanned.chars])))
                figure = digits[ends] > digits[starts]
                z = network.logits(scanned.codes, scanned.place(starts), ends - starts)
                near = np.flatnonzero(z > -1)
                near = near[hashes(scanned.windows(starts[near])) % APART != 0]
                near = near[scanned.plain(starts[near], ends[near])]
                for c, which in ((FIGURE, figure), (LETTERS, ~figure)):
                    seen[c] += int(which.sum())
                    some = near[which[near]]
                    if len(some):
                        pull[c] = pull[c] + network.pull(scanned.windows(starts[some]), ends[some] - starts[some], False)
        for c, n in seen.items():
            if n:
                yield _summed(c, n, _whole(pull[c] + np.zeros(sum(p.size for p in network.parameters()))))
    return texts(docs).mapInArrow(run, PULLED)


def drawn(views: list[bytes], sizes: list[int], hashed: list[int], network: Network):
    """Every labelled secret in ``COPIES`` disguises that depend on its hash: codes and sizes."""
    out = []
    for view, size, h in zip(views, sizes, hashed):
        rng = np.random.default_rng(h)
        shown = "".join(_SHOWN[c] for c in view)
        for _ in range(COPIES):
            other = network.others[int(rng.integers(len(network.others)))]
            out.append(disguised(shown, size, "".join(_SHOWN[c] for c in other), rng))
    return coded([v for v, _ in out]), np.array([n for _, n in out], np.int64)


def secret_pulls(secrets: DataFrame, network: Network) -> DataFrame:
    """The same of labelled secrets."""
    def run(batches):
        for b in batches:
            codes, sizes = drawn(*(b.column(c).to_pylist() for c in ("view", "size", "hashed")), network)
            if len(codes):
                yield _summed(SECRET, len(codes), _whole(network.pull(codes, sizes, True)))
    return secrets.mapInArrow(run, PULLED)


def _added(batches):
    total = {}
    for b in batches:
        for c, n, x in zip(*(b.column(k).to_pylist() for k in range(3))):
            seen, pull = total.get(c, (0, 0))
            total[c] = seen + n, pull + np.frombuffer(x, np.int64)
    for c, (n, x) in total.items():
        yield _summed(c, n, x)


def refined(network: Network, docs: DataFrame, secrets: DataFrame) -> Network:
    """Go on learning from all labelled runs that are not held out."""
    weight = {SECRET: 0.5, FIGURE: 0.25, LETTERS: 0.25}
    m, v = 0.0, 0.0
    for t in range(ROUNDS):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == t)
        known = secrets.where((F.col("hashed") % APART != 0) & (F.shiftright("hashed", APART.bit_length() - 1) % ROUNDS == t))
        rows = pulls(own, network).unionByName(secret_pulls(known, network)).repartition(ADDERS).mapInArrow(_added, PULLED)
        total = {c: (0, 0) for c in weight}
        for r in rows.collect():
            seen, pull = total[r["class"]]
            total[r["class"]] = seen + r["seen"], pull + np.frombuffer(r["pull"], np.int64)
        g = sum(weight[c] * pull / (n * UNIT) for c, (n, pull) in total.items() if n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
        at = 0
        for p in network.parameters() if np.ndim(move) else ():
            p -= move[at:at + p.size].reshape(p.shape)
            at += p.size
    return network


def counted(secrets: DataFrame, network: Network) -> np.ndarray:
    """Counts of the logits of all held-out labelled secrets."""
    def run(batches):
        counts = np.zeros(2 * MOST * STEPS + 1, np.int64)
        for b in batches:
            codes, sizes = drawn(*(b.column(c).to_pylist() for c in ("view", "size", "hashed")), network)
            for k in range(0, len(codes), 512):
                np.add.at(counts, bins(network.forward(codes[k:k + 512], sizes[k:k + 512])[-1]), 1)
        yield _counts(counts)
    return _total(secrets.where(F.col("hashed") % APART == 0).mapInArrow(run, COUNTS))


COUNTS = "place long, n long"


def _counts(counts: np.ndarray) -> pa.RecordBatch:
    place = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[place])], ["place", "n"])


def _total(counts: DataFrame) -> np.ndarray:
    out = np.zeros(2 * MOST * STEPS + 1, np.int64)
    for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def learned(docs: DataFrame, recall: float = RECALL) -> Network:
    """A network that has learnt from all labelled runs, with its threshold as a logit."""
    found = stored(scan(docs), "findings")
    network = trained(found, recall=recall)
    if not len(network.others):
        return network
    secrets = stored(found.where(F.col("class") == SECRET).distinct(), "secrets")
    network = refined(network, docs, secrets)
    network.secrets = counted(secrets, network)
    kept = np.cumsum(network.secrets[::-1])[::-1]  # secrets at this place or above
    network.cut, network.recall = np.inf, 0.0
    if kept[0]:
        place = int(np.flatnonzero(kept >= recall * kept[0])[-1])
        network.cut, network.recall = place / STEPS - MOST, float(kept[place] / kept[0])
    return network


def calibrated(network: Network, others: np.ndarray) -> Network:
    """Slope and offset from the counts of all held-out runs; both classes weigh the same."""
    from .quality import _calibrated
    network.slope, network.offset = 1.0, 0.0
    if len(network.others) and network.secrets.any() and others.any():
        x = (np.arange(len(others)) + 0.5) / STEPS - MOST
        n = others.sum()
        weight = np.concatenate((others.astype(float), network.secrets * (n / network.secrets.sum())))
        y = np.repeat([0.0, 1.0], len(others))
        some = weight > 0
        network.slope, network.offset = _calibrated(np.concatenate((x, x))[some], y[some], weight[some])
    network.threshold = float(network.probability(network.cut))
    return network


FOUND = "doc_id long, spans array<struct<start:int,kind:int,end:int,probability:double>>"


def judged(docs: DataFrame, network: Network, counting: bool = False) -> DataFrame:
    """All findings of every row: base ones and the candidates that the network accepts. With
    ``counting``, logits in place of probabilities, and more rows with the counts of the logits of
    held-out runs that are no secrets."""
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                                   ("probability", pa.float64())]))
        held = None if not counting else np.zeros(2 * MOST * STEPS + 1, np.int64)
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                rows = [[dict(zip(("start", "kind", "end", "probability"), s)) for s in spans]
                        for spans in Scanned(b.column(1).slice(i, j - i)).judged(network, held)]
                columns = [b.column(0).slice(i, j - i), pa.array(rows, kind)]
                columns += [pa.nulls(j - i, pa.int64())] * 2 if counting else []
                yield pa.RecordBatch.from_arrays(columns, names)
        if counting:
            place, n = _counts(held).columns
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.nulls(len(n), kind), place, n], names)
    names = ["doc_id", "spans"] + ["place", "n"] * counting
    return texts(docs).mapInArrow(run, f"{FOUND}, {COUNTS}" if counting else FOUND)


def find(docs: DataFrame) -> DataFrame:
    """Findings of every row by patterns and network."""
    network = learned(docs)
    rows = stored(judged(docs, network, True), "judged")
    network = calibrated(network, _total(rows.where("place is not null")))
    probability = lambda z: 1 / (1 + F.exp(-(F.lit(network.slope) * z + F.lit(network.offset))))
    return rows.where("place is null").select("doc_id", F.transform("spans", lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
        probability(x["probability"]).alias("probability"))).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base findings, and all findings as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def of_kind(i: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    counts = {f"n_{k}": of_kind(i) for i, k in enumerate(KINDS)}
    return found.select(
        "doc_id", *(c.alias(n) for n, c in counts.items()),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"))


def masked_text(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with every finding, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The rows with every finding replaced; rows without text stay as they are, other columns too.
    Only texts leave the JVM."""
    network = learned(docs)

    def replaced(text: pa.Array) -> pa.Array:
        plain, new = text.fill_null(""), []
        for i, j in chunks(plain, BATCH):
            scanned = Scanned(plain.slice(i, j - i))
            new += [masked_text(t, [(s[0], s[2]) for s in spans], mark) if spans else t
                    for t, spans in zip(scanned.texts, scanned.judged(network))]
        pa.default_memory_pool().release_unused()  # the worker lives on through later steps
        return pa.array([t if ok else None for ok, t in zip(text.is_valid().to_pylist(), new)], pa.string())
    return docs.withColumn("text", F.arrow_udf(replaced, "string")(docs["text"]))
