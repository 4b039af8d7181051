"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs set a labelled good document above a labelled bad one. The probability that one beats the other is the
logistic function of the difference of their scores, linear in the features; the weights minimise the logistic loss over
feature differences. A document is good if its score reaches a quantile of the training scores; the score that is returned puts
this threshold at 0.3. The quantile, and how much the frequencies of short texts count, are chosen by cross-validation
within the training documents: folds are fitted without the documents that they are judged on.

Features are of the text alone: byte frequencies, transitions between classes of bytes, and repetition and shape of
words and lines. The fit sees a bounded sample of labelled documents, PER_CLASS of each class at most; scoring is one
narrow pass over whole texts. Null and empty texts have the features of an empty text. Without documents of both
classes all scores are 0.5. Repeated rows give repeated results; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_arrow, strings

#: Bounds of the fit: labelled documents of each class, and preference pairs.
PER_CLASS, PAIRS = 3_000, 60_000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """The class of each byte: letters by case, digits, blanks, line breaks, four kinds of ASCII marks, control, other bytes."""
    of = np.full(256, 10, np.uint8)
    of[:32] = 9
    of[33:127] = 5
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r")):
        of[list(chars)] = k
    for k, chars in ((6, b".,;:"), (7, b"!?'\"-()"), (8, b"#$%&*+/<=>@[\\]^_`{|}~")):
        of[list(chars)] = k
    return of


CLASS, N_CLASSES, SHAPES = _classes(), 11, 11
SIZE = 256 + N_CLASSES**2 + SHAPES
#: Candidates for the length in bytes at which byte and transition frequencies count half; shorter texts' are drawn towards the mean.
SHORT = (0, 50, 200, 800)
#: Folds of the cross-validation, and steps of a fit within it and of the whole one.
FOLDS, TRIAL_ROUNDS, ROUNDS = 4, 100, 300


def _steadied(x: np.ndarray, mean: np.ndarray, short: float) -> np.ndarray:
    """Differences from the mean; that of the frequencies grows with the length, whose logarithm the first shape feature tells."""
    d = x - mean
    size = np.expm1(x[:, -SHAPES] * 10)
    d[:, :-SHAPES] *= (size / np.maximum(size + short, 1))[:, None]
    return d


def features(text: str) -> np.ndarray:
    """SIZE numbers that describe a text; all of them are shares or logarithms, so their scale doesn't grow with length."""
    out = np.zeros(SIZE)
    raw = text.encode()
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    out[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
    kind = CLASS[data]
    if len(kind) > 1:
        out[256 : 256 + N_CLASSES**2] = np.sqrt(np.bincount(kind[:-1].astype(np.int16) * N_CLASSES + kind[1:], minlength=N_CLASSES**2) / (len(kind) - 1))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    pairs = set(zip(words, words[1:], words[2:], strict=False))
    out[-SHAPES:] = (
        np.log1p(len(raw)) / 10,
        np.log1p(len(words)) / 10,
        len(raw) / n / 20,
        len(set(words)) / n,
        len(pairs) / max(1, len(words) - 2),
        len(set(lines)) / m,
        np.log1p(len(raw) / m) / 10,
        np.log1p(m) / 10,
        len(words) / n,
        1.0 if raw[-1:] in b".!?" else 0.0,
        len(set(words[:50])) / max(1, len(words[:50])),
    )
    return out


@dataclass
class Ranker:
    """A fitted model: standardised features times weights, and the threshold and scale of scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    short: float
    threshold: float = 0.0
    scale: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (_steadied(x, self.mean, self.short) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, THRESHOLD at the raw threshold."""
        z = np.clip((self.raw(x) - self.threshold) * self.scale, -500, 500) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


def loss(z: np.ndarray, over: np.ndarray, under: np.ndarray, w: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The mean of log(1 + exp(-(z_over - z_under) w)) over the pairs plus penalty / 2 |w|^2, and its gradient by w."""
    s = z @ w
    ahead = s[over] - s[under]
    lost = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
    pull = np.bincount(over, lost, len(z)) - np.bincount(under, lost, len(z))
    return float(np.logaddexp(0, -ahead).mean() + penalty / 2 * w @ w), penalty * w - z.T @ pull / len(over)


def _fitted(x: np.ndarray, y: np.ndarray, short: float, pairs: int, rounds: int, penalty: float, seed: int) -> Ranker:
    """Weights from pairs drawn by seed, by accelerated gradient descent on loss()."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean = x.mean(axis=0)
    z = _steadied(x, mean, short)
    spread = z.std(axis=0) + 1e-3
    z /= spread
    draw = np.random.default_rng(seed)
    over, under = draw.choice(good, pairs), draw.choice(bad, pairs)
    w = v = np.zeros(x.shape[1])
    step = 4 / ((z * z).sum(axis=1).mean() * 4 + penalty)
    for t in range(rounds):
        new = v - step * loss(z, over, under, v, penalty)[1]
        w, v = new, new + t / (t + 3) * (new - w)
    return Ranker(mean, spread, w, short)


def _validated(x: np.ndarray, y: np.ndarray, pairs: int, penalty: float, seed: int) -> tuple[float, float]:
    """The short length whose folds order unseen pairs with the least loss, the smallest in ties, and the quantile of unseen scores
    that parts the classes best, in the middle where several do."""
    fold = np.empty(len(y), np.int64)
    for k in (0, 1):  # each class is dealt evenly
        own = np.flatnonzero(y == k)
        fold[np.random.default_rng(seed + k).permutation(own)] = np.arange(len(own)) % FOLDS
    best = (np.inf, float(SHORT[0]), 0.5)
    for short in SHORT:
        lost, place = [], np.empty(len(y))
        for k in range(FOLDS):
            out = fold == k
            s = _fitted(x[~out], y[~out], short, pairs, TRIAL_ROUNDS, penalty, seed).raw(x[out])
            # Every pair of the fold: the mean over all of them, good by bad.
            lost.append(np.logaddexp(0, s[y[out] == 0][None] - s[y[out] == 1][:, None]).mean())
            place[out] = (np.argsort(np.argsort(s, kind="stable"), kind="stable") + 0.5) / len(s)
        if (mean := float(np.mean(lost))) < best[0] - 1e-12:
            at = np.linspace(0, 1, 401)
            good, bad = np.sort(place[y == 1]), np.sort(place[y == 0])
            sides = np.searchsorted(bad, at) / len(bad) + 1 - np.searchsorted(good, at) / len(good)
            top = at[sides >= sides.max() - 1e-12]
            best = (mean, float(short), float((top[0] + top[-1]) / 2))
    return best[1:]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 7) -> Ranker | None:
    """Bradley-Terry weights and threshold; None without both classes. Classes of fewer than FOLDS documents aren't enough for
    cross-validation: all frequencies count whole then, and the quantile is the share of the bad class."""
    n = np.bincount(y, minlength=2)
    if not n[0] or not n[1]:
        return None
    short, quantile = _validated(x, y, pairs // 4, penalty, seed) if min(n) >= FOLDS else (0.0, n[0] / len(y))
    m = _fitted(x, y, short, pairs, ROUNDS, penalty, seed)
    s = m.raw(x)
    m.threshold, m.scale = float(np.quantile(s, quantile)), float(4 / max(s.std(), 1e-9))
    return m


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Ranker | None:
    """A Ranker from labelled rows outside the held-out fifth. Only features of the bounded sample come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([features(t).astype(np.float32) for t in strings(b, 2)], pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = map_arrow(labelled_sample(docs, labels, label, per_class).select("doc_id", "y", "text"), run, "doc_id long, y int, x array<float>").toArrow().sort_by("doc_id")
    if not len(rows):
        return None
    return fit(np.stack(rows["x"].to_numpy()).astype(float), rows["y"].to_numpy())


def scored(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b, 1)
            s = model.score(np.stack([features(t) for t in texts])) if model and texts else np.full(len(texts), 0.5)
            yield pa.record_batch([b.column(0), pa.array(s)], ["doc_id", "score"])

    out = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """documents whose score reaches the threshold, all columns as they are."""
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model and b.num_rows:
                b = b.filter(pa.array(model.score(np.stack([features(t) for t in strings(b, k)])) >= THRESHOLD))
            yield b

    return map_arrow(docs, run, docs.schema)
