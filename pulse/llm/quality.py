"""Quality scores by a generalised additive model with pairwise interactions (operator 9).

Features are binned; boosting goes over them in turn, and each shallow tree it fits to
the residuals is a function of one feature's bins, so all trees of a feature add up to
one lookup table. The pairs whose tables explain most of what is left get tables over
two features' coarse bins in the same way. A score is the sigmoid of the looked-up sum.
"""

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.learning import bounded_sample, sampled_texts, sigmoid

FEATURES = [
    "log_words", "word_length", "longest_word", "distinct_words", "repeated_triples", "repeated_lines", "line_words",
    "upper", "digits", "punctuation", "symbols", "exclamations", "other_bytes", "top_word", "closed_lines", "squeezed",
    "short_words", "bars", "links",
]
BINS = 32
PAIR_BINS = 8


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters)] = 1
    return table


CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(b".,;:?!'\"()-"),
        _class(b"#*$%&<>@^~_=+/\\{}[]"),
        _class(b"!"),
        _class(bytes(range(128, 256))),
        _class(b"|"),
    ],
    axis=1,
)


def features(text: str | None) -> list[float]:
    """The features of a whole text; zeros without a word."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    upper, digits, punctuation, symbols, shouts, other, bars = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES
    size = len(data)
    lines = [line for line in data.split(b"\n") if line.strip()]
    counts = Counter(words)
    triples = [*zip(words, words[1:], words[2:])]
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        float(np.log1p(max(map(len, words)))),
        len(counts) / n**0.8,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        upper / size,
        digits / size,
        punctuation / size,
        symbols / size,
        shouts / size,
        other / size,
        max(counts.values()) / n,
        sum(line.rstrip()[-1:] in b".!?\"" for line in lines) / len(lines),
        len(zlib.compress(data, 1)) / size,
        sum(len(word) <= 3 for word in words) / n,
        bars / size,
        len(re.findall(rb"https?:|www\.|@", data)) / n,
    ]


@dataclass
class QualityModel:
    intercept: float
    edges: list[np.ndarray]
    tables: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair x coarse bin x coarse bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = self.intercept + self.tables[np.arange(b.shape[1]), b].sum(axis=1)
        coarse = b * PAIR_BINS // BINS
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total = total + table[coarse[:, i], coarse[:, j]]
        return sigmoid(total)


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow tree's values over ordered bins, from each bin's sum of gradients and of second derivatives."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + ridge))
    if depth and len(gradient) > 1:
        g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        gain = g**2 / (h + ridge) + (gradient.sum() - g) ** 2 / (weight.sum() - h + ridge)
        cut = int(gain.argmax()) + 1
        out[:cut] = _tree(gradient[:cut], weight[:cut], depth - 1, ridge)
        out[cut:] = _tree(gradient[cut:], weight[cut:], depth - 1, ridge)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """The best tree of one cut in each of two features: a value for each quarter of their table."""
    g, h = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (gradient, weight))
    best, out = -1.0, None
    n = len(gradient)
    for i in range(1, n):
        for j in range(1, n):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, n)), (slice(i, n), slice(0, j)), (slice(i, n), slice(j, n))]
            sums = []
            for rows, columns in parts:
                a, b, c, d = rows.start, rows.stop, columns.start, columns.stop
                sums.append([t[b, d] - t[a, d] - t[b, c] + t[a, c] for t in (g, h)])
            gain = sum(s**2 / (w + ridge) for s, w in sums)
            if gain > best:
                best, out = gain, np.zeros_like(gradient)
                for (rows, columns), (s, w) in zip(parts, sums):
                    out[rows, columns] = s / (w + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pairs: int = 6, pair_rounds: int = 15, rate: float = 0.15, ridge: float = 5.0) -> QualityModel:
    """Cyclic boosting: each round goes over all features (then over all pairs) and fits one shallow tree to each."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(column, quantiles)) for column in x.T]
    share = np.clip(y.mean(), 0.001, 0.999)
    model = QualityModel(float(np.log(share / (1 - share))), edges, np.zeros((x.shape[1], BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def sums(index, size):
        p = sigmoid(total)
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(rounds):
        for k in range(x.shape[1]):
            step = rate * _tree(*sums(b[:, k], BINS), depth=2, ridge=ridge)
            model.tables[k] += step
            total += step[b[:, k]]
    coarse, cells = b * PAIR_BINS // BINS, PAIR_BINS * PAIR_BINS
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        g, h = sums(coarse[:, i] * PAIR_BINS + coarse[:, j], cells)
        gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = (a.reshape(PAIR_BINS, PAIR_BINS) for a in sums(coarse[:, i] * PAIR_BINS + coarse[:, j], cells))
            step = rate * _pair_tree(g, h, ridge)
            model.pair_tables[k] += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> QualityModel | None:
    """Learn from at most `bound` labelled rows (labels: doc_id, label 0 or 1), in equal parts by label; None without any.

    The scores are then moved to the labels' own shares, which count all labelled rows.
    """
    sample = bounded_sample(labels, bound)

    def rows_of(batches):
        for batch in batches:
            found = [features(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))],
                ["doc_id", "label", "features"],
            )

    rows = sampled_texts(docs, sample, ["label"]).mapInArrow(rows_of, "doc_id long, label int, features array<double>")
    rows = sorted(tuple(row) for row in rows.collect())  # at most `bound` rows of numbers
    if not rows:
        return None
    x, y = np.array([r[2] for r in rows], np.float64), np.array([r[1] for r in rows], np.float64)
    model = fit(x, y)
    share = labels.agg(F.avg("label")).first()[0]
    odds = [np.log(np.clip(s, 0.001, 0.999) / (1 - np.clip(s, 0.001, 0.999))) for s in (share, y.mean())]
    model.intercept += float(odds[0] - odds[1])
    return model


def text_scores(texts: pa.Array, model: QualityModel | None) -> np.ndarray:
    """The score of each text, as score() gives it."""
    x = np.array([features(text) for text in texts.to_pylist()]).reshape(-1, len(FEATURES))
    return model.score(x) if model and len(x) else np.full(len(x), 0.5)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score (chance of label 1) of each row of `docs` (doc_id, text).

    Whole texts count; a null or empty one has the score of a text without words.
    Without a model every score is 0.5. Repeated rows and null ids give a row each.
    """

    def of(batches):
        for batch in batches:
            found = text_scores(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(of, "doc_id long, score double")
