"""Toxicity scores by a counterfactually regularised classifier (operator 6).

A sparse logistic regression on which words, and which beginnings of words, a text has.
Training pairs each labelled text with copies in which an identity term is swapped for
others of its group, or in which a term is mentioned though it was not, and penalises
the squared change of the score's logit. So a group's mention alone moves no score.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.learning import bounded_sample, sampled_texts, sigmoid, sums_between, word_tables

BUCKETS = 1 << 18
PREFIXES = (4, 5)
#: What the toxic texts weigh together in training, of 1.
TOXIC_PART = 0.4
MARKS = ".,;:!?\"'()[]{}<>*_-…“”„«»"
#: Identity terms by group; terms of a group can stand for each other in a sentence.
IDENTITY_TERMS = {
    "religion": "muslims christians jews hindus buddhists atheists muslime christen juden musulmans chrétiens juifs "
    "musulmanes cristianos judíos",
    "gender": "women men girls boys frauen männer mädchen jungen femmes hommes filles garçons mujeres hombres chicas chicos",
    "origin": "africans asians europeans americans immigrants refugees afrikaner asiaten europäer amerikaner "
    "africains asiatiques européens américains africanos asiáticos europeos americanos",
    "orientation": "gay lesbian bisexual transgender straight schwul lesbisch homosexuel lesbienne lesbiana",
}
GROUP_OF = {term: group for group, terms in IDENTITY_TERMS.items() for term in terms.split()}


def word_features(word: str) -> list[int]:
    """Buckets of a word without marks around it: itself and its beginnings."""
    word = word.strip(MARKS)
    if not word or not word[0].isalpha():
        return []
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(part) % BUCKETS for part in parts]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # BUCKETS, mostly 0
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for words, which, ends in word_tables(texts):
            # Buckets with a weight of each word; a bucket counts once in a text, as in training.
            told = [[b for b in word_features(word) if self.weights[b]] for word in words]
            size = np.fromiter(map(len, told), np.int64, len(told))
            flat, begin = np.array([b for own in told for b in own], np.int64), np.cumsum(size) - size
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            at = np.flatnonzero(size[which])
            word, n = which[at], size[which[at]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(np.repeat(owner[at], n).astype(np.int64) * BUCKETS + flat[np.repeat(begin[word], n) + inner])
            total = np.bincount(pairs // BUCKETS, self.weights[pairs % BUCKETS], len(ends) - 1)
            out.append(sigmoid(self.intercept + total))
        return np.concatenate(out)


def _rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int64), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(int)


def fit(
    present: list[np.ndarray],
    swaps: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    l1: float = 0.0004,
    fairness: float = 1.0,
    rounds: int = 400,
    rate: float = 0.3,
    least: int = 4,
) -> ToxicityModel:
    """Proximal gradient descent, with a step for each weight, on logistic loss + fairness * squared logit changes + l1.

    `present`: buckets of each text's words; `swaps`: buckets that a swap adds and removes;
    buckets in fewer than `least` texts get no weight.
    """
    flat, ends = _rows(present)
    used, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count >= least
    place = np.where(common, np.cumsum(common) - 1, common.sum())  # the last column takes the rare ones
    width = int(common.sum())
    column = place[column]
    at = {int(b): int(p) for b, p in zip(used, place)}
    changes = np.zeros((len(swaps), width + 1))
    for row, (added, removed) in enumerate(swaps):
        for buckets, sign in ((added, 1), (removed, -1)):
            for bucket in buckets:
                changes[row, at.get(int(bucket), width)] += sign
    owner = np.repeat(np.arange(len(y)), np.diff(ends))
    share = np.clip(y.mean(), 0.01, 0.99)
    balance = np.where(y == 1, TOXIC_PART / share, (1 - TOXIC_PART) / (1 - share)) / len(y)
    w, b, squares, squares_b = np.zeros(width + 1), 0.0, np.full(width + 1, 1e-8), 1e-8
    for _ in range(rounds):
        error = (sigmoid(sums_between(w[column], ends) + b) - y) * balance
        gradient = np.bincount(column, error[owner], width + 1)
        if len(swaps):
            gradient += 2 * fairness * changes.T @ (changes @ w) / len(swaps)
        squares += gradient**2
        squares_b += error.sum() ** 2
        step = rate / np.sqrt(squares)
        w = w - step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        w[width] = 0
        b -= rate / np.sqrt(squares_b) * error.sum()
    weights = np.zeros(BUCKETS)
    weights[used[common]] = w[:width]
    return ToxicityModel(weights, float(b))


def counterfactuals(words: set[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What swapping identity terms of a text, or mentioning one, adds to its buckets and takes away."""
    found = [word for word in sorted({w.strip(MARKS) for w in words}) if word in GROUP_OF]
    swaps = []
    for term in found:
        others = [w for w in IDENTITY_TERMS[GROUP_OF[term]].split() if w != term]
        swaps += [(np.array(word_features(other)), np.array(word_features(term))) for other in others]
    return swaps


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000, fairness: float = 1.0) -> ToxicityModel | None:
    """Learn from at most `bound` labelled rows (labels: doc_id, label 0 or 1), in equal parts by label; None without any."""

    def rows_of(batches):
        for batch in batches:
            buckets, terms = [], []
            for words, which, ends in word_tables(batch.column("text")):
                of_word = [word_features(word) for word in words]
                for begin, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    own = set(which[begin:stop].tolist())
                    buckets.append(np.unique(np.array([b for w in own for b in of_word[w]], np.int32)).tobytes())
                    terms.append([words[w] for w in own if words[w].strip(MARKS) in GROUP_OF])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label").cast(pa.int32()),
                    pa.array(buckets, pa.binary()),
                    pa.array(terms, pa.list_(pa.string())),
                ],
                ["doc_id", "label", "buckets", "terms"],
            )

    texts = sampled_texts(docs, bounded_sample(labels, bound), ["label"])
    rows = texts.mapInArrow(rows_of, "doc_id long, label int, buckets binary, terms array<string>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.label, len(r.buckets)))
    swaps = [change for row in rows for change in counterfactuals(set(row.terms))]
    none = np.empty(0, np.int64)
    swaps += [(np.array(word_features(term)), none) for term in GROUP_OF]  # a mention where there was none
    labels_ = np.array([r.label for r in rows], float)
    return fit([np.frombuffer(r.buckets, np.int32) for r in rows], swaps, labels_, fairness=fairness)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score (chance of label 1, 0.5 being even odds) of each row of `docs` (doc_id, text).

    Whole texts count; a null or empty one has the score of a text without words.
    Without a model every score is 0. Repeated rows and null ids give a row each.
    """

    def of(batches):
        for batch in batches:
            texts = batch.column("text")
            found = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(of, "doc_id long, score double")
