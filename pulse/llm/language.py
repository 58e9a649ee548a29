"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams (operator 2)."""

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.learning import bounded_sample, sampled_texts, sums_between, word_tables
from pulse.llm.shingles import GOLDEN, mixed

BUCKETS = 1 << 15
LONGEST = 4
UNKNOWN = "und"
#: Features are shares of a text's n-grams times their idf; this makes them about as large as counts.
SCALE = 100.0


def n_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- to 4-grams of each word with its borders, and where each word's begin and end.

    A word without a letter has none.
    """
    # Every word stands behind a space of its own; a gram may touch a space with its first or last character only.
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    owner = np.cumsum(space) - 1
    letters = np.fromiter((word.isalpha() or any(map(str.isalpha, word)) for word in words), bool, len(words))
    usable = np.append(letters, False)[np.minimum(owner, len(words))]
    grams = np.zeros((len(points), LONGEST), np.uint64)
    valid = np.zeros((len(points), LONGEST), bool)
    valid[:, 0] = ~space & usable
    grams[:, 0] = mixed(points)
    inner = usable.copy()  # no space among the gram's characters but the first and last
    for n in range(2, LONGEST + 1):
        stop = len(points) - n + 1
        if stop < 1:
            break
        grams[:stop, n - 1] = mixed(grams[:stop, n - 2] * GOLDEN + points[n - 1 :])
        if n > 2:
            inner[:stop] &= ~space[n - 2 : n - 2 + stop]
        valid[:stop, n - 1] = inner[:stop]
    buckets = (grams[valid] % np.uint64(BUCKETS)).astype(np.int32)
    sizes = np.bincount(np.repeat(owner, valid.sum(axis=1)), minlength=len(words))[: len(words)]
    return buckets, np.concatenate([[0], np.cumsum(sizes)])


def documents_grams(texts: pa.Array):
    """For each text the buckets of the n-grams of all its words, in turn."""
    for words, which, ends in word_tables(texts):
        flat, borders = n_grams(words)
        of_word = [flat[a:b] for a, b in pairwise(borders.tolist())]
        for begin, stop in pairwise(ends.tolist()):
            yield which[begin:stop], of_word


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 rows, the last one the intercept, by language
    temperature: float = 1.0

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each language by text, and whether the text has a letter."""
        table = self.idf[:, None] * self.weights[:-1] * SCALE
        out, letters = [np.empty((0, len(self.languages)))], [np.empty(0, bool)]
        for words, which, ends in word_tables(texts):
            flat, borders = n_grams(words)
            per_word = sums_between(table[flat], borders)
            total = sums_between(np.diff(borders)[which], ends)
            logits = sums_between(per_word[which], ends) / np.maximum(total, 1)[:, None] + self.weights[-1]
            out.append(softmax(logits / self.temperature))
            letters.append(total > 0)
        return np.concatenate(out), np.concatenate(letters)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each bucket occurs. All documents count."""

    def count(batches):
        total, df = 0, np.zeros(BUCKETS, np.int64)
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            for which, of_word in documents_grams(batch.column("text")):
                if len(which):
                    seen[:] = False
                    seen[np.concatenate([of_word[word] for word in set(which.tolist())])] = True
                    df += seen
                total += 1
        used = np.flatnonzero(df)
        buckets, counts = [-1, *used.tolist()], [total, *df[used].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(counts, pa.int64())], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = dict(counts.collect())  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS)
    for bucket, n in found.items():
        if bucket >= 0:
            df[bucket] = n
    return found.get(-1, 0), df


def sample_vectors(texts: DataFrame) -> list:
    """(label, buckets, shares) of the sampled texts that have a letter."""

    def vectors(batches):
        for batch in batches:
            labels, indices, shares = [], [], []
            for label, (which, of_word) in zip(batch.column("label").to_pylist(), documents_grams(batch.column("text"))):
                flat = np.concatenate([np.empty(0, np.int32), *(of_word[word] for word in which.tolist())])
                if len(flat):
                    found, n = np.unique(flat, return_counts=True)
                    labels.append(label)
                    indices.append(found.astype(np.int32).tobytes())
                    shares.append((n / len(flat)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(labels, pa.string()),
                    pa.array(indices, pa.binary()),
                    pa.array(shares, pa.binary()),
                ],
                ["label", "indices", "shares"],
            )

    rows = texts.mapInArrow(vectors, "label string, indices binary, shares binary").collect()
    return [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in rows]


def follow_the_leader(
    vectors: list, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int
) -> np.ndarray:
    """FTRL-proximal weights of a multinomial logistic regression with elastic-net penalties.

    A weight follows from its sum of gradients z and of their squares n; it stays 0 until |z| passes l1.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(rows):
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[rows])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(vectors)):
            label, index, x = vectors[k]
            index, x = np.append(index, BUCKETS), np.append(x, 1.0)
            w = weights(index)
            error = softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error
            sigma = (np.sqrt(n[index] + gradient**2) - np.sqrt(n[index])) / alpha
            z[index] += gradient - sigma * w
            n[index] += gradient**2
    return weights(np.arange(BUCKETS + 1))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, on a fine grid of powers."""
    best = (np.inf, 1.0)
    for temperature in 2.0 ** np.arange(-1, 4.01, 0.1):
        p = softmax(logits / temperature)[np.arange(len(labels)), labels]
        best = min(best, (-np.log(np.maximum(p, 1e-300)).mean(), temperature))
    return float(best[1])


def train(
    docs: DataFrame,
    bound: int = 1536,
    epochs: int = 2,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 7,
) -> LanguageModel | None:
    """Learn from the rows of `docs` (doc_id, text, lang); None if no row has a language and a letter.

    Document frequencies count all rows. The weights learn from at most `bound` of
    them, in equal parts by language; a quarter of these only sets the temperature.
    """
    docs = docs.filter("lang is not null")
    sample = bounded_sample(docs.select("doc_id", F.col("lang").alias("label")), bound)
    rows = sample_vectors(sampled_texts(docs, sample, ["label"]))
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    languages = sorted({label for label, _, _ in rows})
    total, df = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    vectors = [(languages.index(label), i, x * idf[i] * SCALE) for label, i, x in rows]
    held = [v for k, v in enumerate(vectors) if k % 4 == 3]
    kept = [v for k, v in enumerate(vectors) if k % 4 != 3]
    weights = follow_the_leader(kept, len(languages), epochs, alpha, beta, l1, l2, seed)
    model = LanguageModel(languages, idf, weights)
    if held:
        logits = np.array([x @ weights[i] + weights[-1] for _, i, x in held])
        model.temperature = calibrate(logits, np.array([label for label, _, _ in held]))
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """`docs` (doc_id, text) with lang_pred and score, the probability of that language.

    Whole texts count. A null text, or one without a letter, or any without a model,
    is `und` with score 0. Ties go to the first language by name. Repeated rows and null ids give a row each.
    """

    def predict(batches):
        for batch in batches:
            texts = batch.column("text")
            if model is None:
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p, letters = model.scores(texts)
                best = [model.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), letters)]
                score = np.where(letters, p.max(axis=1, initial=0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
