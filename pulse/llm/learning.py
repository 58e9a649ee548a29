"""What the trained operators share: the rows they may learn from, bounded samples of them, and word tables of texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.tokens import text_runs


#: Bytes of text worked on at once.
RUN_BYTES = 1 << 20
#: The same for word tables; those of their n-grams take up to 100 times as much.
TABLE_BYTES = 1 << 18


def fold(doc_id: str, folds: int):
    """The fold of a document: crc32 of its id as text, modulo `folds`. A null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(-1))


def bounded_sample(labelled: DataFrame, bound: int) -> DataFrame:
    """Of the rows (doc_id, label) at most `bound` with every label in about equal part: those of least hashes of the id.

    An id with several labels counts with the greatest one. Labels are few, their ids are
    not: a label's count tells below which hash about four times its part lies, and only
    ids below are put in order.
    """
    labels = labelled.filter("doc_id is not null and label is not null")
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).collect()
    part = max(1, bound // max(1, len(sizes)))
    hashed = labels.withColumn("hash", F.xxhash64("doc_id"))
    near = F.lit(False)
    for label, n in sizes:
        # At least 64, so that fewer than `part` are left with no chance worth naming.
        share = min(1.0, max(64, 4 * part) / n)
        below = min(2**63 - 1, int(-(2.0**63) + share * 2.0**64))
        near = near | ((F.col("label") == F.lit(label)) & (F.col("hash") <= below))
    place = F.row_number().over(Window.partitionBy("label").orderBy("hash", "doc_id"))
    return hashed.filter(near).withColumn("place", place).filter(F.col("place") <= part).drop("place", "hash")


def sampled_texts(docs: DataFrame, sample: DataFrame, names: list[str]) -> DataFrame:
    """Rows of `docs` that the sample names, with its columns `names`. The sample is bounded, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", *names)), "doc_id")


def word_tables(texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For runs of texts: distinct lower-case words, the number of each word in turn, where each text begins and ends.

    Words are parted by white space; empty ones stand where it begins or ends a text.
    """
    for run in text_runs(texts, TABLE_BYTES):
        lists = pc.utf8_split_whitespace(pc.utf8_lower(run))
        coded = lists.flatten().dictionary_encode()
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        yield words, coded.indices.to_numpy(zero_copy_only=False), ends


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` between consecutive ends."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return np.diff(total[ends], axis=0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
