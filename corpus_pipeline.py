"""The corpus pipeline: documents to packed training sequences.

Each stage takes what the one before kept. The first two models learn from the labelled
rows, and the languages, of the tables in `sf_dir`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulse.llm import language, mixing, neardup, packing, quality
from pulse.llm.learning import fold
from pulse.llm.queries import documents, labels
from pulse.session import narrow_batches, new_folder

#: A document below this chance of good quality goes.
MIN_QUALITY = 0.5
#: A document whose language is not at least this sure goes.
MIN_LANGUAGE = 0.5
#: Greatest number of times that mixing shows a document, on average over its source.
MAX_REPEATS = 1.5


def accepted(docs: DataFrame, verdicts) -> DataFrame:
    """Rows of `docs` for which `verdicts`, a function from an array of texts to booleans, says yes."""

    def judge(batches):
        for batch in batches:
            keep = np.broadcast_to(verdicts(batch.column("text")), batch.num_rows)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, each judged by its own text, whatever its id. A null text is an empty one."""
    given = labels(spark, sf_dir, "quality").filter(fold("doc_id", 4) != 2)
    model = quality.train(documents(spark, sf_dir), given)
    return accepted(docs, lambda texts: quality.text_scores(texts, model) >= MIN_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language, each judged by its own text; texts without a letter, or of no sure language, go."""
    model = language.train(documents(spark, sf_dir).filter(fold("doc_id", 4) != 2))

    def sure(texts):
        chances, letters = model.scores(texts)
        return letters & (chances.max(axis=1, initial=0) >= MIN_LANGUAGE)

    return accepted(docs, sure if model else lambda texts: False)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a likeness of 0.8 or more."""
    return neardup.drop_near_duplicates(docs, words=5, share=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, rows of small sources again up to the repetition limit, in mixed order."""
    size, slot, shown = (mixing.free_name(docs, name) for name in ("_tokens", "_slot", "_pass"))
    mixed = mixing.mix(mixing.counted(docs, size), size, max_repeats=MAX_REPEATS, columns=(slot, shown))
    return mixed.repartitionByRange(slot).sortWithinPartitions(slot).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, token ids and sequences have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each to the Parquet files of the one before."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "stage")
        with narrow_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
