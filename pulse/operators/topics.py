"""TF-IDF features, topic model, topic clusters and the combined text job."""

import sys
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pulse.functions import params
from pulse.functions import words as W
from pulse.functions.columns import mean, preview, sentiment_sign
from pulse.functions.lexicons import STOP_WORDS
from pulse.operators.clusters import assigned, best_clustering
from pulse.operators.scoring import extract_entities, score_emotions, score_mood, score_sentiment
from pulse.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
STARTS = 10
#: About so many words are counted together before their counts are shuffled.
COUNTED_WORDS = 1 << 20
#: Up to so many words that a wanted pair may hold travel to the tasks; with more, all pairs are counted.
MAX_CARRIED_WORDS = 100_000


def _with_tokens(df: DataFrame, text: str, stop_words=STOP_WORDS) -> DataFrame:
    """Add `_tokens`, the words of `terms`."""
    bare = df.withColumn("_bare", W.without_urls(text))
    tokens = W.without_stop_words(W.words(W.long_enough("_bare"), 2), stop_words, lower=False)
    return bare.withColumn("_tokens", tokens).drop("_bare")


def _terms() -> Column:
    return F.concat("_tokens", W.pairs(F.col("_tokens")))


def with_terms(df: DataFrame, text: str = "content", stop_words=STOP_WORDS) -> DataFrame:
    """Add `terms`: words of two or more characters without stop words, then neighbouring pairs."""
    return _with_tokens(df, text, stop_words).withColumn("terms", _terms()).drop("_tokens")


def _runs(batches):
    """(words, codes, owners) of runs of texts with about `COUNTED_WORDS` words: the distinct ones, and for each use its place there and its text."""
    for batch in batches:
        texts = batch.column(0)
        sizes = texts.value_lengths().fill_null(0).to_numpy()
        run = np.cumsum(sizes) // COUNTED_WORDS
        borders = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        for begin, stop in pairwise(borders):
            coded = texts.slice(begin, stop - begin).flatten().dictionary_encode(null_encoding="encode")
            if len(coded):
                codes = coded.indices.to_numpy().astype(np.int64)
                yield coded.dictionary, codes, np.repeat(np.arange(stop - begin), sizes[begin:stop])


def _counts(terms: pa.Array, codes: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """(term, tf, df) of uses `codes` of `terms` in the texts `owners`."""
    uses = np.sort(owners * len(terms) + codes)
    once = uses[np.append(True, uses[1:] != uses[:-1])] % len(terms)  # each term of a text once
    counts = [pa.array(np.bincount(found, minlength=len(terms))) for found in (codes, once)]
    return pa.RecordBatch.from_arrays([terms, *counts], ["term", "tf", "df"])


def _word_counts(batches):
    for words, codes, owners in _runs(batches):
        yield _counts(words, codes, owners)


def _pair_counts(frequent: list | None):
    """Function that counts the neighbouring pairs of words, of `frequent` words if that is a list."""

    def count(batches):
        for words, codes, owners in _runs(batches):
            wanted = owners[:-1] == owners[1:]
            if frequent is not None:
                known = pc.is_in(words, value_set=pa.array(frequent, pa.string())).to_numpy(zero_copy_only=False)[codes]
                wanted &= known[:-1] & known[1:]
            if wanted.any():
                pairs = (codes[:-1] * len(words) + codes[1:])[wanted]
                found, places = np.unique(pairs, return_inverse=True)
                first, second = (words.take(pa.array(part)) for part in divmod(found, len(words)))
                yield _counts(pc.binary_join_element_wise(first, second, " "), places, owners[:-1][wanted])

    return count


def tfidf_vocabulary(df: DataFrame, max_terms=1000, min_df=2, max_df=0.8, n: int | None = None) -> DataFrame:
    """The most used terms with corpus count, document count and smoothed idf.

    `df` has `terms` as `with_terms` makes them. Each task counts the terms of many texts at
    once, so that a row is shuffled for a term of a run of texts and not for each use. Words
    are counted first. A pair is used no more than either of its words, so if there are
    `max_terms` words to choose, only pairs of words used as often as the last of these are
    counted: no other can be chosen. `n` is the number of texts if known.
    """
    words = df.select(F.slice("terms", F.lit(1), F.ceil(F.size("terms") / 2).cast("int")).alias("words"))
    counts, found = _counted_words(words)
    return _vocabulary(words, counts, found if n is None else n, max_terms, min_df, max_df)


def _counted(words: DataFrame, count) -> DataFrame:
    return words.mapInArrow(count, "term string, tf long, df long").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df")
    )


def _counted_words(words: DataFrame) -> tuple[DataFrame, int]:
    """(term, tf, df) of the words, and the number of texts; one pass over the texts for both."""
    texts = Observation()
    counts = cut_lineage(_counted(words.observe(texts, F.count("*").alias("n")), _word_counts))
    return counts, texts.get["n"] if texts._jo.getRow().length() else 0  # an empty plan observes nothing


def _vocabulary(words: DataFrame, counts: DataFrame, n: int, max_terms: int, min_df: int, max_df: float) -> DataFrame:
    """`tfidf_vocabulary` of texts of `words`, of which `counts` has (term, tf, df)."""

    def allowed(counts):
        return counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))

    most = allowed(counts).orderBy(F.desc("tf")).limit(max_terms)
    chosen, least = most.agg(F.count("*"), F.min("tf")).first()
    least = max(min_df, least if chosen and chosen == max_terms else 0)
    frequent = [word for word, in counts.filter(F.col("tf") >= least).select("term").limit(MAX_CARRIED_WORDS + 1).collect()]
    pairs = _counted(words, _pair_counts(frequent if len(frequent) <= MAX_CARRIED_WORDS else None))
    return (
        allowed(counts.union(pairs))
        .orderBy(F.desc("tf"), "term")
        .limit(max_terms)
        .withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)
    )


def tfidf_features(df: DataFrame, vocabulary: list) -> DataFrame:
    """Add `features`, the L2-normed tf-idf vector. The vocabulary is short by `max_terms`, so each
    text is mapped on its own and nothing is shuffled."""
    counts = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in vocabulary], inputCol="terms", outputCol="_tf"
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([row["idf"] for row in vocabulary]), inputCol="_tf", outputCol="_tfidf"
    )
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    return norm.transform(weigh.transform(counts.transform(df))).drop("_tf", "_tfidf")


@dataclass
class Topics:
    """terms: (topic_id, rank, term, weight); sizes: (topic_id, document_count);
    samples: (topic_id, rank, key, text); assignments: (key, topic_id)."""

    terms: DataFrame
    sizes: DataFrame
    samples: DataFrame
    assignments: DataFrame


def extract_topics(
    df: DataFrame, num_topics=5, text="content", key="post_id", max_terms=1000, min_df=2, max_df=0.8,
    top_terms=10, sample_texts=3, starts=STARTS,
) -> Topics:
    """Cluster texts by tf-idf; of several starts the tightest clustering is kept."""
    texts = _with_tokens(df.select(key, text), text)
    words = texts.select(F.col("_tokens").alias("words"))
    counts, n = _counted_words(words)
    if n < 2:
        raise ValueError("need at least 2 texts")
    vocabulary = _vocabulary(words, counts, n, max_terms, min_df, max_df).orderBy("term").collect()
    if not vocabulary:
        raise ValueError("no terms left to tell texts apart")
    features = tfidf_features(texts.withColumn("terms", _terms()), vocabulary).select(key, "features").persist()
    spark = df.sparkSession
    try:
        best = best_clustering(features, min(num_topics, n // 2), [SEED + i for i in range(starts)])
        # Written while the features are held; sizes, samples and clusters read the small result.
        found = cut_lineage(assigned(features, best, key, "topic_id"))
    finally:
        features.unpersist()

    rows = []
    for topic, centre in enumerate(best.centres):
        heaviest = sorted(range(len(centre)), key=lambda j: (-centre[j], vocabulary[j]["term"]))
        rows += [
            (topic, rank + 1, vocabulary[j]["term"], float(centre[j]))
            for rank, j in enumerate(heaviest[:top_terms])
        ]
    terms = spark.createDataFrame(rows, "topic_id int, rank int, term string, weight double")
    first = F.row_number().over(Window.partitionBy("topic_id").orderBy(key))
    chosen = found.withColumn("rank", first).filter(F.col("rank") <= sample_texts)
    # k times sample_texts rows, so the texts need no shuffle
    samples = df.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    sizes = found.groupBy("topic_id").agg(F.count("*").alias("document_count"))
    return Topics(terms, sizes, samples, found)


def topic_clusters(posts: DataFrame, topics: Topics, key="post_id", top: int = 5) -> DataFrame:
    """Per cluster: its leading terms, size, mean signed sentiment and platforms."""
    about = posts.join(topics.assignments, key).groupBy("topic_id").agg(
        F.count("*").alias("size"),
        mean(sentiment_sign()).alias("avg_sentiment"),
        F.sort_array(F.collect_set("platform")).alias("platforms"),
    )
    leading = (
        topics.terms.filter(F.col("rank") <= top)
        .groupBy("topic_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term")))["term"].alias("topics"))
    )
    return about.join(leading, "topic_id").withColumnRenamed("topic_id", "cluster_id")


def batch_process(
    df: DataFrame, operations, lexicon: DataFrame, emotions: DataFrame, dictionary: DataFrame,
    text="content", key="post_id", num_topics=5,
) -> DataFrame:
    """Any of the text jobs over one table: one row per text with a preview and an `error` for blank ones."""
    operations = params.all_of(operations, params.TEXT_OPERATIONS, "operations")
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    marked = df.select(key, text).withColumn("error", F.when(blank, "blank text"))
    good = marked.filter(F.col("error").isNull())
    out = marked.select(key, preview(text).alias("original_text"), "error")
    if "sentiment" in operations and "emotions" in operations:
        out = out.join(score_mood(good, lexicon, emotions, text, key), key, "left")
    elif "sentiment" in operations:
        out = out.join(score_sentiment(good, lexicon, text, key), key, "left")
    elif "emotions" in operations:
        out = out.join(score_emotions(good, emotions, text, key), key, "left")
    if "entities" in operations:
        found = extract_entities(good, dictionary, text, key)
        out = out.join(found.select(key, "entities", "entity_count"), key, "left")
    if "topics" in operations:
        out = out.join(extract_topics(good, num_topics, text, key).assignments, key, "left")
    return out


def batch_summary(processed: DataFrame) -> DataFrame:
    return processed.agg(
        F.count("*").alias("total_texts"),
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
    )
