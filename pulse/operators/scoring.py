"""Sentiment, emotion and entity jobs over a table of texts."""

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import params
from pulse.functions import words as W
from pulse.functions.lookups import join_hot, sized
from pulse.operators.phrases import with_phrases
from pulse.schemas import ENTITIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANCHORS = 64


def _lexicon_sums(df: DataFrame, lexicons: dict, text: str, key: str) -> DataFrame:
    """Per text, the weight of its words in each group of each lexicon.

    `lexicons` maps a group column to its lexicon and the groups to sum; the
    texts are read once for all. Only words of a lexicon survive the join.
    Each text also carries one anchor word with weight zero, so that texts
    without any hit stay, and only (key, sums) is shuffled. Anchors are spread
    over several words to keep them from being one hot join key.
    """
    anchor = F.concat(F.lit(" "), F.pmod(F.xxhash64(key), F.lit(ANCHORS)).cast("string"))
    tokens = df.select(
        key, F.explode(F.concat(W.words(W.cleaned(text)), F.array(anchor))).alias("word")
    )
    entries = df.sparkSession.range(ANCHORS).select(
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("word"),
        F.lit(None).cast("string").alias("group"),
        F.lit(0.0).alias("weight"),
    )
    for column, (lexicon, _) in lexicons.items():
        entries = entries.unionByName(lexicon.select("word", F.col(column).alias("group"), "weight"))
    groups = [name for _, names in lexicons.values() for name in names]
    sums = [F.sum(F.when(F.col("group") == name, F.col("weight")).otherwise(0.0)).alias(name) for name in groups]
    return tokens.join(sized(entries), "word").groupBy(key).agg(*sums)


def _sentiment_columns() -> dict[str, Column]:
    p, n = F.col("positive"), F.col("negative")
    total = p + n + 1.0
    label = F.when((p > n) & (p > 1.0), "positive").when((n > p) & (n > 1.0), "negative").otherwise("neutral")
    return {
        "sentiment": label,
        "sentiment_confidence": F.greatest(p, n, F.lit(1.0)) / total,
        "positive": p / total,
        "negative": n / total,
        "neutral": 1.0 / total,
    }


def _emotion_columns() -> dict[str, Column]:
    names = params.EMOTIONS
    total = sum((F.col(name) for name in names[1:]), F.col(names[0]))
    shares = F.array(*[F.struct(F.lit(name).alias("key"), F.try_divide(name, total).alias("value")) for name in names])
    return {"emotions": F.map_from_entries(F.filter(shares, lambda e: e["value"] > 0))}


def _scored(df, text, key, lexicon=None, emotions=None) -> DataFrame:
    lexicons, columns = {}, {}
    if lexicon is not None:
        lexicons["sentiment"] = (lexicon, params.SENTIMENTS[:2])
        columns.update(_sentiment_columns())
    if emotions is not None:
        lexicons["emotion"] = (emotions, params.EMOTIONS)
        columns.update(_emotion_columns())
    sums = _lexicon_sums(df, lexicons, text, key)
    return sums.select(key, *[column.alias(name) for name, column in columns.items()])


def score_sentiment(df: DataFrame, lexicon: DataFrame, text="content", key="post_id") -> DataFrame:
    """Shares of positive, negative and neutral; p/(p+n+1), n/(p+n+1), 1/(p+n+1). Ties are neutral."""
    return _scored(df, text, key, lexicon=lexicon)


def score_emotions(df: DataFrame, lexicon: DataFrame, text="content", key="post_id") -> DataFrame:
    """Map of emotion to share, summing to 1; empty for texts without any emotion word."""
    return _scored(df, text, key, emotions=lexicon)


def score_mood(df, lexicon: DataFrame, emotions: DataFrame, text="content", key="post_id") -> DataFrame:
    """`score_sentiment` and `score_emotions` in one pass over the texts."""
    return _scored(df, text, key, lexicon, emotions)


MARK, OTHER_MARK = "\uffff", "\ufffe"

# Regex, label, description, weight.
ENTITY_PATTERNS = [
    (W.MONEY, "MONEY", "Monetary values, including unit", 0.7),
    (W.DATE, "DATE", "Absolute or relative dates or periods", 0.7),
]


def _info(label, description, weight) -> Column:
    return F.struct(
        F.lit(label).alias("label"), F.lit(description).alias("description"), F.lit(weight).alias("weight")
    )


def _located(text: Column, pattern: str, info: Callable[[Column], Column]) -> Column:
    """Every match of `pattern` as an entity with its offsets, counted in characters.

    Matches are replaced by a mark that is no character and the text is split
    there; an offset is the length of all pieces and matches before it, summed up once.
    """
    pattern = F.lit(pattern)
    marked = F.regexp_replace(F.translate(text, MARK, OTHER_MARK), pattern, F.lit(MARK))
    split = F.struct(
        F.split(marked, MARK, -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found")
    )

    def starts(at):
        spans = F.zip_with(
            F.slice(at["pieces"], 1, F.size(at["found"])), at["found"],
            lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size")),
        )
        none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))

        def add(sum_, span):
            start = sum_["end"] + span["gap"]
            return F.struct(
                (start + span["size"]).alias("end"), F.concat(sum_["starts"], F.array(start)).alias("starts")
            )

        return F.aggregate(spans, none, add, lambda sum_: sum_["starts"])

    def entity(match, start):
        about = info(match)
        return F.struct(
            match.alias("text"), about["label"].alias("label"), about["description"].alias("description"),
            start.alias("start"), (start + F.length(match)).alias("end"), about["weight"].alias("confidence"),
        )

    def entities(at):
        return F.zip_with(at["found"], starts(at), entity)

    hit = F.when(F.regexp_like(text, pattern), F.array(split)).otherwise(F.array())
    return F.flatten(F.transform(hit, entities)).cast(ENTITIES)


def extract_entities(df: DataFrame, dictionary: DataFrame, text="content", key="post_id") -> DataFrame:
    """Add `entities` (by start) and `entity_count`: dictionary phrases, amounts of money and dates.

    Phrases follow the rule of `with_phrases`.
    """
    body = F.col(text)
    parts = [
        _located(body, pattern, lambda match, about=about: _info(*about)) for pattern, *about in ENTITY_PATTERNS
    ]
    df = with_phrases(df, dictionary, text, key, "_found")
    parts.append(F.col("_found"))
    order = F.array_sort(
        F.concat(*parts),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], a["end"] - b["end"])
        .when(a["label"] < b["label"], -1)
        .when(a["label"] > b["label"], 1)
        .otherwise(0),
    )
    return df.withColumn("entities", order).drop("_found").withColumn("entity_count", F.size("entities"))


def entity_topics(df: DataFrame) -> DataFrame:
    """Add `topics`: lower-cased names of organisations, products, events and people."""
    wanted = F.filter("entities", lambda e: e["label"].isin("ORG", "PRODUCT", "EVENT", "PERSON"))
    names = F.array_distinct(F.transform(wanted, lambda e: F.lower(e["text"])))
    return df.withColumn("topics", F.sort_array(names))


def score_distinct(
    df: DataFrame, scorer: Callable[[DataFrame, str, str], DataFrame], text="content", key="post_id"
) -> DataFrame:
    """Score each distinct text once and give (key, scores) to all rows that hold a copy.

    Texts are matched by their SHA-256, so the rows meet the scores without
    their text, and a text that very many rows share is spread over tasks.
    """
    keyed = df.withColumn("_text_key", F.sha2(text, 256))
    once = keyed.select("_text_key", text).distinct()
    scores = scorer(once, text, "_text_key")
    return join_hot(keyed.select(key, "_text_key"), scores, "_text_key", key).drop("_text_key")


def apply_scorer(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int = 32
) -> DataFrame:
    """Run a pandas scorer, such as a model, on small batches inside each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                yield fn(pdf.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)
