"""Per-row text columns; every operator is a projection and shuffles nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions import words as W
from pulse.functions.lexicons import STOP_WORDS


def clean_text(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("cleaned", W.cleaned(text))


def text_lengths(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumns(
        {"text_length": F.length(text), "cleaned_text_length": F.length(W.cleaned(text))}
    )


def extract_tags(df: DataFrame, text: str = "content") -> DataFrame:
    """Hashtags and mentions with their `#` and `@`."""
    return df.withColumns(
        {"found_hashtags": W.all_matches(text, W.HASHTAG), "found_mentions": W.all_matches(text, W.MENTION)}
    )


def extract_urls(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("found_urls", W.all_matches(text, W.URL))


def ingest_tags(df: DataFrame, text: str = "content") -> DataFrame:
    """Tags as ingestion reads them: words that start with the mark, without it, punctuation kept."""
    split = df.withColumn("_tokens", F.split(W.collapse(text), " "))

    def marked(mark):
        found = F.filter("_tokens", lambda t: t.startswith(mark))
        return F.transform(found, lambda t: F.substring(t, 2, 2**31 - 1))

    return split.withColumns({"hashtags": marked("#"), "mentions": marked("@")}).drop("_tokens")


def preprocess(
    df: DataFrame,
    text: str = "content",
    remove_urls: bool = True,
    remove_mentions: bool = False,
    remove_hashtags: bool = False,
    remove_punctuation: bool = False,
    lowercase: bool = False,
    remove_stopwords: bool = False,
    min_length: int = 3,
    max_length: int = 5000,
    stop_words=STOP_WORDS,
) -> DataFrame:
    """Add `processed` and `length_ok`; rows of another length are marked and kept."""
    out = F.col(text)
    for wanted, pattern in (
        (remove_urls, W.URL),
        (remove_mentions, W.MENTION),
        (remove_hashtags, W.HASHTAG),
        (remove_punctuation, W.PUNCTUATION),
    ):
        out = F.regexp_replace(out, pattern, "") if wanted else out
    out = W.collapse(F.lower(out) if lowercase else out)
    if remove_stopwords:
        out = F.array_join(W.without_stop_words(F.split(out, " "), stop_words), " ")
    return df.withColumn("processed", out).withColumn(
        "length_ok", F.length("processed").between(min_length, max_length)
    )


def content_tokens(df: DataFrame, text: str = "content", first: int = 50, stop_words=STOP_WORDS):
    """The first words that are not stop words, in their own case."""
    tokens = W.without_stop_words(W.all_matches(text, f"{W.WORD}+"), stop_words)
    return df.withColumn("tokens", F.slice(tokens, 1, first))
