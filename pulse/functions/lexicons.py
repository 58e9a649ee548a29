"""Small literal tables for text scoring. Pass your own table of the same columns for another domain."""

from pyspark.sql import DataFrame, SparkSession

# Fixed values
SENTIMENT_WORDS = {
    "positive": {
        "amazing": 2.0, "awesome": 2.0, "beautiful": 1.5, "best": 2.0, "brilliant": 2.0,
        "excellent": 2.0, "fantastic": 2.0, "fun": 1.0, "glad": 1.0, "good": 1.5, "great": 2.0,
        "happy": 1.5, "incredible": 2.0, "like": 0.5, "love": 2.0, "nice": 1.0, "outstanding": 2.0,
        "perfect": 2.0, "thanks": 1.0, "useful": 1.0, "wonderful": 2.0,
    },
    "negative": {
        "angry": 1.5, "annoying": 2.0, "awful": 2.0, "bad": 1.5, "boring": 1.0, "broken": 2.0,
        "bug": 1.0, "disappointing": 2.0, "fail": 1.5, "frustrating": 2.0, "hate": 2.0,
        "horrible": 2.0, "poor": 1.0, "sad": 1.5, "slow": 1.0, "terrible": 2.0, "ugly": 1.5,
        "useless": 2.0, "worst": 2.0, "worthless": 2.0, "wrong": 1.0,
    },
    "neutral": {"average": 1.0, "normal": 1.0, "okay": 1.0, "standard": 1.0, "typical": 1.0, "usual": 1.0},
}
# Fixed values
EMOTION_WORDS = {
    "joy": {"fun": 1.0, "glad": 1.0, "great": 1.0, "happy": 2.0},
    "sadness": {"cry": 1.0, "disappointing": 1.0, "sad": 2.0},
    "anger": {"angry": 2.0, "annoying": 1.0, "broken": 1.0, "hate": 1.0},
    "fear": {"afraid": 2.0, "scary": 1.0, "worried": 1.0},
    "surprise": {"amazing": 1.0, "great": 0.5, "incredible": 1.0, "wow": 2.0},
    "disgust": {"awful": 1.0, "broken": 0.5, "gross": 2.0, "horrible": 1.0},
    "love": {"adore": 2.0, "love": 2.0},
}
# Phrase of one to three lower-case words, label, description, weight.
ENTITY_PHRASES = [
    ("acme corp", "ORG", "Companies, agencies, institutions", 0.9),
    ("jane doe", "PERSON", "People, including fictional", 0.85),
    ("new york", "GPE", "Countries, cities, states", 0.9),
    ("london", "GPE", "Countries, cities, states", 0.9),
    ("tokyo", "GPE", "Countries, cities, states", 0.9),
    ("nova phone", "PRODUCT", "Objects, vehicles, foods", 0.8),
    ("open data summit", "EVENT", "Named events", 0.8),
]
# Fixed values
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each even few for from further "
    "had has have having he her here hers him his how i if in into is it its itself just me more most "
    "my no nor not now of off on once only or other our ours out over own same she should so some such "
    "than that the their theirs them then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with would you your yours"
).split()


def _pairs(groups):
    return [(word, group, weight) for group, words in groups.items() for word, weight in words.items()]


def sentiment_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(SENTIMENT_WORDS), "word string, sentiment string, weight double")


def emotion_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(EMOTION_WORDS), "word string, emotion string, weight double")


def entity_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ENTITY_PHRASES, "phrase string, label string, description string, weight double"
    )
