"""Text expressions. Word characters are Unicode letters, digits and `_`."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse.functions.lexicons import STOP_WORDS

# Fixed values
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
URL = r"https?://[$-_a-z!]+"
HASHTAG = rf"#{WORD}+"
MENTION = rf"@{WORD}+"
PUNCTUATION = r"[\p{P}\p{S}]"
MONEY = r"\$[0-9]+(?:\.[0-9]+)?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
SHORT_TEXT = "neutral text"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_matches(c, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def without_urls(c="content") -> Column:
    return F.regexp_replace(_col(c), URL, "")


def long_enough(c) -> Column:
    """Text without URLs, or the fixed phrase where `cleaned` puts it. Its words are those of `cleaned`, and its whitespace stays.

    `collapse` leaves 3 characters or more where two that are no space have any between them. `c` is read
    more than once, so it should be a column.
    """
    some = f"[^{SPACE[1:]}"
    fits = F.rlike(_col(c), F.lit(f"(?s){some}.+?{some}"))
    return F.when(fits, _col(c)).when(_col(c).isNotNull(), SHORT_TEXT)


def cleaned(c="content") -> Column:
    """Text without URLs and extra whitespace; a fixed phrase if fewer than 3 characters are left."""
    text = collapse(without_urls(c))
    # a pattern instead of a condition, so that the text is cleaned once
    return F.regexp_replace(text, r"(?s)\A.{0,2}\z", SHORT_TEXT)


def words(c="content", shortest: int = 1) -> Column:
    return all_matches(F.lower(_col(c)), f"{WORD}{{{shortest},}}")


def without_stop_words(tokens: Column, stop_words=STOP_WORDS, lower: bool = True) -> Column:
    """Drop stop words; `lower=False` if the tokens are lower-case already."""
    return F.filter(tokens, lambda t: ~(F.lower(t) if lower else t).isin(*stop_words))


def pairs(tokens: Column) -> Column:
    """Neighbouring elements joined by a blank."""
    joined = F.zip_with(
        tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.filter(joined, lambda p: p.isNotNull())


def triples(tokens: Column) -> Column:
    joined = F.zip_with(
        pairs(tokens), F.slice(tokens, 3, F.greatest(F.size(tokens), F.lit(1))),
        lambda ab, c: F.concat(ab, F.lit(" "), c),
    )
    return F.filter(joined, lambda p: p.isNotNull())
