"""Phrases of a dictionary, found in texts by one walk over their words."""

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import words as W
from pulse.functions.lookups import sized
from pulse.schemas import ENTITIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Up to so many phrases travel to the tasks as one automaton; a longer dictionary is joined.
MAX_CARRIED_PHRASES = 50_000
#: The word characters of `W.WORD`; `str.isspace` holds for those of `W.SPACE`.
_WORD = re.compile(r"(\w+)")


def _fold(text: str) -> str:
    return text.lower().replace("ς", "σ")


def _collapsed(gap: str) -> str:
    return re.sub(r"\s+", " ", _fold(gap))


def compile_phrases(entries) -> tuple:
    """Automaton of `entries` (phrase, label, description, weight).

    A state is a node of the trie of the phrases' words: `goto` maps a word to the next
    node, `fail` is the longest proper suffix that is a node too, `link` the nearest
    such suffix at which a phrase ends, `out` the phrases that end at a node with what
    stands before, between and after their words. Phrases without a word are left out.
    """
    goto, out = [{}], [[]]
    for phrase, *about in entries:
        parts = _WORD.split(" ".join((phrase or "").split()))
        if len(parts) == 1:
            continue
        state = 0
        for word in map(_fold, parts[1::2]):
            if word not in goto[state]:
                goto[state][word] = len(goto)
                goto.append({})
                out.append([])
            state = goto[state][word]
        out[state].append((tuple(map(_fold, parts[::2])), tuple(about)))
    fail, link = [0] * len(goto), [0] * len(goto)
    queue = list(goto[0].values())
    for state in queue:
        link[state] = fail[state] if out[fail[state]] else link[fail[state]]
        for word, after in goto[state].items():
            back = fail[state]
            while back and word not in goto[back]:
                back = fail[back]
            fail[after] = goto[back].get(word, 0)
            queue.append(after)
    return goto, fail, link, out


def _taken(gap: str, wanted: str) -> int | None:
    """How many characters at the start of `gap` are `wanted`, a blank of which stands for a run of space."""
    at = 0
    for char in wanted:
        begin = at
        while char == " " and at < len(gap) and gap[at].isspace():
            at += 1
        if char != " " and at < len(gap) and _fold(gap[at]) == char:
            at += 1
        if at == begin:
            return None
    return at


def find_phrases(text: str, machine: tuple) -> list[tuple]:
    """(start, end, about) of every phrase in `text`; matches of one phrase do not overlap."""
    goto, fail, link, out = machine
    spans, ends, state = [], [], 0
    for match in _WORD.finditer(text):
        word = _fold(match.group())
        while state and word not in goto[state]:
            state = fail[state]
        state = goto[state].get(word, 0)
        hit = state if out[state] else link[state]
        while hit:
            ends.append((len(spans), hit))
            hit = link[hit]
        spans.append(match.span())

    found, free = [], {}
    for last, hit in ends:
        before_next = spans[last + 1][0] if last + 1 < len(spans) else len(text)
        behind = text[spans[last][1] : before_next]
        for number, (gaps, about) in enumerate(out[hit]):
            first = last - len(gaps) + 2
            inner = all(
                _collapsed(text[spans[first + k - 1][1] : spans[first + k][0]]) == gaps[k]
                for k in range(1, len(gaps) - 1)
            )
            if not inner:
                continue
            ahead = text[spans[first - 1][1] if first else 0 : spans[first][0]]
            left, right = _taken(ahead[::-1], gaps[0][::-1]), _taken(behind, gaps[-1])
            if left is None or right is None:
                continue
            # A word character right before or after the match would be the end of the neighbouring word.
            if (left and left == len(ahead) and first) or (right and right == len(behind) and before_next < len(text)):
                continue
            start, end = spans[first][0] - left, spans[last][1] + right
            if start >= free.get((hit, number), 0):
                free[hit, number] = end
                found.append((start, end, about))
    return found


_FOUND = pa.struct(
    [
        ("text", pa.string()), ("label", pa.string()), ("description", pa.string()),
        ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()),
    ]
)


def _entities(texts, machines) -> pa.Array:
    """Entities of each text by its automaton; a null text has none."""
    offsets, rows = [0], []
    for text, machine in zip(texts, machines):
        if text:
            for start, end, (label, description, weight) in find_phrases(text, machine):
                rows.append((text[start:end], label, description, start, end, weight))
        offsets.append(len(rows))
    columns = zip(*rows) if rows else [[]] * len(_FOUND)
    parts = [pa.array(values, field.type) for values, field in zip(columns, _FOUND)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_FOUND)))


def _carried(entries: list) -> Column:
    """Function of a text with the automaton of all phrases."""
    machine = compile_phrases(entries)

    @F.arrow_udf(ENTITIES)
    def find(texts: pa.Array) -> pa.Array:
        return _entities((text.as_py() for text in texts), (machine for _ in texts))

    return find


def _held(dictionary: DataFrame, df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, `_held`) of the phrases whose words a text holds in order, by a join on sequences of words."""
    def folded(column):
        return W.all_matches(F.translate(F.lower(column), "ς", "σ"), f"{W.WORD}+")  # as `_fold` has them

    entries = dictionary.withColumn("_words", folded("phrase")).filter(F.size("_words") > 0)
    lengths = [n for n, in entries.select(F.size("_words")).distinct().collect()]  # few: numbers of words
    words = F.col("_words")

    def sequences(n):
        first = F.sequence(F.lit(0), F.size(words) - n)
        joined = F.transform(first, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    held = F.array_distinct(F.concat(*map(sequences, lengths)))
    candidates = df.select(key, folded(text).alias("_words")).select(key, F.explode(held).alias("_words"))
    entries = entries.withColumn("_words", F.array_join("_words", " "))
    return (
        candidates.join(sized(entries), "_words")
        .groupBy(key)
        .agg(F.collect_list(F.struct("phrase", "label", "description", "weight")).alias("_held"))
    )


@F.arrow_udf(ENTITIES)
def _find_held(texts: pa.Array, held: pa.Array) -> pa.Array:
    machines = (compile_phrases(tuple(row.values()) for row in rows.as_py() or []) for rows in held)
    return _entities((text.as_py() for text in texts), machines)


def with_phrases(df: DataFrame, dictionary: DataFrame, text: str, key: str, into: str = "_found") -> DataFrame:
    """Add `into`: the entities of the phrases of `dictionary` (phrase, label, description, weight) in `text`.

    A phrase is found in any case, with any space between its words, where no word
    character precedes or follows it; punctuation stands for itself, and matches of
    one phrase do not overlap. A phrase needs a word. Up to `MAX_CARRIED_PHRASES`
    phrases are collected and every text is walked once, without a shuffle. Of a longer
    dictionary each text first gets the phrases whose words it holds, by a join, and is
    walked for those. `key` must be unique then. Null and empty texts have no entity.
    """
    entries = dictionary.select(
        "phrase", "label", "description", F.col("weight").cast("double").alias("weight")
    ).filter("phrase IS NOT NULL")
    few = entries.limit(MAX_CARRIED_PHRASES + 1).collect()
    if len(few) <= MAX_CARRIED_PHRASES:
        return df.withColumn(into, _carried(few)(F.col(text)))
    held = df.join(_held(entries, df, text, key), key, "left")
    return held.withColumn(into, _find_held(F.col(text), F.col("_held"))).drop("_held")
