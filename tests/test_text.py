import math
import re
from random import Random

import pytest
from pyspark.sql import functions as F

from pulse.functions import lexicons as LX
from pulse.functions import words as W
from pulse.functions.lookups import join_hot
from pulse.operators import phrases as P
from pulse.operators import scoring as S
from pulse.operators import text as X
from pulse.operators import topics as K


def texts(spark, *values):
    return spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(values)], "post_id string, content string")


def column(df, name):
    return [r[name] for r in df.orderBy("post_id").collect()]


def test_cleaning(spark):
    df = texts(spark, "a  b \n c https://x.y/z?q=1 d", "", "http://x.y", "ab", "abc", "   ")
    assert column(X.clean_text(df), "cleaned") == ["a b c d", *["neutral text"] * 3, "abc", "neutral text"]
    assert column(X.text_lengths(df), "text_length")[1:4] == [0, 10, 2]


def test_tags_keep_mark_and_know_accents(spark):
    found = X.extract_tags(texts(spark, "#über_1 and #ai! @you, mail@host http://x/#f"))
    assert column(found, "found_hashtags") == [["#über_1", "#ai", "#f"]]
    assert column(found, "found_mentions") == [["@you", "@host"]]


def test_ingest_tags_keep_punctuation(spark):
    found = X.ingest_tags(texts(spark, "see #ai! x#no\n#b @me @"))
    assert column(found, "hashtags") == [["ai!", "b"]]
    assert column(found, "mentions") == [["me", ""]]


def test_urls_stop_at_hash_and_tilde(spark):
    found = X.extract_urls(texts(spark, "http://a.b/c?d=1#e https://f/~g 'http://h/i'"))
    assert column(found, "found_urls") == [["http://a.b/c?d=1", "https://f/", "http://h/i'"]]


def test_preprocess_switches(spark):
    df = texts(spark, "The Quick, #fox @you http://x/y and more")
    every = dict(remove_mentions=True, remove_hashtags=True, remove_punctuation=True, lowercase=True, remove_stopwords=True)
    assert column(X.preprocess(df), "processed") == ["The Quick, #fox @you and more"]
    assert column(X.preprocess(df, **every), "processed") == ["quick"]
    assert column(X.preprocess(df, **every, min_length=6), "length_ok") == [False]


def test_content_tokens_are_cut_after_stop_words(spark):
    df = texts(spark, " ".join(["the"] * 60 + [f"W{i}" for i in range(60)]))
    assert column(X.content_tokens(df), "tokens") == [[f"W{i}" for i in range(50)]]


def test_sentiment(spark):
    df = texts(spark, "great!", "broken", "great but broken", "", "nothing here", "Great GREAT http://great/")
    scored = S.score_sentiment(df, LX.sentiment_lexicon(spark)).orderBy("post_id").collect()
    assert [r["sentiment"] for r in scored] == ["positive", "negative", "neutral", "neutral", "neutral", "positive"]
    assert all(math.isclose(r["positive"] + r["negative"] + r["neutral"], 1) for r in scored)
    assert scored[5]["positive"] == 4 / 5


def test_emotions_sum_to_one(spark):
    scored = S.score_emotions(texts(spark, "great, so sad", "plain"), LX.emotion_lexicon(spark))
    with_words, without = column(scored, "emotions")
    assert math.isclose(sum(with_words.values()), 1) and without == {}


def test_combined_scores_equal_single_scores(spark):
    df = texts(spark, "great sad", "broken", "x")
    lexicon, emotions = LX.sentiment_lexicon(spark), LX.emotion_lexicon(spark)
    both = S.score_mood(df, lexicon, emotions).orderBy("post_id")
    single = S.score_sentiment(df, lexicon).join(S.score_emotions(df, emotions), "post_id").orderBy("post_id")
    assert both.collect() == single.collect()


TEXT = "Naïve: NEW  York, new york; newyork. Acme\nCorp paid $5 and $1250.50 on 2024-03-01! Acme, Corp"


@pytest.mark.parametrize("carried", [200, 0])
def test_entities_point_at_their_text(spark, carried, monkeypatch):
    monkeypatch.setattr(P, "MAX_CARRIED_PHRASES", carried)
    row = S.extract_entities(texts(spark, TEXT, "none", "\uffff new york"), LX.entity_dictionary(spark)).orderBy("post_id").collect()
    assert [(e["start"], e["end"]) for e in row[2]["entities"]] == [(2, 10)]
    found = row[0]["entities"]
    assert [(e["text"], e["label"]) for e in found] == [
        ("NEW  York", "GPE"), ("new york", "GPE"), ("Acme\nCorp", "ORG"), ("$5", "MONEY"), ("$1250.50", "MONEY"), ("2024-03-01", "DATE"),
    ]
    assert all(TEXT[e["start"] : e["end"]] == e["text"] for e in found)
    assert row[1]["entity_count"] == 0
    assert S.entity_topics(spark.createDataFrame(row[:1])).first()["topics"] == ["acme\ncorp"]


@pytest.mark.parametrize("carried", [200, 0])
def test_overlapping_phrases_are_all_found(spark, carried, monkeypatch):
    monkeypatch.setattr(P, "MAX_CARRIED_PHRASES", carried)
    rows = [("new york", "GPE", "", 0.9), ("york city hall", "ORG", "", 0.5), ("york", "PERSON", "", 0.1)]
    dictionary = spark.createDataFrame(rows, "phrase string, label string, description string, weight double")
    found = S.extract_entities(texts(spark, "New York City Hall on $2024-01-02"), dictionary).first()["entities"]
    assert [(e["text"], e["label"]) for e in found] == [
        ("New York", "GPE"), ("York", "PERSON"), ("York City Hall", "ORG"), ("$2024", "MONEY"), ("2024-01-02", "DATE"),
    ]


@pytest.mark.parametrize("carried", [200, 0])
def test_phrases_of_any_length_with_punctuation_are_found(spark, carried, monkeypatch):
    monkeypatch.setattr(P, "MAX_CARRIED_PHRASES", carried)
    phrases = ["Bank of New England", "at&t", "c++", "u.s.", "c", "+ d", "a(b", "++"]
    rows = [(phrase, "ORG", "", 0.5) for phrase in phrases]
    dictionary = spark.createDataFrame(rows, "phrase string, label string, description string, weight double")
    text = "bank  of new\tEngland, AT&T and C++ d in the U.S.; uxs, att, A(B c"
    row = S.extract_entities(texts(spark, text, None, ""), dictionary).orderBy("post_id").collect()
    assert [(e["text"], e["start"]) for e in row[0]["entities"]] == [
        (found, text.index(found)) for found in ("bank  of new\tEngland", "AT&T", "C", "C++", "+ d", "U.S.", "A(B")
    ] + [("c", len(text) - 1)]
    assert [not r["entities"] for r in row[1:]] == [True, True]


def test_offsets_of_many_matches(spark):
    text = "$1 x " * 4000
    found = S.extract_entities(texts(spark, text), LX.entity_dictionary(spark)).first()["entities"]
    assert [e["start"] for e in found] == list(range(0, 20000, 5))


def by_regex(text, phrases):
    """(start, end, phrase) of each phrase by a pattern of its own."""
    found = []
    for phrase in phrases:
        body = r"\s+".join(re.escape(word) for word in phrase.split())
        if re.search(r"\w", phrase):
            hits = re.finditer(rf"(?i)(?<!\w)(?:{body})(?!\w)", text or "")
            found += [(hit.start(), hit.end(), phrase) for hit in hits]
    return sorted(found)


@pytest.mark.parametrize("carried", [10_000, 0])
def test_phrases_equal_patterns_on_odd_texts(spark, carried, monkeypatch):
    """Words that repeat, marks at either end, runs of space, over 3,000 random texts and 150 phrases."""
    monkeypatch.setattr(P, "MAX_CARRIED_PHRASES", carried)
    random = Random(7)

    def odd(most):
        return "".join(random.choice(["a", "B", "ab", "é", "_", "1", " ", " ", "\t", "+", "!", "$", "\u2028"]) for _ in range(random.randint(1, most)))

    phrases = sorted({" ".join(odd(8).lower().split()) for _ in range(150)} | {"a a", "a b a", "b a", "a"})
    rows = [(phrase, phrase, "", 0.5) for phrase in phrases]
    dictionary = spark.createDataFrame(rows, "phrase string, label string, description string, weight double")
    bodies = [odd(60) for _ in range(3000)] + ["", None, "a " * 20000]
    found = P.with_phrases(texts(spark, *bodies), dictionary, "content", "post_id").select("content", "_found").collect()
    assert len(found) == len(bodies)
    for body, entities in found:
        assert sorted((e["start"], e["end"], e["label"]) for e in entities) == by_regex(body, phrases), body
        assert all(body[e["start"] : e["end"]] == e["text"] for e in entities)


def test_phrases_shuffle_nothing(spark):
    df = texts(spark, TEXT)
    plan = S.extract_entities(df, LX.entity_dictionary(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_empty_dictionary(spark):
    dictionary = LX.entity_dictionary(spark).limit(0)
    assert S.extract_entities(texts(spark, "New York"), dictionary).first()["entity_count"] == 0


def test_distinct_scoring_serves_all_copies(spark):
    df = spark.range(500).select(
        F.col("id").cast("string").alias("post_id"), F.when(F.col("id") % 3 == 0, "broken").otherwise(F.concat(F.lit("great "), "id")).alias("content")
    )
    seen = []

    def scorer(once, text, key):
        seen.append(once.count())
        return S.score_sentiment(once, LX.sentiment_lexicon(spark), text, key)

    counts = {r["sentiment"]: r["count"] for r in S.score_distinct(df, scorer).groupBy("sentiment").count().collect()}
    assert counts == {"negative": 167, "positive": 333} and seen == [334]


@pytest.mark.parametrize("share, rows_per_task", [(0.001, 20), (0.5, 20), (0.001, 10**6)])
def test_hot_keys_join_like_others(spark, share, rows_per_task):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = rows.select("k").distinct().filter("k <> 1").withColumn("v", F.col("k") * 2)
    joined = join_hot(rows, table, "k", "id", share, rows_per_task).orderBy("id").collect()
    assert [(r["id"], r["k"], r["v"]) for r in joined] == [
        (i, k, None if k == 1 else 2 * k) for i in range(1000) for k in [-1 if i % 3 == 0 else i]
    ]


def test_scorer_gets_small_batches(spark):
    sizes = S.apply_scorer(
        spark.range(100).coalesce(1).select(F.col("id").alias("n")), lambda pdf: pdf.assign(size=len(pdf)), "n long, size long"
    )
    assert sorted({r["size"] for r in sizes.collect()}) == [4, 32]


def test_pairs_and_triples(spark):
    row = spark.sql("SELECT array('a','b','c') AS t, array('a') AS s").select(
        W.pairs(F.col("t")), W.triples(F.col("t")), W.pairs(F.col("s")), W.triples(F.col("s"))
    )
    assert tuple(row.first()) == (["a b", "b c"], ["a b c"], [], [])


def test_vocabulary_against_brute_force(spark):
    docs = ["cats chase mice", "cats chase dogs and the mice", "dogs sleep", "cats sleep a lot"]
    terms = []
    for doc in docs:
        words = [w for w in re.findall(r"\w{2,}", doc) if w not in LX.STOP_WORDS]
        terms.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    wanted = {}
    for term in {t for ts in terms for t in ts}:
        df = sum(term in ts for ts in terms)
        if 2 <= df <= 0.8 * 4:
            wanted[term] = (sum(ts.count(term) for ts in terms), df, math.log(5 / (1 + df)) + 1)
    found = K.tfidf_vocabulary(K.with_terms(texts(spark, *docs))).collect()
    assert {r["term"]: (r["tf"], r["df"]) for r in found} == {term: w[:2] for term, w in wanted.items()}
    assert {r["term"]: r["idf"] for r in found} == pytest.approx({term: w[2] for term, w in wanted.items()})
    features = K.tfidf_features(K.with_terms(texts(spark, *docs)), found)
    for row, ts in zip(features.orderBy("post_id").collect(), terms):
        raw = [ts.count(r["term"]) * r["idf"] for r in found]
        norm = math.sqrt(sum(x * x for x in raw))
        assert list(row["features"]) == pytest.approx([x / norm for x in raw])


@pytest.mark.parametrize("carried", [100, 1])
def test_vocabulary_of_few_terms(spark, monkeypatch, carried):
    """Terms are counted by runs of texts, and only pairs that can be chosen; the choice is that of all terms, ties by name."""
    monkeypatch.setattr(K, "COUNTED_WORDS", 5)
    monkeypatch.setattr(K, "MAX_CARRIED_WORDS", carried)
    docs = ["red fox red fox", "red fox jumps", "red fox naps", "blue fox jumps", None, "", "blue hen jumps", "naps naps"]
    df = K.with_terms(texts(spark, *docs))
    tf, seen = {}, {}
    for row in df.collect():
        for term in row["terms"] or []:
            tf[term] = tf.get(term, 0) + 1
            seen.setdefault(term, set()).add(row["post_id"])
    good = [t for t in tf if 2 <= len(seen[t]) <= 0.8 * len(docs)]
    for k in (1, 2, 3, 5, 50):
        found = K.tfidf_vocabulary(df, max_terms=k)
        wanted = [(t, tf[t], len(seen[t])) for t in sorted(good, key=lambda t: (-tf[t], t))[:k]]
        assert [(r["term"], r["tf"], r["df"]) for r in found.collect()] == wanted
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_of_long_enough_texts(spark):
    bodies = ["", " ", "a", "ab", "a b", "a\tb ", "  ab ", None, "http://x.y ab", " ab\u0085c", "x\x1c\u3000y", "ab\n", "\U0001f600b", "ab c"]
    df = texts(spark, *bodies).withColumn("_bare", W.without_urls("content"))
    wanted, found = W.words(W.cleaned("content"), 2), W.words(W.long_enough("_bare"), 2)
    assert df.filter(~wanted.eqNullSafe(found)).count() == 0


def test_topics_separate_unlike_texts(spark):
    docs = [f"cats chase mice at night {i % 2}" for i in range(6)] + [f"stocks rise on market news {i % 2}" for i in range(6)]
    found = K.extract_topics(texts(spark, *docs), num_topics=2, starts=3)
    groups = {r["post_id"]: r["topic_id"] for r in found.assignments.collect()}
    assert len({groups[f"p{i}"] for i in range(6)}) == len({groups[f"p{i}"] for i in range(6, 12)}) == 1
    assert sorted(r["document_count"] for r in found.sizes.collect()) == [6, 6]
    assert found.samples.count() == 6


def test_topics_need_two_texts(spark):
    with pytest.raises(ValueError):
        K.extract_topics(texts(spark, "only one"))


def test_batch_counts_errors(spark):
    lexicon, emotions, dictionary = LX.sentiment_lexicon(spark), LX.emotion_lexicon(spark), LX.entity_dictionary(spark)
    df = texts(spark, "great " * 30, "  ", None)
    done = K.batch_process(df, ["sentiment", "emotions", "entities"], lexicon, emotions, dictionary)
    rows = done.orderBy("post_id").collect()
    assert [r["error"] for r in rows] == [None, "blank text", "blank text"]
    assert rows[0]["sentiment"] == "positive" and len(rows[0]["original_text"]) == 103 and rows[1]["sentiment"] is None
    assert tuple(K.batch_summary(done).first()) == (3, 1, 2)
    with pytest.raises(ValueError):
        K.batch_process(df, ["summary"], lexicon, emotions, dictionary)
