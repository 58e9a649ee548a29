"""Queries for the text jobs."""

from pyspark.sql import functions as F

from pulse.functions import columns as C
from pulse.functions import lexicons as LX
from pulse.functions import words as W
from pulse.operators import scoring as S
from pulse.operators import text as X
from pulse.operators import topics as K
from pulse.plans.registry import query
from pulse.plans.views import _STOP, clean, quoted, sentiment
from pulse.sources import adapters as A

_WORDS = quoted(W.WORD + "+")


@query("C16_text_lengths", f"SELECT doc_id, CAST(length(text) AS INT) AS text_length, CAST(length({clean('text')}) AS INT) AS cleaned_text_length FROM documents", "")
def _(spark, folder):
    return X.text_lengths(A.documents(spark, folder), "text").select("doc_id", "text_length", "cleaned_text_length")


@query("E01_clean_text", f"SELECT post_id, {clean('content')} AS cleaned FROM posts_text", "posts_text")
def _(spark, folder):
    return X.clean_text(A.posts_with_text(spark, folder)).select("post_id", "cleaned")


def _exploded(df, **columns):
    """(post_id, kind, position, tag) of every element of the array columns."""
    parts = [
        df.select("post_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("position", "tag"))
        for kind, column in columns.items()
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _found(kind, expression):
    return f"""SELECT post_id, '{kind}' AS kind, unnest(found) AS tag,
                      CAST(generate_subscripts(found, 1) - 1 AS INT) AS position
               FROM (SELECT post_id, {expression} AS found FROM posts_text)"""


@query(
    "E02_extract_tags",
    _found("hashtag", f"regexp_extract_all(content, {quoted(W.HASHTAG)})")
    + " UNION ALL "
    + _found("mention", f"regexp_extract_all(content, {quoted(W.MENTION)})"),
    "posts_text",
)
def _(spark, folder):
    found = X.extract_tags(A.posts_with_text(spark, folder))
    return _exploded(found, hashtag="found_hashtags", mention="found_mentions")


@query("E03_extract_urls", _found("url", f"regexp_extract_all(content, {quoted(W.URL)})"), "posts_text")
def _(spark, folder):
    return _exploded(X.extract_urls(A.posts_with_text(spark, folder)), url="found_urls")


def _marked(mark):
    flat = f"trim(regexp_replace(content, {quoted(W.SPACE + '+')}, ' ', 'g'))"
    return f"""list_transform(list_filter(string_split({flat}, ' '), lambda t: starts_with(t, '{mark}')),
                              lambda t: substring(t, 2))"""


@query(
    "E04_ingest_tags", _found("hashtag", _marked("#")) + " UNION ALL " + _found("mention", _marked("@")), "posts_text"
)
def _(spark, folder):
    found = X.ingest_tags(A.posts_with_text(spark, folder).drop("hashtags", "mentions"))
    return _exploded(found, hashtag="hashtags", mention="mentions")


def _replaced(column, *patterns):
    for pattern in patterns:
        column = f"regexp_replace({column}, {quoted(pattern)}, '', 'g')"
    return f"trim(regexp_replace({column}, {quoted(W.SPACE + '+')}, ' ', 'g'))"


@query(
    "E05_preprocess",
    f"""SELECT post_id, processed, length(processed) BETWEEN 3 AND 5000 AS length_ok FROM (
            SELECT post_id, array_to_string(list_filter(string_split(lower({_replaced('content', W.URL, W.MENTION, W.HASHTAG, W.PUNCTUATION)}), ' '),
                                                        lambda t: t NOT IN ({_STOP})), ' ') AS processed
            FROM posts_text)""",
    "posts_text",
)
def _(spark, folder):
    done = X.preprocess(
        A.posts_with_text(spark, folder), remove_mentions=True, remove_hashtags=True, remove_punctuation=True,
        lowercase=True, remove_stopwords=True,
    )
    return done.select("post_id", "processed", "length_ok")


@query(
    "E05_preprocess_default",
    f"""SELECT doc_id, processed, length(processed) BETWEEN 3 AND 5000 AS length_ok
        FROM (SELECT doc_id, {_replaced('text', W.URL)} AS processed FROM documents)""",
    "",
)
def _(spark, folder):
    return X.preprocess(A.documents(spark, folder), "text").select("doc_id", "processed", "length_ok")


def _content_tokens(first):
    return f"""array_to_string(list_filter(regexp_extract_all(text, {_WORDS}),
                               lambda t: lower(t) NOT IN ({_STOP}))[1:{first}], ' ')"""


@query("E06_content_tokens", f"SELECT doc_id, {_content_tokens(50)} AS tokens FROM documents", "")
def _(spark, folder):
    found = X.content_tokens(A.documents(spark, folder), "text")
    return found.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("D08_first_n", f"SELECT doc_id, {_content_tokens(3)} AS tokens FROM documents", "")
def _(spark, folder):
    found = X.content_tokens(A.documents(spark, folder), "text")
    return found.select("doc_id", F.array_join(C.first_n("tokens", 3), " ").alias("tokens"))


@query("E07_score_sentiment", "SELECT * FROM scored", "scored")
def _(spark, folder):
    return S.score_sentiment(A.posts_with_text(spark, folder), LX.sentiment_lexicon(spark))


@query("E08_score_emotions", "SELECT post_id, emotion, score FROM post_emotions", "post_emotions")
def _(spark, folder):
    scored = S.score_emotions(A.posts_with_text(spark, folder), LX.emotion_lexicon(spark))
    return scored.select("post_id", F.explode("emotions").alias("emotion", "score"))


@query(
    "D07_top_emotions",
    """SELECT post_id, emotion, score,
              CAST(row_number() OVER (PARTITION BY post_id ORDER BY score DESC, emotion) - 1 AS INT) AS place
       FROM post_emotions QUALIFY place < 8""",
    "post_emotions",
)
def _(spark, folder):
    scored = S.score_emotions(A.posts_with_text(spark, folder), LX.emotion_lexicon(spark))
    ranked = scored.select("post_id", F.posexplode(C.top_emotions()).alias("place", "top"))
    return ranked.select("post_id", "place", "top.emotion", "top.score")


def _entities(spark, folder):
    return S.extract_entities(A.posts_with_text(spark, folder), LX.entity_dictionary(spark))


@query("E09_extract_entities", "SELECT * FROM entities", "entities")
def _(spark, folder):
    return _entities(spark, folder).select("post_id", F.inline("entities"))


@query(
    "E09_entity_count",
    """SELECT p.post_id, CAST(count(e.label) AS INT) AS entity_count
       FROM posts p LEFT JOIN entities e ON e.post_id = p.post_id GROUP BY 1""",
    "posts entities",
)
def _(spark, folder):
    return _entities(spark, folder).select("post_id", "entity_count")


def _endings(k) -> list[str]:
    """Phrases of the line that ends a post's text, of two, four, four and six words, in odd capitals."""
    return [
        f"Tag{k % 10}!  @User_{k}", f"tag{k % 10}! @user_{k} #über_{k % 3} HTTP",
        f"#über_{k % 3} http://Example.org/{k}", f"http://example.org/{k}?x=1",
    ]


@query(
    "E09_long_dictionary",
    """SELECT post_id, e.found AS text, 'PRODUCT' AS label, 'ending' AS description,
              CAST(length(content) - length(e.ending) AS INT) AS start,
              CAST(length(content) - length(e.ending) + length(e.found) AS INT) AS "end",
              CAST(0.5 AS DOUBLE) AS confidence
       FROM (SELECT post_id, content, unnest([
                 {'found': tag, 'ending': concat(tag, ' ', mark, link, '?x=1#f')},
                 {'found': concat(tag, ' ', mark, 'http'), 'ending': concat(tag, ' ', mark, link, '?x=1#f')},
                 {'found': concat(mark, link), 'ending': concat(mark, link, '?x=1#f')},
                 {'found': concat(link, '?x=1'), 'ending': concat(link, '?x=1#f')}]) AS e
             FROM (SELECT post_id, content, concat('tag', k % 10, '! @user_', k) AS tag,
                          concat('#über_', k % 3, ' ') AS mark, concat('http://example.org/', k) AS link
                   FROM posts_text))
       UNION ALL
       SELECT post_id, found, label, description, start, start + CAST(length(found) AS INT), 0.7
       FROM patterns WHERE matched""",
    "posts_text patterns",
)
def _(spark, folder):
    """400 phrases with `!`, `@`, `#`, `/`, `.` and `?`."""
    phrases = [(phrase, "PRODUCT", "ending", 0.5) for k in range(100) for phrase in _endings(k)]
    dictionary = spark.createDataFrame(phrases, "phrase string, label string, description string, weight double")
    dictionary = dictionary.dropDuplicates(["phrase"])
    found = S.extract_entities(A.posts_with_text(spark, folder), dictionary)
    return found.select("post_id", F.inline("entities"))


@query(
    "D06_entity_topics",
    """SELECT DISTINCT post_id, lower(text) AS topic FROM entities
       WHERE label IN ('ORG', 'PRODUCT', 'EVENT', 'PERSON')""",
    "entities",
)
def _(spark, folder):
    return S.entity_topics(_entities(spark, folder)).select("post_id", F.explode("topics").alias("topic"))


def _terms(spark, folder):
    return K.with_terms(A.documents(spark, folder), "text")


# Logarithms and norms may differ in the last bit between engines, so reports carry 9 digits.
@query("E10_tfidf_vocabulary", "SELECT term, tf, df, round(idf, 9) AS idf FROM vocabulary", "vocabulary")
def _(spark, folder):
    return K.tfidf_vocabulary(_terms(spark, folder)).withColumn("idf", F.round("idf", 9))


@query(
    "E10_tfidf_features",
    """SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight
       FROM (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM doc_terms JOIN vocabulary USING (term) GROUP BY 1, 2)""",
    "vocabulary",
)
def _(spark, folder):
    terms = _terms(spark, folder)
    vocabulary = K.tfidf_vocabulary(terms).orderBy("term").collect()
    names = spark.createDataFrame([(i, r["term"]) for i, r in enumerate(vocabulary)], "position int, term string")
    # Only terms that a text has become rows; features are sparse.
    vector = F.unwrap_udt("features")
    entry = F.arrays_zip(vector["indices"].alias("position"), vector["values"].alias("weight"))
    present = F.filter(entry, lambda e: e["weight"] > 0)
    weights = K.tfidf_features(terms, vocabulary).select("doc_id", F.inline(present))
    return weights.join(F.broadcast(names), "position").select(
        "doc_id", "term", F.round("weight", 9).alias("weight")
    )


@query("E11_extract_topics")
def _(spark, folder):
    found = K.extract_topics(A.documents(spark, folder), text="text", key="doc_id")
    return found.terms.join(found.sizes, "topic_id")


def _batch(spark, folder, operations):
    return K.batch_process(
        A.posts_with_text(spark, folder), operations,
        LX.sentiment_lexicon(spark), LX.emotion_lexicon(spark), LX.entity_dictionary(spark),
    )


@query("E12_batch_process")
def _(spark, folder):
    return _batch(spark, folder, ["sentiment", "emotions", "entities", "topics"]).select(
        "post_id", "original_text", "error", "sentiment", "sentiment_confidence",
        F.size("emotions").alias("n_emotions"), "entity_count", "topic_id",
    )


@query(
    "E12_batch_scores",
    """SELECT s.post_id, s.sentiment, s.sentiment_confidence, coalesce(m.n_emotions, 0) AS n_emotions, n.entity_count
       FROM scored s
       LEFT JOIN (SELECT post_id, CAST(count(*) AS INT) AS n_emotions FROM post_emotions GROUP BY 1) m USING (post_id)
       JOIN (SELECT p.post_id, CAST(count(e.label) AS INT) AS entity_count
             FROM posts p LEFT JOIN entities e ON e.post_id = p.post_id GROUP BY 1) n USING (post_id)""",
    "posts scored post_emotions entities",
)
def _(spark, folder):
    """All but the topics, whose clusters SQL cannot state."""
    return _batch(spark, folder, ["sentiment", "emotions", "entities"]).select(
        "post_id", "sentiment", "sentiment_confidence", F.size("emotions").alias("n_emotions"), "entity_count"
    )


@query(
    "E12_batch_summary",
    """SELECT count(*) AS total_texts, count(*) FILTER (length(trim(content)) > 0) AS success_count,
              count(*) FILTER (length(trim(content)) = 0) AS error_count FROM posts_text""",
    "posts_text",
)
def _(spark, folder):
    done = K.batch_process(
        A.posts_with_text(spark, folder), ["sentiment", "entities"],
        LX.sentiment_lexicon(spark), LX.emotion_lexicon(spark), LX.entity_dictionary(spark),
    )
    return K.batch_summary(done)


@query("E13_score_distinct", sentiment("documents", "doc_id", "text"), "lexicon")
def _(spark, folder):
    lexicon = LX.sentiment_lexicon(spark)
    return S.score_distinct(
        A.documents(spark, folder),
        lambda texts, text, key: S.score_sentiment(texts, lexicon, text, key),
        "text",
        "doc_id",
    )


@query("E14_apply_scorer", "SELECT doc_id, length(text) AS score FROM documents", "")
def _(spark, folder):
    def scorer(texts):
        return texts.assign(score=texts["text"].str.len())[["doc_id", "score"]]

    texts = A.documents(spark, folder).select("doc_id", "text")
    return S.apply_scorer(texts, scorer, "doc_id long, score long")


@query("J06_topic_clusters")
def _(spark, folder):
    posts = A.posts_with_text(spark, folder)
    clusters = K.topic_clusters(posts, K.extract_topics(posts))
    return clusters.withColumns(
        {"topics": F.array_join("topics", ","), "platforms": F.array_join("platforms", ",")}
    )
