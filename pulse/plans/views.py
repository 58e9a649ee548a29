"""SQL forms of the adapter views and of shared steps, as WITH clauses."""

from pulse.functions import lexicons
from pulse.functions import words as W

NOW = "(SELECT max(ts) FROM events)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def item(v):
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else repr(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(item, row)) + ")" for row in rows)


def clean(column: str) -> str:
    no_url = f"regexp_replace({column}, {quoted(W.URL)}, '', 'g')"
    flat = f"trim(regexp_replace({no_url}, {quoted(W.SPACE + '+')}, ' ', 'g'))"
    return f"CASE WHEN length({flat}) < 3 THEN 'neutral text' ELSE {flat} END"


_STOP = ", ".join(map(quoted, lexicons.STOP_WORDS))


def sentiment(source: str, key: str, text: str) -> str:
    """Lexicon sentiment of every row of `source`."""
    return f"""
        SELECT {key}, CASE WHEN p > n AND p > 1 THEN 'positive' WHEN n > p AND n > 1 THEN 'negative'
                           ELSE 'neutral' END AS sentiment,
               greatest(p, n, 1.0) / (p + n + 1.0) AS sentiment_confidence,
               p / (p + n + 1.0) AS positive, n / (p + n + 1.0) AS negative, 1.0 / (p + n + 1.0) AS neutral
        FROM (
            SELECT s.{key},
                   coalesce(sum(CASE WHEN l.sentiment = 'positive' THEN l.weight END), 0.0) AS p,
                   coalesce(sum(CASE WHEN l.sentiment = 'negative' THEN l.weight END), 0.0) AS n
            FROM {source} s
            LEFT JOIN (SELECT {key}, unnest(regexp_extract_all(lower({clean(text)}),
                              {quoted(W.WORD + '+')})) AS word FROM {source}) t ON t.{key} = s.{key}
            LEFT JOIN lexicon l ON l.word = t.word
            GROUP BY s.{key})"""


VIEWS = {
    "base": """
        SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
               CASE event_id % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' ELSE 'instagram' END AS platform,
               CAST(floor(value * 4) AS INT) AS likes_count
        FROM events""",
    "posts": """
        SELECT concat(platform, '_', event_id) AS post_id, platform, concat('user_', user_id) AS author, ts,
               likes_count, event_id, k, value, event_type,
               CASE WHEN platform = 'twitter' THEN CAST(floor(likes_count / 3.0) AS INT) ELSE 0 END AS shares_count,
               CAST(floor(likes_count / 5.0) AS INT) AS comments_count,
               likes_count + CASE WHEN platform = 'twitter' THEN CAST(floor(likes_count / 3.0) AS INT) ELSE 0 END
                   + CAST(floor(likes_count / 5.0) AS INT) AS engagement,
               CASE WHEN k % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 5 < 3 THEN [concat('tag', k % 10)]
                    ELSE [concat('tag', k % 10), event_type] END AS hashtags,
               [concat('user_', k)] AS mentions,
               CASE WHEN event_type = 'error' THEN NULL WHEN value >= 60 THEN 'positive'
                    WHEN value < 20 THEN 'negative' ELSE 'neutral' END AS sentiment,
               CASE WHEN event_type = 'error' THEN 0 WHEN value >= 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END AS sign,
               CASE WHEN event_type <> 'error' THEN CAST((k % 50 + 50) / 100.0 AS DECIMAL(5,4)) END AS sentiment_confidence,
               CASE WHEN event_type <> 'error' THEN ts END AS processed_at,
               CASE WHEN event_type <> 'error' THEN k END AS processing_time_ms
        FROM base""",
    "posts_text": """
        SELECT p.*, coalesce(d.lang, 'en') AS language,
               concat(coalesce(d.text || chr(10), ''),
                   CASE WHEN value >= 60 THEN 'great' WHEN value < 20 THEN 'broken' ELSE 'usual' END, ' ',
                   CASE k % 5 WHEN 0 THEN 'Acme Corp raised $1250.50' WHEN 1 THEN 'from New York on 2024-03-01'
                       WHEN 2 THEN 'about the Open Data Summit' WHEN 3 THEN 'with Jane Doe' ELSE 'on a Nova Phone' END,
                   ' #tag', k % 10, '! @user_', k, ' #über_', k % 3, ' http://example.org/', k, '?x=1#f') AS content
        FROM posts p LEFT JOIN documents d ON d.doc_id = p.event_id""",
    "tags": "SELECT * EXCLUDE (hashtags), unnest(hashtags) AS topic FROM posts",
    "hourly": """
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS time_window, topic, platform, count(*) AS mentions_count,
               CAST(round(avg(sign), 4) AS DECIMAL(5,4)) AS sentiment_score
        FROM tags GROUP BY ALL""",
    "trending": """
        SELECT time_window, topic, platform, mentions_count, sentiment_score,
               CAST(round(CASE WHEN before_window = time_window - INTERVAL 1 HOUR
                               THEN mentions_count / before_mentions END, 4) AS DECIMAL(18,4)) AS growth_rate,
               CASE WHEN before_window = time_window - INTERVAL 1 HOUR
                    THEN CAST(mentions_count - before_mentions AS DOUBLE) END AS velocity
        FROM (SELECT *, lag(time_window) OVER w AS before_window, lag(mentions_count) OVER w AS before_mentions,
                     row_number() OVER (PARTITION BY time_window ORDER BY mentions_count DESC, topic, platform) AS place
              FROM hourly
              WINDOW w AS (PARTITION BY topic, platform ORDER BY time_window))
        WHERE place <= 20""",
    "recent_trending": """
        SELECT * FROM trending
        WHERE time_window >= {now} - INTERVAL 24 HOUR""",
    "top_topics": """
        SELECT topic, CAST(sum(mentions_count) AS BIGINT) AS mentions,
               coalesce(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 0.0) AS sentiment_score,
               coalesce(CAST(sum(growth_rate) AS DOUBLE) / nullif(count(growth_rate), 0), 0.0) AS growth_rate,
               string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms
        FROM recent_trending GROUP BY topic
        ORDER BY mentions DESC, sentiment_score DESC, topic LIMIT 10""",
    "activity": """
        SELECT event_id AS id, user_id, event_type AS activity_type, concat('client_', user_id) AS client_id,
               CASE WHEN user_id = 0 THEN 'admin' WHEN user_id % 2 = 1 THEN 'authenticated'
                    ELSE 'anonymous' END AS user_type,
               CASE event_id % 4 WHEN 0 THEN '/ml/sentiment' WHEN 1 THEN '/ml/extract-entities'
                    WHEN 2 THEN '/analytics/trending' ELSE '/analytics/metrics' END AS endpoint,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS response_status,
               CAST(floor(value * 10) AS INT) AS processing_time_ms, ts
        FROM events""",
    "clients": """
        SELECT client_id, endpoint,
               count(*) FILTER (ts >= {now} - INTERVAL 60 SECOND) AS requests_last_minute,
               count(*) FILTER (ts >= {now} - INTERVAL 3600 SECOND) AS requests_last_hour,
               count(*) FILTER (ts >= {now} - INTERVAL 86400 SECOND) AS requests_last_day
        FROM activity WHERE ts >= {now} - INTERVAL 86400 SECOND AND ts <= {now} GROUP BY 1, 2""",
    "lexicon": "SELECT * FROM ("
    + values([(w, g, x) for g, ws in lexicons.SENTIMENT_WORDS.items() for w, x in ws.items()])
    + ") t(word, sentiment, weight)",
    "emotion_lexicon": "SELECT * FROM ("
    + values([(w, g, x) for g, ws in lexicons.EMOTION_WORDS.items() for w, x in ws.items()])
    + ") t(word, emotion, weight)",
    "dictionary": f"SELECT * FROM ({values(lexicons.ENTITY_PHRASES)}) t(phrase, label, description, weight)",
    "post_words": f"""
        SELECT post_id, unnest(regexp_extract_all(lower({clean('content')}), {quoted(W.WORD + '+')})) AS word
        FROM posts_text""",
    "post_emotions": """
        SELECT post_id, emotion, w / sum(w) OVER (PARTITION BY post_id) AS score
        FROM (SELECT post_id, emotion, sum(CAST(weight AS DOUBLE)) AS w
              FROM post_words JOIN emotion_lexicon USING (word) GROUP BY ALL)""",
    "scored": sentiment("posts_text", "post_id", "content"),
    # The text as word and non-word pieces, with the number of characters before each
    "pieces": f"""
        SELECT post_id, pos, piece, CAST(sum(length(piece)) OVER w AS INT) - CAST(length(piece) AS INT) AS start,
               lead(piece, 1) OVER w AS p1, lead(piece, 2) OVER w AS p2,
               lead(piece, 3) OVER w AS p3, lead(piece, 4) OVER w AS p4
        FROM (SELECT post_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
              FROM (SELECT post_id, regexp_extract_all(content, {quoted(f'{W.WORD}+|[^' + W.WORD[1:-1] + ']+')}) AS parts
                    FROM posts_text))
        WINDOW w AS (PARTITION BY post_id ORDER BY pos)""",
    "grams": f"""
        SELECT post_id, start, piece AS found FROM pieces
        UNION ALL
        SELECT post_id, start, piece || p1 || p2 FROM pieces WHERE regexp_full_match(p1, {quoted(W.SPACE + '+')})
        UNION ALL
        SELECT post_id, start, piece || p1 || p2 || p3 || p4 FROM pieces
        WHERE regexp_full_match(p1, {quoted(W.SPACE + '+')}) AND regexp_full_match(p3, {quoted(W.SPACE + '+')})""",
    "patterns": """
        SELECT post_id, label, description, piece AS found,
               CAST(sum(length(piece)) OVER (PARTITION BY post_id, label ORDER BY pos) AS INT)
                   - CAST(length(piece) AS INT) AS start, matched
        FROM (SELECT post_id, label, description, pattern, unnest(parts) AS piece,
                     generate_subscripts(parts, 1) AS pos,
                     regexp_full_match(unnest(parts), pattern) AS matched
              FROM (SELECT post_id, 'MONEY' AS label, 'Monetary values, including unit' AS description,
                           '\\$[0-9]+(?:\\.[0-9]+)?' AS pattern,
                           regexp_extract_all(content, '\\$[0-9]+(?:\\.[0-9]+)?|[^$]+|\\$') AS parts FROM posts_text
                    UNION ALL
                    SELECT post_id, 'DATE', 'Absolute or relative dates or periods',
                           '[0-9]{4}-[0-9]{2}-[0-9]{2}',
                           regexp_extract_all(content, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[^0-9]+|[0-9]') FROM posts_text))""",
    "entities": f"""
        SELECT post_id, found AS text, label, description, start,
               start + CAST(length(found) AS INT) AS "end", CAST(weight AS DOUBLE) AS confidence
        FROM grams JOIN dictionary
          ON phrase = regexp_replace(lower(found), {quoted(W.SPACE + '+')}, ' ', 'g')
        UNION ALL
        SELECT post_id, found, label, description, start, start + CAST(length(found) AS INT), 0.7
        FROM patterns WHERE matched""",
    "doc_tokens": f"""
        SELECT doc_id, list_filter(regexp_extract_all(lower({clean('text')}), {quoted(W.WORD + '{2,}')}),
                                   lambda t: t NOT IN ({_STOP})) AS t
        FROM documents""",
    "doc_terms": """
        SELECT doc_id, unnest(t) AS term FROM doc_tokens
        UNION ALL
        SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM doc_tokens""",
    "vocabulary": """
        SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df,
               ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1.0 AS idf
        FROM doc_terms GROUP BY term
        HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) <= 0.8 * (SELECT count(*) FROM documents)
        ORDER BY tf DESC, term LIMIT 1000""",
}

NEEDS = {
    "posts": ["base"],
    "posts_text": ["posts"],
    "tags": ["posts"],
    "hourly": ["tags"],
    "trending": ["hourly"],
    "recent_trending": ["trending"],
    "top_topics": ["recent_trending"],
    "clients": ["activity"],
    "post_words": ["posts_text"],
    "post_emotions": ["post_words", "emotion_lexicon"],
    "scored": ["posts_text", "lexicon"],
    "pieces": ["posts_text"],
    "grams": ["pieces"],
    "patterns": ["posts_text"],
    "entities": ["grams", "patterns", "dictionary"],
    "doc_terms": ["doc_tokens"],
    "vocabulary": ["doc_terms"],
}


def select(uses, body: str) -> str:
    """`body` behind the views it uses and those they build on."""
    order: list[str] = []

    def add(name):
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    clauses = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return (f"WITH {clauses}\n{body}" if order else body).replace("{now}", NOW)
