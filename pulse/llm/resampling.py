"""Target-distribution importance resampling (operator 11).

Features are hashed to buckets. How much more often a bucket comes in the target than in
all documents is its gain, one array of bounded size; a document's weight is the sum of its
features' gains, and a hash of its id adds Gumbel noise. The cutoff of the draw is found
by exact counts over the stored scores; only drawn rows are then sorted.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.learning import RUN_BYTES
from pulse.llm.ordered import numbered
from pulse.llm.tokens import text_runs
from pulse.session import new_folder

BUCKETS = 10_000
#: What parts words: all of ASCII but digits and letters, A-Z being lower case by then.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parts of a bracket that one job counts.
GRID = 1024
MAX_WORDS = 600_000
_crc: dict[str, int] = {}


def word_codes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """For runs of texts: each word's crc32 and number among the run's distinct words, these words, each text's borders."""
    for run in text_runs(texts, RUN_BYTES):
        lists = pc.split_pattern_regex(pc.ascii_lower(run), GAPS)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(_crc) > MAX_WORDS:
            _crc.clear()
        for word in words:
            if word not in _crc:
                _crc[word] = zlib.crc32(word.encode())
        crc = np.fromiter((_crc[word] for word in words), np.int64, len(words))
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        real = np.fromiter(map(bool, words), bool, len(words))[which]  # gaps at a text's ends leave empty words
        before = np.concatenate([[0], np.cumsum(real)])
        which = which[real]
        yield crc[which], which, [word.encode() for word in words], before[ends]


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: bucket and text of each feature, and the number of words of each text.

    A feature is a run of 1 to `longest` consecutive words; its bucket is the crc32 of the
    words, joined by single spaces, modulo `buckets`.
    """
    for crc, which, words, ends in word_codes(texts):
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        last = ends[1:][owner]
        found, owners, state = [crc % buckets], [owner], crc
        for n in range(2, longest + 1):
            # The crc of a longer run follows from that of the shorter one and the next word.
            at = np.flatnonzero(np.arange(len(crc)) + n <= last)
            joined = np.full(len(crc), -1, np.int64)
            pairs, back = np.unique(np.stack([state[at], which[at + n - 1]], axis=1), axis=0, return_inverse=True)
            longer = [zlib.crc32(b" " + words[w], c) for c, w in pairs.tolist()]
            joined[at] = np.array(longer, np.int64)[back.ravel()] if len(at) else 0
            state = joined
            found.append(state[at] % buckets)
            owners.append(owner[at])
        yield np.concatenate(found), np.concatenate(owners), np.diff(ends)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column `text` fall in each bucket. Every task hands on one row for each of its buckets at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _, _ in feature_buckets(batch.column("text"), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    found = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        found[bucket] = n
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source), for each bucket."""
    n = len(source)
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by a hash of the id. A null id has that of an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of `docs`."""

    def weigh(batches):
        for batch in batches:
            words, features, weights = ([np.empty(0, np.int64)] for _ in range(3))
            for found, owner, n_words in feature_buckets(batch.column("text"), longest, len(gains)):
                words.append(n_words)
                features.append(np.bincount(owner, minlength=len(n_words)))
                # Doubles hold these sums of whole numbers without a rest.
                weights.append(np.bincount(owner, gains[found], len(n_words)).astype(np.int64))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def bisected(rows: DataFrame, column: str, wanted: int) -> tuple[int, int]:
    """The greatest threshold that at least `wanted` values reach, and how many lie above it.

    1 <= wanted <= rows. Each round is one job that counts the rows in `GRID` parts of the
    bracket, exactly; the part in which the threshold lies is the next bracket.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0  # rows over `high`
    while low < high:
        width = -(-(high - low + 1) // GRID)
        value = f"cast({column} as decimal(38, 0))" if high - low >= 1 << 62 else column
        part = F.expr(f"({value} - ({low})) div {width}")
        inside = rows.filter(F.col(column).between(low, high))
        counts = inside.groupBy(part.alias("part")).count()
        for part, n in sorted(counts.collect(), reverse=True):  # at most GRID rows
            if above + n >= wanted:
                low, high = low + int(part) * width, min(high, low + (int(part) + 1) * width - 1)
                break
            above += n
    return low, above


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): doc_id, n_features, weight, score, rank.

    The `percent` highest scores of the documents with `least_words` words are drawn, ties
    to the smaller doc_id, null ids last; rank counts 1, 2, ... and is null for the others.
    Null and empty texts have no feature and weight 0. Whole texts count, however long.
    Rows that repeat an id each have their own score, and equal ones ranks of their own.
    Without a `target` row all gains follow from the documents alone; without documents there is no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gains = bucket_gains(bucket_counts(rows, longest, buckets), bucket_counts(target, longest, buckets))
    folder = new_folder(spark, "scores")
    # Rows that are equal in all else are told apart by `row`.
    scored = weighed(rows, gains, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    scored = spark.read.parquet(folder)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return scored.select(*names, none)
    score, above = bisected(able, "score", drawn)
    tied = F.col("score") == score
    # Of the tied rows the least ids; nulls stand behind all.
    ties = able.filter(tied & F.col("doc_id").isNotNull()).select((-F.col("doc_id")).alias("back"))
    last = -bisected(ties, "back", drawn - above)[0] if ties.count() >= drawn - above else None
    within = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    chosen = (F.col("n_words") >= least_words) & ((F.col("score") > score) | (tied & within))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = numbered(scored.filter(chosen).select(*names, "row", F.lit(0).cast("long").alias("all")), "all", order)
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return ranked.select(*names, rank).union(scored.filter(~chosen).select(*names, none))
