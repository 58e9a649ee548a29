"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions only (operator 7).

A sketch is the ascending array of the K least hashes of a text's distinct word shingles.
Sketches of parts merge into the sketch of the whole, and tell resemblance, containment
and the number of distinct shingles.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import new_folder

K = 64
WORDS = 5


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Bottom-k sketch of a whole text. Fewer words than a shingle has are one shingle; no words give an empty sketch."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    hashes = F.transform(found, lambda word: F.xxhash64(word))

    def least(of: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(of) - words + 1, F.lit(1)))
        # Where words are missing they hash as nothing, so that the one run stands for all there are.
        runs = F.transform(starts, lambda i: F.xxhash64(*(F.try_element_at(of, i + j) for j in range(words))))
        return F.when(F.size(of) == 0, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.sort_array(F.array_distinct(runs)), 1, k)
        )

    # A lambda's variable is computed once; an expression inside a lambda would be for every run.
    return F.element_at(F.transform(F.array(hashes), least), 1)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(sketches: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts; only k values of a key leave a task."""
    values = sketches.select(key, F.explode(column).alias("value")).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("value"))
    least = values.withColumn("place", place).filter(F.col("place") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("value")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1. Two empty sketches are alike, an empty and another one are not."""
    union = merged(a, b, k)
    both = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first one's shingles that the second has too, 0 to 1."""
    alike = resemblance(a, b, k)
    common = alike / (1 + alike) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    """A sketch as text: base64 of its 8-byte values."""
    text = F.base64(F.unhex(F.array_join(F.transform(a, lambda v: F.lpad(F.hex(v), 16, "0")), "")))
    return F.translate(text, "\r\n", "")


def followers(keys: DataFrame) -> DataFrame:
    """For each row (id, copy, ...) next_id and next_copy of the following row in descending order; the first one after the last.

    `keys` must be distinct. Rows are sorted in range partitions; only the first key of
    each partition, one row of a small table, is looked up across them.
    """
    folder = new_folder(keys.sparkSession, "order")
    order = [F.desc("id"), F.desc("copy")]
    keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    keys = keys.sparkSession.read.parquet(folder)
    firsts = keys.groupBy("part").agg(F.max(F.struct("id", "copy")).alias("first"))
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("then"))
    following = F.lead(F.struct("id", "copy")).over(Window.partitionBy("part").orderBy(*order))
    found = keys.withColumn("following", following).join(F.broadcast(firsts), "part")
    found = found.withColumn("following", F.coalesce("following", "then"))
    return found.select(
        *[c for c in keys.columns if c != "part"],
        F.col("following.id").alias("next_id"),
        F.col("following.copy").alias("next_copy"),
    )


def fingerprint_edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of each row of `docs` (doc_id, text; other columns are not read) and of its edited text.

    The edit replaces the last third of the characters by as many first ones (or all)
    of the next document in descending order of id, after the last the first. Null
    texts are empty; a null id comes last. Rows with one id follow each other by a hash
    of their texts; rows that repeat id and text are one place in that order and give equal rows.
    `n_distinct` estimates a text's distinct shingles, `within_edited` the share of them that the
    edited text has too. An empty table gives no row.
    """
    lowest = F.lit(-(2**63))  # stands for a null id
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), F.xxhash64(text).alias("copy")
    n_chars = F.char_length("text")
    keys = docs.select(*known, text.alias("text")).select("id", "copy", F.floor(n_chars / 3).cast("int").alias("third"))
    order = followers(keys.distinct())
    rows = docs.select(*known, text.alias("text")).withColumn("sketch", sketch(F.col("text"), k, words))
    before = order.select(
        F.col("id").alias("of_id"), F.col("copy").alias("of_copy"), "third",
        F.col("next_id").alias("id"), F.col("next_copy").alias("copy"),
    )
    heads = rows.join(before, ["id", "copy"]).select(
        F.col("of_id").alias("id"), F.col("of_copy").alias("copy"),
        F.expr("left(text, third)").alias("head"), F.col("sketch").alias("next_sketch"),
    ).dropDuplicates(["id", "copy"])
    edited = F.concat(F.expr("left(text, n_chars - cast(floor(n_chars / 3) as int))"), "head")
    found = rows.join(heads, ["id", "copy"]).withColumn("n_chars", n_chars).withColumn("edited", edited)
    found = found.withColumn("edited_sketch", sketch(F.col("edited"), k, words))
    return found.select(
        F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_distinct"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("within_edited"),
    )
