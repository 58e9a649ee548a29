"""Near-duplicate groups by bottom-k sketches of one hash function (operator 10).

A document is the set of its hashed shingles. Documents with equal sets are one class,
of which one goes on. From the hash values of a set two things are retained: the
`SKETCH` least ones, whose union-sketch estimates the likeness of two sets, and the
`RUN` least of each residue class, or of a small set its least ones. Sets that are alike
enough agree in some of these, so inverted lists of retained values hold the pairs:

* A set of n values counts for size levels of n and 1.25 n, so that two sets of at
  least 0.8 likeness have in common the level of the larger one.
* Levels that end up to `SMALL` are exact. Sets of up to 38 values, the larger of at least
  s, have t = ceil(0.8 s) values or more in common, and the `PICK` least of these are among
  the first n - t + `PICK` values of each set. The lists are those of all picks of so many
  values from there.
* A higher level that ends at size m has min(32, m/4 + 1) residue classes. Sets of up to
  m = 124 differ in at most m/4 values, hence agree in a whole class, but no list tells so
  if that class is empty in both: all agreeing classes are empty with a chance of at most
  5e-8, at a likeness of just 0.8. Larger sets agree in each of 32 classes with a chance
  of 0.8 ^ 4 or more; all 32 differ with a chance of 5e-8 at a likeness of just 0.8.
* In each list the member with the most company is the pivot. Pairs of pivot and
  member that pass the estimate are compared on whole sets. This joins nearly all.
* Lists whose members still belong to several components are taken again, without their
  texts: a sketch of a set of up to `SKETCH` values is that set, so pairs of such sets are
  decided on the spot. Of larger sets the 31 high bits of the `DEEP` least values are there, which can
  only overstate what two sets share. All pairs are compared by the `WIDE` least of them, and those that
  pass by all: up to `DEEP` values they reject a pair for certain, beyond by an estimate.
  Pairs that pass this too are compared on whole sets.
* Lists of more blocks than a member has values to be parted by are first parted by these, if that makes less work: two sketches that
  are alike enough share one of their rarest values in the list, so members meet only
  where they do. A passage that many texts share is frequent, and brings nobody together.

Pairs inside a component need no comparison, since only components are asked for.
"""

import hashlib
from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.components import connected_components
from pulse.llm.shingles import GOLDEN, mixed, shingle_sets, text_batches
from pulse.llm.tokens import without_words
from pulse.session import narrow_batches, new_folder

SKETCH = 64
RUN = 4
CLASSES = 32
LEVEL = 1.5
#: Levels that end up to this size are listed by picks of PICK values, without a miss.
SMALL = 40
PICK = 2
#: An estimate from SKETCH values of a likeness of 0.8 falls this far short (28 or fewer common values) in at
#: most 2 of 10,000,000,000 pairs, and never if the union has up to SKETCH values. What it lets pass is compared whole.
SLACK = 0.35
BLOCK = 256
#: In lists of several components members are compared by this many values.
WIDE = 256
#: An estimate from WIDE values falls this far short of a likeness of 0.8 in at most 1 of 10,000,000,000 pairs.
WIDE_SLACK = 0.19
#: Pairs that pass are compared by this many values, of which the 31 high bits travel.
DEEP = 1024
#: An estimate from DEEP values falls this far short of a likeness of 0.8 in at most 1 of 100,000,000,000 pairs.
DEEP_SLACK = 0.09
#: Columns of the table of members and values that are multiplied at once.
COLUMNS = 4096
#: Ids of documents to compare are broadcast up to this many (8 MB); beyond, they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


@cache
def picks(n: int, k: int) -> np.ndarray:
    """Places of all choices of k from n, a column each."""
    return np.array(list(combinations(range(n), k)), np.int64).T


def small_keys(values: np.ndarray, share: float, level: int) -> np.ndarray:
    """Hashes of picks of least values: two sets that are alike, the larger one of this level, have one in common."""
    least = ceil(LEVEL**level - 1e-9)
    common = ceil(share * max(least, len(values)) - 1e-9)
    if common > len(values):
        return np.empty(0, np.uint64)
    pick = min(PICK, ceil(share * least - 1e-9))
    chosen = values[picks(len(values) - common + pick, pick)]
    key = np.full(chosen.shape[1], mixed(np.array([level << 32], np.uint64))[0])
    for column in chosen:
        key = mixed(key * GOLDEN + column)
    return key


def list_keys(values: np.ndarray, share: float) -> np.ndarray:
    """Hashes of the picks or runs of retained values by which a set is listed."""
    keys = []
    n = len(values)
    for level in sorted({int(np.log(size) / np.log(LEVEL) + 1e-9) for size in (n, n / share)}):
        most = LEVEL ** (level + 1)
        if most <= SMALL:
            keys.append(small_keys(values, share, level))
            continue
        classes = min(CLASSES, int(most * (1 / share - 1)) + 1)
        residue = (values % np.uint64(classes)).astype(np.int64)
        order = np.argsort(residue, kind="stable")
        residue, ordered = residue[order], values[order]
        begin = np.searchsorted(residue, np.arange(classes + 1))
        place = np.arange(n) - begin[residue]
        kept = place < RUN
        run = np.zeros((classes, RUN), np.uint64)
        run[residue[kept], place[kept]] = ordered[kept]
        key = mixed(np.arange(classes, dtype=np.uint64) + np.uint64(level << 32))
        for column in run.T:
            key = mixed(key * GOLDEN + column)
        keys.append(key[begin[1:] > begin[:-1]])
    return np.concatenate(keys)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def signatures(docs: DataFrame, words: int, share: float) -> DataFrame:
    """doc_id, n (set size), set_key (equal for equal sets; null if empty), sketch and list keys of each row."""

    @without_words
    def sign(batches):
        for batch in text_batches(batches):
            sizes, keys, sketches, lists = [], [], [], []
            for values in shingle_sets(batch.column("text"), words):
                sizes.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                sketches.append(values[:SKETCH].copy())  # a view would hold the whole set
                lists.append(list_keys(values, share) if len(values) else values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(sketches), _lists(lists)],
                ["doc_id", "n", "set_key", "sketch", "keys"],
            )

    return docs.mapInArrow(sign, "doc_id long, n long, set_key binary, sketch array<long>, keys array<long>")


def promising(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and sketches allow a likeness of `share`; `sure` if the sketches are the sets."""
    small = nodes.select("id", "n", "sketch")
    joined = pairs.join(small.toDF("a", "n_a", "sketch_a"), "a").join(small.toDF("b", "n_b", "sketch_b"), "b")
    joined = joined.filter(F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b") - 1e-6)
    shared = F.array_intersect("sketch_a", "sketch_b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    estimate = F.size(F.array_intersect(shared, union)) / F.size(union)
    sure = F.greatest("n_a", "n_b") <= SKETCH
    alike_ = 100 * F.size(shared) >= round(share * 100) * (F.col("n_a") + F.col("n_b") - F.size(shared))
    fits = F.when(sure, alike_).otherwise(estimate >= share - SLACK)
    return joined.filter(fits).select("a", "b", sure.alias("sure"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a < b, and their other columns."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest).distinct()


def named(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` that the column `id` of `ids` names."""
    ids = ids.select(F.col("id").alias("doc_id")).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", "left_semi")


def whole_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, values) of the documents that the column `id` of `ids` names: their sets as sorted 8-byte values."""

    @without_words
    def whole(batches):
        for batch in text_batches(batches):
            sets = [values.tobytes() for values in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "values"])

    return named(docs, ids).mapInArrow(whole, "id long, values binary")


def wide_sketches(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, sketch) of the documents that the column `id` of `ids` names: set size and up to DEEP least values."""

    @without_words
    def wide(batches):
        for batch in text_batches(batches):
            sets = [(len(values), values[:DEEP].copy()) for values in shingle_sets(batch.column("text"), words)]
            sizes = pa.array([n for n, _ in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, _lists([v for _, v in sets])], ["id", "n", "sketch"])

    return named(docs, ids).mapInArrow(wide, "id long, n long, sketch array<long>").filter("n > 0").distinct()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


MEMBER = ["key", "id", "component", "n"]


def sided(members: DataFrame) -> DataFrame:
    """Members (key, id, component, n) of lists of several components, with `outside` (not in the largest one), `mains` and `outs` (members in it, and not)."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    lists = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"))
    lists = lists.filter(F.col("all") > F.col("main.size"))
    found = members.select(MEMBER).join(lists, "key")
    outside = (F.col("component") != F.col("main.component")).alias("outside")
    return found.select(*MEMBER, outside, F.col("main.size").alias("mains"), (F.col("all") - F.col("main.size")).alias("outs"))


def most_parts(share: float) -> int:
    """Greatest number of lists to which parted() takes a member: in a list of fewer blocks, meeting all of them is less work."""
    return SKETCH - ceil((share - SLACK) * SKETCH - 1e-9) + 1


def parted(members: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """Lists (key, id, component, n) parted by values: a member goes to the lists of its rarest values.

    `sketches` (id, sketch) has those of the members. Of k values, at least c of them in common
    with any sketch alike, the k - c + 1 rarest ones hold a common one.
    """
    values = members.select("key", "id").join(sketches, "id").select("key", "id", F.explode("sketch").alias("value"))
    counts = values.groupBy("key", "value").agg(F.count("*").alias("count"))
    order = values.join(counts, ["key", "value"]).groupBy("key", "id")
    order = order.agg(F.array_sort(F.collect_list(F.struct("count", "value"))).alias("order"))  # up to SKETCH values
    common = F.when(F.col("n") <= SKETCH, F.ceil(share * F.col("n") - 1e-9)).otherwise(ceil((share - SLACK) * SKETCH - 1e-9))
    wanted = (F.least("n", F.lit(SKETCH)) - common + 1).cast("int")
    chosen = members.join(order, ["key", "id"]).withColumn("of", F.explode(F.slice("order", F.lit(1), wanted)))
    chosen = chosen.filter("of.count > 1")
    return chosen.select(F.xxhash64("key", "of.value").alias("key"), *MEMBER[1:], F.col("key").alias("list"), F.col("of.count").alias("company"))


def less_work(parts: DataFrame, lists: DataFrame) -> DataFrame:
    """Keys of the lists (as sided() gives them) whose parts make less than half as many rows for blocks as the whole list."""
    rows = F.sum(1 + F.col("company") / BLOCK).alias("rows")
    found = parts.groupBy(F.col("list").alias("key")).agg(rows)
    size = F.max("mains") + F.max("outs")
    whole = lists.groupBy("key").agg((size * (1 + size / BLOCK)).alias("all"))
    return whole.join(found, "key", "left").filter("2 * coalesce(rows, 0) < all").select("key")


def numbered(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sorted lists in `values`, of these sizes, with a number for each occurrence of a value, so that no list holds one twice."""
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(values))
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    again = place - np.maximum.accumulate(np.where(first, place, 0))
    return values.astype(np.int64) * DEEP + again


def values_in_common(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each two of the sorted lists in `values`, of these sizes, the number of values in common (as often as both have them)."""
    owner = np.repeat(np.arange(len(size)), size)
    _, value, count = np.unique(numbered(values, size), return_inverse=True, return_counts=True)
    often = count[value] > 1
    column = (np.cumsum(count > 1) - 1)[value[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[often][order], column[order]
    common = np.zeros((len(size), len(size)), np.float32)
    for begin in range(0, int((count > 1).sum()), COLUMNS):
        low, high = np.searchsorted(column, (begin, begin + COLUMNS))
        has = np.zeros((len(size), COLUMNS), np.float32)
        has[owner[low:high], column[low:high] - begin] = 1
        common += has @ has.T
    return common


def deep_alike(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of `n` and `m` values may be alike by their DEEP least values, as numbered() gives them; no is certain if both have up to DEEP."""
    common = np.intersect1d(a, b, assume_unique=True)
    if max(n, m) <= DEEP:
        return 100 * len(common) >= percent * (n + m - len(common))
    union = np.union1d(a, b)[:DEEP]
    return 100 * np.searchsorted(common, union[-1], "right") >= (percent - 100 * DEEP_SLACK) * len(union) - 1e-3


def links_in_lists(members: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b, sure) of members of lists, as sided() gives them, that are in unlike components.

    `sketches` (id, n, sketch) has the sizes and up to DEEP least values of the members' sets. Sure pairs are alike, the others may be by their sketches. Members outside a list's
    largest component are dealt in blocks of about BLOCK, those in it too. A block from
    outside meets every block in a group of their own; blocks of one component never meet. Only
    pairs leave the task, and none between members that sure ones already join.
    """
    percent = round(share * 100)

    @without_words
    def compare(batches):
        for batch in batches:
            links = []
            for group in batch.column("group"):
                rows = group.values
                id_, component, block, n = (rows.field(c).to_numpy() for c in ("id", "component", "block", "n"))
                if component.min() == component.max():
                    continue
                deep, sketch = rows.field("deep"), rows.field("sketch")
                held = deep.value_lengths().to_numpy()
                deep, begin = deep.flatten().to_numpy(), np.cumsum(held) - held
                wide = np.arange(len(deep)) - np.repeat(begin, held) < WIDE
                common = values_in_common(deep[wide], np.minimum(held, WIDE))
                deep = np.split(numbered(deep, held), begin[1:])
                small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
                # An estimate of x needs x times as many common values as the union's sketch has.
                likely = np.where(
                    large <= WIDE,
                    100 * common >= percent * (small + large - common) - 1e-3,
                    (common >= (share - WIDE_SLACK) * WIDE - 1e-3) & (small >= share * large - 1e-6),
                )
                if block.min() != block.max():  # pairs inside a block are compared in its own group
                    likely &= block[:, None] != block
                joined = {c: c for c in dict.fromkeys(component.tolist())}  # components that links of this group have joined

                def root(c):
                    while joined[c] != c:
                        c = joined[c]
                    return c

                found = np.argwhere(np.triu(likely & (component[:, None] != component), 1))
                sure = large[found[:, 0], found[:, 1]] <= SKETCH
                for (i, j), known in [*zip(found[sure].tolist(), [True] * int(sure.sum())), *zip(found[~sure].tolist(), [False] * int((~sure).sum()))]:
                    one, other = root(int(component[i])), root(int(component[j]))
                    if one != other:
                        if known:
                            if not alike(sketch[i].values.to_numpy(), sketch[j].values.to_numpy(), percent):
                                continue
                            joined[max(one, other)] = min(one, other)
                        elif large[i, j] > WIDE and not deep_alike(deep[i], deep[j], int(n[i]), int(n[j]), percent):
                            continue
                        links.append((int(id_[i]), int(id_[j]), known))
            a, b, known = zip(*links) if links else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(known, pa.bool_())], ["a", "b", "sure"]
            )

    def count(size: str):
        return F.ceil(F.col(size) / BLOCK).cast("int")

    high_bits = F.transform("sketch", lambda value: F.shiftright(value, 32).cast("int"))
    sketches = sketches.select("id", "n", high_bits.alias("deep"), F.when(F.col("n") <= SKETCH, F.col("sketch")).alias("sketch"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), count("outs")).otherwise(count("mains"))).cast("int")
    met = F.when(F.col("outside"), count("mains")).otherwise(count("outs"))
    members = members.withColumn("own", own)
    across = members.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1))).select(
        *MEMBER, F.lit(0).alias("kind"), F.col("outside").cast("int").alias("block"),
        F.when(F.col("outside"), F.col("own")).otherwise(F.col("other")).alias("low"),
        F.when(F.col("outside"), F.col("other")).otherwise(F.col("own")).alias("high"),
    )
    # Block i from outside meets block j from there as (min, max); with one block only, that is itself.
    among = members.filter("outside and outs > 1").withColumn("other", F.explode(F.sequence(F.lit(0), count("outs") - 1)))
    among = among.select(
        *MEMBER, F.lit(1).alias("kind"), F.col("own").alias("block"),
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
    )
    return (
        across.union(among)
        .drop("n")
        .join(sketches, "id")
        .groupBy("key", "kind", "low", "high")
        .agg(F.collect_list(F.struct("id", "component", "block", "n", "deep", "sketch")).alias("group"))
        .select("group")
        .mapInArrow(compare, "a long, b long, sure boolean")
        .transform(ordered)
    )


def exact_links(pairs: DataFrame, docs: DataFrame, words: int, share: float) -> DataFrame:
    """Of the pairs (a, b, sure) the sure ones, and those whose whole sets have a likeness of at least `share`."""
    percent = round(share * 100)

    @without_words
    def link(batches):
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("values_a", "values_b"))
            keep = [alike(a, b, percent) for a, b in zip(*sets)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    open_ = pairs.filter(~F.col("sure")).select("a", "b")
    sets = whole_sets(docs, open_.select(F.explode(F.array("a", "b")).alias("id")), words)
    joined = open_.join(sets.toDF("b", "values_b"), "b").join(sets.toDF("a", "values_a"), "a")
    found = joined.select("a", "b", "values_a", "values_b").mapInArrow(link, "a long, b long")
    return found.union(pairs.filter("sure").select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 2, share: float = 0.8) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of `words`-word shingles have a Jaccard likeness
    of at least `share`; component_id is the least doc_id that can be reached, and the
    document with that id is kept. A text of fewer words is one shingle; a null or
    empty one is linked with nothing. Rows with equal doc_id are one document, linked
    by any of its texts; a row with a null doc_id is in no group: its component_id is
    null and it is kept. Copies of one set are never expanded into pairs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(spark, f"neardup-{name}")
        with narrow_batches(spark):
            df.write.parquet(folder)
        return spark.read.parquet(folder)

    signed = stored(signatures(docs, words, share), "signatures")
    known = signed.filter("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sketch", "keys")).alias("first"))
    classes = stored(classes.select("set_key", F.col("first.doc_id").alias("id"), "first.n", "first.sketch", "first.keys"), "classes")
    # Rows of one doc_id in several classes link these.
    member = known.select("doc_id", "set_key").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a != z")
    same = member.join(several.select("doc_id", "a"), "doc_id").filter("a != id").select("a", F.col("id").alias("b"))

    posted = classes.select(F.explode("keys").alias("key"), "id")
    lists = posted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    posted = stored(posted.join(lists, "key"), "lists")
    company = posted.groupBy("id").agg(F.sum("members").alias("company"))
    pivots = posted.join(company, "id").groupBy("key").agg(F.max(F.struct("company", "id")).getField("id").alias("a"))
    pairs = posted.join(pivots, "key").filter("a != id").select("a", F.col("id").alias("b")).transform(ordered)
    pairs = stored(promising(pairs, classes, share), "pairs")
    links = stored(exact_links(pairs, docs, words, share).union(same), "links")
    components = connected_components(links)

    placed = posted.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_lists = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = placed.join(mixed_lists.filter("low != high").select("key"), "key", "left_semi")
    left = stored(sided(left.join(classes.select("id", "n"), "id")), "mixed-lists")
    sketches = classes.select("id", "sketch")
    long_lists = left.filter(F.col("outs") > BLOCK * most_parts(share))
    parts = stored(parted(long_lists, sketches, share), "parts")
    worth = stored(less_work(parts, long_lists), "lists-to-part")
    parts = parts.join(worth.withColumnRenamed("key", "list"), "list", "left_semi")
    left = left.join(worth, "key", "left_anti").select(left.columns).union(stored(sided(parts), "parted-lists"))
    wide = stored(wide_sketches(docs, left, words), "wide-sketches")
    more = stored(links_in_lists(left, wide, share), "more-pairs")
    links = links.union(stored(exact_links(more, docs, words, share), "more-links"))
    components = connected_components(links)

    of_class = classes.select("set_key", "id").join(components, "id", "left")
    of_class = of_class.select("set_key", F.coalesce("component", "id").alias("component_id"))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(of_class, "set_key", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with all columns of `docs` (doc_id, text and any others).

    The rows of the least doc_id in a group stay, one of each text; which of several equal
    (doc_id, text) is not told. A row with a null doc_id is in a group by its text as others
    are, behind all ids. Rows with equal doc_id and other texts are one document, as in
    near_duplicates(). Texts without a word are alike only if they have one doc_id and are equal.
    """
    names, own = docs.columns, "id"
    while own.lower() in (c.lower() for c in names):
        own += "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Equal texts without an id are one document, of a number beyond ids in use.
    nameless = F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**62))
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), nameless))
    ids = rows.select(F.col(own).alias("doc_id"), text.alias("text"))
    found = near_duplicates(ids, words, share)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    rows = rows.join(dropped, own, "left_anti")
    again = rows.groupBy(own).agg(F.count("*").alias("n")).filter("n > 1").select(own)
    if again.isEmpty():
        return rows.select(names)
    single = rows.join(again, own, "left_anti")
    several = rows.join(again, own, "left_semi").dropDuplicates([own, "text"])
    return single.union(several).select(names)
