"""Prefix trie of conversations by collapsing whole sequences (operator 13).

A conversation is the sequence of its turns; a prefix is known by a hash of it, so texts
never travel. Identical conversations are one weighted sequence, named by its smallest
member. Sequences that are proper prefixes of others are told from the leaves by an
anti-join, and the weighted prefixes of all sequences are aggregated to nodes.

A node's smallest member goes on through one child at most, so every sequence owns a
chain of nodes. What a node and all below it sum up to is the sum over the chains of all
sequences through the node, without the part of its own chain above it: running sums
along chains and one more aggregate, however deep the trie is.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.ordered import PRIME, numbered
from pulse.session import new_folder

HEADS = 9
FAMILY = 5
#: Ids that one row holds while the ends of a node are put in order.
CHUNK = 1000
EMPTY = hashlib.sha256(b"").hexdigest()
HASHES = ("h0", "h1", "h2", "h3")
NODE = ["depth", "high", "low"]


def key(names: list[str]) -> list[Column]:
    """Two longs of four hashes."""
    a, b, c, d = (F.col(n) for n in names)
    return [F.shiftleft(a, 31).bitwiseOR(b), F.shiftleft(c, 31).bitwiseOR(d)]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, place, bytes and hashes of each turn, in the order of turns (null first), then roles, then hashes of texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)
    hashed = [F.pmod(F.shiftright(F.xxhash64(F.lit(k), "role", "text"), 17), F.lit(PRIME)).alias(h) for k, h in enumerate(HASHES)]
    rows = rows.filter("conv_id is not null").select(
        "conv_id", "turn", "role", F.octet_length("text").cast("long").alias("bytes"), *hashed
    )
    # Repeated turns are told apart by `row`, so that any number of them can be dealt out.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role"), *map(F.col, HASHES), F.col("row")]
    return numbered(rows, "conv_id", order).select("conv_id", "place", "bytes", *HASHES)


def rebuilt_rows(turns: DataFrame, conversations: DataFrame, heads: int, family: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth, its hash, that of the prefix before, bytes of the last text.

    Conversation c begins with the first h turns of conversation c - c % family and goes
    on with its own turns after its first h; h is the crc32 of c as decimal text modulo `heads`.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    shared = turns.filter((F.col("place") < heads) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    first = conversations.select("conv_id", base, h.alias("h")).join(shared, "base").filter("place <= h")
    own = turns.filter(F.col("place") > h)
    columns = ["conv_id", "place", "bytes", *HASHES]
    rows = first.select(*columns, F.lit(0).alias("part_of")).union(own.select(*columns, F.lit(1).alias("part_of")))
    rows = rows.withColumnRenamed("place", "turn_place")
    rows = numbered(rows, "conv_id", [F.col("part_of"), F.col("turn_place")], hashes=HASHES)
    high, low = key([*HASHES])
    before_high, before_low = key([f"{name}_before" for name in HASHES])
    return rows.select(
        "conv_id", F.col("place").alias("depth"), high.alias("high"), low.alias("low"),
        before_high.alias("before_high"), before_low.alias("before_low"), "bytes",
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """For each node at which conversations end the SHA-256 of their ids, ascending and comma-joined.

    Ids are sorted in range partitions and joined to rows of up to CHUNK of them; only these
    rows of a node meet in a task, which hashes them as they come and holds one batch.
    """

    def chunks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = np.stack([batch.column(c).to_numpy() for c in NODE], axis=1)
            ids = batch.column("conv_id").to_pylist()
            new = np.flatnonzero(np.any(nodes[1:] != nodes[:-1], axis=1)) + 1
            cuts = sorted({0, *new.tolist(), *range(0, len(ids), CHUNK)})
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            picked = [pa.array(nodes[cuts, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*picked, pa.array([ids[a] for a in cuts], pa.int64()), pa.array(texts)], [*NODE, "first", "ids"])

    def digests(batches):
        node, digest = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])], [*NODE, "ends"])

        for batch in batches:
            for *of, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if of != node:
                    if node is not None:
                        yield row()
                    node, digest = of, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if node is not None:
            yield row()

    schema = ", ".join(f"{c} long" for c in NODE)
    joined = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = joined.select(*NODE, "conv_id").mapInArrow(chunks, f"{schema}, first long, ids string")
    joined = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return joined.mapInArrow(digests, f"{schema}, ends string")


def prefix_trie(conversations: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """One row for each distinct prefix of the rebuilt `conversations` (conv_id, turn, role, text; others are not read).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. A null role or text is empty. Equal turns of a
    conversation come in the order of roles, then of hashes of their texts; repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation and are left out.
    An empty table gives no node, not even a root.
    """
    spark = conversations.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(spark, f"prefixes-{name}")
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    turns = turn_rows(conversations)
    known = turns.select("conv_id").distinct()
    rows = rebuilt_rows(turns, known, heads, family)
    root = [F.lit(0).cast("long").alias(c) for c in NODE]
    # Where each conversation ends; one without turns ends at the root.
    whole = rows.select("conv_id", *NODE).union(known.select("conv_id", *root))
    ends = whole.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    ends = stored(ends, "ends")

    sequences = ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("seq"))
    inner = rows.select((F.col("depth") - 1).alias("depth"), F.col("before_high").alias("high"), F.col("before_low").alias("low")).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    others = sequences.join(inner, NODE, "left_semi").withColumn("leaf", F.lit(0).cast("long"))
    sequences = stored(leaves.union(others).select("seq", "weight", "leaf"), "sequences")
    none = F.lit(None).cast("long")
    prefixes = rows.withColumnRenamed("conv_id", "seq").join(sequences, "seq")
    columns = ["seq", *NODE, "before_high", "before_low", "bytes", "weight", "leaf"]
    tops = sequences.select("seq", *root, none.alias("before_high"), none.alias("before_low"), F.lit(0).cast("long").alias("bytes"), "weight", "leaf")
    prefixes = stored(prefixes.select(*columns).union(tops), "rows")

    nodes = prefixes.groupBy(*NODE).agg(
        F.min("seq").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.max("before_high").alias("before_high"),
        F.max("before_low").alias("before_low"),
        ((F.sum("weight") - 1) * F.max("bytes")).alias("cost"),
    )
    chains = numbered(nodes, "conv_id", [F.col("depth")], sums=("cost",)).withColumnRenamed("cost_before", "above")
    own_cost = (F.col("cost") - F.col("above")).alias("total")
    totals = chains.groupBy(F.col("conv_id").alias("seq")).agg(F.sum(own_cost).alias("total")).filter("total > 0")
    through = prefixes.select("seq", *NODE).join(totals, "seq").groupBy(*NODE).agg(F.sum("total").alias("total"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("before_high").alias("high"), F.col("before_low").alias("low")]
    children = chains.filter("depth > 0").select(*up)
    zero, no_ends = F.lit(0).cast("long"), F.lit(None).cast("string").alias("ends")
    facts = (
        through.select(*NODE, "total", zero.alias("child"), no_ends)
        .union(children.select(*NODE, zero.alias("total"), F.lit(1).cast("long").alias("child"), no_ends))
        .union(end_hashes(ends).select(*NODE, zero.alias("total"), zero.alias("child"), "ends"))
        .groupBy(*NODE)
        .agg(F.sum("total").alias("total"), F.sum("child").alias("n_children"), F.max("ends").alias("ends"))
    )
    parents = chains.select(
        (F.col("depth") + 1).alias("depth"), F.col("high").alias("before_high"), F.col("low").alias("before_low"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    found = chains.join(facts, NODE, "left").join(parents, ["depth", "before_high", "before_low"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.coalesce("total", F.lit(0)) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
