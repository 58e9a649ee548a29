"""Token-id files of shuffled planes (operator 8).

A folder of such files is a Parquet table with a row for each chunk of at most
`block` ids, written by one Spark job: its committer takes care of lost tasks, and any
store that Spark reaches will do. A chunk's ids are transposed into planes - all lowest
bytes (or bits) first, then all next ones - and each plane is compressed on its own.
The row's other columns are the chunk index: the file's place in the order of
documents (`shard`), the ids before the chunk there (`first`), and id, start and size
of each document that has ids in it. Documents lie in ascending order of id, shard after shard.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm.tokens import token_ids

BLOCK = 1 << 16
CHUNK = (
    "shard long, first long, n_ids long, doc_ids array<long>, starts array<long>, sizes array<long>, "
    "kind string, planes array<binary>"
)
CHUNK_ARROW = pa.schema(
    [("shard", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64())]
    + [(name, pa.list_(pa.int64())) for name in ("doc_ids", "starts", "sizes")]
    + [("kind", pa.string()), ("planes", pa.list_(pa.binary()))]
)


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids: 4 of bytes or 32 of bits, lowest first."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        table = np.packbits(np.unpackbits(table, axis=1, bitorder="little"), axis=0, bitorder="little")
    zip_ = zstandard.ZstdCompressor(level=level)
    return [zip_.compress(np.ascontiguousarray(plane).tobytes()) for plane in table.T]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    unzip = zstandard.ZstdDecompressor()
    table = np.stack([np.frombuffer(unzip.decompress(plane), np.uint8) for plane in planes], axis=1)
    if kind == "bit":
        bits = np.unpackbits(table, axis=0, count=n_ids, bitorder="little")
        table = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(table).view("<u4").ravel()


def write_ids(
    docs: DataFrame,
    folder: str,
    vocabulary: str = "word_bpe_49k.json",
    end: int = 2,
    block: int = BLOCK,
    kind: str = "byte",
) -> None:
    """Write the ids of all documents (doc_id, text; other columns are not read), each followed by `end`.

    Null texts are empty. Rows with the same id are separate documents in the order of
    their texts; null ids come first. An empty table gives a folder without chunks.
    """

    def chunks(batches) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held, held_docs, first = np.empty(0, np.uint32), [], 0  # ids not written yet; documents that have ids there

        def row(ids, index):
            planes = to_planes(ids, kind)
            values = [shard, first, len(ids), *([d[i] for d in index] for i in range(3)), kind, planes]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNK_ARROW)], schema=CHUNK_ARROW)

        def cut(last: bool):
            nonlocal held, held_docs, first
            at, k = 0, 0
            while len(held) - at >= block or last and at < len(held):
                ids = held[at : at + block]
                stop, open_from = first + len(ids), k
                while k < len(held_docs) and held_docs[k][1] < stop:
                    k += 1
                yield row(ids, held_docs[open_from:k])
                first, at = stop, at + len(ids)
                if k and held_docs[k - 1][1] + held_docs[k - 1][2] > stop:
                    k -= 1  # this document goes on in the next chunk
            held, held_docs = held[at:], held_docs[k:]

        for batch in batches:
            ids, ends = token_ids(batch.column("text"), vocabulary, end)
            base = first + len(held)
            held_docs += zip(batch.column("doc_id").to_pylist(), (base + ends[:-1]).tolist(), np.diff(ends).tolist())
            held = np.concatenate([held, ids])
            yield from cut(last=False)
        yield from cut(last=True)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(chunks, CHUNK).write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of each document in the files.

    A task decodes its chunks one by one. Only documents that go over a chunk's end
    are put together in a shuffle.
    """

    def pieces(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                ids = from_planes(chunk["planes"], chunk["n_ids"], chunk["kind"])
                starts, sizes = np.array(chunk["starts"], np.int64), np.array(chunk["sizes"], np.int64)
                begin = np.maximum(starts - chunk["first"], 0)
                stop = np.minimum(starts + sizes - chunk["first"], len(ids))
                parts = [ids[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk["shard"]] * len(parts), pa.int64()),
                        pa.array(chunk["doc_ids"], pa.int64()),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(begin + chunk["first"]),
                        pa.array(parts, pa.binary()),
                    ],
                    ["shard", "doc_id", "place", "n_tokens", "at", "ids"],
                )

    stored = spark.read.schema(CHUNK).parquet(folder)
    found = stored.mapInArrow(
        pieces, "shard long, doc_id long, place long, n_tokens long, at long, ids binary"
    )
    whole = F.length("ids") == 4 * F.col("n_tokens")
    parted = (
        found.filter(~whole)
        .groupBy("shard", "doc_id", "place", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .withColumn("ids", F.expr("aggregate(parts, X'', (all, p) -> concat(all, p.ids))"))
    )
    columns = ["shard", "doc_id", "place", "n_tokens", "ids"]
    documents = found.filter(whole).select(columns).unionByName(parted.select(columns))
    # One row for each file that was written: small whatever the documents.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return documents.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids"
    )
