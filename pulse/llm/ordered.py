"""Places and running totals of sorted rows when one group may hold most of them.

Rows are sorted in range partitions, so a large group lies in many tasks. Each task
numbers what it has of a group; what the tasks before it had - one small row for each
task - is added afterwards.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.session import new_folder

#: Prefix hashes are polynomials modulo this prime, so that products of two values fit in 64 bits.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_621, 1_588_635_695, 742_938_285)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo PRIME."""
    found, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        found = np.where(left & 1, found * square % PRIME, found)
        square, left = square * square % PRIME, left >> 1
    return found


def numbered(rows: DataFrame, group: str, order: list[Column], sums: tuple = (), hashes: tuple = ()) -> DataFrame:
    """`rows`, stored, with `place` (1, 2, ... by `order` inside the `group`, a long without nulls).

    Columns of `sums` become running sums, of `hashes` (0 to PRIME - 1; at most four)
    hashes of the group's values up to the row, both inclusive; `<name>_before` is the
    same without the row. Rows that are equal in group and order come in any order.
    """
    spark, names = rows.sparkSession, rows.columns
    taken = [*sums, *hashes]

    def number(batches):
        part = TaskContext.get().partitionId()
        last, held = None, np.zeros(1 + len(taken), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            goes_on = int(key[0]) == last  # what the batches before had of the first run

            def running(values, before, modulus):
                total = np.cumsum(values)
                total -= (total - values)[first][run]
                if goes_on:
                    total[run == 0] += before
                return total % modulus if modulus else total

            place = running(np.ones(len(key), np.int64), held[0], 0)
            columns, ends = [], [place[-1]]
            for k, name in enumerate(taken):
                values, modulus = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64), 0
                if name in hashes:
                    modulus = PRIME
                    values = values % PRIME * powers(BASES[hashes.index(name)], place - 1) % PRIME
                total = running(values, held[1 + k], modulus)
                before = (total - values) % modulus if modulus else total - values
                columns += [total, before]
                ends.append(total[-1])
            last, held = int(key[-1]), np.array(ends, np.int64)
            kept = [batch.column(name) for name in names if name not in taken]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.full(len(key), part)), pa.array(place), *map(pa.array, columns)], schema.names
            )

    fields = [field for field in rows.schema if field.name not in taken]
    own = ["part", "place", *(n for name in taken for n in (name, f"{name}_before"))]
    schema = T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in own)])
    keys = [F.col(group), *order]
    folder = new_folder(spark, "numbered")
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema).write.parquet(folder)
    stored = spark.read.parquet(folder)

    # A row for each task: the first group, and the totals of the last one.
    at_end = F.max(F.struct(group, "place", *taken)).alias("end")
    parts = stored.groupBy("part").agg(F.min(group).alias("first"), at_end).orderBy("part").collect()
    carried, before = [], None
    for row in parts:
        n, *totals = row.end[1:]
        mine = before[1:] if before and before[0] == row.first else (0, [0] * len(taken))
        if mine[0]:
            shifts = [pow(BASES[k], mine[0], PRIME) for k in range(len(hashes))]
            carried.append((row.part, row.first, mine[0], *mine[1], *shifts))
        if row.end[0] == row.first and mine[0]:
            shift = [1] * len(sums) + [pow(BASES[k], mine[0], PRIME) for k in range(len(hashes))]
            totals = [a + s * b for a, b, s in zip(mine[1], totals, shift)]
            totals = [t % PRIME if k >= len(sums) else t for k, t in enumerate(totals)]
            n += mine[0]
        before = (row.end[0], n, totals)
    extra = [f"_{k}" for k in range(1 + len(taken) + len(hashes))]
    schema_of = ", ".join(f"{name} long" for name in ("part", group, *extra))
    found = stored.join(F.broadcast(spark.createDataFrame(carried, schema_of)), ["part", group], "left")

    def added(name: str, k: int) -> Column:
        more = F.coalesce(f"_{k + 1}", F.lit(0))
        if name.removesuffix("_before") in sums:
            return (F.col(name) + more).alias(name)
        shift = F.coalesce(f"_{1 + len(taken) + k - len(sums)}", F.lit(1))
        return ((F.col(name) * shift + more) % PRIME).alias(name)

    return found.select(
        *(f.name for f in fields),
        (F.col("place") + F.coalesce("_0", F.lit(0))).alias("place"),
        *(added(n, k) for k, name in enumerate(taken) for n in (name, f"{name}_before")),
    )
