"""Hierarchical packing of documents into training sequences of several lengths (operator 1)."""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.tokens import release_free, token_ids

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 64 * 2048

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_id long, ids binary"
)


class Pool:
    """Pieces that wait for a place, by length. A piece is (doc_id, tokens of its document, start, ids)."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.lengths = 0  # bit n is set if there is a piece of n ids
        self.size = 0

    def add(self, piece) -> None:
        n = len(piece[3])
        self.by_length.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.size += n

    def take(self, most: int):
        """A longest piece of at most `most` ids, or None."""
        n = (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1:
            return None
        own = self.by_length[n]
        piece = own.pop()
        if not own:
            self.lengths ^= 1 << n
        self.size -= n
        return piece


def cut(piece, n: int) -> tuple:
    doc, tokens, start, ids = piece
    return (doc, tokens, start, ids[:n]), (doc, tokens, start + n, ids[n:])


def fill(pool: Pool, window: int, first=None) -> list:
    """A full window: its gap goes to the longest pieces that fit, at last to part of one that does not.

    The pool must hold at least `window` ids, `first` included.
    """
    own, gap = ([first], window - len(first[3])) if first else ([], window)
    while gap:
        piece = pool.take(gap)
        if piece is None:
            piece, rest = cut(pool.take(max(TIERS[-1], window)), gap)
            pool.add(rest)
        own.append(piece)
        gap -= len(piece[3])
    return own


def pack_pool(pool: Pool, tiers: tuple[int, ...]) -> Iterator[tuple[int, list]]:
    """Full windows (size, pieces), longest tier first, until what is left fills none.

    A piece opens a window of the smallest tier that holds it whole; the gap
    behind it is filled from shorter tiers.
    """
    while pool.size:
        first = pool.take(tiers[-1])
        n = len(first[3])
        window = next(t for t in tiers if t >= n)
        if n + pool.size < window:
            pool.add(first)
            return
        yield window, fill(pool, window, first)


def pack_rest(pool: Pool) -> Iterator[tuple[int, list]]:
    """What fills no window goes to sequences that each have a power of two ids."""
    while pool.size:
        window = 1 << (pool.size.bit_length() - 1)
        yield window, fill(pool, window)


def deal_steps(windows: list[tuple[int, list]], n: int) -> list[int]:
    """The step of each window: `n` steps of even token counts and tier mix.

    Longest windows first, each goes to the step with the fewest ids so far.
    """
    loads = [(0, step) for step in range(n)]
    steps = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -windows[k][0]):
        load, step = loads[0]
        steps[k] = step
        heapq.heapreplace(loads, (load + windows[k][0], step))
    return steps


def full_steps(windows: list[tuple[int, list]], step_tokens: int) -> tuple[int, int]:
    """(number of steps, windows that fill them), leaving at least a step's ids for what comes later."""
    n = sum(size for size, _ in windows) // step_tokens - 1
    taken = total = 0
    while total < n * step_tokens:
        total += windows[taken][0]
        taken += 1
    return max(n, 0), taken


def copied(piece):
    """The piece with ids of its own, so that those of its batch can go."""
    *about, ids = piece
    return (*about, ids.copy())


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns are not read) in sequences of at most max(tiers) ids.

    A document is its ids and `end`; a null or empty text is `end` alone. Whole windows
    of the longest tier are cut off first; the rest is routed to the smallest tier that
    holds it. Each tier is packed best-fit, gaps of long windows being filled from
    shorter tiers. Every task packs its own rows batch by batch, keeping less than a
    window and two steps between batches; what it has left at its end goes to sequences of powers of
    two, so no sequence is padded. Rows that repeat or have a null id are documents of
    their own. `sequence_id` is unique; `offset` counts ids before the piece in its
    sequence; sequences of a `step_id` hold `step_tokens` ids in total, give or take a window. A
    task's last two steps share what is left and hold three quarters to one and a half of that; a task with fewer ids is one step.
    A text of any length is cut; its ids are in memory with those of its batch. An empty table has no pieces.
    """
    longest = tiers[-1]
    if list(tiers) != sorted(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be ascending powers of two")

    def pack_task(batches):
        base = TaskContext.get().partitionId() << 33
        pool, waiting, sequences, steps = Pool(), [], 0, 0

        def rows(windows, n):
            nonlocal sequences, steps
            dealt = deal_steps(windows, n)
            columns = [[] for _ in range(9)]
            for (size, pieces), step in zip(windows, dealt):
                offset = 0
                for doc, tokens, start, ids in pieces:
                    row = (doc, start, len(ids), tokens, base + sequences, offset, size, base + steps + step, ids.tobytes())
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += len(ids)
                sequences += 1
            steps += n
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_id", "ids"],
            )

        for batch in batches:
            ids, ends = token_ids(batch.column("text"), vocabulary, end)
            windows = waiting
            for doc, begin, stop in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                whole = (stop - begin) // longest * longest
                for start in range(0, whole, longest):
                    piece = (doc, stop - begin, start, ids[begin + start : begin + start + longest])
                    windows.append((longest, [piece]))
                if begin + whole < stop:
                    pool.add((doc, stop - begin, whole, ids[begin + whole : stop]))
            windows += pack_pool(pool, tiers)
            kept, pool = pool, Pool()
            while kept.size:
                pool.add(copied(kept.take(longest)))
            n, taken = full_steps(windows, step_tokens)
            if n:
                yield rows(windows[:taken], n)
            waiting = [(size, [*map(copied, pieces)]) for size, pieces in windows[taken:]]
        waiting += pack_rest(pool)
        if waiting:
            yield rows(waiting, max(1, round(sum(size for size, _ in waiting) / step_tokens)))
        pool = windows = waiting = kept = None
        release_free()  # the worker outlives its task

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(pack_task, SCHEMA)
