"""Hashed word shingles of texts, batch by batch, for operators that run in Arrow functions."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pulse.llm.tokens import text_runs

#: Bytes of text whose words are worked on at once.
RUN_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all."""
    values = (values ^ (values >> np.uint64(30))) * MIX[0]
    values = (values ^ (values >> np.uint64(27))) * MIX[1]
    return values ^ (values >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z in lower case, parted by ASCII white space), and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    which = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    real = np.fromiter(map(bool, words), bool, len(words))[which]  # white space at a text's ends leaves empty words
    before = np.concatenate([[0], np.cumsum(real)])
    return hashes[which][real], before[ends]


def text_batches(batches: Iterator[pa.RecordBatch], size: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of each batch with about `size` bytes in its column `text`, so that few sets are held at once; a longer text is a part of its own."""
    for batch in batches:
        row = 0
        for run in text_runs(batch.column("text"), size):
            yield batch.slice(row, len(run))
            row += len(run)


def shingle_sets(texts: pa.Array, size: int = 2) -> Iterator[np.ndarray]:
    """For each text the ascending 63-bit hashes of its distinct shingles of `size` words.

    Fewer words are one shingle together; no words give an empty set.
    """
    for run in text_runs(texts, RUN_BYTES):
        words, ends = word_hashes(run)
        combined = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            combined = mixed(combined * GOLDEN + words[k : k + len(combined)])
        combined >>= np.uint64(1)
        for begin, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if stop - begin >= size:
                yield np.unique(combined[begin : stop - size + 1])
            else:
                short = np.zeros(min(1, stop - begin), np.uint64)
                for word in words[begin:stop]:
                    short = mixed(short * GOLDEN + word + np.uint64(size))
                yield short >> np.uint64(1)
