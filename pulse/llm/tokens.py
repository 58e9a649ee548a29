"""Token counts (operator 4), and the encoder that packing and id files share.

White space bounds every word of both vocabularies' splitting rules, so a text may be
cut at a safe boundary - a space after a character that is no white space - and its
parts encoded apart. Each Arrow batch is cut into words, and only the words that this
worker has not met go to the tokenizers library. Words that hold a special token, or
letters beyond the Latin blocks, go there whole, so every id is the library's own.
"""

import ctypes
import gc
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a splitting rule may count as white space (fixed values); the first ten are ASCII.
SPACES = [*map(chr, (32, *range(9, 14), *range(28, 32)))] + [
    *map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
]
#: Splitting rules of the two vocabularies (fixed values of the public files).
BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters below this are composed and have the same classes in every Unicode version in use.
LATIN_END = chr(0x250)
LETTER_STOP = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([.,])"
#: Words that a worker remembers; with their ids about 200 bytes each.
MAX_WORDS = 600_000
MAX_CACHED_BYTES = 64
BATCH_BYTES = 8 << 20

_cached: dict[tuple[type, str], dict] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of a Latin character.

    Printable Latin-1 characters stand for their own byte, the other bytes for 256 onwards.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = [chr(b if b in printable else next(others)) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(ord(LATIN_END))}


BYTE_LETTERS = _byte_letters()


class WordCache(dict):
    """What the vocabulary `name` makes of a word; computed where it is missing."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.library.model

    @classmethod
    def shared(cls, name: str) -> "WordCache":
        """The one of this Python worker, whose memory outlives the task."""
        cache = _cached.get((cls, name))
        if cache is None:
            cache = _cached[cls, name] = cls(name)
        if len(cache) > MAX_WORDS:
            cache.clear()
        return cache

    def keep(self, word: str, value):
        if len(word) <= MAX_CACHED_BYTES:
            self[word] = value
        return value

    @staticmethod
    def plain(text: str) -> bool:
        return "<|" not in text and (text.isascii() or max(text) < LATIN_END)


def release_free() -> None:
    """Give memory that is free back to the system: a worker outlives its task, and what Arrow and the allocator keep would lie beside later work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def forget_words() -> None:
    """Drop what this worker remembers of words; a later task that needs them begins anew."""
    if _cached:
        _cached.clear()
        gc.collect()
        release_free()


def without_words(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that needs no vocabulary and much memory: the words that earlier tasks left in its worker go before it, and its own free memory after it."""

    @wraps(work)
    def run(batches):
        forget_words()
        yield from work(batches)
        release_free()

    return run


class PieceCounts(WordCache):
    """Token counts with a byte-level vocabulary of texts between safe boundaries."""

    def __missing__(self, text: str) -> int:
        plain = self.plain(text)
        parts = BYTE_PARTS.findall(text) if plain and not text[1:].isalpha() else [text]
        if not plain:
            count = len(self.library.encode(text, add_special_tokens=False))
        elif len(parts) == 1:
            count = len(self.model.tokenize(text.translate(BYTE_LETTERS)))
        else:
            count = sum([self[part] for part in parts])
        return self.keep(text, count)


class WordIds(WordCache):
    """Ids, as bytes of little-endian unsigned 32-bit integers, with a vocabulary that drops white space."""

    def __missing__(self, word: str) -> bytes:
        plain = self.plain(word)
        if plain:
            parts = [word] if word.isalpha() and word.islower() else WORD_PARTS.findall(word.lower())
        if not plain:
            ids = self.library.encode(word, add_special_tokens=False).ids
        elif parts == [word]:
            ids = [token.id for token in self.model.tokenize(word.translate(BYTE_LETTERS))]
        else:
            return self.keep(word, b"".join([self[part] for part in parts]))
        return self.keep(word, struct.pack(f"<{len(ids)}I", *ids))


def text_runs(texts: pa.Array, size: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """`texts` without nulls, in runs of about `size` bytes; a longer text is a run of its own."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(texts):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + size, "right")))
        yield texts.slice(row, stop - row)
        row = stop


def _words(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct values of all lists, the number of each value, and where each list begins and ends."""
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return words, coded.indices.to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def token_counts(texts: pa.Array, vocabulary: str) -> np.ndarray:
    """Tokens of each text with a byte-level vocabulary."""
    out = [np.empty(0, np.int64)]
    for run in text_runs(texts):
        counts = PieceCounts.shared(vocabulary)
        # A space after other white space is no safe boundary: such texts are cut by a slower rule.
        odd = np.zeros(len(run), bool)
        for space in SPACES:
            odd |= pc.match_substring(run, space + " ").to_numpy(zero_copy_only=False)
        words, which, ends = _words(pc.split_pattern(run, " "))
        sizes = np.fromiter(map(counts.__getitem__, [" " + word for word in words]), np.int64, len(words))[which]
        heads = ends[:-1]  # a text's first word has no space before it
        first = [words[i] for i in which[heads]]
        sizes[heads] = np.fromiter(map(counts.__getitem__, first), np.int64, len(first))
        total = _sums(sizes, ends)
        for row in np.flatnonzero(odd):
            head, *rest = re.split(r"(?<=\S) ", run[int(row)].as_py())
            total[row] = counts[head] + sum(counts[" " + word] for word in rest)
        out.append(total)
    return np.concatenate(out)


def token_ids(texts: pa.Array, vocabulary: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by `end`, and where each text begins and ends among them."""
    ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for run in text_runs(texts):
        cache = WordIds.shared(vocabulary)
        if not pc.any(pc.match_substring(run, "<|")).as_py() and _composed(run):
            # Fewer words to look up; a letter and a comma or stop are always parted.
            run = pc.replace_substring_regex(pc.ascii_lower(run), LETTER_STOP, r"\1 \2")
        words, which, ends = _words(pc.ascii_split_whitespace(run))
        # Each text's last word is followed by a word of its own that stands for `end`.
        which = np.insert(which, ends[1:], len(words))
        ends = ends + np.arange(len(ends))
        coded = [*map(cache.__getitem__, words), struct.pack("<I", end)]
        flat = np.frombuffer(b"".join(coded), "<u4")
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin = np.cumsum(length) - length
        n = length[which]
        stop = np.cumsum(n)
        ids.append(flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[which] - stop + n, n)])
        sizes.append(_sums(n, ends))
    sizes = np.concatenate(sizes)
    # A worker outlives its task: what Arrow keeps of the runs' words would stay beside the work of later stages.
    run = words = which = coded = flat = None
    release_free()
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])


def _composed(run: pa.Array) -> bool:
    """Whether lower case is the same before and after composing letters: no combining marks."""
    return not pc.any(pc.match_substring_regex(run, r"[^\x{00}-\x{24F}]")).as_py()


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): its bytes and tokens.

    A null text is empty: no bytes, no tokens. Whole texts count, however long; special
    tokens inside a text count as the library counts them. Repeated rows and null ids
    each give their row. `over_limit` marks texts of more than `limit` tokens.
    """

    def count(batches):
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(token_counts(texts, vocabulary))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
