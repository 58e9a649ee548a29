"""Byte-level BPE by a lazily determinised transducer, and streaming decoding (operator 12).

Merging by ranks gives a piece of text the one sequence of tokens in which every two
neighbours, merged alone, stay as they are. So whether a token can end a prefix depends only
on the token before it, the last one of a shorter prefix. The transducer reads byte by byte.
Its state is the set of places in the vocabulary's trie that tokens begun so far have
reached; sets are made when they are first met and kept with their transitions, at most one
for each node of the trie. A register holds the last tokens of the prefixes that a token may
still follow, no more than the longest token has bytes. Of the tokens that end at a byte
the one that stays beside its predecessor is noted. What is common to all prefixes in the
register is emitted, so the lookahead is bounded.

Decoding reads tokens one by one through a machine whose state is the start of a UTF-8
character that has not ended yet.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.learning import RUN_BYTES
from pulse.llm.shingles import GOLDEN
from pulse.llm.tokens import LATIN_END, LETTER_STOP, SPACES, _words, text_runs, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_WORDS = 400_000
#: Bytes of ids of long words that a worker remembers.
MAX_CACHED_BYTES = 32 << 20
#: Longer pieces run through the transducer alone.
LANE_BYTES = 64
LONG_WORD = 256
MAX_PAIRS = 1_000_000
#: Bytes after which what is settled is emitted, and the register cut.
REGISTER = 1024
#: Parts the words of a run; texts that have it themselves go another way.
MARK = "\x01"
ODD = rf"[{''.join(rf'\x{{{ord(c):x}}}' for c in SPACES)}][ \n]|\n[{''.join(rf'\x{{{ord(c):x}}}' for c in SPACES)}]|{MARK}"


@cache
def splitter(exact: bool):
    """The pattern that parts text before merging. Exact: with the character classes of the tiktoken library.

    Both know the same classes for Latin letters; for later additions to Unicode the library is asked.
    """
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    if not exact:
        return regex.compile(pattern)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for name in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={})
        known = set(bytes(library.encode_ordinary(points)).decode())
        newer = [ord(c) for c in regex.findall(name, points) if c not in known]
        older = known - set(regex.findall(name, points))
        if older:
            raise RuntimeError(f"{name}: the library knows {len(older)} characters more")
        if newer:
            runs = np.split(newer, np.flatnonzero(np.diff(newer) != 1) + 1)
            apart = "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)
            # As a class of its own or inside a negated one the newer characters must count as no letter.
            pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{apart}])")
            pattern = pattern.replace(f" ?{name}+", rf" ?(?:(?![{apart}]){name})+")
    return regex.compile(pattern)


class Pairs:
    """Verdicts on pairs of tokens (one << 32 | other) by open addressing, so that many are looked up at once."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.forget()

    def forget(self) -> None:
        self.keys, self.verdicts, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, bool), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it belongs."""
        slot = ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return slot

    def put(self, keys: np.ndarray, verdicts: np.ndarray) -> None:
        """Keep distinct new keys."""
        self.n += len(keys)
        while len(keys):
            slot, first = np.unique(self.slots(keys), return_index=True)  # of keys that want one place the first gets it
            self.keys[slot], self.verdicts[slot] = keys[first], verdicts[first]
            keys, verdicts = np.delete(keys, first), np.delete(verdicts, first)


class Transducer:
    """Encodes pieces with a rank vocabulary that has all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The pair of tokens that a token is merged from, if ranks only grow from parts to wholes.
        self.halves = self.split_all()
        # The trie: children of each node by byte, and the size and token that end there.
        self.children: list[dict[int, int]] = [{}]
        self.ended: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if not self.halves and self.merged(token) != [token]:
                continue  # comes as a whole piece only
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.children)
                    self.children.append({})
                node = below
            self.ended[node] = (len(token), rank)
        # States: sets of nodes, longest way first; the tokens that end in each; transitions.
        self.sets: list[tuple[int, ...]] = [()]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.places: dict[tuple[int, ...], int] = {(): 0}
        self.steps = np.full((1 << 10, 256), -1, np.int32)
        self.end_sizes, self.end_tokens = (np.zeros((1 << 10, 0), np.int32) for _ in range(2))
        self.size_of = np.array([self.sizes.get(rank, 0) for rank in range(max(self.sizes) + 1)], np.int64)
        self.spines: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.neighbours = Pairs()
        self.recent: dict[int, bool] = {}

    def merged(self, piece: bytes, below: int = 1 << 62) -> list[bytes]:
        """The plain rule: the adjacent pair of least rank is merged, the first of equals, until none has a rank `below`."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split_all(self) -> dict[int, tuple[int, int]]:
        """The last merge of each token of two bytes or more; nothing unless every token outranks its parts."""
        halves = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self.merged(token, rank)
                if len(parts) != 2 or max(map(self.ranks.get, parts)) >= rank:
                    return {}
                halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return halves

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts at a token's left (0) or right (1) border while it is merged: bytes, rank of their merge, of the next one."""
        found = self.spines.get((token, side))
        if found is None:
            found, part, ends = [], token, 1 << 62
            while part in self.halves:
                found.append((self.bytes_of[part], part, ends))
                part, ends = self.halves[part][side], part
            found.append((self.bytes_of[part], -1, ends))
            self.spines[token, side] = found
        return found

    def stay(self, key: int) -> bool:
        """Whether two adjacent tokens (one << 32 | other) stay as they are when their bytes are merged."""
        one, other = key >> 32, key & 0xFFFFFFFF
        a, b = self.bytes_of[one], self.bytes_of[other]
        return a + b not in self.ranks and (self.apart(one, other) if self.halves else self.merged(a + b) == [a, b])

    def staying(self, keys: np.ndarray) -> np.ndarray:
        """stay() of many pairs."""
        pairs = self.neighbours
        slot = pairs.slots(keys)
        new = pairs.keys[slot] != keys
        if new.any():
            if 2 * (pairs.n + len(keys)) > len(pairs.keys):
                pairs.forget()
                new[:] = True
            unknown = np.unique(keys[new])
            pairs.put(unknown, np.fromiter(map(self.stay, unknown.tolist()), bool, len(unknown)))
            slot = pairs.slots(keys)
        return pairs.verdicts[slot]

    def apart(self, one: int, other: int) -> bool:
        """Whether no merge ever joins the two: none of parts that lie at the border together has a rank below their own next merges.

        A part is there from its own merge (-1: from the beginning) until its next one. Of
        equal ranks the merge further left comes first.
        """
        ranks = self.ranks
        for part, born, ends in self.spine(one, 1):
            for next_part, next_born, next_ends in self.spine(other, 0):
                if born < next_ends and next_born < ends:
                    rank = ranks.get(part + next_part)
                    if rank is not None and rank < ends and rank <= next_ends:
                        return False
        return True

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        nodes = tuple(below for node in (*self.sets[state], 0) if (below := self.children[node].get(byte)) is not None)
        place = self.places.get(nodes)
        if place is None:
            place = self.places[nodes] = len(self.sets)
            self.sets.append(nodes)
            ends = [self.ended[node] for node in nodes if node in self.ended]
            more = max(0, len(self.sets) - len(self.steps)) and len(self.steps)
            wider = max(0, len(ends) - self.end_sizes.shape[1])
            if more or wider:
                self.steps = np.pad(self.steps, ((0, more), (0, 0)), constant_values=-1)
                self.end_sizes, self.end_tokens = (np.pad(a, ((0, more), (0, wider))) for a in (self.end_sizes, self.end_tokens))
            for k, (size, token) in enumerate(ends):
                self.end_sizes[place, k], self.end_tokens[place, k] = size, token
        self.steps[state, byte] = place
        return place

    def back(self, last: list[int], stop: int) -> list[int]:
        """The tokens of the prefix of `stop` bytes."""
        out = []
        while stop:
            out.append(last[stop])
            stop -= self.sizes[last[stop]]
        return out[::-1]

    def settled(self, last: list[int]) -> int:
        """The longest prefix that all prefixes which tokens may still follow have in common."""
        open_ = set(range(max(0, len(last) - self.longest), len(last)))
        while len(open_) > 1:
            most = max(open_)
            open_.remove(most)
            open_.add(most - self.sizes[last[most]])
        return open_.pop()

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match of the splitting pattern, of any length: only the register is held, and what is emitted."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, last, state, check = [], [0], 0, REGISTER  # last[n]: the last token of the first n bytes
        for byte in piece:
            known = int(self.steps[state, byte])
            state = known if known >= 0 else self.step(state, byte)
            at = len(last)
            for node in self.sets[state]:
                size, token = self.ended.get(node, (0, 0))
                if size and (size == at and not out or size <= at and self.near(last[at - size] << 32 | token)):
                    last.append(token)
                    break
            if at > check:
                cut = self.settled(last)
                out += self.back(last, cut)
                last = last[cut:]
                check = max(REGISTER, 2 * len(last))
        return out + self.back(last, len(last) - 1)

    def near(self, key: int) -> bool:
        if len(self.recent) > MAX_PAIRS:
            self.recent.clear()
        known = self.recent.get(key)
        if known is None:
            known = self.recent[key] = self.stay(key)
        return known

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of short pieces as little-endian unsigned 32-bit integers: the machine runs over all of them side by side."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-length, kind="stable")  # lanes that still run are the first ones
        length = length[order]
        flat = np.frombuffer(b"".join([pieces[k] for k in order.tolist()]), np.uint8)
        begin = np.cumsum(length) - length
        widest = int(length[0]) if len(length) else 0
        last = np.zeros((widest + 1, len(pieces)), np.int32)
        state = np.zeros(len(pieces), np.int64)
        for at in range(1, widest + 1):
            lanes = int(np.searchsorted(-length, -at, "right"))
            byte = flat[begin[:lanes] + at - 1]
            after = self.steps[state[:lanes], byte]
            new = after < 0
            if new.any():
                for key in np.unique(state[:lanes][new] << 8 | byte[new]).tolist():
                    self.step(key >> 8, key & 255)
                after = self.steps[state[:lanes], byte]
            state[:lanes] = after
            open_, k = np.arange(lanes), 0
            while len(open_):
                size, token = self.end_sizes[state[open_], k], self.end_tokens[state[open_], k]
                fits = size == at
                asked = np.flatnonzero(~fits)
                keys = last[at - size[asked], open_[asked]].astype(np.int64) << 32 | token[asked]
                fits[asked] = self.staying(keys)
                last[at, open_[fits]] = token[fits]
                open_, k = open_[~fits], k + 1
        # From the end back: every token tells where the one before it ends.
        stop, open_, found = length.copy(), np.arange(len(pieces)), []
        count = np.zeros(len(pieces), np.int64)
        while len(open_ := open_[stop[open_] > 0]):
            token = last[stop[open_], open_]
            found.append((open_, token))
            stop[open_] -= self.size_of[token]
            count[open_] += 1
        ends = np.cumsum(count)
        tokens = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
        for k, (lane, token) in enumerate(found):
            tokens[ends[lane] - 1 - k] = token
        data, borders = tokens.tobytes(), (4 * np.concatenate([[0], ends])).tolist()
        out = [b""] * len(pieces)
        for lane, k in enumerate(order.tolist()):
            out[k] = data[borders[lane] : borders[lane + 1]]
        return out


class Decoder:
    """Text of a stream of tokens, as far as its characters are complete.

    The state is the start of an unfinished character (at most three bytes). Bytes that
    belong to no character become U+FFFD, as in the standard library's decoder.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.state = b""
        # Tokens that are whole characters lead from the empty state back to it.
        moved = {token: self.move(b"", token) for token in bytes_of}
        self.texts = [moved[token][0] if token in moved else "" for token in range(max(bytes_of, default=-1) + 1)]
        self.whole = np.zeros(max(bytes_of, default=-1) + 1, bool)
        self.whole[[token for token, (_, rest) in moved.items() if not rest]] = True

    @staticmethod
    def sound(data: bytes, at: int) -> tuple[int, bool]:
        """How many bytes from `at` belong together, and whether they are a whole character (else: broken or unfinished)."""
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if size < 2:
            return 1, size == 1
        # The second byte rules out overlong forms, surrogates and what lies over U+10FFFF.
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        n = 1
        while n < size and at + n < len(data) and low <= data[at + n] <= high:
            n, low, high = n + 1, 0x80, 0xBF
        return n, n == size

    def move(self, state: bytes, token: int) -> tuple[str, bytes]:
        """The text that a token completes, and the state after it."""
        data, at, out = state + self.bytes_of[token], 0, []
        while at < len(data):
            n, whole = self.sound(data, at)
            if not whole and at + n == len(data) and (n > 1 or data[at] >= 0xC2 and data[at] < 0xF5):
                break  # unfinished
            out.append(data[at : at + n].decode() if whole else "�")
            at += n
        if len(self.moves) > MAX_PAIRS:
            self.moves.clear()
        found = self.moves[state, token] = ("".join(out), data[at:])
        return found

    def feed(self, ids: np.ndarray) -> str:
        """The text that these tokens complete."""
        state, moves, out = self.state, self.moves, []
        text_of, tokens = self.texts.__getitem__, ids.tolist()
        at = 0
        for part in [*np.flatnonzero(~self.whole[ids]).tolist(), len(tokens)]:
            while state and at < len(tokens):
                text, state = moves.get((state, tokens[at])) or self.move(state, tokens[at])
                out.append(text)
                at += 1
            if at < part:
                out += map(text_of, tokens[at:part])
                at = part
            if at == part < len(tokens):
                text, state = moves.get((state, tokens[at])) or self.move(state, tokens[at])
                out.append(text)
                at += 1
        self.state = state
        return "".join(out)

    def close(self) -> str:
        """What is left at the end of a stream: an unfinished character is a broken one."""
        left, self.state = self.state, b""
        return "�" if left else ""


class Words(dict):
    """Ids, as bytes of little-endian unsigned 32-bit integers, of text between safe boundaries."""

    def __init__(self, vocabulary: str):
        with open(tokenizer_path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.machine = Transducer(ranks)
        self.decoder = Decoder(self.machine.bytes_of)
        self.size = 0

    def __missing__(self, text: str) -> bytes:
        self.learn([text])
        return self[text]

    def learn(self, texts: list[str]) -> None:
        """Make the ids of all these texts known."""
        parted, pieces = [], {}
        for text in texts:
            plain = text.isascii() or max(text) < LATIN_END
            if plain and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                pieces[text] = b""
            else:
                own = splitter(not plain).findall(text)
                parted.append((text, own))
                pieces |= dict.fromkeys([piece for piece in own if piece not in self], b"")
        coded = [piece.encode() for piece in pieces]
        whole = [self.machine.ranks.get(data) for data in coded]
        lanes = [k for k, data in enumerate(coded) if whole[k] is None and len(data) <= LANE_BYTES]
        made = dict(zip(lanes, self.machine.encode_many([coded[k] for k in lanes])))
        for k, piece in enumerate(pieces):
            if whole[k] is not None:
                ids = whole[k].to_bytes(4, "little")
            else:
                ids = made[k] if k in made else np.array(self.machine.encode(coded[k]), "<u4").tobytes()
            pieces[piece] = ids
        self.update(pieces)
        for text, own in parted:
            self[text] = b"".join([self[piece] for piece in own])
        self.size += sum(len(self[text]) for text, _ in parted if len(text) > LONG_WORD)


@cache
def words_of(vocabulary: str) -> Words:
    """The one of this Python worker, whose memory outlives the task."""
    return Words(vocabulary)


def short_runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, pa.Array, bool]]:
    """Runs of texts as (row of the first, texts, whether the last one ends): longer texts come in parts, cut at safe boundaries."""
    row = 0
    for run in text_runs(texts, size):
        if len(run) > 1 or len(run[0].as_py()) <= size:
            yield row, run, True
        else:
            text, at = run[0].as_py(), 0
            while len(text) - at > size:
                # A space after a character that is no white space, and before one that is none.
                cut = regex.compile(r"(?<=\S) (?=\S)").search(text, at + size)
                if cut is None:
                    break
                yield row, pa.array([text[at : cut.start()]], pa.string()), False
                at = cut.start()
            yield row, pa.array([text[at:]], pa.string()), True
        row += len(run)


def encoded(texts: pa.Array, vocabulary: str = VOCABULARY) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """For runs of texts: row of the first, all ids, each text's borders among them, whether the last text ends."""
    for row, run, over in short_runs(texts):
        cache_ = words_of(vocabulary)
        if len(cache_) > MAX_WORDS or cache_.size > MAX_CACHED_BYTES:
            cache_.clear()
            cache_.size = 0
        # White space after white space is no safe boundary: such texts are cut by a slower rule.
        odd = pc.match_substring_regex(run, ODD).to_numpy(zero_copy_only=False)
        parts = pc.replace_substring(pc.replace_substring(run, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        parts = pc.replace_substring_regex(parts, LETTER_STOP, rf"\1{MARK}\2")
        words, place, ends = _words(pc.split_pattern(parts, MARK))
        cache_.learn([word for word in words if word not in cache_])
        coded = [*map(cache_.__getitem__, words)]
        flat = np.frombuffer(b"".join(coded), "<u4")
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin = np.cumsum(length) - length
        n = length[place]
        stop = np.cumsum(n)
        ids = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[place] - stop + n, n)]
        borders = np.concatenate([[0], stop])[ends]
        if odd.any():
            own = [ids[a:b] for a, b in zip(borders[:-1], borders[1:])]
            for k in np.flatnonzero(odd).tolist():
                head, *rest = re.split(r"(?<=\S) ", run[k].as_py())
                rest = [head, *(" " + word for word in rest)]
                cache_.learn([word for word in {*rest} if word not in cache_])
                own[k] = np.frombuffer(b"".join(map(cache_.__getitem__, rest)), "<u4")
            ids = np.concatenate(own)
            borders = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        yield row, ids, borders, over


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts are encoded, without special tokens, and their ids decoded again. A null
    text is empty: no ids. Repeated rows and null ids give a row each. Long texts pass in
    parts, so a task holds one run of texts, and no text's ids, at a time.
    """

    def run(batches):
        for batch in batches:
            counts, hashes, texts = [], [], []
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for _, ids, borders, over in encoded(batch.column("text"), vocabulary):
                decoder = words_of(vocabulary).decoder
                last = len(borders) - 2
                for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
                    n += b - a
                    of_ids.update(ids[a:b].tobytes())
                    of_text.update(decoder.feed(ids[a:b]).encode())
                    if k < last or over:
                        of_text.update(decoder.close().encode())
                        counts.append(n)
                        hashes.append(of_ids.hexdigest())
                        texts.append(of_text.hexdigest())
                        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of each row of `docs` (doc_id, text); rules as in round_trip()."""

    def run(batches):
        for batch in batches:
            out, held = [], []
            for _, ids, borders, over in encoded(batch.column("text"), vocabulary):
                for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
                    held.append(ids[a:b].tobytes())
                    if k < len(borders) - 2 or over:
                        out.append(b"".join(held))
                        held = []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows (doc_id, ids) as encode() gives them; null ids are no tokens, broken characters U+FFFD."""

    def run(batches):
        for batch in batches:
            decoder = words_of(vocabulary).decoder
            texts = []
            for ids in batch.column("ids"):
                texts.append(decoder.feed(np.frombuffer(ids.as_py() or b"", "<u4")) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text string")
