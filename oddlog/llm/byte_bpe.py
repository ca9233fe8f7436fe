"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A pre-token that is in the vocabulary as a whole is resolved by one probe of a minimal perfect hash. Every other one is
merged: its bytes form a linked list, and a heap holds the adjacent pairs by rank, leftmost first. That is the rule of
the public rank-file encoders, so ids are the same. Null and empty texts have no ids; a decoded empty list is empty.
The vocabulary is one small file, read on the driver and broadcast (1 MB for 50,000 tokens).
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import slices, text_batches

MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
ROOM = 96 << 20  # bytes of the pre-tokens that a worker remembers from one turn of its memo; it holds two
ENTRY = 190  # bytes that a remembered pre-token takes besides its letters and ids
PAIRS = 1 << 18  # pairs of tokens whose merge a worker remembers
LONG = 1 << 20  # characters from which a text is pre-tokenised piecewise


# The letters and numbers among the first 256 code points.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
SEPARATORS = re.compile("[\x1c-\x1f]")  # space to the standard library, not to Unicode's White_Space


def is_narrow(text: str) -> bool:
    """True if the standard library's pattern engine, which is twice as fast, splits the text alike."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not SEPARATORS.search(text)


def latin(pattern: str) -> str:
    """``pattern`` with Unicode classes spelt out for the first 256 code points."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = pattern[at : at + 5]
        if name in (r"\p{L}", r"\p{N}"):
            members = LETTERS if name == r"\p{L}" else NUMBERS
            out.append(members if inside else f"[{members}]")
            at += 5
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every displacement deals keys out afresh."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Hash and displace: every key has a slot of its own among exactly as many slots as keys.

    Buckets are placed by falling size. A bucket looks for a displacement that sends all its keys to free slots;
    buckets of one key take any free slot, stored as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = self.size // 4 + 1
        self.shift = np.zeros(self.buckets, np.int64)
        codes = self.codes(keys)
        if len(np.unique(codes)) != self.size:
            raise ValueError("keys repeat or collide")
        home = (codes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        taken = np.zeros(self.size, bool)
        self.slots = np.zeros(self.size, np.int64)
        for bucket in np.argsort(-sizes, kind="stable"):
            if sizes[bucket] < 2:
                break
            members = order[starts[bucket] : starts[bucket + 1]]
            for first in range(1, 1 << 24, 64):
                tries = np.arange(first, first + 64, dtype=np.uint64)[:, None] * np.uint64(STEP)
                spots = (mixed(codes[members][None, :] + tries) % np.uint64(self.size)).astype(np.int64)
                good = ~taken[spots].any(axis=1)
                spread = np.sort(spots, axis=1)
                good &= (spread[:, 1:] != spread[:, :-1]).all(axis=1)
                if good.any():
                    hit = int(good.argmax())
                    self.shift[bucket] = first + hit
                    self.slots[members] = spots[hit]
                    taken[spots[hit]] = True
                    break
        free = iter(np.flatnonzero(~taken))
        for bucket in np.flatnonzero(sizes == 1):
            spot = next(free)
            self.shift[bucket] = -spot - 1
            self.slots[order[starts[bucket]]] = spot
        self.shifts: list[int] = self.shift.tolist()

    @staticmethod
    def codes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Slot of each key; for a foreign key some slot, so the caller compares the key stored there."""
        codes = self.codes(keys)
        shift = self.shift[(codes % np.uint64(self.buckets)).astype(np.int64)]
        moved = mixed(codes + shift.astype(np.uint64) * np.uint64(STEP)) % np.uint64(self.size)
        return np.where(shift < 0, -shift - 1, moved.astype(np.int64))

    def find_one(self, key: bytes) -> int:
        """The same for a single key, without arrays."""
        code = xxhash.xxh3_64_intdigest(key)
        shift = self.shifts[code % self.buckets]
        if shift < 0:
            return -shift - 1
        h = (code + shift * STEP) & MASK
        h = ((h ^ (h >> 32)) * MIX) & MASK
        h = ((h ^ (h >> 32)) * MIX) & MASK
        return (h ^ (h >> 32)) % self.size


class Pairs(dict):
    """What a function gives for a key, worked out at its first use."""

    def __init__(self, work_out):
        self.work_out = work_out

    def __missing__(self, key: int) -> int:
        found = self[key] = self.work_out(key)
        return found


class Vocabulary:
    """Ranks behind a perfect hash, with what a worker has learnt so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids: list[int] = [0] * len(keys)
        for key, slot in zip(keys, self.hash.slots.tolist()):
            self.keys[slot], self.ids[slot] = key, ranks[key]
        del self.hash.slots
        self.pattern = pattern

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.prepare()

    def prepare(self) -> None:
        self.match = regex.compile(self.pattern)
        self.match_narrow = re.compile(latin(self.pattern))
        self.tokens = {i: key for key, i in zip(self.keys, self.ids)}
        self.byte_ids = self.whole([bytes([b]) for b in range(256)]).tolist()
        ids = self.byte_ids
        self.pairs = Pairs(self.pair)
        self.byte_pairs = [[self.pairs[ids[a] << 32 | ids[b]] for b in range(256)] for a in range(256)]
        self.forget()

    def __getstate__(self):
        return {name: self.__dict__[name] for name in ("hash", "keys", "ids", "pattern")}

    def forget(self) -> None:
        """Start with an empty memo: the pre-tokens used since its last turn, and those of the turn before."""
        self.memo: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.held = 0

    def remember(self, words: set[str]) -> None:
        """Make the ids of all words known: from the turn before where they are still there, otherwise learnt."""
        memo, last = self.memo, self.last
        missing = words.difference(memo)
        again = missing.intersection(last)
        for word in again:
            memo[word] = last[word]
        self.held += sum(ENTRY + len(w) + len(memo[w]) for w in again)
        self.learn(list(missing.difference(again)))

    def turn(self, room: int) -> None:
        """When the memo has used its room, what was not used since its last turn goes."""
        if self.held > room:
            self.memo, self.last, self.held = {}, self.memo, 0

    def whole(self, keys: list[bytes]) -> np.ndarray:
        """Id of every key that is a token as a whole, otherwise -1."""
        stored, ids = self.keys, self.ids
        slots = self.hash.find(keys).tolist()
        return np.fromiter((ids[s] if stored[s] == k else -1 for s, k in zip(slots, keys)), np.int64, len(keys))

    def pair(self, code: int) -> int:
        """Id of two joined tokens (their ids packed into ``code``), or -1."""
        key = self.tokens[code >> 32] + self.tokens[code & 0xFFFFFFFF]
        slot = self.hash.find_one(key)
        return self.ids[slot] if self.keys[slot] == key else -1

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself: merges of lowest rank first, the leftmost among equals.

        ``after`` and ``before`` link the parts that are left; ``best`` is the rank at which a part joins its successor.
        A heap entry holds a rank and a place, and is stale if ``best`` has changed there.
        """
        first, ids, known = self.byte_pairs, self.byte_ids, self.pairs
        parts = [ids[b] for b in word]
        n = len(parts)
        best = [first[a][b] for a, b in zip(word, word[1:])]
        best.append(-1)
        heap = [rank << 32 | at for at, rank in enumerate(best) if rank >= 0]
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            at = entry & 0xFFFFFFFF
            part = entry >> 32
            if best[at] != part:
                continue
            right = after[at]
            follow = after[at] = after[right]
            parts[at] = part
            parts[right] = best[right] = -1
            if follow < n:
                before[follow] = at
                found = best[at] = known[part << 32 | parts[follow]]
                if found >= 0:
                    heappush(heap, found << 32 | at)
            else:
                best[at] = -1
            left = before[at]
            if left >= 0:
                found = best[left] = known[parts[left] << 32 | part]
                if found >= 0:
                    heappush(heap, found << 32 | left)
        return [p for p in parts if p >= 0]

    def learn(self, words: list[str]) -> None:
        """Ids of new pre-tokens: the perfect hash first, merging for what it does not hold."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        raw = [w.encode() for w in words]
        for word, key, found in zip(words, raw, self.whole(raw).tolist()):
            ids = self.memo[word] = array("i", (found,) if found >= 0 else self.merge(key)).tobytes()
            self.held += ENTRY + len(key) + len(ids)

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in portions, so that a very long text needs no list of all of them."""
        match = self.match_narrow if is_narrow(text) else self.match
        if len(text) <= LONG:
            yield match.findall(text)
            return
        found = (m.group() for m in match.finditer(text))
        while portion := list(islice(found, 1 << 16)):
            yield portion

    def encode(self, texts: list[str], room: int | None = None) -> tuple[np.ndarray, list[int]]:
        """All ids one after another, and the number of ids of each text. ``room``: of a turn of the memo, else ``ROOM``."""
        out, counts, waiting, pending = [], [], [], []

        def flush():
            self.remember(set(waiting))
            found = [self.memo[word] for word in waiting]
            out.append(np.frombuffer(b"".join(found), np.int32))
            first = 0
            for doc, n in pending:
                counts[doc] += sum(map(len, found[first : first + n])) // 4
                first += n
            waiting.clear()
            pending.clear()
            self.turn(ROOM if room is None else room)

        for doc, text in enumerate(texts):
            counts.append(0)
            for portion in self.words(text):
                waiting.extend(portion)
                pending.append((doc, len(portion)))
                if len(waiting) > 1 << 19:
                    flush()
        if pending:
            flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


def encoder(spark: SparkSession, path: str, pattern: str, room: int | None = None):
    """A function from a text column to its ids (array of int). ``path``: the rank file as the driver sees it."""
    shared = text_batches(spark).sparkContext.broadcast(vocabulary(path, pattern))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        words = shared.value
        parts, counts = [], []
        for portion in slices(texts):
            found, sizes = words.encode(portion, room)
            parts.append(found)
            counts += sizes
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts or [np.zeros(0, np.int32)])))

    return ids


def decoder(spark: SparkSession, path: str):
    """A function from an id column to the decoded bytes (binary). Null ids decode to empty bytes."""
    by_id = {i: token for token, i in read_ranks(path).items()}
    shared = text_batches(spark).sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id) + 1)])

    @F.arrow_udf("binary")
    def text(ids: pa.Array) -> pa.Array:
        tokens = pa.array(shared.value, pa.large_binary())
        lengths = np.array([len(t) for t in shared.value], np.int64)
        ids = ids.fill_null([])
        flat = ids.flatten()
        ends = np.concatenate([[0], np.cumsum(lengths[flat.to_numpy(zero_copy_only=False)])])
        bounds = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        whole = tokens.take(flat)
        data = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(),
            len(ids),
            [None, pa.array(ends[bounds].astype(np.int64)).buffers()[1], whole.buffers()[2]],
        )
        return data.cast(pa.binary())

    return text


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", room: int | None = None
) -> DataFrame:
    """``docs`` with the ids of every whole text; a column already called ``ids_col`` is replaced.

    ``room``: bytes of the pre-tokens that a worker remembers from one turn of its memo, where it shares its memory with
    other steps; it changes no id.
    """
    return docs.withColumn(ids_col, encoder(docs.sparkSession, path, pattern, room)(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that their ids stand for."""
    return rows.withColumn(out_col, decoder(rows.sparkSession, path)(F.col(ids_col)))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
