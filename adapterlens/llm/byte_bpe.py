"""Byte-level BPE encoding and decoding on length-bucketed matrices.

A text is cut into the matches of a pattern. Matches that are not tokens as they are become rows of
padded numpy matrices, one matrix for each range of lengths. In every round each row merges its
leftmost pair of least rank: pairs are looked up in a hash table, the merged cell closes up by one
place, and rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from adapterlens.llm.common import array_column, table

#: Upper ends of the ranges of lengths. A longer row is merged by a heap: a matrix would take the
#: square of its length.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Cells of one matrix.
CELLS = 1 << 20
#: Characters of the chunks that a worker remembers, some 20 bytes of memory each; beyond, it forgets
#: all and begins anew.
REMEMBERED = 3_000_000
#: Bytes of texts that are encoded together.
BYTES = 1 << 20
#: A rank above all others.
NEVER = np.iinfo(np.int32).max
#: Chunks part before white space that follows something else, where no pattern of this kind has a
#: match across. A text with a character of AMBIGUOUS, on which engines differ, stays whole.
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
AMBIGUOUS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]")


def chunked(text: str | None) -> list[str]:
    if not text:
        return []
    return [text] if AMBIGUOUS.search(text) else CHUNK.findall(text)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], one after the other."""
    at = offsets_of(lengths)
    return pool[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])]


class PairTable:
    """Pairs of ids -> (rank, merged id), by open addressing with linear steps."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = self._keys(left, right)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank, self.merged = np.full(1 << self.bits, NEVER, np.int32), np.full(1 << self.bits, -1, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slots = self._slots(keys[todo], step)
            free = self.keys[slots] == np.iinfo(np.uint64).max
            self.keys[slots[free]] = keys[todo[free]]  # of pairs that meet in a slot, one stays
            placed = self.keys[slots] == keys[todo]
            self.rank[slots[placed]], self.merged[slots[placed]] = rank[todo[placed]], merged[todo[placed]]
            todo, step = todo[~placed], step + 1
        self.steps = step

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slots(self, keys: np.ndarray, step: int) -> np.ndarray:
        slots = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (slots + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; NEVER and -1 for one that is none, or has an id below 0."""
        rank, merged = np.full(len(left), NEVER, np.int32), np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._keys(left[todo], right[todo])
        for step in range(self.steps):
            if not len(todo):
                break
            slots = self._slots(keys, step)
            held = self.keys[slots]
            hit = held == keys
            rank[todo[hit]], merged[todo[hit]] = self.rank[slots[hit]], self.merged[slots[hit]]
            on = ~hit & (held != np.iinfo(np.uint64).max)
            todo, keys = todo[on], keys[on]
        return rank, merged


class Memo:
    """Chunks of text -> runs of numbers in pools, up to a total length of the chunks.

    solve(chunks) gives, for each pool, the numbers of all chunks in a row and how many each has.
    """

    def __init__(self, solve: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], remembered: int = REMEMBERED):
        self.solve, self.remembered = solve, remembered
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.characters, self.pools = 0, None

    def runs(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each pool, the numbers of texts, given as chunks, and where each text's begin, and the last
        one's end."""
        flat = list(chain.from_iterable(texts))
        new = [c for c in dict.fromkeys(flat) if c not in self.place]
        if self.characters + sum(map(len, new)) > self.remembered and self.place:
            self._forget()
            new = list(dict.fromkeys(flat))
        if new or self.pools is None:
            found = self.solve(new)
            old = self.pools or [(np.zeros(0, np.int32), np.zeros(1, np.int64))] * len(found)
            self.pools = [(np.concatenate([pool, numbers]), np.concatenate([ends, ends[-1] + np.cumsum(lengths)])) for (pool, ends), (numbers, lengths) in zip(old, found, strict=True)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.characters += sum(map(len, new))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        chunks = offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)))
        out = []
        for pool, ends in self.pools:
            starts = ends[at]
            lengths = ends[at + 1] - starts
            out.append((gather(pool, starts, lengths), offsets_of(lengths)[chunks]))
        return out


def classes_of(letters: str) -> set[str]:
    """The characters that the tiktoken library's pattern engine takes for class `letters`.

    Its Unicode tables are older than those of `regex`; one call over all characters tells.
    """
    import tiktoken

    single = tiktoken.Encoding("class", pat_str=letters, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return set(bytes(single.encode_ordinary(every)).decode())


class Pattern:
    """Matches of a pattern, with the letters and numbers that the tiktoken library knows."""

    #: A character that is no letter, number or space.
    NEITHER = "\ue000"

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        differ = {}
        for name in (r"\p{L}", r"\p{N}"):
            ours = set(regex.findall(name, "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
            theirs = classes_of(name)
            if theirs - ours:
                raise ValueError("the tables of tiktoken are newer than those of regex")
            differ |= dict.fromkeys(map(ord, ours - theirs), self.NEITHER)
        self.differ, self.odd = differ, frozenset(map(chr, differ))

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.differ))]


class ByteBpe:
    """A vocabulary of byte strings with ranks, and what it encodes.

    Two neighbouring tokens merge if their bytes together are a token, whose rank is that of the
    pair; a match that is a token as a whole is that token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.pattern, self.memo = ranks, Pattern(pattern), Memo(self._solve, remembered)
        self.bytes_to_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.table = PairTable(left, right, rank, rank)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        lengths = np.full(size, -1, np.int64)
        lengths[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.lengths, self.starts = lengths, offsets_of(np.maximum(lengths, 0))[:-1]
        self.letters = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.tokens = {r: t for t, r in tokens}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str, pattern: str) -> ByteBpe:
        """The vocabulary of a file of base64 tokens and ranks, once per process."""
        with open(path, "rb") as lines:
            return ByteBpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and len(texts) + 1 places where each text's begin."""
        return self.memo.runs([chunked(x) for x in texts])[0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of ids in a row, and where each run's begin. An unknown id is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id that is not in the vocabulary")
        lengths = self.lengths[ids]
        return gather(self.letters, self.starts[ids], lengths), offsets_of(lengths)[offsets]

    def _solve(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of all chunks in a row, and how many each has."""
        matches = [self.pattern.pieces(c) for c in chunks]
        place: dict[str, int] = {}
        at = np.array([place.setdefault(p, len(place)) for m in matches for p in m], np.int64)
        ids, starts, lengths = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in place])
        counts = np.fromiter(map(len, matches), np.int64, len(matches))
        return [(gather(ids, starts[at], lengths[at]), np.diff(offsets_of(lengths[at])[offsets_of(counts)]))]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): the ids of piece i are ids[starts[i] : starts[i] + lengths[i]]."""
        starts, lengths = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        done = np.flatnonzero(whole >= 0)
        starts[done] = np.arange(len(done))
        parts, size = [whole[done].astype(np.int32)], len(done)
        sizes, todo, low = np.fromiter(map(len, pieces), np.int64, len(pieces)), whole < 0, 0

        def keep(rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> None:
            nonlocal size
            parts.append(numbers)
            starts[rows], lengths[rows] = size + offsets_of(counts)[:-1], counts
            size += len(numbers)

        for width in WIDTHS:
            bucket = np.flatnonzero(todo & (sizes > low) & (sizes <= width))
            for first in range(0, len(bucket), CELLS // width):
                rows = bucket[first : first + CELLS // width]
                matrix = np.full((len(rows), width), -1, np.int32)
                filled = np.arange(width) < sizes[rows][:, None]
                matrix[filled] = self.bytes_to_ids[np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)]
                self._merge_matrix(matrix, rows, keep)
            low = width
        for i in np.flatnonzero(todo & (sizes > low)):
            numbers = self._merge_long(self.bytes_to_ids[np.frombuffer(pieces[i], np.uint8)])
            keep(np.array([i]), numbers, np.array([len(numbers)]))
        return np.concatenate(parts), starts, lengths

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = self.table.find(left.ravel(), right.ravel())
        return rank.reshape(left.shape), merged.reshape(left.shape)

    def _merge_matrix(self, matrix: np.ndarray, rows: np.ndarray, keep: Callable) -> None:
        """Merge the padded rows of ids until no pair is left; `keep(rows, ids, counts)` takes what is done.

        All rows that go on have merged the same number of times, so each round is a column narrower.
        """
        ranks, _ = self._find(matrix[:, :-1], matrix[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1) if matrix.shape[1] > 1 else np.zeros(len(rows), np.int64)
            on = ranks[np.arange(len(rows)), best] < NEVER if matrix.shape[1] > 1 else np.zeros(len(rows), bool)
            if not on.all():
                ended = matrix[~on]
                keep(rows[~on], ended[ended >= 0], (ended >= 0).sum(axis=1))
                matrix, ranks, rows, best = matrix[on], ranks[on], rows[on], best[on]
                if not len(rows):
                    return
            line, k = np.arange(len(rows)), best[:, None]
            _, merged = self.table.find(matrix[line, best], matrix[line, best + 1])
            cells = np.arange(matrix.shape[1] - 1)
            matrix = np.take_along_axis(matrix, cells + (cells > k), axis=1)
            matrix[line, best] = merged
            ranks = np.take_along_axis(ranks, cells[:-1] + (cells[:-1] >= k), axis=1)
            for near in (best - 1, best):
                ok = (near >= 0) & (near < ranks.shape[1])
                at, where = line[ok], near[ok]
                ranks[at, where] = self.table.find(matrix[at, where], matrix[at, where + 1])[0]

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges in one long row, by a heap of its pairs."""
        values, n = [self.tokens[i] for i in ids.tolist()], len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := self.ranks.get(values[i] + values[i + 1])) is not None]
        due = {i: (j, r) for r, i, j in heap}
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r = self.ranks.get(values[i] + values[j])
            if r is None:
                due.pop(i, None)
            else:
                due[i] = (j, r)
                heapq.heappush(heap, (r, i, j))

        while heap:
            r, i, j = heapq.heappop(heap)
            if due.get(i) != (j, r):
                continue
            values[i], values[j] = values[i] + values[j], None
            due.pop(i)
            due.pop(j, None)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([self.ranks[v] for v in values if v is not None], np.int32)


def int_lists(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(numbers.astype(np.int32)))


def binaries(letters: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())])


def list_parts(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists without nulls between them, and where each list's begin."""
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return rows.flatten().to_numpy(zero_copy_only=False), offsets_of(lengths)


def ids_column(path: str, pattern: str) -> Callable[[Column | str], Column]:
    """Texts -> array<int>, with the vocabulary at `path`."""
    return array_column(lambda texts: int_lists(*ByteBpe.load(path, pattern).encode(texts.to_pylist())), "array<int>", size=BYTES)


def bytes_column(path: str, pattern: str) -> Callable[[Column | str], Column]:
    """array<int> -> the binary that it stands for."""
    return array_column(lambda ids: binaries(*ByteBpe.load(path, pattern).decode(*list_parts(ids))), "binary")


def digests_column(path: str, pattern: str) -> Callable[[Column | str], Column]:
    """array<int> -> how many, the SHA-256 of the ids as little-endian unsigned 32-bit numbers, and of the
    bytes that they stand for."""

    def run(rows: pa.Array) -> pa.Array:
        ids, offsets = list_parts(rows)
        letters, ends = ByteBpe.load(path, pattern).decode(ids, offsets)
        hexes = [[hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for data, at in ((ids.astype("<u4").view(np.uint8), 4 * offsets), (letters, ends))]
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets), pa.int64()), *map(pa.array, hexes)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return array_column(run, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All rows and columns of docs(text, ...) with column `ids`, the ids of the whole text; special
    tokens are plain text.

    A null or empty text has none. Texts are read whole, in batches cut by their bytes; one long
    text is a batch of its own. Repeated rows are all kept. A column of docs named as the added one
    is an error, all other names are free. Empty in, empty out.
    """
    if ids.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {ids}")
    return docs.withColumn(ids, ids_column(path, pattern)("text"))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add column `decoded`, the bytes of the ids; null ids give none, an unknown id is an error."""
    if decoded.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"encoded has a column {decoded}")
    return encoded.withColumn(decoded, bytes_column(path, pattern)(ids))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. Nulls, empty, long and repeated
    texts: as `encode_documents` says; a null or empty text has the digests of no bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return encoded.select("doc_id", digests_column(path, pattern)("ids").alias("d")).select("doc_id", "d.*")
