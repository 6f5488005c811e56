"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers part the same bytes. Where a token of each ends, both can be cut. The search halves
the intervals between known cuts: it looks up the middle token's end among the other's ends by
bisection, and steps to the next ends on either side until a common one is found; both halves are
searched alike, and an interval without a cut inside becomes a group. All intervals of a batch of
texts are halved together, in numpy arrays.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.byte_bpe import AMBIGUOUS, Memo, chunked, gather, offsets_of
from adapterlens.llm.common import array_column, cut, fresh, join_counted, table

#: Rows of the table of linked id pairs up to which it is broadcast: 24 bytes each.
BROADCAST_PAIRS = 1 << 20
#: Texts and bytes that are aligned together.
ROWS, BYTES = 1 << 12, 1 << 20
#: Chunks that are handed to a tokenizer as one text, after one that is dropped again.
JOINED, LEAD = 256, " x"
#: Characters of the chunks that a worker remembers.
REMEMBERED = 5_000_000

ALIGNED = "struct<a: array<int>, b: array<int>, a_ends: array<int>, b_ends: array<int>>"
SUMMED = "struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, pairs: array<bigint>, times: array<int>>"


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable ones of Latin-1 stand for
    themselves, the others, in order, for the characters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id, and the ids' decimal digits, as runs in pools."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.starts, self.letters = offsets_of(self.lengths)[:-1], np.frombuffer(b"".join(tokens), np.uint8)
        digits = [b"%d " % i for i in range(self.size)]
        self.digit_lengths = np.fromiter(map(len, digits), np.int64, self.size)
        self.digit_starts, self.digits = offsets_of(self.digit_lengths)[:-1], np.frombuffer(b"".join(digits), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.letters, self.starts[ids], self.lengths[ids])


class Pair:
    """Two tokenizers: A, byte-level, reads space + text; B, of pieces, reads text and adds the space."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, whole = byte_letters(), json.loads(self.a.to_str())["model"]["vocab"]
        entries = [b""] * max(self.a.get_vocab_size(), max(whole.values()) + 1)
        for token, i in whole.items():
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a_vocabulary = Vocabulary(entries)
        self.b_vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]])
        # Texts with white space that B's pieces hold are encoded whole; so are all, if pieces span words.
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        joined = " " if any(re.search("[^▁]▁", x) for x in pieces) else "".join(sorted({c for x in pieces for c in x if c in "\t\n\x0b\x0c\r"}))
        self.whole = re.compile(f"[{joined}]" if joined else "(?!)")
        self.memo = Memo(self._solve, REMEMBERED)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(a_path: str, b_path: str) -> Pair:
        return Pair(a_path, b_path)

    def _solve(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A's ids of chunks, B's, and for each chunk whether a tokenizer changes its bytes."""
        odd = any(p.search("".join(chunks)) for p in (AMBIGUOUS, self.whole))
        apart = np.fromiter((c[-1] in " \t\n\x0b\x0c\r" or (odd and bool(AMBIGUOUS.search(c) or self.whole.search(c))) for c in chunks), bool, len(chunks))
        plain, others = ([c for c, x in zip(chunks, apart.tolist(), strict=True) if x == which] for which in (False, True))
        found = [self._solve_joined(plain) or self._solve_each(plain), self._solve_each(others)]
        out, place = [], np.where(apart, len(plain) + np.cumsum(apart) - 1, np.cumsum(~apart) - 1)
        for (x, x_lengths), (y, y_lengths) in zip(*found, strict=True):
            lengths = np.concatenate([x_lengths, y_lengths])
            out.append((gather(np.concatenate([x, y]), offsets_of(lengths)[place], lengths[place]), lengths[place]))
        return out

    def _solve_joined(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """The same for chunks that may stand one after the other, many in a call; None if the bytes of any are
        changed."""
        rows = [[LEAD, *chunks[i : i + JOINED]] for i in range(0, len(chunks), JOINED)]
        texts, flat = ["".join(r) for r in rows], [c for r in rows for c in r]
        said = [c.encode("utf-8", "surrogatepass") for c in flat]
        ends, own = np.cumsum(np.fromiter(map(len, said), np.int64, len(said))), np.fromiter((c is not LEAD for c in flat), bool, len(flat))
        pools = []
        for vocabulary, found in (
            (self.a_vocabulary, [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]),
            (self.b_vocabulary, self.b.encode([t[1:] for t in texts], num_threads=1)),
        ):
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            at = np.cumsum(vocabulary.lengths[ids])
            upto = np.searchsorted(at, ends)
            if not len(at) or at[-1] != ends[-1] or (at[upto] != ends).any() or vocabulary.spelled(ids).tobytes() != b"".join(said):
                return None
            counts = np.diff(upto, prepend=-1)
            pools.append((ids[np.repeat(own, counts)], counts[own]))
        return [*pools, (np.zeros(len(chunks), np.int32), np.ones(len(chunks), np.int64))]

    def _solve_each(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [[x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]]
        # B adds the space that a chunk begins with; where it begins with another white space, the
        # added one is a piece of its own and goes.
        spaced = [c[0] == " " for c in chunks]
        ids = self.b.encode([c[1:] if s else c for c, s in zip(chunks, spaced, strict=True)], num_threads=1)
        space = [self.b.piece_to_id("▁")]  # a lone one is left at the end of a text
        found.append([space if c == " " else x if s else x[1:] for c, x, s in zip(chunks, ids, spaced, strict=True)])
        pools = [(np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int64, len(x))) for x in found]
        said, changed = [c.encode("utf-8", "surrogatepass") for c in chunks], np.zeros(len(chunks), np.int32)
        for vocabulary, (numbers, lengths) in zip((self.a_vocabulary, self.b_vocabulary), pools, strict=True):
            spelled, ends = vocabulary.spelled(numbers).tobytes(), offsets_of(vocabulary.lengths[numbers])[offsets_of(lengths)].tolist()
            changed |= np.fromiter((spelled[x:y] != z for x, y, z in zip(ends[:-1], ends[1:], said, strict=True)), bool, len(chunks))
        return [*pools, (changed, np.ones(len(chunks), np.int64))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids in a row, where each text's begin, B's, where each text's begin). A text whose bytes
        either tokenizer does not keep has none."""
        whole = [f" {x}" if x else "" for x in texts]
        (a, a_at), (b, b_at), (changed, at) = self.memo.runs([[x] if x and self.whole.search(x) else chunked(x) for x in whole])
        same = np.diff(offsets_of(changed)[at]) == 0
        return (*_kept(a, a_at, same), *_kept(b, b_at, same))


def _kept(ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if which.all():
        return ids, at
    lengths = np.diff(at)
    return ids[np.repeat(which, lengths)], offsets_of(np.where(which, lengths, 0))


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both rising rows of ends have the same value, as places in each.

    The rows are those of several texts, one after the other; text i has the ends a_ends[a_at[i] :
    a_at[i + 1]], all above the last text's, and both its last ends are equal.
    """
    some = np.diff(a_at) > 0
    # An interval runs from after place lo - 1 to place hi in each row; hi is a shared cut.
    a_lo, a_hi, b_lo, b_hi = a_at[:-1][some], a_at[1:][some] - 1, b_at[:-1][some], b_at[1:][some] - 1
    a_found, b_found = [a_hi], [b_hi]
    while len(a_lo):
        open_ = (a_lo < a_hi) & (b_lo < b_hi)  # a side of one token has no cut inside
        a_lo, a_hi, b_lo, b_hi = a_lo[open_], a_hi[open_], b_lo[open_], b_hi[open_]
        if not len(a_lo):
            break
        middle = (a_lo + a_hi - 1) // 2
        i, j = _to_the_right(a_ends, b_ends, middle, a_hi, b_hi)
        none = i == a_hi
        if none.any():
            i[none], j[none] = _to_the_left(a_ends, b_ends, middle[none], a_lo[none], b_lo[none])
        cut_ = (i >= a_lo) & (j >= b_lo)
        i, j, a_lo, a_hi, b_lo, b_hi = i[cut_], j[cut_], a_lo[cut_], a_hi[cut_], b_lo[cut_], b_hi[cut_]
        a_found.append(i)
        b_found.append(j)
        a_lo, a_hi = np.concatenate([a_lo, i + 1]), np.concatenate([i, a_hi])
        b_lo, b_hi = np.concatenate([b_lo, j + 1]), np.concatenate([j, b_hi])
    return np.sort(np.concatenate(a_found)), np.sort(np.concatenate(b_found))


def _to_the_right(a_ends: np.ndarray, b_ends: np.ndarray, start: np.ndarray, a_hi: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From A's place `start` on, the first common end of each interval: its last end at the latest."""
    i, j = start.copy(), np.zeros_like(start)
    todo = np.arange(len(start))
    while len(todo):
        j[todo] = np.searchsorted(b_ends, a_ends[i[todo]], "left")
        ahead = b_ends[j[todo]] != a_ends[i[todo]]
        todo = todo[ahead]
        i[todo] = np.searchsorted(a_ends, b_ends[j[todo]], "left")
        todo = todo[a_ends[i[todo]] != b_ends[j[todo]]]
    return i, j


def _to_the_left(a_ends: np.ndarray, b_ends: np.ndarray, start: np.ndarray, a_lo: np.ndarray, b_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before A's place `start`, the last common end of each interval; a place before lo if there is none."""
    i, j = start - 1, np.full_like(start, -1)
    todo = np.flatnonzero(i >= a_lo)
    while len(todo):
        j[todo] = np.searchsorted(b_ends, a_ends[i[todo]], "right") - 1
        todo = todo[j[todo] >= b_lo[todo]]
        behind = b_ends[j[todo]] != a_ends[i[todo]]
        todo = todo[behind]
        i[todo] = np.searchsorted(a_ends, b_ends[j[todo]], "right") - 1
        todo = todo[i[todo] >= a_lo[todo]]
        todo = todo[a_ends[i[todo]] != b_ends[j[todo]]]
    return i, j


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def align_texts(pair: Pair, texts: list[str | None]) -> pa.Array:
    """ALIGNED of every text: both tokenizers' ids, and how many tokens of each end at each shared cut."""
    a, a_at, b, b_at = pair.encode(texts)
    a_ends, b_ends = np.cumsum(pair.a_vocabulary.lengths[a]), np.cumsum(pair.b_vocabulary.lengths[b])
    a_cuts, b_cuts = shared_cuts(a_ends, b_ends, a_at, b_at)
    cuts_at = np.searchsorted(a_cuts, a_at)
    each = np.diff(cuts_at)
    lists = [_lists(a, a_at, pa.int32()), _lists(b, b_at, pa.int32())]
    lists += [_lists(cuts + 1 - np.repeat(at[:-1], each), cuts_at, pa.int32()) for cuts, at in ((a_cuts, a_at), (b_cuts, b_at))]
    return pa.StructArray.from_arrays(lists, ["a", "b", "a_ends", "b_ends"])


def _parts(rows: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each field of an array of structs of lists, the values and where each list's begin."""
    return [(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets_of(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))) for x in rows.flatten()]


def spelled_groups(pair: Pair, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups `a1,a2|b1;a3|b2,b3;` of all texts as ASCII, and where each group begins."""
    a_group, b_group = (np.repeat(np.arange(len(cuts)), np.diff(cuts, prepend=-1)) for cuts in (a_cuts, b_cuts))
    before_b, before_a = np.concatenate([[0], b_cuts + 1]), a_cuts + 1
    slots = np.concatenate([np.arange(len(a)) + before_b[a_group], np.arange(len(b)) + before_a[b_group]])
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    own = np.concatenate([pair.a_vocabulary.digit_lengths[a], pair.b_vocabulary.digit_lengths[b]])
    starts = np.concatenate([pair.a_vocabulary.digit_starts[a], pair.b_vocabulary.digit_starts[b] + len(pair.a_vocabulary.digits)])
    marks = np.full(len(slots), ord(","), np.uint8)
    marks[a_cuts], marks[len(a) + b_cuts] = ord("|"), ord(";")
    letters = gather(np.concatenate([pair.a_vocabulary.digits, pair.b_vocabulary.digits]), starts[order], own[order])
    ends = offsets_of(own[order])
    letters[ends[1:] - 1] = marks[order]
    firsts = np.concatenate([[0], a_cuts + b_cuts + 2])
    return letters, ends[firsts]


def summed(pair: Pair, rows: pa.Array) -> pa.Array:
    """SUMMED of every ALIGNED: counts, the digest of the groups, and how often each pair of ids is linked."""
    (a, a_at), (b, b_at), (a_ends, cuts_at), (b_ends, _) = _parts(rows)
    each, n = np.diff(cuts_at), len(rows)
    a_cuts, b_cuts = a_ends - 1 + np.repeat(a_at[:-1], each), b_ends - 1 + np.repeat(b_at[:-1], each)
    letters, begins = spelled_groups(pair, a, b, a_cuts, b_cuts)
    whole = letters.tobytes()
    digests = [hashlib.sha256(whole[begins[x] : begins[y] - 1]).hexdigest() if y > x else "" for x, y in zip(cuts_at[:-1].tolist(), cuts_at[1:].tolist(), strict=True)]
    # A link for each shared cut: no token is empty, so one token of each ends there.
    ids = pair.a_vocabulary.size * pair.b_vocabulary.size
    keys = np.repeat(np.arange(n), each) * ids + a[a_cuts] * pair.b_vocabulary.size + b[b_cuts]
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times, keys = np.diff(np.append(first, len(keys))), keys[first]
    pairs, at = keys % ids, np.searchsorted(keys, np.arange(n + 1) * ids)
    counts = [pa.array(np.diff(x), pa.int64()) for x in (a_at, b_at, cuts_at, cuts_at)]
    return pa.StructArray.from_arrays([*counts, pa.array(digests, pa.string()), _lists(pairs, at, pa.int64()), _lists(times, at, pa.int32())], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def aligned_column(a_path: str, b_path: str) -> Callable[[Column | str], Column]:
    """Texts -> ALIGNED."""
    return array_column(lambda texts: align_texts(Pair.load(a_path, b_path), texts.to_pylist()), ALIGNED, ROWS, BYTES)


def summed_column(a_path: str, b_path: str) -> Callable[[Column | str], Column]:
    """ALIGNED -> SUMMED."""
    return array_column(lambda rows: summed(Pair.load(a_path, b_path), rows), SUMMED, ROWS)


def linked_column(a_path: str, b_path: str) -> Callable[[Column | str], Column]:
    """Texts -> SUMMED: aligned and summed in one worker, which holds the tokenizers once, so that no ids go out
    and in again."""

    def linked(texts: pa.Array) -> pa.Array:
        pair = Pair.load(a_path, b_path)
        return summed(pair, align_texts(pair, texts.to_pylist()))

    return array_column(linked, SUMMED, ROWS, BYTES)


def link_documents(docs: DataFrame, a_path: str, b_path: str, linked: str = "linked") -> DataFrame:
    """All rows and columns of docs(text, ...) with column `linked`: the counts, the groups' digest and the linked
    pairs of what `align_documents` finds, without the ids."""
    if linked.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {linked}")
    return docs.withColumn(linked, linked_column(a_path, b_path)("text"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, aligned: str = "aligned") -> DataFrame:
    """All rows and columns of docs(text, ...) with column `aligned`: the ids of both tokenizers and the
    shared cuts, as counts of tokens of each that end at a cut or before.

    A null or empty text, or one whose bytes a tokenizer changes, has no tokens. Special tokens are
    plain text. Long texts are aligned whole, each in a batch of its own; repeated rows are all kept.
    A column of docs named as the added one is an error, all other names are free. Empty in, empty
    out.
    """
    if aligned.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {aligned}")
    return docs.withColumn(aligned, aligned_column(a_path, b_path)("text"))


def pair_counts(documents: DataFrame, b_size: int) -> DataFrame:
    """pair, count, best, n of documents(pairs, times): how many links hold a pair, whether no pair with
    the same B id has more, and how many documents have it. Partial sums come before the shuffle; a
    B id has at most as many rows as A has ids."""
    each = documents.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"), F.count("*").alias("n"))
    highest = counts.groupBy(F.pmod("pair", F.lit(b_size)).alias("b")).agg(F.max("count").alias("most"))
    both = counts.join(highest, F.pmod("pair", F.lit(b_size)) == F.col("b"))
    return both.select("pair", "count", (F.col("count") == F.col("most")).alias("best"), "n")


def scored(documents: DataFrame, b_size: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """documents(pairs, times, ...) with n_best and count_sum in place of both columns.

    The table of pairs is broadcast if it has `broadcast_pairs` rows at most; beyond, only pairs of
    many documents are, and the others are joined by shuffle.
    """
    key = fresh("key", documents)
    rows = cut(documents.withColumn(key, F.monotonically_increasing_id()))
    counts = cut(pair_counts(rows, b_size))
    n = counts.count()
    each = rows.select(F.col(key).alias("_row"), F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if n <= broadcast_pairs:
        joined = each.join(F.broadcast(counts), "pair")
    else:
        joined = join_counted(each, counts, ["pair"], counts.agg(F.sum("n")).first()[0])
    sums = joined.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, F.col(key) == F.col("_row"), "left").drop(key, "_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. Nulls,
    empty, long and repeated texts: as `align_documents` says; without tokens all numbers are 0."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)
    documents = docs.select("doc_id", "linked").select("doc_id", "linked.*")
    return scored(documents, Pair.load(*paths).b_vocabulary.size)
