"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

A text's segmentation is a best path: of the greatest sum of piece scores in a unigram model, of
neighbours that all fit in a byte-pair model. Texts are cut where no
piece can reach across, and the parts are solved once each and remembered. A giant document is
split into chunks at fixed places that may cut through pieces. A chunk's transfer matrix holds the
best score from each place where a piece from the left may end to each place where a piece may end
beyond the right edge; matrices combine associatively in the (max, +) semiring, in a tree of grouped
steps. Going down the tree, the states at the edges of a group give those of its members, and the
chunks are traced back apart.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from adapterlens.llm.common import ROWS_AT_ONCE, cut, fresh, short_batches, table

#: The public vocabulary file that the query uses; a parameter everywhere else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a chunk. Documents of over two chunks take the scan.
CHUNK = 16_384
#: Matrices that one step of the scan's tree combines, at most.
FAN = 512
#: Characters of a text at most: a value of Spark's holds 2 GB.
MOST_CHARACTERS = 1 << 31
#: Parts (of up to SHORT characters) that a Python worker remembers in each of two generations.
REMEMBERED = 200_000
SHORT = 40
#: Characters of the texts whose parts are solved together, about.
CHARACTERS_AT_ONCE = 1 << 20
NO_PIECE = 1 << 62
NEVER = -(1 << 60)
#: (from, to) -> (score, preference among equal ones)
Transfer = dict[tuple[int, int], tuple[int, int]]
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10


class Memory:
    """Ids of parts that were solved before, in two generations: when the younger is full it becomes
    the older one, from which parts return as they are met. Parts of over SHORT characters are
    forgotten at once. `odd` are those whose ids do not decode to them."""

    def __init__(self, solve: Callable[[list[str]], list[bytes]], returns: Callable[[list[str], list[bytes]], list[bool]], most: int = REMEMBERED):
        self.solve, self.returns, self.most = solve, returns, most
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.long: list[str] = []

    def recall(self, lists: list[list[str]]) -> dict[str, bytes]:
        """A table that holds all parts of the lists, until it is asked for the next time."""
        for part in self.long:
            self.young.pop(part, None)
        if len(self.young) >= self.most:
            self.older, self.young = self.young, {}
            self.odd.intersection_update(self.older)
        young, older = self.young, self.older
        missing = []
        for part in set().union(*lists).difference(young):
            if part in older:
                young[part] = older[part]
            else:
                missing.append(part)
        solved = self.solve(missing)
        young.update(zip(missing, solved, strict=True))
        self.odd.update(p for p, r in zip(missing, self.returns(missing, solved), strict=True) if not r)
        self.long = [p for p in missing if len(p) > SHORT]
        return young


#: The memory of a Python worker by vocabulary, kept over the tasks that it runs.
_MEMORIES: dict[int, Memory] = {}
#: Pairs of pieces that fit or not, by vocabulary, as the lattice met them.
_FITTING: dict[int, dict[tuple[str, str], bool]] = {}


class Pieces:
    """The vocabulary as plain tables. Scores are whole numbers, so that sums are exact in any order."""

    def __init__(self, pieces: list[tuple[str, float, str]], unknown: int = 0):
        """pieces: (piece, score, kind) by id; kind is normal, byte or special."""
        normal = [s for _, s, k in pieces if k == "normal"]
        scale = 1 if all(float(s).is_integer() for s in normal) else 1 << 20
        self.score = {p: (i, round(s * scale)) for i, (p, s, k) in enumerate(pieces) if k == "normal"}
        self.unknown_score = round((min(normal, default=0) - UNKNOWN_PENALTY) * scale)
        self.unknown = unknown
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.longest = max(map(len, self.score), default=1)
        self.surface = [p.replace(SPACE, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"" for p, _, k in pieces]
        across = any(a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:], strict=False))
        line = "" if any("\n" in p for p in self.score) else "\n"
        # Parts end before a space that follows something else, and around a line end, if no piece holds one inside.
        self.part = None if across else re.compile(f"{line}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.line = line
        self.part_start = re.compile(f"(?<=[^{SPACE}])(?={SPACE})" + ("|(?<=\n)|(?=\n)" if line else ""))
        self.key = hash((type(self).__name__, tuple(pieces)))

    @staticmethod
    def load(path: str) -> Pieces:
        """Read a .model file on the driver; tasks get the tables, not the path."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "special" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        made = PairPieces if model_type(path) == "bpe" else Pieces
        return made([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())], sp.unk_id())

    def forward(self, text: str, size: int, start: dict[int, int]) -> tuple[list[int], list[int]]:
        """Best scores of ending a piece at each place of `text`, and the length of that piece.

        Pieces start before place `size`; what follows is there to be reached into. start: scores
        of places where a piece from the left ends (length 0 marks those). Of equal scores the
        longest piece stands, one from the left before all.
        """
        end = len(text)
        best, length = [NEVER] * (end + 1), [-1] * (end + 1)
        for k, v in start.items():
            if k <= end and v > NEVER:
                best[k], length[k] = v, 0
        known, longest = self.score, self.longest
        for i in range(min(size, end)):
            here = best[i]
            if here == NEVER:
                continue
            for j in range(i + 1, min(i + longest, end) + 1):
                hit = known.get(text[i:j])
                if hit is not None:
                    s = here + hit[1]
                elif j == i + 1:
                    s = here + self.unknown_score
                else:
                    continue
                if s > best[j]:
                    best[j], length[j] = s, j - i
        return best, length

    def ids_of(self, text: str, length: list[int], end: int) -> list[int]:
        """Piece ids of the path that ends at `end`, back to where it came from the left."""
        out: list[int] = []
        while length[end] > 0:
            piece = text[end - length[end] : end]
            hit = self.score.get(piece)
            if hit:
                out.append(hit[0])
            else:
                out.extend(reversed(self._unknown_ids(piece)))
            end -= length[end]
        return out[::-1]

    def _unknown_ids(self, piece: str) -> list[int]:
        """Pieces of an unknown character's UTF-8 bytes, or the unknown piece in a model without them."""
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def memory(self) -> Memory:
        """This worker's memory under this vocabulary."""
        if self.key not in _MEMORIES:
            _MEMORIES[self.key] = Memory(self.solved, self.returned)
        return _MEMORIES[self.key]

    def best_of(self, part: str) -> list[int]:
        """Ids of a part that no piece reaches across."""
        return self.ids_of(part, self.forward(part, len(part), {0: 0})[1], len(part))

    def solved(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as 32-bit numbers in a row."""
        return [array("i", self.best_of(p)).tobytes() for p in parts]

    def returned(self, parts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether the ids of each part decode to it."""
        want = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in parts]
        have = list(map(self.surface.__getitem__, np.frombuffer(b"".join(ids), dtype=np.int32).tolist()))
        places = np.cumsum([0, *(len(i) // 4 for i in ids)])
        ends = np.cumsum([0, *map(len, have)])[places]
        if b"".join(have) == b"".join(want) and np.array_equal(np.diff(ends), list(map(len, want))):
            return [True] * len(parts)
        return [b"".join(have[a:b]) == w for a, b, w in zip(places.tolist(), places[1:].tolist(), want, strict=False)]

    def parts(self, text: str | None) -> list[str]:
        """The parts of a text, with the mark that the model puts first; none of an empty one."""
        text = normalised(text) if text else ""
        return self.part.findall(text) if self.part else [text] if text else []

    def solve(self, parts: list[str]) -> np.ndarray:
        """Ids of parts that no piece reaches across, one after another."""
        return np.frombuffer(b"".join(map(self.memory().recall([parts]).__getitem__, parts)), dtype=np.int32)

    def solve_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether they decode to it: all its parts must do so alone, and it
        must not hold the mark that reads as a space. Parts are solved once for many texts."""
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < CHARACTERS_AT_ONCE:
                size += len(texts[at] or "")
                parts.append(self.parts(texts[at]))
                at += 1
            known = self.memory().recall(parts)
            odd = self.memory().odd
            for ps, text in zip(parts, texts[at - len(parts) : at], strict=True):
                ids = np.frombuffer(b"".join(map(known.__getitem__, ps)), dtype=np.int32)
                yield ids, SPACE not in (text or "") and (not odd or odd.isdisjoint(ps))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return next(self.solve_all([text]))[0]

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        """The text of ids; invalid byte sequences become U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids if ids is not None else ()))
        return data.decode("utf-8", "replace").removeprefix(" ")

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last place from `low` up to `high` that no piece reaches across, if there is one."""
        low = max(low, 1)
        first = self.part_start.search(text, low) if self.part else None
        if first is None or first.start() >= high:
            return None
        last = text.rfind(SPACE, low, high)
        while last > low and text[last - 1] == SPACE:
            last -= 1
        if last == low and text[last - 1] == SPACE:
            last = first.start()
        if self.line:
            end = text.rfind("\n", low - 1, high)
            last = max(last, end + 1 if 0 <= end < high - 1 else end)
        return first.start(), max(last, first.start())

    def transfer(self, text: str, back: int, size: int) -> Transfer:
        """A chunk's matrix: {(from, to): (score, preference among equal ones)}, without the hopeless.

        text: `back` characters before the chunk, its `size` own, and up to `longest - 1` after.
        State k: a piece ends k characters after the edge.
        """
        text, n, out = text[back:], self.longest, {}
        cuts = self.cuts(text, 0, size)
        runs = {k: self.forward(text[: cuts[0]] if cuts else text, cuts[0] if cuts else size, {k: 0}) for k in range(n)}
        if cuts:
            first, last = cuts
            middle = sum(self.forward(p, len(p), {0: 0})[0][-1] for p in self.part.findall(text[first:last]))
            best, _ = self.forward(text[last:], size - last, {0: 0})
            paths = {k: (r[0][first], self._lengths(r[1], first)) for k, r in runs.items() if first < len(r[0]) and r[0][first] > NEVER}
            order = {k: i for i, k in enumerate(sorted(paths, key=lambda k: paths[k][1]))}
            for k, (score, _) in paths.items():
                for to in range(n):
                    if size - last + to < len(best) and best[size - last + to] > NEVER:
                        out[k, to] = (score + middle + best[size - last + to], order[k])
            return out
        for to in range(n):
            end = size + to
            paths = {k: (r[0][end], self._lengths(r[1], end)) for k, r in runs.items() if end < len(r[0]) and r[0][end] > NEVER and not (r[1][end] == 0 and k != end)}
            order = {k: i for i, k in enumerate(sorted(paths, key=lambda k: paths[k][1]))}
            out |= {(k, to): (score, order[k]) for k, (score, _) in paths.items()}
        return out

    def _lengths(self, length: list[int], at: int) -> tuple[int, ...]:
        """Piece lengths of a path from the right; the piece that came from the left is the longest."""
        out = []
        while length[at] > 0:
            out.append(length[at])
            at -= length[at]
        return (*out, len(length) + self.longest)

    def trace(self, text: str, back: int, size: int, start: int, end: int) -> np.ndarray:
        """Ids of the pieces that start in a chunk, from state `start` to state `end`."""
        text = text[back:]
        cuts = self.cuts(text, 0, size)
        if not cuts:
            return np.array(self.ids_of(text, self.forward(text, size, {start: 0})[1], size + end), dtype=np.int32)
        first, last = cuts
        left = self.forward(text[:first], first, {start: 0})[1]
        right = self.forward(text[last:], size - last, {0: 0})[1]
        return self._joined(text[:first], left, first, text[first:last], text[last:], right, size - last + end)

    def _joined(self, head: str, left: list[int], first: int, middle: str, tail: str, right: list[int], end: int) -> np.ndarray:
        inner = self.solve(self.part.findall(middle))
        return np.concatenate([np.array(self.ids_of(head, left, first), dtype=np.int32), inner, np.array(self.ids_of(tail, right, end), dtype=np.int32)])


class PairPieces(Pieces):
    """A vocabulary of the byte-pair kind, whose encoding is a best path too.

    A segmentation is what merging gives if and only if every two neighbouring pieces are what
    merging gives for the two alone. So scores are 0 for neighbours that fit and minus infinity
    for others, and exactly one way is left. States name the piece at the edge: 64 * (characters
    before the edge) + (characters after it); 0 is the text's beginning.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], unknown: int = 0):
        super().__init__(pieces, unknown)
        self.rank = {p: -s for p, (_, s) in self.score.items()}
        self._tables: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> tuple:
        """Arrays for merging many parts at once: the symbol of each character, sorted keys of the
        symbol pairs that are a piece together, with that piece and its rank. Symbols are piece ids,
        and numbers beyond for characters that are no piece."""
        if self._tables is None:
            symbol = {p: i for p, (i, _) in self.score.items()}
            beyond = len(self.surface)
            for c in sorted({c for p in self.score for c in p} - symbol.keys()):
                symbol[c] = beyond = beyond + 1
            of_character = np.full(0x110000, beyond + 1, dtype=np.int64)
            of_character[[ord(c) for c in symbol if len(c) == 1]] = [i for c, i in symbol.items() if len(c) == 1]
            wide = beyond + 2
            rows = sorted((symbol[p[:k]] * wide + symbol[p[k:]], i, self.rank[p]) for p, (i, _) in self.score.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
            keys, pieces, ranks = np.array([*rows, (NO_PIECE, 0, NO_PIECE)], dtype=np.int64).T.copy()
            self._tables = of_character, keys, pieces, ranks, wide
        return self._tables

    def solved(self, parts: list[str]) -> list[bytes]:
        """Short parts are merged side by side in arrays, one merge of each part at a time: the
        neighbours whose union has the best rank, leftmost of equal ones, until none is a piece.
        Long parts and those with characters that are no piece go through `best_of`."""
        out: list[bytes] = [b""] * len(parts)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        of_character = self.tables()[0]
        symbols = of_character[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")] if parts else length
        start = np.cumsum(length) - length
        known = np.add.reduceat(symbols >= len(self.surface), start) == 0 if parts else length > 0
        widths = [0, 4, 6, 8, 10, 12, 16, 24, SHORT]
        for low, wide in zip(widths, widths[1:], strict=False):
            rows = np.flatnonzero(known & (length > low) & (length <= wide))
            for at in range(0, len(rows), 1 << 16):
                some = rows[at : at + (1 << 16)]
                self._merge(symbols, start[some], length[some], wide, some, out)
        for i in np.flatnonzero(~known | (length > SHORT)).tolist():
            out[i] = array("i", self.best_of(parts[i])).tobytes()
        return out

    def _merge(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, wide: int, rows: np.ndarray, out: list[bytes]) -> None:
        """Merge parts of at most `wide` symbols and put their ids into `out` at `rows`."""
        _, keys, pieces, ranks, base = self.tables()
        n, place = len(start), np.arange(wide)
        inside = place < length[:, None]
        now = np.where(inside, symbols[np.minimum(start[:, None] + place, len(symbols) - 1)], base)

        def pair(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and piece of each two symbols together."""
            key = left * base + right
            hit = np.searchsorted(keys, key)
            good = keys[hit] == key
            return np.where(good, ranks[hit], NO_PIECE), pieces[hit]

        rank, piece = np.full((n, wide), NO_PIECE), np.zeros((n, wide), np.int64)
        if wide > 1:
            both = inside[:, 1:]
            left, right = now[:, :-1][both], now[:, 1:][both]
            rank[:, :-1][both], piece[:, :-1][both] = pair(left, right)
        after = np.minimum(place + 1, wide) * np.ones((n, 1), np.int64)  # the next symbol's place
        after[after >= length[:, None]] = wide
        before = np.tile(place - 1, (n, 1))
        alive = inside.copy()
        open_ = np.arange(n)
        while len(open_):
            best = rank[open_].argmin(axis=1)
            more = rank[open_, best] < NO_PIECE
            open_, best = open_[more], best[more]
            gone = after[open_, best]
            now[open_, best] = piece[open_, best]
            alive[open_, gone] = False
            rank[open_, gone] = NO_PIECE
            following = after[open_, gone]
            after[open_, best] = following
            some = following < wide
            before[open_[some], following[some]] = best[some]
            rank[open_[~some], best[~some]] = NO_PIECE
            r, b = open_[some], best[some]
            rank[r, b], piece[r, b] = pair(now[r, b], now[r, following[some]])
            some = best > 0
            r, b = open_[some], best[some]
            a = before[r, b]
            rank[r, a], piece[r, a] = pair(now[r, a], now[r, b])
        data = now[alive].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(alive.sum(axis=1))
        for row, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[row] = data[a:b]

    def best_of(self, part: str) -> list[int]:
        """The one way of fitting pieces through the part: longest piece first, a step back where
        none fits. A place is reached in one way only, so one that led nowhere is never tried again."""
        known, fits = self.score, self.fits
        end, at, last = len(part), 0, ""
        path: list[str] = []
        dead: set[int] = set()
        tries = [iter(range(self.longest, 0, -1))]
        while at < end:
            for n in tries[-1]:
                piece, j = part[at : at + n], at + n
                if j <= end and j not in dead and (n == 1 or piece in known) and fits(last, piece):
                    path.append(piece)
                    at, last = j, piece
                    tries.append(iter(range(self.longest, 0, -1)))
                    break
            else:
                dead.add(at)
                tries.pop()
                at -= len(path.pop())
                last = path[-1] if path else ""
        out: list[int] = []
        for piece in path:
            hit = known.get(piece)
            out += (hit[0],) if hit else self._unknown_ids(piece)
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether merging `left + right` gives these two."""
        known = _FITTING.setdefault(self.key, {})
        got = known.get((left, right))
        if got is None:
            got = self.merged(left + right) == ([left, right] if left else [right])
            if len(known) >= REMEMBERED:
                known.clear()
            known[left, right] = got
        return got

    def merged(self, text: str) -> list[str]:
        """Merge the neighbours whose union scores best, leftmost first, until none is a piece."""
        out, rank = list(text), self.rank.get
        ranks = [rank(a + b, NO_PIECE) for a, b in zip(text, text[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NO_PIECE:
                break
            i = ranks.index(best)
            out[i] += out.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(out[i - 1] + out[i], NO_PIECE)
            if i < len(ranks):
                ranks[i] = rank(out[i] + out[i + 1], NO_PIECE)
        return out

    def lattice(self, text: str, size: int, at: int, before: str) -> list[int]:
        """Length of the one fitting piece that ends at each place, from place `at` after piece `before`."""
        end = len(text)
        length = [-1] * (end + 1)
        if at > end:
            return length
        length[at] = 0
        known, longest, fits = self.score, self.longest, self.fits
        for i in range(at, min(size, end)):
            if length[i] < 0:
                continue
            last = text[i - length[i] : i] if i > at else before
            for j in range(i + 1, min(i + longest, end) + 1):
                piece = text[i:j]
                if (j == i + 1 or piece in known) and length[j] < 0 and fits(last, piece):
                    length[j] = j - i
        return length

    def forward(self, text: str, size: int, start: dict[int, int]) -> tuple[list[int], list[int]]:
        length = self.lattice(text, size, 0, "")
        return [0 if x >= 0 else NEVER for x in length], length

    def _piece(self, text: str, back: int, state: int) -> tuple[int, str]:
        """Where a state's piece ends, and the piece."""
        before, after = divmod(state, 64)
        return back + after, text[back - before : back + after]

    def _outs(self, length: list[int], edge: int) -> list[int]:
        """States at the right edge: pieces that start before it."""
        return [64 * (length[edge + k] - k) + k for k in range(self.longest) if edge + k < len(length) and length[edge + k] > k]

    def transfer(self, text: str, back: int, size: int) -> Transfer:
        starts = [0] if not back else [64 * b + a for b in range(1, min(self.longest, back) + 1) for a in range(self.longest - b + 1) if back + a <= len(text) and (a + b == 1 or text[back - b : back + a] in self.score)]
        edge = back + size
        cuts = self.cuts(text, back, edge)
        if cuts:
            first, last = cuts
            outs = self._outs(self.lattice(text[last:], edge - last, 0, ""), edge - last)
            alive = [s for s in starts if self.lattice(text[:first], first, *self._piece(text, back, s))[first] >= 0]
            return {(s, to): (0, 0) for s in alive for to in outs}
        through = {s: 64 * (s // 64 + size) + s % 64 - size for s in starts if s % 64 >= size}  # a piece over the whole chunk
        own = {(s, to): (0, 0) for s in starts if s not in through for to in self._outs(self.lattice(text, edge, *self._piece(text, back, s)), edge)}
        return own | {x: (0, 0) for x in through.items()}

    def trace(self, text: str, back: int, size: int, start: int, end: int) -> np.ndarray:
        edge, stop = back + size, back + size + end % 64
        cuts = self.cuts(text, back, edge)
        if not cuts and start % 64 >= size:
            return np.zeros(0, dtype=np.int32)
        if not cuts:
            return np.array(self.ids_of(text, self.lattice(text, edge, *self._piece(text, back, start)), stop), dtype=np.int32)
        first, last = cuts
        left = self.lattice(text[:first], first, *self._piece(text, back, start))
        right = self.lattice(text[last:], edge - last, 0, "")
        return self._joined(text[:first], left, first, text[first:last], text[last:], right, stop - last)


def model_type(path: str) -> str:
    """`unigram` or `bpe`, as the .model file says."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]


def normalised(text: str) -> str:
    """With the leading space that the model adds, spaces written as U+2581."""
    return SPACE + text.replace(" ", SPACE)


def combine(a: Transfer, b: Transfer) -> Transfer:
    """Max-plus product of two matrices; associative. Of equal scores the preferred stands.

    Preferences only order the ways to one place, so they are numbered anew there.
    """
    after: dict[int, list[tuple[int, int, int]]] = {}
    for (i, j), (score, prefer) in b.items():
        after.setdefault(i, []).append((j, score, prefer))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (i, k), (score, prefer) in a.items():
        for j, more, then in after.get(k, ()):
            best[i, j] = max(best.get((i, j), (NEVER, 0, 0)), (score + more, then, prefer))
    ways: dict[int, set[tuple[int, int]]] = {}
    for (_, j), (_, then, prefer) in best.items():
        ways.setdefault(j, set()).add((then, prefer))
    order = {j: {w: n for n, w in enumerate(sorted(ws))} for j, ws in ways.items()}
    return {(i, j): (score, order[j][then, prefer]) for (i, j), (score, then, prefer) in best.items()}


def end_state(whole: Transfer) -> int:
    """The best state in which a text ends, with no piece beyond its end."""
    return max((to for at, to in whole if at == 0 and to % 64 == 0), key=lambda to: whole[0, to])


def edge_states(matrices: list[Transfer], start: int, end: int) -> list[tuple[int, int]]:
    """(from, to) of every matrix on the best way through all, from state `start` to state `end`.

    Forward, the best score of each state at each edge; backward, the state that each matrix is
    entered in, by score and then preference.
    """
    at, before = {start: 0}, []
    for m in matrices:
        before.append(at)
        now: dict[int, int] = {}
        for (i, j), (score, _) in m.items():
            if i in at:
                now[j] = max(now.get(j, NEVER), at[i] + score)
        at = now
    states = []
    for v, m in zip(reversed(before), reversed(matrices), strict=True):
        begin = max((i for i, j in m if j == end and i in v), key=lambda i: (v[i] + m[i, end][0], m[i, end][1]))
        states.append((begin, end))
        end = begin
    return states[::-1]


def packed(m: Transfer) -> bytes:
    return zlib.compress(np.array([(i, j, s, p) for (i, j), (s, p) in m.items()], dtype="<i8").tobytes(), 1)


def unpacked(data: bytes) -> Transfer:
    rows = np.frombuffer(zlib.decompress(data), dtype="<i8").reshape(-1, 4).tolist()
    return {(i, j): (s, p) for i, j, s, p in rows}


def _ids_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)])
    values = np.concatenate([np.zeros(0, np.int32), *parts])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _with_columns(df: DataFrame, source: str, added: str, function) -> DataFrame:
    """Add the columns of schema `added` = function(array of `source`), in short Arrow batches that
    are passed on at once, so that neither side holds the long arrays of many rows."""
    more = DataType.fromDDL(added).fields
    short_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns, *function(part.column(source))], names=[*part.schema.names, *(f.name for f in more)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *more]))


def with_ids(docs: DataFrame, pieces: Pieces, ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """Add the ids and, if named, whether they decode to the text, to docs(text, ...), for texts
    that are not giant."""

    def made(texts: pa.Array) -> list[pa.Array]:
        found = list(pieces.solve_all(texts.to_pylist()))
        out = [_ids_array([ids for ids, _ in found])]
        return [*out, pa.array([back for _, back in found], pa.bool_())] if round_trip else out

    return _with_columns(docs, "text", f"`{ids}` array<int>" + (f", `{round_trip}` boolean" if round_trip else ""), made)


def decoded(encoded: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add column `text`, what the ids in column `ids` stand for; null ids give an empty text."""
    return _with_columns(encoded, ids, f"`{text}` string", lambda rows: [pa.array([pieces.decode(x.values.to_numpy() if x.is_valid else None) for x in rows], pa.string())])


def _map_chunks(df: DataFrame, function, schema: str) -> DataFrame:
    """Rows of chunks -> rows, one pandas batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ROWS_AT_ONCE):
                yield pd.DataFrame([function(r) for r in frame.iloc[at : at + ROWS_AT_ONCE].to_dict("records")])

    return df.mapInPandas(run, schema)


def chunks_of(texts: DataFrame, longest: int, chunk: int) -> DataFrame:
    """key, c, back, size, part of texts(key, text): chunk c with `back` characters before and up to
    `longest - 1` after it. One pass over each text; the chunks of one are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), normalised(batch.column(1)[i].as_py())
                for first in range(0, len(text), chunk * ROWS_AT_ONCE):
                    rows = []
                    for at in range(first, min(first + chunk * ROWS_AT_ONCE, len(text)), chunk):
                        back = longest if at >= longest else at
                        rows.append({"key": key, "c": at // chunk, "back": back, "size": min(chunk, len(text) - at), "part": text[at - back : at + chunk + longest - 1]})
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("key", pa.string()), ("c", pa.int32()), ("back", pa.int32()), ("size", pa.int32()), ("part", pa.string())])
    return texts.select("key", "text").mapInArrow(run, "key string, c int, back int, size int, part string").repartition("key", "c")


def levels(chunk: int, fan: int = FAN) -> int:
    """Steps of the tree over the chunks of the longest text that there can be."""
    n, out = -(-MOST_CHARACTERS // chunk), 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def scan(matrices: DataFrame, steps: int, fan: int = FAN) -> DataFrame:
    """key, c, start, end: the edge states of matrices(key, c, cells).

    Upwards, each `fan` neighbouring matrices become one by `combine`, until each key has one.
    Downwards, each group's states give its members'. No group holds over `fan` matrices.
    """

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c")
        whole = unpacked(frame["cells"].iloc[0])
        for cells in frame["cells"].iloc[1:]:
            whole = combine(whole, unpacked(cells))
        return pd.DataFrame({"key": frame["key"].iloc[:1], "c": frame["g"].iloc[:1], "cells": [packed(whole)]})

    def walked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c")
        states = edge_states([unpacked(x) for x in frame["cells"]], int(frame["start"].iloc[0]), int(frame["end"].iloc[0]))
        return pd.DataFrame({"key": frame["key"], "c": frame["c"], "start": [s for s, _ in states], "end": [e for _, e in states]})

    group = F.floor(F.col("c") / fan).cast("int")
    tree = [matrices.select("key", "c", "cells")]
    for _ in range(steps):
        tree.append(tree[-1].withColumn("g", group).groupBy("key", "g").applyInPandas(joined, "key string, c int, cells binary"))
    states = _map_chunks(tree.pop(), lambda r: {"key": r["key"], "c": 0, "start": 0, "end": end_state(unpacked(r["cells"]))}, "key string, c int, start int, end int")
    while tree:
        above = states.select("key", F.col("c").alias("g"), "start", "end")
        states = tree.pop().withColumn("g", group).join(above, ["key", "g"]).groupBy("key", "g").applyInPandas(walked, "key string, c int, start int, end int")
    return states


def scan_encode(texts: DataFrame, pieces: Pieces, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """key, ids of giant texts(key, text) with distinct keys, by the max-plus scan."""
    chunks = chunks_of(texts, pieces.longest, chunk)

    def measure(r: dict) -> dict:
        return {"key": r["key"], "c": r["c"], "cells": packed(pieces.transfer(r["part"], r["back"], r["size"]))}

    def emit(r: dict) -> dict:
        return {"key": r["key"], "c": r["c"], "ids": pieces.trace(r["part"], r["back"], r["size"], r["start"], r["end"])}

    matrices = cut(_map_chunks(chunks, measure, "key string, c int, cells binary"))
    states = cut(scan(matrices, levels(chunk, fan), fan))
    traced = _map_chunks(chunks.join(states, ["key", "c"]), emit, "key string, c int, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("c", "ids")))
    return traced.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encode_documents(docs: DataFrame, pieces: Pieces, chunk: int = CHUNK, ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """All rows and columns of docs(text, ...) with column `ids`, the piece ids of the whole text,
    and, if named, column `round_trip`, whether decoding them gives the text back.

    A null or empty text has no ids. Unknown characters become their UTF-8 bytes' pieces, or the
    unknown piece in a model without them. U+2581 in a text reads as a space, and then round_trip
    is false. Repeated rows are all kept; repeated giant texts are solved once. A column of docs
    with an added name is an error; all other names are free. Empty in, empty out.
    """
    added = [ids, *([round_trip] if round_trip else [])]
    if clash := {c.lower() for c in docs.columns} & {a.lower() for a in added}:
        raise ValueError(f"docs has columns of the added names: {sorted(clash)}")
    giant = F.coalesce(F.length("text") > 2 * chunk, F.lit(False))
    short = with_ids(docs.where(~giant), pieces, ids, round_trip)
    key, own = F.sha2("text", 256), fresh("key", docs, *added)
    solved = scan_encode(docs.where(giant).select(key.alias("key"), "text").dropDuplicates(["key"]), pieces, chunk)
    if round_trip:
        solved = decoded(solved, pieces).withColumn("back", F.sha2("decoded", 256) == F.col("key"))
    solved = solved.select(F.col("key").alias(own), F.col("ids").alias(ids), *([F.col("back").alias(round_trip)] if round_trip else []))
    long = docs.where(giant).withColumn(own, key).join(solved, own)
    return short.unionByName(long.drop(own))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, for every document.

    Nulls, empty, long and repeated texts: as `encode_documents` says.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, Pieces.load(MODEL), round_trip="round_trip")
    return encoded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "round_trip")
