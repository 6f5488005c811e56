"""Benchmark decontamination: BM25 with block-max WAND, then a check of question and answer.

The test items are the indexed side. Every passage of every training text (a window of two
neighbouring blocks of words) is a query that retrieves all items whose BM25 score reaches a share
of the score the item gives itself. A retrieved item counts as leaked if both its question and its
answer are covered by five-word runs that the passage contains; of a shorter question or answer the
run is the whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.common import batch_column, fresh, table

K1, B = 1.2, 0.75
#: Share of an item's score for itself from which it is retrieved.
THRESHOLD = 0.6
#: Share of the words of the question, and of the answer, that shared runs must cover.
OVERLAP = 0.6
RUN = 5
#: Postings per block, and words per block of a passage at least.
POSTINGS, WORDS = 32, 64
#: Characters of the items in one index, about, and of the indexes that one pass over the texts holds.
INDEX_CHARACTERS, PASS_CHARACTERS = 4_000_000, 16_000_000
#: Items of up to CLASS characters are alike in length, then those of up to 4, 16, ... times as many.
CLASS = 4_000
EPS = 1e-9
#: Lower-cased text as bytes: ASCII letters and digits and all above ASCII stay, the rest parts words.
KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(KEEP).split()


def question_words(text: str, total: int) -> int:
    """How many of an item's words are its question: up to the first `?`, else up to the first line
    end, else half of them. The rest, at least one word if there are two, is the answer."""
    for mark in ("?", "\n"):
        head, found, tail = text.partition(mark)
        if found and words_of(head) and words_of(tail):
            return len(words_of(head))
    return (total + 1) // 2


class Index:
    """Impact-ordered facts about the items: for each term its postings in blocks with their maxima.

    Impacts are divided by the item's score for itself, so that one threshold serves all items.
    """

    def __init__(self, items: list[tuple[int, str]], df: Counter, n_items: int, mean_words: float):
        words = [words_of(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.characters = sum(len(t) for _, t in items)
        self.words = words
        self.question = [question_words(t or "", len(w)) for (_, t), w in zip(items, words, strict=True)]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.span = max([WORDS, *map(len, words)])
        n = len(self.vocabulary)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        essential: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        self.needed = np.zeros(len(items))
        for i, ws in enumerate(words):
            scores = {}
            for w, tf in Counter(ws).items():
                idf = np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
                scores[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean_words))
            own = sum(scores.values())
            rest = 1.0
            for w, s in sorted(scores.items(), key=lambda x: (df[x[0]], -x[1], x[0])):
                postings[self.vocabulary[w]].append((i, s / own))
                if rest > THRESHOLD / 2:  # rare terms first, until the others alone are far from enough
                    essential[self.vocabulary[w]].append((i, s / own))
                    rest -= s / own
            self.needed[i] = THRESHOLD - rest
        self.postings = [([i for i, _ in p], [s for _, s in p]) for p in postings]
        self.top = [max(s) if s else 0.0 for _, s in self.postings]
        self.blocks = [[(p[0][min(a + POSTINGS, len(p[0])) - 1], max(p[1][a : a + POSTINGS])) for a in range(0, len(p[0]), POSTINGS)] for p in self.postings]
        self.first = np.cumsum([0, *map(len, essential)])
        self.essential_item = np.array([i for e in essential for i, _ in e], dtype=np.int64)
        self.essential_score = np.array([s for e in essential for _, s in e])
        self.is_essential = np.diff(self.first) > 0

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the windows that may reach the threshold for some item.

        An item can only do so if its rare (essential) terms in the window weigh at least what the
        others lack; their postings are short, and are summed per block of words in arrays.
        """
        at = np.flatnonzero(ids >= 0)
        at = at[self.is_essential[ids[at]]]
        if not len(at):
            return at
        n_terms, n_items = len(self.top), len(self.ids)
        pair = np.unique((at // self.span) * n_terms + ids[at])
        block, term = pair // n_terms, pair % n_terms
        count = self.first[term + 1] - self.first[term]
        take = np.repeat(self.first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        key = np.repeat(block, count) * n_items + self.essential_item[take]
        keys, inverse = np.unique(key, return_inverse=True)
        mass = np.bincount(inverse, weights=self.essential_score[take])
        later = np.searchsorted(keys, keys + n_items)
        later_mass = np.where((later < len(keys)) & (keys[np.minimum(later, len(keys) - 1)] == keys + n_items), mass[np.minimum(later, len(keys) - 1)], 0)
        earlier = np.searchsorted(keys, keys - n_items)
        earlier_mass = np.where(keys[np.minimum(earlier, len(keys) - 1)] == keys - n_items, mass[np.minimum(earlier, len(keys) - 1)], 0)
        needed, block = self.needed[keys % n_items] - EPS, keys // n_items
        return np.unique(np.concatenate([block[mass + later_mass >= needed], np.maximum(block[mass + earlier_mass >= needed] - 1, 0)]))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND over the terms: all (item, score) with a score of THRESHOLD or more."""
        found: list[tuple[int, float]] = []
        places = {t: 0 for t in terms}
        last = len(self.ids)

        def seek(t: int, item: int) -> None:
            """Move a cursor to its first posting at `item` or later, block by block."""
            items, p = self.postings[t][0], places[t]
            while p < len(items) and self.blocks[t][p // POSTINGS][0] < item:
                p = (p // POSTINGS + 1) * POSTINGS
            while p < len(items) and items[p] < item:
                p += 1
            places[t] = p

        def here(t: int) -> int:
            items = self.postings[t][0]
            return items[places[t]] if places[t] < len(items) else last

        while True:
            order = sorted((here(t), t) for t in places)
            bound, pivot = 0.0, last
            for item, t in order:
                if item == last:
                    break
                bound += self.top[t]
                if bound >= THRESHOLD - EPS:
                    pivot = item
                    break
            if pivot == last:
                return found
            ahead = [t for item, t in order if item <= pivot]
            beyond = min((item for item, _ in order if item > pivot), default=last)
            bound, skip = 0.0, beyond
            for t in ahead:
                block = next((b for b in self.blocks[t][places[t] // POSTINGS :] if b[0] >= pivot), None)
                if block:
                    bound += block[1]
                    skip = min(skip, block[0] + 1)
            if bound < THRESHOLD - EPS:
                for t in ahead:
                    seek(t, max(skip, pivot + 1))
            elif order[0][0] == pivot:
                score = sum(self.postings[t][1][places[t]] for t in ahead)
                if score >= THRESHOLD - EPS:
                    found.append((pivot, score))
                for t in ahead:
                    seek(t, pivot + 1)
            else:
                for t in ahead:
                    seek(t, pivot)

    def overlap(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's words that lie in runs of the passage.

        Runs are taken over the item, and over question and answer by themselves, so that one of
        fewer than RUN words has a run of its own.
        """
        words, q = self.words[item], self.question[item]
        hit = np.zeros(len(words), dtype=bool)
        held: dict[int, set[tuple[bytes, ...]]] = {}
        for start, stop in ((0, len(words)), (0, q), (q, len(words))):
            run = min(RUN, stop - start)
            if run and run not in held:
                held[run] = set(zip(*(passage[k:] for k in range(run)), strict=False))
            for i in range(start, stop - run + 1 if run else start):
                if tuple(words[i : i + run]) in held[run]:
                    hit[i : i + run] = True
        return float(hit[:q].mean()), float(hit[q:].mean()) if q < len(words) else 1.0

    def leaks(self, text: str | None) -> list[dict]:
        """Verified items of one text: item_id, score, question, answer; the best window of each."""
        return self.leaks_in(words_of(text))

    def leaks_in(self, words: list[bytes]) -> list[dict]:
        """The same of a text's words."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        for w in self.windows(ids).tolist():
            inside = slice(w * self.span, (w + 2) * self.span)
            terms = np.unique(ids[inside])
            for item, score in self.retrieve(terms[terms >= 0].tolist()):
                question, answer = self.overlap(item, words[inside])
                if question >= OVERLAP and answer >= OVERLAP:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, question, answer))
        return [{"item_id": self.ids[i], "score": round(s, 6), "question": round(q, 6), "answer": round(a, 6)} for i, (s, q, a) in sorted(best.items())]


def indexes(benchmark: DataFrame, most: int = INDEX_CHARACTERS) -> Iterator[Index]:
    """Indexes over benchmark(item_id, text), one after another, each of items of like length and of
    about `most` characters at most, so that a long item widens the windows of few others.

    The driver holds one block of items at a time; document frequencies are those of all items.
    Items without a word cannot be found and are left out.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    like = F.greatest(F.lit(0), F.floor(F.log(4.0, F.length("text") / CLASS)) + 1).cast("int")
    items = items.withColumn("like", like)
    sizes = {r.like: r.n for r in items.where("text <> ''").groupBy("like").agg(F.sum(F.length("text")).alias("n")).collect()}
    blocks = [(k, b, -(-n // most)) for k, n in sorted(sizes.items()) for b in range(-(-n // most))]

    def block(at: tuple[int, int, int]) -> list[tuple]:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(at[2]))
        return [(r.item_id, r.text) for r in items.where((F.col("like") == at[0]) & (part == at[1])).orderBy("item_id", "text").collect() if words_of(r.text)]

    held = {blocks[0]: block(blocks[0])} if len(blocks) == 1 else {}
    df: Counter = Counter()
    total, known = 0, 0
    for at in blocks:
        for _, t in held.get(at) or block(at):
            ws = words_of(t)
            df.update(set(ws))
            total, known = total + len(ws), known + 1
    for at in blocks:
        if found := held.get(at) or block(at):
            yield Index(found, df, known, max(1.0, total / max(1, known)))


def passes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The indexes in groups that one pass over the texts holds."""
    group: list[Index] = []
    for index in indexes(benchmark):
        if group and sum(x.characters for x in group) + index.characters > PASS_CHARACTERS:
            yield group
            group = []
        group.append(index)
    if group:
        yield group


LEAKS = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def leaks_column(group: list[Index]):
    """A column function: text -> leaks of all indexes of a group, by item."""

    def leaks(text: str | None) -> list[dict]:
        words = words_of(text)
        return sorted((leak for index in group for leak in index.leaks_in(words)), key=lambda x: x["item_id"])

    return batch_column(lambda texts: [leaks(t) for t in texts], LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question, answer: one row per row of docs(doc_id, text) and leaked
    item of benchmark(item_id, text), with the values of its best passage.

    score is the passage's BM25 score over the item's own; question and answer are covered shares.
    Null and empty texts leak nothing, as do null and wordless items; items without an id are left
    out. Items of one word have no answer, which then counts as covered. Repeated rows are reported
    each. Further columns are ignored. With an empty table on either side there are no rows.
    """
    out = None
    for group in passes(benchmark.where("item_id is not null")):
        found = docs.select("doc_id", leaks_column(group)("text").alias("leaks")).where(F.size("leaks") > 0).select("doc_id", F.inline("leaks"))
        out = found if out is None else out.unionByName(found)
    nothing = F.lit(None).cast(LEAKS)
    return docs.where("false").select("doc_id", F.inline(nothing)) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs(text, ...) in which no item leaked, with their own columns, whatever their
    names. Nulls, empty texts and tables, repeats: as `find_leaks` says, and nothing leaks there."""
    own = fresh("leaks", docs)
    for group in passes(benchmark.where("item_id is not null")):
        docs = docs.withColumn(own, leaks_column(group)("text")).where(F.size(own) == 0).drop(own)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of every document. Nulls, empty and long texts, repeats: as `find_leaks` says."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
