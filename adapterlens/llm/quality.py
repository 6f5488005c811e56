"""Quality rules as a learned decision list.

Statistics of every whole text are columns. Sequential covering learns an ordered list of
threshold conjunctions from labelled statistics: each rule is grown on one part of the labelled
sample, pruned on the other, and taken if it stays precise; what it covers is set aside before the
next. The list becomes one CASE expression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.common import bounded_sample, fresh, table, text_column

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Labelled rows that the list is learned from, about: those with a low hash of doc_id.
SAMPLE = 10_000
#: Thresholds tried per feature, conditions per rule, rules per list.
THRESHOLDS, CONDITIONS, RULES = 48, 4, 12
#: A rule must be this precise on the pruning part and on the whole sample, and cover this many rows.
PRECISION, SUPPORT = 0.97, 5
STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint,n_distinct:bigint>"


def repeated_words(words: list) -> int:
    """Words inside 5-word windows that occur twice or more in the list, first ones included."""
    n = len(words) - 4
    if n < 2:
        return 0
    if n > 100_000:  # the same by ranks, in arrays
        _, at = np.unique(np.array(words, dtype=object), return_inverse=True)
        pair = np.unique(at[:-1].astype(np.int64) * (at.max() + 1) + at[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2].astype(np.int64) * (pair.max() + 1) + pair[2:], return_inverse=True)[1]
        _, five, count = np.unique(four[:-1].astype(np.int64) * (at.max() + 1) + at[4:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[five] > 1)
    else:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        again = [i for i, w in enumerate(windows) if count[w] > 1]
    covered, end = 0, 0
    for i in again:
        covered += i + 5 - max(i, end)
        end = i + 5
    return int(covered)


def text_stats(text: str | None) -> dict:
    """The statistics of one text; a null text has none of anything."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_distinct": len(set(words)),
    }


def features(s: str = "_stats") -> dict[str, Column]:
    """What rules compare with thresholds, from the statistics in struct `s`."""
    share = lambda a, b: F.col(f"{s}.{a}") / F.greatest(F.col(f"{s}.{b}"), F.lit(1))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "n_words": F.col(f"{s}.n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, named: dict[str, Column]) -> Column:
        c = named[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        c = x[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


def _covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.of(x)
    return out


def _candidates(x: dict[str, np.ndarray]) -> list[Condition]:
    out = []
    for name, values in x.items():
        seen = np.unique(values)
        if len(seen) < 2:
            continue
        middle = (seen[:-1] + seen[1:]) / 2
        for t in np.unique(middle[np.linspace(0, len(middle) - 1, min(THRESHOLDS, len(middle))).astype(int)]):
            out += [Condition(name, True, float(t)), Condition(name, False, float(t))]
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the condition with the best FOIL gain until no good row is covered or nothing gains."""
    rule: list[Condition] = []
    inside, candidates = np.ones(len(bad), dtype=bool), _candidates(x)
    masks = [c.of(x) for c in candidates]
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), inside.sum()
        best, gain = None, 1e-9
        for c, m in zip(candidates, masks, strict=True):
            now = inside & m
            p, n = (now & bad).sum(), now.sum()
            if p and (g := p * (np.log2(p / n) - np.log2(p0 / n0))) > gain:
                best, gain = (c, m), g
        if best is None:
            break
        rule.append(best[0])
        inside &= best[1]
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Drop last conditions while (bad - good) / covered on the pruning part does not fall."""

    def worth(r: list[Condition]) -> float:
        m = _covers(r, x)
        return ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rules, each a conjunction that says `bad`; what none covers is good.

    Every third row prunes, the others grow. Without rows of both kinds the list is empty.
    """
    rules: list[list[Condition]] = []
    open_ = np.ones(len(bad), dtype=bool)
    pruning = np.arange(len(bad)) % 3 == 2
    while len(rules) < RULES and (open_ & bad).any() and (open_ & ~bad).any():
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        grown = _grow(*part(open_ & ~pruning))
        rule = _prune(grown, *part(open_ & pruning))
        if not rule:
            break
        hit = _covers(rule, x) & open_
        on_prune = hit & pruning
        precise = lambda m: (m & bad).sum() >= PRECISION * m.sum()
        if (hit & bad).sum() < SUPPORT or not precise(hit) or not precise(on_prune):
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def list_column(rules: list[list[Condition]], named: dict[str, Column]) -> Column:
    """The list as one ordered CASE expression: true where a document is good."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column(named)
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and badness of about `rows` labelled documents; this bounded table comes to the driver.

    Of several texts of one doc_id that with the least hash counts; of several labels the least.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    picked = bounded_sample(known, rows, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    got = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("doc_id", "quality", text_column(text_stats, STATS)("text").alias("_stats"))
        .select("doc_id", "quality", *[c.alias(k) for k, c in features().items()])
        .toPandas()
        .sort_values("doc_id")
    )
    return {k: got[k].to_numpy(dtype=float) for k in features()}, (got["quality"] == 0).to_numpy()


def with_quality(docs: DataFrame, rules: list[list[Condition]], names: tuple[str, str, str] = ("_stats", "_failed", "_kept")) -> DataFrame:
    """Add a struct of statistics, whether the base check fails and whether the row is kept, to every
    row of docs(text, ...), under the given names, which docs must not have."""
    stats, failed, kept = names
    n_words, n_repeat = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (
        docs.withColumn(stats, text_column(text_stats, STATS)("text"))
        .withColumn(failed, (n_words < 10) | (100 * n_repeat > 20 * n_words))
        .withColumn(kept, ~F.col(failed) & list_column(rules, features(stats)))
    )


def only_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that the base check and the learned list keep, with their
    own columns, whatever their names. Nulls, repeats and empty tables: as `judge_quality` says."""
    rules = learn_list(*labelled_sample(docs, labels, sample))
    names = tuple(fresh(x, docs) for x in ("stats", "failed", "kept"))
    return with_quality(docs, rules, names).where(F.col(names[2])).select([f"`{c}`" for c in docs.columns])


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, the five base statistics, base_failed, kept.

    labels: doc_id, quality (0 bad, 1 good). Of several labels for one doc_id the least counts;
    null labels are ignored; with none, or only one kind, nothing but the base check rejects.
    Words are runs outside ASCII white space. A null text has zero words and so fails the base
    check. Repeated rows are judged each. Further columns are ignored. Empty in, empty out.
    """
    rules = learn_list(*labelled_sample(docs, labels, sample))
    judged = with_quality(docs.select("doc_id", "text"), rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"_stats.{n}" for n in names], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document. Nulls, empty and long texts, repeats: as `judge_quality` says."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
