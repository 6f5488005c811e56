"""Substring dedup by hashing normalised text units.

Lines are cut at the ends of sentences into units. Units are normalised and hashed;
digests are grouped over all documents, and the earliest ranked occurrence of each is kept. Later
occurrences go, with their places in the original text on record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adapterlens.llm.common import broadcast_if_small, cut, fresh, short_batches, table

#: Words that a run of repeated units needs in the query: a few words that recur by chance stay.
QUERY_WORDS = 25
UNIT_END = re.compile(r"[.!?]+[\"')\]]*[\x20\t]+")
UNIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("unit", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])


def units(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, normalised words) of the units of a text: sentences within lines; code points."""
    at = 0
    for line in text.split("\n"):
        start = 0
        for end in [*(m.end() for m in UNIT_END.finditer(line)), len(line)]:
            words = line[start:end].lower().split()
            if words:
                yield at + start, at + end, words
            start = end
        at += len(line) + 1


def digest(words: list[str]) -> tuple[int, int]:
    data = xxhash.xxh3_128_digest(" ".join(words))
    return int.from_bytes(data[:8], "big", signed=True), int.from_bytes(data[8:], "big", signed=True)


def unit_rows(docs: DataFrame) -> DataFrame:
    """One row per unit of docs(doc_id, text): place, number of words and 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_hash, text in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text")), strict=True):
                doc_id, text_hash = doc_id.as_py(), text_hash.as_py()
                rows = [(k, a, b, len(words), *digest(words)) for k, (a, b, words) in enumerate(units(text.as_py()))]
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([text_hash] * n, pa.int64()), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(UNIT_SCHEMA)[2:], strict=True)]], schema=UNIT_SCHEMA)

    short_batches()
    own = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, "doc_id bigint, text_hash bigint, unit int, start bigint, stop bigint, words int, hi bigint, lo bigint")


def repeated_runs(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """Removed passages of docs(doc_id, text): doc_id, text_hash, start, stop, n_units, n_words, kept_in.

    start and stop (exclusive) are code points in the original text. kept_in lists the documents
    that keep the earliest occurrences, ascending; it may name the document itself. Repeated units
    that stand next to each other are one run; with `min_words`, runs of fewer words stay.

    Rank: by doc_id (nulls last), then the text's hash, then place. Rows that repeat both doc_id
    and text are one document. Null and empty texts have no units. Further columns are ignored.
    Empty in, empty out.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "start")
    rows = unit_rows(docs)
    # Partial sums come before the shuffle, so a digest in every document is one row per task.
    first = rows.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last").drop("last")
    first = cut(first)
    later = rows.join(broadcast_if_small(first, first.count()), ["hi", "lo"]).where(rank != F.col("first"))
    later = later.select("doc_id", "text_hash", "unit", "start", "stop", "words", F.col("first.doc_id").alias("kept")).dropDuplicates(["doc_id", "text_hash", "unit"])
    order = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    islands = later.withColumn("island", F.col("unit") - F.row_number().over(order))
    return (
        islands.groupBy("doc_id", "text_hash", "island")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"),
            F.sort_array(F.collect_set("kept")).alias("kept_in"),
        )
        .where(F.col("n_words") >= min_words)
        .drop("island")
    )


def without_repeats(docs: DataFrame, min_words: int = 1, removed: str = "removed") -> DataFrame:
    """All rows of docs(doc_id, text, ...) with the repeated runs cut out of `text`, and column
    `removed`: their places in the original, null where nothing goes.

    Ranks, nulls, repeats and empty tables: as `repeated_runs` says; every row that repeats a
    document loses what the document loses. A column of docs with the added name is an error; all
    other names are free.
    """
    if removed.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {removed}")
    id_, hash_, runs_ = (fresh(x, docs, removed) for x in ("id", "hash", "runs"))
    runs = repeated_runs(docs.select("doc_id", "text"), min_words).groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(runs_))
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left")
    ends = F.concat(F.transform(runs_, lambda r: r["start"]), F.array(F.length("text").cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs_, lambda r: r["stop"]))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substr(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")
    text = F.when(F.col(runs_).isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(runs_).alias(removed))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of QUERY_WORDS words or more that the documents lose. Nulls, empty and long texts, ties,
    repeats, further columns, empty tables: as `repeated_runs` says."""
    return repeated_runs(table(spark, sf_dir, "documents"), QUERY_WORDS).drop("text_hash")
