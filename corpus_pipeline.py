"""A corpus pipeline over `documents`, of text operators.

Each stage takes (spark, docs, sf_dir) and returns a table, written as Parquet and read again as
the next one's docs. All but the last return the columns of `documents`.

In every stage further columns pass whatever their names, but for the last, which returns its own;
an empty table gives an empty one; texts are read whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm import decontaminate, pii, quality, sentencepiece_scan, simhash
from adapterlens.llm.common import remove, shared_dir, table

#: SimHash candidates of this stage: 3-word fingerprints, as in the operator's own query, that differ
#: in up to 6 bits. Fingerprints of texts whose five-word shingles are 0.8 alike or more differ in 2
#: to 11 bits, so bands of least shingle values propose pairs too; every pair is compared exactly.
RADIUS, BLOCKS = 6, 8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the base check or the learned decision list.

    A null or empty text fails. Repeated rows are judged alike, each by itself. Without labels of
    both kinds only the base check rejects.
    """
    return quality.only_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles are 0.8 alike or more.

    The least doc_id stays, nulls last, then the least hash of the text; of rows that repeat both
    one stays. Null, empty and wordless texts are one group.
    """
    return simhash.keep_one(docs, radius=RADIUS, blocks=BLOCKS, exact=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item. Null and empty texts hold none and stay, as do
    repeated rows without one; items without an id or a word are ignored."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets, and count the characters anew. A null text stays
    null, with a null count; repeated rows are treated alike."""
    return pii.without_personal_data(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document. A null or empty text has none; repeated rows stay."""
    pieces = sentencepiece_scan.Pieces.load(sentencepiece_scan.MODEL)
    encoded = sentencepiece_scan.encode_documents(docs.select("doc_id", "text"), pieces)
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("personal data", redact),
    ("sentencepiece encoding", encode),
]

#: Learned rules, fingerprints and BM25 cannot be said in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage wrote goes when the next has read it."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
