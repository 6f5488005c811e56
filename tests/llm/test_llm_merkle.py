"""The Merkle manifest beside a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from adapterlens.llm import merkle as M

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """(root, per leaf the [(left, right), ...] up to it)."""
    nodes, members, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in members[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            held.append([i for m in members[at : at + 8] for i in m])
        nodes, members = above, held
    return nodes[0], paths


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted(((r, leaf_of(r, r.text)) for r in rows if r.lang == x), key=lambda x: (first(x[0].doc_id), x[1])) for x in langs]
    below = [tree([leaf for _, leaf in g]) for g in groups]
    root, above = tree([subroot for subroot, _ in below]) if groups else (None, [])
    out = []
    for group, (subroot, paths), top in zip(groups, below, above, strict=True):
        for (r, leaf), path in zip(group, paths, strict=True):
            whole, text = path + top, r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf_of(r, text)
            for left, right in whole:
                now = h(left, now, right)
            out.append((r.doc_id, leaf, subroot, root, h(*(x for pair in whole for x in pair)), now, now == root))
    return sorted(out, key=repr)


def found(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = M.op12_merkle_manifest(spark, str(tmp_path))
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=repr)


def test_whole_table_equals_the_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = M.op12_merkle_manifest(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


@pytest.mark.parametrize("local", [1, 3])
def test_nulls_ties_repeats_and_every_shape(spark, tmp_path, monkeypatch, local):
    # with blocks of 8 leaves, trees of up to 700 leaves need four rounds
    monkeypatch.setattr(M, "LOCAL", local)
    sizes = {"one": 1, "eight": 8, "nine": 9, "many": 530, "Zed": 65, "ä": 3, "": 64, None: 4}
    rows = [(i, f"s{i % 3}", lang, i if i % 5 else None, f"Text {i}" if i % 7 else None) for lang, n in sizes.items() for i in range(n)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "x", "nine", 1, ""), (5, "y", "nine", 1, "")] + [(7, "same", "many", 1, "Same Text")] * 40
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("level0", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("block", F.lit(2))
    want = plain(spark.createDataFrame(rows, COLUMNS).collect())
    assert found(spark, docs.repartition(5), tmp_path) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tables_of_no_and_few_rows(spark, tmp_path, n):
    docs = spark.createDataFrame([(i, "s", "en", 3, "A long text " * 30_000) for i in range(n)], COLUMNS)
    assert found(spark, docs, tmp_path) == plain(docs.collect())


def test_manifest_gives_proofs_that_fold_to_the_root(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = M.verified(M.manifest(docs, F.col("text")))
    assert rows.count() == docs.count() and rows.where("not verified or tampered <> leaf").count() == 0
    assert rows.select("root").distinct().count() == 1
