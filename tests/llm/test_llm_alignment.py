"""Tokenizer alignment beside the libraries' own calls and plain loops."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from adapterlens.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = A.byte_letters()
    entry = {i: bytes(letters[c] for c in t) for t, i in json.loads(a.to_str())["model"]["vocab"].items() if all(c in letters for c in t)}
    assert decoders.ByteLevel().decode([a.id_to_token(i) for i in range(256, 400)]).encode() == b"".join(entry[i] for i in range(256, 400))
    return a, b, entry


def plain_tokens(libraries, text):
    """([(id, end)] of A, of B), both empty where bytes are changed."""
    a, b, entry = libraries
    if not text:
        return [], []
    said, out = f" {text}".encode(), []
    for ids, spelled in ((a.encode(f" {text}", add_special_tokens=False).ids, lambda i: entry[i]), (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        at, rows = 0, []
        for i in ids:
            at += len(spelled(i))
            rows.append((i, at))
        if b"".join(map(spelled, ids)) != said:
            return [], []
        out.append(rows)
    return tuple(out)


def plain(libraries, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    tokens = [plain_tokens(libraries, t) for t in texts]
    links = [fast_links(a, b) for a, b in tokens]
    count = Counter(p for x in links for p in x)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (a, b), own in zip(tokens, links, strict=True):
        ends = sorted({x for _, x in a} & {x for _, x in b})
        groups, last = [], 0
        ia = ib = 0
        for e in ends:
            ga, gb = [], []
            while ia < len(a) and last < a[ia][1] <= e:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and last < b[ib][1] <= e:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
            last = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest))
    return out


def fast_links(a, b):
    at = {y: j for j, y in b}
    return [(i, at[x]) for i, x in a if x in at]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_whole_table_equals_the_plain_version(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in docs), plain(libraries, [r.text for r in docs]), strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.op11_tokenizer_alignment(spark, sf_dir).collect()}
    assert got == want and sum(w[0] for w in want.values()) > 10_000


def odd_texts():
    r = random.Random(5)
    letters = [*map(chr, range(33, 127)), *" " * 40, "\n", "\t", "é", "日", "本", "😀", "\xa0", "\x1c", "﻿", "ﬁ", "①"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(200)]
    return [None, "", " ", "a", "  two   spaces ", "<|endoftext|> <s> </s> <0x41> <unk>", "▁under", "=" * 500, "12345 " * 50, "word " * 9000, *texts, *texts[:9]]


def test_odd_texts_nulls_repeats_and_clashing_columns(spark, libraries):
    texts = odd_texts()
    docs = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    aligned = A.align_documents(docs, *PATHS)
    rows = A.scored(aligned.select("doc_id", "text", A.summed_column(*PATHS)("aligned").alias("s")).select("doc_id", "text", "s.*"), 32_000).collect()
    want = sorted(zip((t or "-" for t in texts), plain(libraries, texts), strict=True))
    assert sorted((r.text or "-", tuple(r[c] for c in COLUMNS)) for r in rows) == want
    assert any(w[1][0] == 0 for w in want if w[0] not in "-") and any(w[1][0] for w in want)
    with pytest.raises(ValueError, match="has a column"):
        A.align_documents(docs.withColumn("Aligned", docs.doc_id), *PATHS)
    assert A.align_documents(docs.where("false"), *PATHS).count() == 0


def test_both_ways_of_joining_counts_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    summed = A.align_documents(docs, *PATHS).select("doc_id", A.summed_column(*PATHS)("aligned").alias("s")).select("doc_id", "s.*")
    few, many = (sorted(map(tuple, A.scored(summed, 32_000, n).select("doc_id", "n_best", "count_sum").collect())) for n in (1 << 20, 10))
    assert few == many


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_all_common_ends(seed):
    r = random.Random(seed)
    a_rows, b_rows, at = [], [], 0
    for _ in range(r.randint(1, 9)):
        n = r.choice([0, 1, 2, 30, 200])
        if n:
            common = [at + n]
            share = r.random()
            a_rows.append(sorted({at + x for x in range(1, n) if r.random() < share} | set(common)))
            b_rows.append(sorted({at + x for x in range(1, n) if r.random() < 1 - share} | set(common)))
        else:
            a_rows.append([])
            b_rows.append([])
        at += n
    a, b = (np.array([x for row in rows for x in row], np.int64) for rows in (a_rows, b_rows))
    a_at, b_at = (np.array([0, *np.cumsum([len(x) for x in rows])]) for rows in (a_rows, b_rows))
    i, j = A.shared_cuts(a, b, a_at, b_at)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_links_come_out_of_one_worker_a_task(spark, sf_dir, capsys):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    linked = A.link_documents(docs, *PATHS).select("doc_id", "linked.*")
    apart = A.align_documents(docs, *PATHS).select("doc_id", A.summed_column(*PATHS)("aligned").alias("s")).select("doc_id", "s.*")
    assert sorted(linked.collect()) == sorted(apart.collect())
    capsys.readouterr()
    linked.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    with pytest.raises(ValueError, match="has a column"):
        A.link_documents(docs.withColumnRenamed("doc_id", "linked"), *PATHS)
