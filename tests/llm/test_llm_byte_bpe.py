"""Byte-level BPE beside the tiktoken library, and round trips."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from adapterlens.llm import byte_bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(values, offsets):
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def odd_texts():
    r = random.Random(7)
    letters = [chr(c) for c in [*range(32, 127), *range(0x400, 0x420), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F610)]]
    space = [" "] * 60 + ["\n"] * 10 + list("\t\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎​ 　﻿")
    newer = [chr(c) for c in (0x558, 0x88F, 0x209D, 0x11DE0, 0x1246F)]
    texts = ["".join(r.choice(letters + space + newer) for _ in range(r.randint(0, 300))) for _ in range(400)]
    texts += ["".join(chr(c) for c in r.sample(range(0x110000), 60) if not 0xD800 <= c < 0xE000) for _ in range(60)]
    long = ["a" * n for n in (127, 128, 129, 4000)] + [" " * n for n in (1, 2, 3, 130, 3000)]
    return [*texts, *long, "\n \n" * 90, "ab" * 900, "日本語" * 700, "", "<|endoftext|> it's 12345 ok"]


def test_ids_equal_the_library(library):
    bpe, texts = B.ByteBpe.load(PATH, PATTERN), odd_texts()
    ids, offsets = bpe.encode([*texts, None])
    assert [x.tolist() for x in runs(ids, offsets)] == [*map(library.encode_ordinary, texts), []]
    letters, at = bpe.decode(ids, offsets)
    assert [x.tobytes() for x in runs(letters, at)] == [t.encode() for t in texts] + [b""]


def test_memory_is_bounded_and_does_not_change_ids(library):
    small = B.ByteBpe(B.ByteBpe.load(PATH, PATTERN).ranks, PATTERN, remembered=50)
    for text in odd_texts()[:40]:
        assert small.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert small.memo.characters <= max(50, len(text))


def test_every_width_of_a_bucket_merges_alike(library):
    bpe = B.ByteBpe.load(PATH, PATTERN)
    r = random.Random(3)
    pieces = ["".join(r.choice("abcdeinorst") for _ in range(n)) for n in range(1, 200) for _ in range(5)]
    ids, starts, lengths = bpe.encode_pieces([p.encode() for p in pieces])
    assert [ids[s : s + n].tolist() for s, n in zip(starts, lengths, strict=True)] == [library.encode_ordinary(p) for p in pieces]


def test_pair_table_finds_what_it_holds_and_nothing_else():
    import numpy as np

    left, right = np.arange(5000) % 71, np.arange(5000) // 71
    held = B.PairTable(left, right, np.arange(5000), np.arange(5000) + 9)
    rank, merged = held.find(left, right)
    assert (rank == np.arange(5000)).all() and (merged == np.arange(5000) + 9).all()
    rank, merged = held.find(np.array([71, -1, 3]), np.array([0, 0, -1]))
    assert (rank == B.NEVER).all() and (merged == -1).all()


def test_unknown_ids_are_an_error():
    import numpy as np

    with pytest.raises(ValueError, match="not in the vocabulary"):
        B.ByteBpe.load(PATH, PATTERN).decode(np.array([5, 60_000]), np.array([0, 2]))


def test_documents_with_nulls_long_texts_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 40_000, "x"), (4, "two  spaces", None), (4, "two  spaces", None), (None, "a" * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string")
    found = B.decode_documents(B.encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert B.encode_documents(docs.where("false"), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="has a column"):
        B.encode_documents(docs.withColumn("IDS", docs.doc_id), PATH, PATTERN)


def test_query_equals_the_library_on_the_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op13_byte_bpe(spark, sf_dir).collect()}
    assert got == want
