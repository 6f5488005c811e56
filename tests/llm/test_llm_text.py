"""Quality rules, personal data, decontamination and SentencePiece against plain versions."""

import collections
import functools
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adapterlens.llm import decontaminate, pii, quality
from adapterlens.llm import sentencepiece_scan as sp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string")


def plain_stats(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_matches_plain_statistics_and_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.judge_quality(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        stats = plain_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.kept for r in rows if known.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if known.get(r.doc_id) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None, "x"), (2, "", "x"), (3, text, "x"), (3, text, "x"), (None, text, "x")]
    got = quality.judge_quality(documents(spark, rows), labels).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False)] * 2 + [(10, False, True)] * 3
    assert quality.judge_quality(documents(spark, []), labels).count() == 0


def test_repeated_words_by_ranks_equals_plain():
    words = [f"w{i % 700}" for i in range(3000)] + [f"x{i}" for i in range(110_000)]
    assert quality.repeated_words(words) == plain_stats(" ".join(words))[4]


def test_learned_list_is_precise_and_pruned():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000), "noise": r.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.1) & (x["a"] > 0.3))
    rules = quality.learn_list(x, bad)
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= quality._covers(rule, x)
    assert (caught & ~bad).mean() < 0.01 and (caught & bad).sum() > 0.93 * bad.sum()
    assert quality.learn_list(x, np.zeros(3000, bool)) == []


def plain_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0

    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(patterns).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    alphabet = "a@b.c-1 9_%+2().5"
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert [pii.written([s]) for s in pii.base_spans(text)] == plain_spans(text), text
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000) == []


def test_personal_data_query_shape(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) or not base


def test_field_makes_repeats_agree(spark, sf_dir):
    """A number found once by its pattern is found again where the pattern fails, and other numbers are not."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train_field(docs.withColumn("text", F.concat("text", F.lit(" "), "text")))
    card = "4111111111111111"
    text = f"pay with {card} now. then {card} 5500005555555559 too, on day 12 of 53538 or 4736962."
    (added,) = pii.added_spans([text], field)
    assert {text[a:b] for a, b, k in added if k == "card"} >= {card}
    assert not {text[a:b] for a, b, _ in added} & {"12", "53538", "4736962"}


def test_message_passing_equals_enumeration():
    """On a chain with one skip edge (a loop), marginals stay close to the exact ones."""
    import itertools

    r = np.random.default_rng(0)
    k = len(pii.LABELS)
    field = pii.Field({}, np.zeros((1, k)), r.normal(0, 0.3, (k, k)), np.eye(k))
    own = r.normal(0, 1, (4, k))
    field.logits = lambda tokens: own
    chain, skip = np.array([[0, 1], [1, 2], [2, 3]]), np.array([[0, 3]])
    exact = np.zeros((4, k))
    for ys in itertools.product(range(k), repeat=4):
        s = sum(own[i, y] for i, y in enumerate(ys)) + sum(field.chain[ys[a], ys[b]] for a, b in chain) + field.skip[ys[0], ys[3]]
        for i, y in enumerate(ys):
            exact[i, y] += np.exp(s)
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.abs(field.marginals([None] * 4, chain, skip) - exact).max() < 0.03


def test_marginals_do_not_depend_on_the_batch():
    r = np.random.default_rng(4)
    k = len(pii.LABELS)
    skip = r.normal(size=(k, k))
    field = pii.Field({"bias": 0}, r.normal(size=(1, k)), 3 * r.normal(size=(k, k)), 3 * (skip + skip.T))
    texts = [" ".join(f"{r.choice(['a@b.co', 'call', '+1 202 555 0101', '202-555', '7', 'x'])}" for _ in range(n)) for n in (1, 5, 20, 60, 3, 40)]
    tokens, *edges = pii.graph(texts)
    whole, of = field.beliefs(tokens, *edges), np.array([t[0] for t in tokens])
    for i, text in enumerate(texts):
        own = pii.graph([text])
        if own[0]:
            assert np.array_equal(field.beliefs(*own), whole[of == i])
    assert len(set(of)) > 3


def test_personal_data_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "mail a@b.co", "x"), (4, "mail a@b.co", "x"), (4, "mail a@b.co", "x")]
    got = pii.find_personal_data(documents(spark, rows)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in got) == sorted([("1", 0, ""), ("2", 0, ""), ("None", 1, "email:5:11"), ("4", 1, "email:5:11"), ("4", 1, "email:5:11")])
    assert all(r.base_sha256 == empty for r in got if not r.n_email)
    assert pii.find_personal_data(documents(spark, [])).count() == 0
    assert pii.redacted("mail a@b.co now", [(5, 11, "email"), (7, 11, "card")]) == "mail [EMAIL] now"


def plain_bm25(items, passage):
    """Every item's score for a passage over its score for itself."""
    words = {i: decontaminate.words_of(t) for i, t in items}
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    n, mean = len(words), sum(map(len, words.values())) / len(words)

    def score(ws, query):
        tf = collections.Counter(ws)
        return sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in tf if w in query)

    return {i: score(ws, passage) / score(ws, set(ws)) for i, ws in words.items()}


def test_block_max_wand_equals_full_scoring():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(r.choice(vocabulary[: r.choice([20, 120])]) for _ in range(r.randint(3, 30)))) for i in range(150)]
    index = decontaminate.Index(items, collections.Counter(w for _, t in items for w in set(decontaminate.words_of(t))), len(items), float(np.mean([len(t.split()) for _, t in items])))
    for _ in range(120):
        passage = {r.choice(vocabulary).encode() for _ in range(r.randint(1, 60))}
        want = {i: s for i, s in plain_bm25(items, passage).items() if s >= decontaminate.THRESHOLD - 1e-9}
        got = dict(index.retrieve([index.vocabulary[w] for w in passage if w in index.vocabulary]))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        ids = np.array([index.vocabulary.get(w, -1) for w in passage])
        assert not want or 0 in index.windows(ids)


def test_leaks_are_found_and_clean_texts_are_not(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: decontaminate.words_of(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        text = b" ".join([b"", *decontaminate.words_of(r.text), b""])
        want |= {(r.doc_id, i) for i, ws in items.items() if b" ".join([b"", *ws, b""]) in text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert not kept & {d for d, _ in got} and len(kept) == docs.count() - len({d for d, _ in got})


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, "What is the tallest hill of the old town? It is the mill hill near the river."), (2, None), (3, "..."), (4, "sole")], "item_id long, text string")
    leaked = "filler " * 100 + "what is the TALLEST hill of the old town; it is the mill hill near the river" + " filler" * 100
    rows = [(1, leaked, "x"), (1, leaked, "x"), (2, "What is the tallest hill of the old town?", "x"), (3, None, "x"), (4, "", "x")]
    got = decontaminate.find_leaks(documents(spark, rows), bench).collect()
    assert [(r.doc_id, r.item_id, r.question, r.answer) for r in got] == [(1, 1, 1.0, 1.0)] * 2
    assert decontaminate.find_leaks(documents(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.find_leaks(documents(spark, []), bench).count() == 0


def test_blocks_of_items_give_the_same_leaks(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [r.text for r in docs.collect()]
    one, many = list(decontaminate.indexes(bench)), list(decontaminate.indexes(bench, most=1500))
    assert len(many) > 3
    for t in texts:
        found = [sorted(x["item_id"] for index in which for x in index.leaks(t)) for which in (one, many)]
        assert found[0] == found[1]


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.load(sp.MODEL)


def odd_texts():
    r = random.Random(11)
    for alphabet in ("abcdefgh ", "thein", "aé漢 \n", "aaaa ", "a b", "0123 .,x", "  a", "    !"):
        for _ in range(25):
            yield "".join(r.choice(alphabet) for _ in range(r.randint(1, 120)))


def cut_in_chunks(p, text, size):
    whole, n = sp.normalised(text), p.longest
    return [(whole[max(0, i - n) : i + size + n - 1], min(n, i), min(size, len(whole) - i)) for i in range(0, len(whole), size)]


def chunked(p, text, size):
    chunks = cut_in_chunks(p, text, size)
    matrices = [p.transfer(*c) for c in chunks]
    whole = functools.reduce(sp.combine, matrices)
    states = sp.edge_states(matrices, 0, sp.end_state(whole))
    return np.concatenate([p.trace(*c, a, b) for c, (a, b) in zip(chunks, states, strict=True)]).tolist()


def test_ids_equal_the_library_and_come_back(pieces, spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    for text in odd_texts():
        ids = pieces.encode(text).tolist()
        assert ids == library.encode(text)
        assert pieces.decode(ids) == text
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sp.op8_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_parts_merge_in_arrays_as_one_by_one(pieces):
    r = random.Random(3)
    parts = list({"".join(r.choice(a) for _ in range(r.randint(1, 45))) for a in ("▁the nrsaio", "abé", "aaab", "漢\n1", "▁") for _ in range(300)})
    for part, ids in zip(parts, pieces.solved(parts), strict=True):
        assert ids == np.array(pieces.best_of(part), dtype=np.int32).tobytes()
        assert "".join(pieces.merged(part)) == part
    assert pieces.solved([]) == [] and all(pieces.returned(parts, pieces.solved(parts)))
    assert pieces.returned(["▁a", "b"], [pieces.solved(["▁a"])[0], b""]) == [True, False]


def test_memory_keeps_two_generations():
    asked = []
    memory = sp.Memory(lambda parts: asked.extend(parts) or [p.encode() for p in parts], lambda parts, ids: [p != "odd" for p in parts], most=2)
    for parts in (["a", "b", "odd"], ["c", "a"], ["d" * 50], ["a"]):
        known = memory.recall([parts])
        assert [known[p] for p in parts] == [p.encode() for p in parts]
    assert sorted(asked) == ["a", "b", "c", "d" * 50, "odd"]


def test_scan_in_a_tree_of_small_groups(spark, pieces):
    unigram = sp.Pieces([(p, -float(len(p) % 7 + 1), "normal") for p in pieces.score])
    rows = [(str(i), t) for i, t in enumerate(odd_texts()) if len(t) > 60]
    texts = spark.createDataFrame(rows, "key string, text string")
    for p in (pieces, unigram):
        got = {r.key: r.ids for r in sp.scan_encode(texts, p, chunk=17, fan=3000).collect()}
        assert got == {k: p.encode(t).tolist() for k, t in rows}
    matrices = spark.createDataFrame([("k", c, bytearray(sp.packed(pieces.transfer(*x)))) for c, x in enumerate(cut_in_chunks(pieces, "the thin hinterland, " * 20, 16))], "key string, c int, cells binary")
    two, five = ([tuple(r) for r in sp.scan(matrices, steps, fan).orderBy("c").collect()] for steps, fan in ((1, 64), (4, 3)))
    assert two == five


def test_a_name_in_use_is_an_error(spark, pieces):
    with pytest.raises(ValueError):
        sp.encode_documents(documents(spark, []).withColumnRenamed("extra", "IDS"), pieces)
    clash = documents(spark, [(1, "of a text " * 30, "x"), (2, "b", "y")]).withColumnRenamed("extra", "_key").withColumn("key", F.lit(1)).withColumn("decoded", F.lit(2))
    got = sp.encode_documents(clash, pieces, chunk=50, round_trip="back")
    assert got.columns == [*clash.columns, "ids", "back"]
    assert sorted((r._key, r.key, r.decoded, r.back) for r in got.collect()) == [("x", 1, 2, True), ("y", 1, 2, True)]


def test_chunks_equal_the_whole_for_both_kinds(pieces):
    unigram = sp.Pieces([(p, -float(hash(p) % 997) / 7, "normal") for p in pieces.score])
    for text in odd_texts():
        for p in (pieces, unigram):
            whole = p.encode(text).tolist()
            assert all(chunked(p, text, size) == whole for size in (16, 20, 33))


def test_unigram_equals_the_library(pieces, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(sp.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    r = random.Random(2)
    for p in model.pieces:
        if p.type == 1:
            p.score = -r.randint(1, 4000) / 128
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    mine, library = sp.Pieces.load(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert type(mine) is sp.Pieces
    for _ in range(200):
        text = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(12))
        assert mine.encode(text).tolist() == library.encode(text)


def test_matrices_combine_associatively(pieces):
    text = sp.normalised("the thin hinterland " * 8)
    n = pieces.longest
    m = [pieces.transfer(text[max(0, i - n) : i + 20 + n - 1], min(n, i), min(20, len(text) - i)) for i in range(0, 80, 20)]
    left = sp.combine(sp.combine(m[0], m[1]), m[2])
    right = sp.combine(m[0], sp.combine(m[1], m[2]))
    assert {k: v[0] for k, v in left.items()} == {k: v[0] for k, v in right.items()}


def test_documents_of_all_sizes(spark, pieces):
    long = "The long text goes on and on, without an end. " * 120 + "x" * 3000 + " done"
    rows = [(1, None, "x"), (2, "", "x"), (3, "short one", "x"), (4, long, "x"), (4, long, "x"), (None, long[::-1], "x")]
    got = sp.encode_documents(documents(spark, rows), pieces, chunk=500, round_trip="round_trip")
    assert got.columns == ["doc_id", "text", "extra", "ids", "round_trip"]
    for r in got.collect():
        assert r.ids == pieces.encode(r.text).tolist()
        assert pieces.decode(r.ids) == (r.text or "") and r.round_trip
    assert got.count() == 6
    back = sp.decoded(got, pieces)
    assert sorted(r.decoded for r in back.collect()) == sorted(r[1] or "" for r in rows)
    assert sp.encode_documents(documents(spark, []), pieces).count() == 0


def test_evidence_reaches_every_repeat():
    """A number recognised once pulls its fiftieth repeat as it does the first."""
    k = len(pii.LABELS)
    field = pii.Field({}, np.zeros((0, k)), np.zeros((k, k)), 3 * np.eye(k))
    tokens, chain, skip = pii.graph([" and ".join(["4111111111111111", *["x4111111111111111x"] * 50])])
    tokens = [(*t[:4], pii.LABELS.index("card") if not i else 0) for i, t in enumerate(tokens)]
    field.logits = lambda tokens: np.array([[20.0 * (t[4] == label) * (label > 0) for label in range(k)] for t in tokens])
    p = field.beliefs(tokens, chain, skip)[:, pii.LABELS.index("card")]
    assert len(p) == 51 and p[1:].min() > 0.9 and np.ptp(p[1:]) < 1e-3


def test_messages_run_down_a_long_chain():
    k, n = len(pii.LABELS), 60
    field = pii.Field({}, np.zeros((0, k)), 6 * np.eye(k), np.eye(k))
    own = np.zeros((n, k))
    own[0, 2] = 20
    field.logits = lambda tokens: own
    p = field.marginals([None] * n, np.array([(i, i + 1) for i in range(n - 1)]), np.zeros((0, 2), dtype=np.int64))
    assert p[30, 2] > 0.6


def test_short_answers_leak_with_their_question(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France? Paris"), (2, "Name it?\nThe old mill hill near the river"), (3, "Which town has the tallest hill? Upper Mill")], "item_id long, text string")
    rows = [
        (1, "We ask: what is the capital of France? The answer is Paris.", "x"),
        (2, "What is the capital of France? Nobody says.", "x"),
        (3, "They name it often, and it is the old mill hill near the river", "x"),
        (4, "Which town has the tallest hill? (a) Upper Mill", "x"),
        (5, "Which town has the tallest hill? Mill and Upper", "x"),
    ]
    got = decontaminate.find_leaks(documents(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.question, r.answer) for r in got) == [(1, 1, 1.0, 1.0), (3, 2, 1.0, 1.0), (4, 3, 1.0, 1.0)]
    assert {r.doc_id for r in decontaminate.without_leaks(documents(spark, rows), bench).collect()} == {2, 5}


def test_numbers_with_spaces_share_a_hub_with_their_repeats(spark):
    """Spaced phones and cards are one token, tied to later forms that the patterns do not take."""
    text = "call +1 555 123 4567 now, or 555 123 4567. pay 4111 1111 1111 1111 today; 12 4111 1111 1111 1111 53538 and 999 123 4567"
    tokens, _, skip = pii.graph([text])
    hub = dict(skip.tolist())
    words = {text[a:b]: hub.get(i) for i, (_, a, b, _, _) in enumerate(tokens)}
    assert words["+1 555 123 4567"] == words["555 123 4567."] is not None
    at = [hub.get(i) for i, (_, a, b, _, _) in enumerate(tokens) if text[a:b] == "4111 1111 1111 1111"]
    assert len(at) == 2 and at[0] == at[1] is not None
    assert "999" in words and "12" in words and "53538" in words
    k = len(pii.LABELS)
    field = pii.Field({}, np.zeros((0, k)), np.zeros((k, k)), 4 * np.eye(k))
    field.logits = lambda tokens: np.array([[20.0 * (t[4] == label) * (label > 0) for label in range(k)] for t in tokens])
    (added,) = pii.added_spans([text], field)
    assert [(text[a:b], kind) for a, b, kind in added] == [("555 123 4567", "phone"), ("4111 1111 1111 1111", "card")]


def test_base_spans_of_numbers_of_any_length():
    for digits, fits in (("0" * 5000, True), ("0" * 5000 + "1", True), ("9" * 5000, False), ("256", False), ("00255", True)):
        text = f"x {digits}.0.0.1 y"
        assert pii.base_spans(text) == ([(2, 2 + len(digits) + 6, "ip")] if fits else [])
        assert len(pii.graph([text])[0]) == 1
    assert pii.base_spans("1" * 6000) == [] and pii.graph(["+" + "1" * 6000 + " " + "2" * 6000 + "@"])[0]


def test_field_is_the_same_however_rows_are_dealt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(20))
    one, two = (pii.train_field(d, most_tokens=150) for d in (docs.coalesce(1), docs.repartition(7, F.rand(3))))
    assert one.names == two.names and all(np.array_equal(getattr(one, w), getattr(two, w)) for w in ("node", "chain", "skip"))


def test_messages_are_exact_on_trees():
    """Marginals of chains with a hub equal those of all labellings, counted one by one."""
    import itertools

    g = np.random.default_rng(4)
    k, n = len(pii.LABELS), 5
    field = pii.Field({}, np.zeros((0, k)), g.normal(size=(k, k)), g.normal(size=(k, k)))
    own, hub = g.normal(size=(n, k)), g.normal(size=(1, k))
    field.logits = lambda tokens: own
    chain, skip = np.array([(0, 1), (2, 3)]), np.array([(1, 5), (2, 5), (4, 5)])
    got = field.marginals([None] * n, chain, skip, hub)
    want = np.zeros((n + 1, k))
    every = np.concatenate([own, hub])
    for labels in itertools.product(range(k), repeat=n + 1):
        score = sum(every[i, x] for i, x in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
        for i, x in enumerate(labels):
            want[i, x] += np.exp(score)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_redaction_passes_names_in_use(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", 99, "x"), (2, None, 5, "y")], "doc_id long, text string, n_chars long, _found string")
    field = pii.train_field(docs)
    assert [tuple(r) for r in pii.without_personal_data(docs, field).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", 16, "x"), (2, None, None, "y")]
    assert pii.without_personal_data(docs.where("false"), field).count() == 0


def test_quality_passes_names_in_use(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good, "a", 1, 2), (2, "short", "b", 1, 2), (1, good, "c", 1, 2), (None, None, "d", 1, 2)], "doc_id long, text string, _stats string, _failed int, _kept int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in quality.only_good(docs, labels).collect()) == [(1, good, "a", 1, 2), (1, good, "c", 1, 2)]


def test_leaks_pass_names_in_use(spark):
    item = "the quick brown fox jumps over the lazy dog near the old mill"
    docs = spark.createDataFrame([(1, f"so {item} end", "x", 1), (2, "nothing here", "y", 2), (3, None, "z", 3)], "doc_id long, text string, _leaks string, leaks int")
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()] == [1]
    assert sorted(tuple(r) for r in decontaminate.without_leaks(docs, bench).collect()) == [(2, "nothing here", "y", 2), (3, None, "z", 3)]


def test_leaks_equal_full_scores_of_all_windows(spark, sf_dir):
    """Every window of every text against every item, by the formula and without an index."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, decontaminate.words_of(r.text), r.text) for r in bench.collect()]
    assert len(list(decontaminate.indexes(bench))) == 1
    df = collections.Counter(w for _, ws, _ in items for w in set(ws))
    mean, span = sum(len(ws) for _, ws, _ in items) / len(items), max(64, *(len(ws) for _, ws, _ in items))
    impact = collections.defaultdict(list)
    for i, ws, _ in items:
        scores = {w: np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, tf in collections.Counter(ws).items()}
        for w, x in scores.items():
            impact[w].append((i, x / sum(scores.values())))
    words = {i: (ws, decontaminate.question_words(t, len(ws))) for i, ws, t in items}

    def covered(part, run_from, passage):
        hit, runs = [False] * len(part), {tuple(passage[k : k + run_from]) for k in range(len(passage) - run_from + 1)}
        for k in range(len(part) - run_from + 1):
            if tuple(part[k : k + run_from]) in runs:
                hit[k : k + run_from] = [True] * run_from
        return hit

    want = set()
    for r in docs.collect():
        text = decontaminate.words_of(r.text)
        for at in range(0, len(text), span):
            passage, score = text[at : at + 2 * span], collections.Counter()
            for w in set(passage):
                for i, x in impact.get(w, ()):
                    score[i] += x
            for i, x in score.items():
                if x >= 0.6 - 1e-9:
                    ws, q = words[i]
                    hit = np.array(covered(ws, min(5, len(ws)), passage))
                    hit[:q] |= np.array(covered(ws[:q], min(5, q), passage), dtype=bool)
                    if q < len(ws):
                        hit[q:] |= np.array(covered(ws[q:], min(5, len(ws) - q), passage), dtype=bool)
                    if hit[:q].mean() >= 0.6 and (q == len(ws) or hit[q:].mean() >= 0.6):
                        want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9_decontamination(spark, sf_dir).collect()}
    assert got == want and len(want) >= 3
