"""SimHash near-dedup and substring dedup against brute force, and their edge cases."""

import random
import re

import pytest
import xxhash

from adapterlens.llm import simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string")


def test_near_duplicates_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (format(prints[i], "016x"), want[i]) for i in texts}


def test_near_duplicate_edges(spark):
    rows = [(5, None, "a"), (4, "", "a"), (3, "   \t", "a"), (9, "Two words", "b"), (8, "two WORDS", "b"), (None, "two words", "b"), (8, "two WORDS", "b"), (1, "x " * 40_000, "c")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3), (4, 3), (3, 3), (9, 8), (8, 8), (8, 8), (None, 8), (1, 1)], key=str)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_tree_finds_all_components(radius):
    r = random.Random(radius)
    for _ in range(20):
        seeds = [r.getrandbits(64) for _ in range(4)]
        values = list({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for s in seeds for _ in range(25)})
        roots = simhash.linked(values, radius)
        want = components(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= radius)
        assert len(set(zip(roots, want.values(), strict=True))) == len(set(roots)) == len(set(want.values()))


def test_split_shards_lose_no_link(spark):
    r = random.Random(7)
    near = [s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in (r.getrandbits(64) for _ in range(3)) for _ in range(60)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in near})
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    want = components(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    for tree in (8, 4096):
        links = [(x.a, x.b) for x in simhash.fingerprint_links(prints, tree=tree).collect()]
        pairs = {frozenset(x) for x in links}
        got = components(values, lambda a, b, pairs=pairs: frozenset((a, b)) in pairs)
        assert got == want


def test_long_text_in_segments(monkeypatch):
    from adapterlens.llm import common

    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_segments", lambda t: common.word_segments(t, size=64))
    assert simhash.fingerprint(text) == whole


def test_keep_one_leaves_one_row_of_each_class(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(3, text, "a"), (1, text, "b"), (2, text.replace("word150", "other"), "c"), (7, "quite different words here", "d"), (7, "quite different words here", "d"), (None, "alone without id", "e"), (None, text, "f")]
    kept = simhash.keep_one(documents(spark, rows), radius=6, blocks=8)
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(((r.doc_id, r.extra) for r in kept.collect()), key=str) == sorted([(1, "b"), (7, "d"), (None, "e")], key=str)


def plain_runs(rows, least):
    """Units by a character loop: a sentence ends with the blanks after its mark, a line with its end."""
    docs = sorted({(d, t) for d, t in rows if t}, key=lambda x: (x[0] is None, x[0]))
    seen, out = {}, []
    for d, t in docs:
        places, start, at = [], 0, 0
        while at < len(t):
            if t[at] == "\n":
                places.append((start, at))
                start = at = at + 1
                continue
            if t[at] in ".!?":
                end = at
                while end < len(t) and t[end] in ".!?":
                    end += 1
                while end < len(t) and t[end] in "\"')]":
                    end += 1
                blank = end
                while blank < len(t) and t[blank] in " \t":
                    blank += 1
                if blank > end:
                    places.append((start, blank))
                    start = at = blank
                    continue
            at += 1
        places.append((start, len(t)))
        run = []
        for a, b in [*places, (None, None)]:
            key = tuple(t[a:b].lower().split()) if a is not None else ()
            if a is not None and not key:
                continue
            if key in seen:
                run.append((a, b, len(key), seen[key]))
                continue
            if run and sum(x[2] for x in run) >= least:
                out.append((d, run[0][0], run[-1][1], sorted({x[3] for x in run})))
            run = []
            if key:
                seen[key] = d
    return out


@pytest.mark.parametrize("least", [1, substring_dedup.QUERY_WORDS])
def test_runs_match_brute_force(spark, sf_dir, least):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_runs([(r.doc_id, r.text) for r in docs.collect()], least)
    got = [(r.doc_id, r.start, r.stop, r.kept_in) for r in substring_dedup.repeated_runs(docs, least).collect()]
    assert len(want) > 10
    assert sorted(got) == sorted(want)


def test_passage_inside_lines_goes_and_the_rest_stays(spark):
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(30)) + "."
    rows = [(2, f"Own words here. {passage} More of mine.", "x"), (1, f"{passage}\nFirst", "x"), (3, "Short line.\nShort line.\nlast", "x"), (4, None, "x"), (5, "", "x"), (3, "Short line.\nShort line.\nlast", "y")]
    docs = documents(spark, rows)
    kept = sorted((r.doc_id, r.extra, r.text) for r in substring_dedup.without_repeats(docs, 25).collect())
    assert [k for k in kept if k[0] != 4] == sorted((d, e, "Own words here. More of mine." if d == 2 else t) for d, t, e in rows if d != 4)
    every = {(r.doc_id, r.extra): (r.text, r.removed) for r in substring_dedup.without_repeats(docs).collect()}
    assert every[3, "x"][0] == every[3, "y"][0] == "Short line.\n\nlast" and every[4, "x"] == (None, None)
    (run,) = substring_dedup.repeated_runs(docs, 25).collect()
    assert rows[0][1][run.start : run.stop].strip() == passage and run.kept_in == [1]
    assert substring_dedup.repeated_runs(documents(spark, [])).count() == 0
    taken = spark.createDataFrame([(1, "one two. three\none two. ", "a", 1)], "doc_id long, text string, text_hash string, _runs int")
    assert [tuple(r)[:4] for r in substring_dedup.without_repeats(taken, removed="gone").collect()] == [(1, "one two. three\n", "a", 1)]
    with pytest.raises(ValueError):
        substring_dedup.without_repeats(taken, removed="TEXT_hash")


def test_exact_classes_match_brute_force(spark, sf_dir, monkeypatch):
    """Edited copies beyond 6 bits go, and texts within 6 bits that are not 0.8 alike stay."""
    r = random.Random(5)
    rows = [(x.doc_id, x.text, "x") for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for k in range(25):
        words = [f"{r.choice('abcdef')}{r.randint(0, 400)}" for _ in range(150)]
        for c, edits in enumerate((0, 1, 2, 3, 4)):
            new = words[:]
            for at in r.sample(range(len(new)), edits):
                new[at] = f"edit{at}"
            rows.append((10_000 + 10 * k + c, " ".join(new), "x"))
    block = " ".join(f"b{i}" for i in range(12))
    rows += [(20_000, " ".join([block] * 20 + [f"left{i}" for i in range(12)]), "x"), (20_001, " ".join([block] * 20 + [f"right{i}" for i in range(12)]), "x")]
    sets = {}
    for i, t, _ in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    far = sum(alike(a, b) and (prints[a] ^ prints[b]).bit_count() > 6 for a in sets for b in sets if a < b)
    assert far > 10 and (prints[20_000] ^ prints[20_001]).bit_count() <= 6 and not alike(20_000, 20_001)
    want = set(components(sorted(sets), alike).values())
    for firsts, sets in ((simhash.FIRSTS, simhash.BLOCK_SETS), (1, 3)):
        monkeypatch.setattr(simhash, "FIRSTS", firsts)
        monkeypatch.setattr(simhash, "BLOCK_SETS", sets)
        kept = {x.doc_id for x in simhash.keep_one(documents(spark, rows), radius=6, blocks=8, exact=True).collect()}
        assert kept == want


def test_alike_pairs_match_plain_counts(monkeypatch):
    import numpy as np

    r = random.Random(8)
    base = [r.getrandbits(60) for _ in range(40)]
    sets = [np.array(sorted({r.getrandbits(60) if r.random() < 0.12 else b for b in base}), dtype=np.int64) for _ in range(30)] + [np.zeros(0, np.int64)] * 2
    roots, side = np.array([k % 11 for k in range(32)]), np.array([k % 2 for k in range(32)])
    for cells in (simhash.CELLS, 64):
        monkeypatch.setattr(simhash, "CELLS", cells)
        for cross in (False, True):
            both = lambda i, j: len(set(sets[i].tolist()) & set(sets[j].tolist()))
            want = [(i, j) for i in range(32) for j in range(i + 1, 32) if 5 * both(i, j) >= 4 * (len(sets[i]) + len(sets[j]) - both(i, j)) and roots[i] != roots[j] and (not cross or side[i] != side[j])]
            assert len(want) > 3 and [tuple(x) for x in simhash.alike_pairs(sets, roots, side, cross).tolist()] == want


def test_every_two_members_of_different_roots_meet_in_a_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SETS", 4)
    rows = [(1, k, 9, 7 if k < 20 else k) for k in range(33)] + [(2, k, 9, 7) for k in range(9)]
    placed = simhash.blocks_of(spark.createDataFrame(rows, "bucket long, node long, n int, root long")).collect()
    met = set()
    for x in placed:
        for y in placed:
            same = (x.bucket, x.cross, x.lo, x.hi) == (y.bucket, y.cross, y.lo, y.hi)
            if same and x.node < y.node and x.root != y.root and (x.side != y.side or not x.cross and x.lo == x.hi):
                met.add((x.node, y.node))
    assert {x.bucket for x in placed} == {1}
    assert met == {(a, b) for a in range(33) for b in range(a + 1, 33) if b >= 20}


def test_shard_of_fifty_trees_is_dealt_again(spark):
    """Fingerprints that agree on most bits overflow a shard; no link is lost and no part copied over and over."""
    r = random.Random(9)
    tree, low = 8, [1 << b for b in range(64)]
    near = [sum(low[b] for b in r.sample(range(12), r.randint(0, 12))) | sum(low[b] for b in r.sample(range(40, 64), r.randint(0, 2))) for _ in range(500)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in near})
    assert len(values) > 50 * tree / 2
    want = components(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 1)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    shards, n = simhash.dealt(prints, 1, 3, tree)
    assert n == len(values) and len(shards) > 1
    links = {frozenset((x.a, x.b)) for x in simhash.fingerprint_links(prints, 1, 3, tree).collect()}
    assert components(values, lambda a, b: frozenset((a, b)) in links) == want


def test_names_in_use_pass(spark):
    taken = "doc_id long, text string, left_out string, _hash string, _id int, _gone int, least int"
    rows = [(1, "a b c d e f", "x", "y", 1, 2, 3), (2, "a b c d e f", "x", "y", 1, 2, 3)]
    docs = spark.createDataFrame(rows, taken)
    for exact in (False, True):
        assert [tuple(r) for r in simhash.keep_one(docs, exact=exact).collect()] == rows[:1]
        assert simhash.keep_one(docs.where("false"), exact=exact).count() == 0
    nothing = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, " ", "z")], "doc_id long, text string, extra string")
    assert [r.doc_id for r in simhash.keep_one(nothing, exact=True).collect()] == [1]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from adapterlens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(60)], "k long, v int")
    lookup = rows.groupBy("k").count().withColumnRenamed("count", "n")
    lookup = lookup.withColumn("w", lookup.k * 10)
    for bound in (common.BROADCAST_ROWS, 20):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = sorted((r.k, r.v, r.w) for r in common.join_counted(rows, lookup, "k", 60).collect())
        assert got == sorted((r.k, r.v, r.k * 10) for r in rows.collect())
