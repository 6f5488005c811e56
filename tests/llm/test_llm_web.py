"""HTML extraction, URL filtering, sharding, chat formatting and the pipeline."""

import collections
import html
import re
import zlib

import pytest
from pyspark.sql import functions as F

from adapterlens.llm import chat, sharding, url_filter
from adapterlens.llm import html_extract as he


@pytest.fixture(scope="module")
def trees(spark):
    return he.fit_trees(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article(source):
    inner = re.search(r"(?s)<article>(.*?)</article>", source)[1]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_every_article_is_extracted(spark, sf_dir, trees):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    rows = he.extract_pages(pages, trees).collect()
    assert len(rows) == len(sources)
    for r in rows:
        assert r.text == article(sources[r.page_id]) and r.n_chars == len(r.text)


def test_held_out_layouts(spark, sf_dir, trees):
    found = wanted = shared = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).collect():
        for source in he.training_pages(r.html, 10_000 + r.page_id)[1:]:
            page = he.Page(source)
            got = collections.Counter(he.extract([source], trees)[0].split())
            x, parent, depth = he.node_table([page])
            truth = page.text(_marked(page, parent, depth)).split()
            want = collections.Counter(truth)
            found, wanted, shared = found + got.total(), wanted + want.total(), shared + (got & want).total()
    assert shared / found > 0.97 and shared / wanted > 0.95


def _marked(page, parent, depth):
    import numpy as np

    side = np.isin([he.GROUP.get(t, -1) for t in page.tags], he.SIDE_GROUPS) | np.array([he._attribute_tokens(a)[1] > 0 for a in page.attrs])
    keep = np.array(page.keep)
    for i in np.argsort(depth, kind="stable").tolist():
        keep[i] = keep[i] or (parent[i] >= 0 and keep[parent[i]] and not side[i])
    return keep


def test_decoding_is_never_contradictory_and_best():
    import itertools

    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(60):
        n = 9
        parent = np.array([-1, *(r.integers(0, i) for i in range(1, n))])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds = r.normal(0, 2, n)
        kept = he.decode(odds, parent, depth)
        best = max(sum(odds[i] for i in range(1, n) if ys[i]) for ys in itertools.product([0, 1], repeat=n) if ys[0] and all(not ys[i] or ys[parent[i]] for i in range(1, n)))
        assert kept[0] and all(not kept[i] or kept[parent[i]] for i in range(1, n))
        assert abs(sum(odds[1:][kept[1:]]) - best) < 1e-9


HOSTILE = ["<a " * 40_000, "<div>" * 9_000 + "</p>" * 9_000, '<b ">" ' * 20_000, "<b '> " * 20_000, "<li><ul>" + "<b>" * 8_000 + "<li></li>" * 8_000, "<svg>" * 20_000, "<textarea>" * 20_000, "<![CDATA[" * 20_000 + ">", "<!" * 50_000, "<!-- x" * 20_000, "<" * 100_000, "<link " * 30_000, "<meta rel=canonical " * 10_000]


def test_malformed_pages_take_linear_time(spark, trees):
    import time

    began = time.time()
    for source in HOSTILE:
        he.extract([source], trees)
        he.training_pages(source[:20_000], 1)
    assert time.time() - began < 60
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", x) for i, x in enumerate(HOSTILE)], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages).count() == len(HOSTILE) and time.time() - began < 120


def test_nothing_of_an_article_is_lost(trees):
    body = " ".join(f"<p>Paragraph {i} of the article, which has some words, and ends here.</p>" for i in range(12))
    inside = "<p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <noscript>plain form</noscript> of <object>an object</object> with <svg><text>a label</text></svg> in a long line of text, and more.</p>"
    page = f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title of it</h1>{body}{inside}<script>x < 1</script></article><footer>&copy; 2020 Me</footer></body></html>"
    (text,) = he.extract([page], trees)
    assert text.startswith("Title of it Paragraph 0 of") and text.endswith("Then x=2 and plain form of an object with a label in a long line of text, and more.")


def test_page_structure_survives_stray_and_open_tags():
    page = he.Page("<p>One<p>two <b>x</b></i><div class='a>b'>y</div>a < b &amp; c<!-- c --><ul><li>1<ul><li>in</ul><li>2</ul></b>end")
    assert [(page.tags[n], t) for n, _, t in page.texts] == [("p", "One"), ("p", "two "), ("b", "x"), ("div", "y"), ("#text", "a < b & c"), ("#text", "1"), ("li", "in"), ("li", "2"), ("#text", "end")]
    assert [page.depth[n] for n, _, _ in page.texts] == [1, 1, 2, 1, 1, 3, 4, 2, 1]


def test_html_edges(spark, trees):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "only plain text", "x"), (4, "u", "<p>a &lt;b&gt; &amp;\n c</p>", "x"), (4, "u", "<p>a &lt;b&gt; &amp;\n c</p>", "x"), (5, "u", "<script>var t='</p>'", "x"), (6, "u", "<div>" * 3000 + "deep", "x"), (7, "u", "<p a='<'>x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in he.extract_pages(pages, trees).collect())
    assert [g for g in got if g[0] < 6] == [(1, ""), (2, ""), (3, "only plain text"), (4, "a <b> & c"), (4, "a <b> & c"), (5, "")]
    assert he.extract_pages(pages.where("false")).count() == 0


def test_url_classes_spread_blocks_and_allow_wins(spark):
    canonical = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    rows = [
        (1, "http://bad.com/en/1", None, "x"),
        (2, "http://alias.info/x", canonical("http://bad.com/en/1"), "x"),
        (3, "http://alias2.info/y", '<meta http-equiv="refresh" content="0; url=http://alias.info/x">', "x"),
        (4, "https://example.com/en/7", canonical("http://bad.com/en/1?z"), "x"),
        (5, "http://third.info/", canonical("//EXAMPLE.com/en/71"), "x"),
        (6, "http://third.info/q", canonical("/"), "x"),
        (7, None, None, "x"),
        (8, "no scheme", "<p>", "x"),
        (8, "no scheme", "<p>", "x"),
        (9, "http://Sub.EXAMPLE.net/de/8?p#f", None, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    want = {1: ("com/en/", "block", "rule"), 2: (None, "block", "class"), 3: (None, "block", "class"), 4: ("example.com/en/7", "allow", "rule"), 5: (None, "allow", "class"), 6: (None, "allow", "class"), 7: (None, "allow", "default"), 8: (None, "allow", "default"), 9: ("example.net/de/8", "block", "rule")}
    inline = url_filter.judge_urls(pages)
    got = {r.page_id: (r.rule, r.verdict, r.decided_by) for r in inline.collect()}
    assert got == want and inline.count() == len(rows)
    joined = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"))
    assert {r.page_id: (r.rule, r.verdict, r.decided_by) for r in joined.collect()} == want
    more = spark.createDataFrame([("http://no.scheme/a", "http://bad.com/en/1"), ("http://q.info/", None)], "src string, dst string")
    assert url_filter.judge_urls(pages, redirects=more).count() == len(rows)
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_allow_wins_over_block_in_a_class(spark):
    pages = spark.createDataFrame([(1, "http://a.info/", None)], "page_id long, url string, html string")
    edges = [("http://a.info/", "http://bad.com/en/1"), ("http://a.info/", "http://ok.net/de/1")]
    (row,) = url_filter.judge_urls(pages, redirects=spark.createDataFrame(edges, "src string, dst string")).collect()
    assert (row.verdict, row.decided_by) == ("allow", "class")


@pytest.mark.parametrize("turned", [False, True])
def test_equal_rules_with_both_verdicts_allow_in_every_form(spark, turned):
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("block", "com", "")]
    rules = rules[::-1] if turned else rules
    urls = ["http://a.com/x", "http://b.a.com/x/z", "http://a.com/x/y/z", "http://c.com", "http://a.com/" + "long/" * 3000, "http://d.org/x", None]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    stored = spark.createDataFrame(rules, "verdict string, host string, path string").repartition(3)
    inline, joined = (sorted(map(tuple, url_filter.judge_urls(pages, r).collect())) for r in (rules, stored))
    assert inline == joined
    assert [r[4] for r in inline] == ["allow", "allow", "block", "block", "block", "allow", "allow"]


def test_a_class_of_many_members_is_joined_whole(spark):
    edges = spark.range(3000).select(F.concat(F.lit("http://m.org/"), F.col("id")).alias("src"), F.lit("http://hub.org/es/").alias("dst"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://m.org/"), F.col("id")).alias("url"), F.lit(None).cast("string").alias("html"))
    rows = url_filter.judge_urls(pages, redirects=edges).groupBy("verdict", "decided_by").count().collect()
    assert [tuple(r) for r in rows] == [("block", "class", 3000)]


def test_components_of_paths_stars_and_rings(spark):
    from adapterlens.llm.common import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {200 + i: 200 for i in range(1, 9)}
    assert got == want


def test_shards_are_balanced_and_gapless(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard_documents(docs, shards=4).collect()
    places = collections.defaultdict(list)
    sizes = collections.Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert len(rows) == len(texts)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)


def test_slot_maps_are_versioned_and_growth_moves_into_the_new_shard(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    records = sharding.sized(docs, slots=64)
    stats, path = sharding.slot_bytes(records), str(tmp_path / "map")
    sharding.store_map(sharding.first_map(spark, 3, 64), path)
    balanced = sharding.rebalanced_map(sharding.read_map(spark, path), stats, 3)
    sharding.store_map(balanced, path)
    sharding.store_map(sharding.grown_map(sharding.read_map(spark, path), stats, 3), path)
    maps = collections.defaultdict(dict)
    for r in spark.read.parquet(path).collect():
        maps[r.version][r.vslot] = r.shard
    assert sorted(maps) == [1, 2, 3] and all(len(m) == 64 for m in maps.values())
    load = lambda m: sorted(sum(r.bytes for r in stats.collect() if m[r.vslot] == s) for s in range(3))
    assert load(maps[2])[2] - load(maps[2])[0] < load(maps[1])[2] - load(maps[1])[0]
    kept = sum(maps[1][v] == maps[2][v] for v in maps[1])
    assert 64 > kept >= 32
    moved = {v for v in maps[2] if maps[2][v] != maps[3][v]}
    assert moved and all(maps[3][v] == 3 for v in moved)
    edited = sharding.edited_map(sharding.read_map(spark, path), spark.createDataFrame([(5, 9)], "vslot int, shard int"))
    assert {r.version for r in edited.collect()} == {4} and {r.vslot for r in edited.collect() if r.shard == 9} == {5}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sharding.store_map(balanced, path)
    assert sharding.shard_documents(docs, 4, 64, path).where("map_version = 3").count() == docs.count()


def test_later_records_follow_a_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    first, later = (spark.createDataFrame([(i, f"text {i}") for i in range(a, a + 100)], "doc_id long, text string") for a in (0, 100))
    sharding.store_map(sharding.first_map(spark, 16), path)
    sharding.store_map(sharding.rebalanced_map(sharding.read_map(spark, path), sharding.slot_bytes(sharding.sized(first)), 16), path)
    got = sharding.shard_documents(later, path=path).collect()
    assert sorted(r.doc_id for r in got) == list(range(100, 200)) and {r.map_version for r in got} == {2}
    part = spark.read.parquet(path).where("vslot < 7")
    with pytest.raises(Exception, match="lacks slot"):
        sharding.assign(sharding.sized(later), sharding.newest(part)).collect()


def test_shard_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "x"), (2, "é", "x")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == [("1", 1, 0), ("1", 1, 0), ("2", 3, zlib.crc32("é".encode())), ("None", 1, 0)]
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_rotation(turns):
    by = collections.defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t, role or "unknown", text or ""))
    for c, said in by.items():
        said.sort()
        for me in {s[2] for s in said}:
            out, masks = "", []
            for _, _, role, text in said:
                out += "<|assistant|>\n" if role == me else f"<|user name={role}|>\n"
                start = len(out)
                out += f"{text}<|end|>"
                if role == me:
                    masks.append(f"{start}:{len(out)}")
                out += "\n"
            yield (c, me), (out, ",".join(masks))


@pytest.mark.parametrize("turns_a_row", [2, 256])
def test_rotation_matches_plain(spark, sf_dir, turns_a_row):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.collect()] + [(None, 1, "ana", "hi"), (None, 2, None, None), (7000, None, "bo", "x"), (7000, 3, "bo", "é"), (7000, 3, "bo", "é")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chunk", "2 as masks")
    got = collections.defaultdict(list)
    for r in chat.rotate(docs, turns_a_row).collect():
        got[r.conv_id, r.perspective].append((r.chunk, r.start, r.text, r.masks))
    want = dict(plain_rotation(rows))
    assert got.keys() == want.keys()
    for key, parts in got.items():
        parts.sort()
        assert "".join(p[2] for p in parts) == want[key][0]
        assert ",".join(p[3] for p in parts if p[3]) == want[key][1]
        assert all(p[1] == sum(len(q[2]) for q in parts[:i]) for i, p in enumerate(parts))
    assert chat.rotate(docs.where("false")).count() == 0


def test_pipeline_keeps_clean_documents_and_applies_decisions(spark, sf_dir):
    import corpus_pipeline
    from adapterlens.llm import decontaminate, pii, quality
    from adapterlens.llm.sentencepiece_scan import MODEL, Pieces

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge_quality(docs, labels).where("kept").collect()}
    sets = {}
    for i in kept:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), rows[i] or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in kept}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sorted(kept):
        for b in sorted(kept):
            both = len(sets[a] & sets[b]) if a < b else 0
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    firsts = {i for i in kept if parent[i] == i}
    (index,) = decontaminate.indexes(bench)
    clean = {i for i in firsts if not index.leaks(rows[i])}
    pieces = Pieces.load(MODEL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == clean
    for i in clean:
        spans = pii.base_spans(rows[i])
        text = pieces.decode(got[i].ids)
        assert got[i].n_tokens == len(got[i].ids)
        assert (text == rows[i]) if not pii.CANDIDATE.search(rows[i]) else not [s for s in pii.base_spans(text) if s[2] in {"email", "ip"}] or not spans
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
