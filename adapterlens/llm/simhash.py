"""Near-duplicate detection by SimHash fingerprints and BK-trees.

Fingerprints that differ in few bits agree on some choice of bit blocks (pigeonhole), so every
choice deals the distinct fingerprints into shards. Each shard gets a BK-tree whose children are
keyed by their Hamming distance to the parent; a search follows only edges within the radius of
the distance at hand. Shards return one link per member, never pairs, and connected components
join the links of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.common import BROADCAST_ROWS, broadcast_if_small, connected_components, cut, fresh, gathered, join_counted, table, text_column, word_segments

SEED = 42
WORDS, RADIUS = 3, 3
#: Bit blocks. RADIUS blocks can differ, so shards agree on the others: 2 of 5 blocks, 25 bits or
#: more, 10 choices. Over 1e9 distinct fingerprints, 6 blocks give 20 choices of 31 bits or more.
BLOCKS = 5
#: Near duplicates proper: five-word shingle sets with a similarity of ALIKE[0] / ALIKE[1] or more.
EXACT_WORDS, ALIKE = 5, (4, 5)
#: Bands of least values that propose pairs beside the fingerprints, and values per band.
BANDS, BAND = 28, 5
MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 32, 1 << 63, BANDS * BAND, dtype=np.uint64) | np.uint64(1)
#: Earliest members of its buckets that a text is compared with before blocks are.
FIRSTS = 4
#: Sets and set values of a block's part, about, and cells of an incidence matrix.
BLOCK_SETS, BLOCK_VALUES, CELLS = 500, 250_000, 1 << 21
#: Members of a tree. Larger shards are dealt again by the bits that are left.
TREE = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a lower-cased (A-Z) text, as a signed integer.

    A bit is set if it is set in over half of the shingles' XXH64 values, repeats included. A text
    of fewer words has one shingle of all; no words give zero.
    """
    ones, n = np.zeros(64, dtype=np.int64), 0
    for values in shingle_values(text, words):
        for at in range(0, len(values), 1 << 16):
            part = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(values)
    value = int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def shingle_values(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 values of the word shingles of a lower-cased (A-Z) text, segment by segment.

    A text of fewer words has one shingle of all; no words give nothing.
    """
    n, tail = 0, []
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for segment in word_segments(text or ""):
        have = tail + [w.lower() for w in segment] if len(segment) < 8 else tail + join(segment).lower().split()
        if len(have) < words:
            tail = have
            continue
        shingles = map(join, zip(*(have[i:] for i in range(words)), strict=False))
        values = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        n += len(values)
        yield values
        tail = have[len(have) - words + 1 :]
    if not n and tail:
        yield np.array([digest(join(tail), SEED)], dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct values of the five-word shingles of a text, ascending."""
    parts = [np.unique(v) for v in shingle_values(text, EXACT_WORDS)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def sketch(text: str | None, words: int = WORDS) -> dict:
    """fp: the fingerprint; node: a digest of the shingle set; n: its size; buckets: a digest of
    each band of least values under seeded permutations (of values that are random already, a
    multiplication is one). Sets that are x alike share a bucket with
    probability 1 - (1 - x ** BAND) ** BANDS, which is 0.99998 at 0.8."""
    own = shingle_set(text)
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 512):
        part = own[at : at + 512]
        least = np.minimum(least, (part[None, :] * MULTIPLIERS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, BAND).astype("<u8")
    digest = lambda data, seed: int(np.uint64(xxhash.xxh3_64_intdigest(data, seed)).astype(np.int64))
    return {"fp": fingerprint(text, words), "node": digest(own.astype("<u8").tobytes(), SEED), "n": len(own), "buckets": [digest(r.tobytes(), k) for k, r in enumerate(rows)]}


def masks(radius: int, blocks: int, agreed: int = 0) -> list[int]:
    """The bits that two fingerprints within `radius` share for some entry: all choices of blocks.

    agreed: bits that they are known to share; the others are parted into blocks, and each mask
    holds all of the agreed ones.
    """
    if not radius < blocks:
        raise ValueError("there must be more blocks than differing bits")
    open_ = [b for b in range(64) if not agreed >> b & 1]
    edges = [len(open_) * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in open_[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [agreed | sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def linked(values: list[int], radius: int) -> list[int]:
    """Union of a shard's members through a BK-tree: for each member the index of its component.

    The tree grows as it is searched: a member looks for earlier ones within the radius, following
    only children whose edge differs from the distance at hand by the radius at most, and is then
    hung below. A subtree known to lie in the member's own component is passed over, so dense
    groups cost about a look per member and not one per pair.
    """
    n = len(values)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    children: list[dict[int, int]] = [{} for _ in range(n)]
    whole = [True] * n  # the subtree is one component
    for i in range(1, n):
        x, stack = values[i], [0]
        while stack:
            j = stack.pop()
            if whole[j] and find(j) == find(i):
                continue
            d = (values[j] ^ x).bit_count()
            if d <= radius:
                parent[find(i)] = find(j)
            for edge, child in children[j].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        j = 0
        while True:
            if whole[j] and find(j) != find(i):
                whole[j] = False
            d = (values[j] ^ x).bit_count()
            child = children[j].get(d)
            if child is None:
                children[j][d] = i
                break
            j = child
    return [find(i) for i in range(n)]


def _shard_links(radius: int):
    """Batches sorted by shard -> links (a, b) of each member with the first one of its component."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(values: np.ndarray) -> list[tuple[int, int]]:
        unsigned = values.astype(np.uint64).tolist()
        signed, roots = values.tolist(), linked(unsigned, radius)
        return [(signed[i], signed[r]) for i, r in enumerate(roots) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("mask", "shard", "fp")])
            now = now if rest is None else np.concatenate([rest, now])
            edge = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1)) + 1
            cuts = [0, *edge.tolist()]
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    found += links(now[a:b, 2])
            rest = now[cuts[-1] :]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)
        if rest is not None and len(rest) > 1 and (found := links(rest[:, 2])):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(prints: DataFrame, radius: int, blocks: int, tree: int) -> tuple[list[DataFrame], int]:
    """Shards (mask, shard, fp) of prints(fp), distinct, in which every two fingerprints within
    `radius` meet; and how many prints there are.

    mask tells the bits that a shard's members agree on, shard those bits. A shard of over `tree`
    members is dealt again by blocks of the bits that are left, each time a fixed number of copies
    of a member, until it has `tree` members or so few bits are left that it cannot have more.
    """
    spark, done, total = prints.sparkSession, [], prints.count()
    choices = F.array(*[F.lit(_signed(m)) for m in masks(radius, blocks)])
    now = prints.select("fp", F.explode(choices).alias("mask")).withColumn("shard", F.col("fp").bitwiseAND(F.col("mask")))
    left = max(radius + 2, tree.bit_length() - 1)  # with so few open bits a shard is small or cannot be parted
    while True:
        sizes = now.where(64 - F.bit_count("mask") > left).groupBy("mask", "shard").agg(F.count("*").alias("n"))
        big = cut(gathered(sizes.where(F.col("n") > tree).select("mask", "shard"), total))
        found = [r["mask"] & (2**64 - 1) for r in big.select("mask").distinct().collect()]
        if not found:
            return [*done, now], total
        listed = broadcast_if_small(big, big.count())
        done.append(now.join(listed, ["mask", "shard"], "left_anti"))
        # Masks are choices of blocks of choices of blocks, whatever the prints: a short table.
        finer = [(_signed(m), _signed(x)) for m in found for x in masks(radius, min(blocks, 64 - m.bit_count()), m)]
        finer = broadcast_if_small(spark.createDataFrame(finer, "mask long, finer long"), len(finer))
        again = now.join(listed, ["mask", "shard"], "left_semi").join(finer, "mask")
        now = cut(again.select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("shard")).distinct())


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """Links a, b that join all fingerprints of prints(fp), distinct, into their components: a
    BK-tree per shard."""
    shards, total = dealt(prints, radius, blocks, tree)
    out = None
    for rows in shards:
        placed = rows.select("mask", "shard", "fp").repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp")
        found = placed.mapInArrow(_shard_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _classes(own: DataFrame, radius: int, blocks: int, tree: int) -> tuple[DataFrame, int]:
    """fp, n, least: how many rows of own(row, fp) have each fingerprint, and the least `row` over all
    fingerprints reachable from it; and the number of rows."""
    total = own.count()
    prints = cut(gathered(own.groupBy("fp").agg(F.min("row").alias("least"), F.count("*").alias("n")), total))
    roots = cut(connected_components(fingerprint_links(prints.select("fp"), radius, blocks, tree)))
    members = gathered(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), total).select(F.col("node").alias("fp"), "root")
    known = members.join(broadcast_if_small(prints.select("fp", "least"), total), "fp")
    of_root = cut(gathered(known.groupBy("root").agg(F.min("least").alias("shared"), F.count("*").alias("n")), total))
    shared = join_counted(members, of_root, ["root"], total).select("fp", "shared")
    classes = prints.join(broadcast_if_small(shared, total), "fp", "left").select("fp", "n", F.coalesce("shared", "least").alias("least"))
    return cut(gathered(classes, total)), total


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs(doc_id, text).

    fingerprint: 16 hex digits. component_id: the least doc_id among all rows reachable over
    fingerprints that differ in `radius` bits at most, the row itself included. A null or empty
    text has fingerprint zero and is linked like any other. A null doc_id is never least; a class
    of nothing else has a null component_id. Repeated rows are one class. Further columns are
    ignored. Empty in, empty out.
    """
    own = cut(docs.select("doc_id", text_column(lambda t: fingerprint(t, words), "bigint")("text").alias("fp")))
    classes, total = _classes(own.select(F.col("doc_id").alias("row"), "fp"), radius, blocks, tree)
    return join_counted(own, classes, ["fp"], total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def enough(both, one, other):
    """Whether sets of sizes `one` and `other` with `both` members in common are alike."""
    return both * ALIKE[1] >= (one + other - both) * ALIKE[0]


def alike_pairs(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, cross: bool) -> np.ndarray:
    """Pairs (i, j), i < j, of sets that are alike and have different roots; with `cross`, only pairs
    of different sides. Intersections are counted in a product of incidence matrices, some of the
    distinct values at a time."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(value)[value] > 1
    _, value = np.unique(value[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    wide = max(1, CELLS // len(sets))
    for at in range(0, int(value[-1]) + 1 if len(value) else 0, wide):
        low, high = np.searchsorted(value, [at, at + wide])
        x = np.zeros((len(sets), wide), dtype=np.float32)
        x[row[low:high], value[low:high] - at] = 1
        both += x @ x.T
    good = enough(both, size[:, None], size[None, :]) & (roots[:, None] != roots[None, :])
    if cross:
        good &= side[:, None] != side[None, :]
    return np.argwhere(np.triu(good, 1))


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (bucket, cross, lo, hi) -> links (a, b) of alike members."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, root, side, sets = (list(x) for x in zip(*(r[1:] for r in block), strict=True))
        pairs = alike_pairs(sets, np.array(root), np.array(side), block[0][0][1] or block[0][0][2] != block[0][0][3])
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node)[pairs[:, k]]) for k in (0, 1)], schema=out)

    block: list[tuple] = []
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in ("bucket", "cross", "lo", "hi")), strict=True)
        sets = batch.column("set")
        for i, (key, *rest) in enumerate(zip(keys, *(batch.column(k).to_pylist() for k in ("node", "root", "side")), strict=True)):
            if block and block[0][0] != key:
                yield from links(block)
                block = []
            block.append((key, *rest, sets[i].values.to_numpy()))
    if block:
        yield from links(block)


def blocks_of(members: DataFrame) -> DataFrame:
    """bucket, cross, lo, hi, side, node, root: which members(bucket, node, n, root) meet in a task.

    In a bucket, the members of its most frequent root need not be compared with each other. They
    and the rest are parted, by how many there are and by the sizes of their sets; each two parts of
    the rest meet, and each part of the rest meets each of the others. Buckets of one root are left out.
    """
    per = members.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("n").alias("v"))
    first = F.struct("k", "root", "v")
    mixed = per.groupBy("bucket").agg(F.max(first).alias("x"), F.sum("k").alias("k"), F.sum("v").alias("v")).where("k > x.k")
    parts = lambda k, v: F.greatest(F.ceil(k / BLOCK_SETS), F.ceil(v / BLOCK_VALUES)).cast("int")
    mixed = mixed.select("bucket", F.col("x.root").alias("main"), parts(F.col("x.k"), F.col("x.v")).alias("p"), parts(F.col("k") - F.col("x.k"), F.col("v") - F.col("x.v")).alias("q"))
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("p")).otherwise(F.col("q"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda cross, lo, hi, side: F.struct(F.lit(cross).alias("cross"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    of_main = F.transform(upto(F.col("q")), lambda j: block(True, j, F.col("own"), F.lit(1)))
    with_rest = F.transform(upto(F.col("q")), lambda j: block(False, F.least("own", j), F.greatest("own", j), (F.col("own") > j).cast("int")))
    with_main = F.transform(upto(F.col("p")), lambda j: block(True, F.col("own"), j, F.lit(0)))
    placed = members.join(mixed, "bucket").withColumn("own", own)
    return placed.select("bucket", "node", "root", F.inline(F.when(is_main, of_main).otherwise(F.concat(with_rest, with_main))))


def _alike_classes(docs: DataFrame, row: Column, words: int, radius: int, blocks: int, tree: int) -> DataFrame:
    """row, least: the least row reachable over pairs whose five-word shingle sets are alike.

    Pairs are proposed by fingerprints within `radius` bits and by shared buckets, and compared
    exactly. First each member is compared with a few of the earliest ones of its buckets, which
    joins most of a group of copies at about a pair per member. Then all members of a bucket that
    are in different classes by then are compared, in blocks of bounded size.
    """
    found = text_column(lambda t: sketch(t, words), "struct<fp:bigint,node:bigint,n:int,buckets:array<bigint>>")
    own = cut(docs.select(row.alias("row"), found("text").alias("s")).select("row", "s.*"))
    total = own.count()
    nodes = cut(gathered(own.groupBy("node", "fp", "n").agg(F.min("row").alias("least"), F.count("*").alias("copies")), total))
    small = lambda df, rows=total: broadcast_if_small(df, rows)
    rank = F.struct(F.col("row.unknown").alias("u"), F.col("row.doc_id").alias("d"), "node")
    dealt_ = own.select("node", "n", rank.alias("rank"), F.explode("buckets").alias("bucket"))
    shared = dealt_.groupBy("bucket").agg(F.min("rank").alias("first"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket", F.col("first.node").alias("first"), F.col("first").alias("rank"))
    shared = cut(gathered(shared, BANDS * total))
    n_shared = shared.count()
    members = dealt_.select("bucket", "node", "n").join(broadcast_if_small(shared.select("bucket"), n_shared), "bucket", "left_semi").distinct()
    members = cut(gathered(members, BANDS * total))
    n = members.count()

    of_print = gathered(nodes.groupBy("fp").agg(F.min("node").alias("x")), total)
    near = fingerprint_links(of_print.select("fp"), radius, blocks, tree)
    end = lambda k: small(of_print.select(F.col("fp").alias(k), F.col("x").alias(f"x{k}")))
    proposed = near.join(end("a"), "a").join(end("b"), "b").select(F.col("xa").alias("a"), F.col("xb").alias("b"))
    proposed = proposed.unionByName(nodes.join(small(of_print), "fp").select(F.col("node").alias("a"), F.col("x").alias("b")))
    firsts = members.join(broadcast_if_small(shared, n_shared), "bucket").where("node <> first").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("rank")), 1, FIRSTS).alias("r"))
    proposed = proposed.unionByName(firsts.select(F.col("node").alias("a"), F.explode("r.node").alias("b")))
    pairs = proposed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    size = lambda k: small(nodes.groupBy("node").agg(F.max("n").alias(f"n{k}")).withColumnRenamed("node", k))
    apart = F.least("na", "nb") * ALIKE[1] >= F.greatest("na", "nb") * ALIKE[0]
    pairs = cut(gathered(pairs.join(size("a"), "a").join(size("b"), "b").where(apart).select("a", "b"), total))
    n_pairs = pairs.count()

    wanted = members.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    source = nodes.join(small(wanted, n + 2 * n_pairs), "node", "left_semi").groupBy("node").agg(F.min("least").alias("least")).select("node", F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_hash"))
    source = cut(gathered(source, total))
    as_set = text_column(lambda t: shingle_set(t).astype(np.int64), "array<bigint>")
    same = docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text).eqNullSafe(F.col("_hash")))
    sets = docs.join(broadcast_if_small(source, source.count()), same).select("node", as_set("text").alias("set"))
    sets = cut(sets.dropDuplicates(["node"]))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    links = cut(two.where(enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"))  # in as many tasks as the sets need
    roots = cut(connected_components(links))
    now = cut(gathered(members.join(small(roots, n_pairs), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")), n))
    placed = cut(gathered(blocks_of(now), n))
    n_placed = placed.count()
    if n_placed:
        met = placed.join(sets, "node") if n_placed > BROADCAST_ROWS else sets.join(F.broadcast(placed), "node")
        met = met.select("bucket", "cross", "lo", "hi", "side", "node", "root", "set").repartition("bucket", "cross", "lo", "hi").sortWithinPartitions("bucket", "cross", "lo", "hi", "side", "node")
        more = cut(gathered(met.mapInArrow(_block_links, "a long, b long").distinct(), n))
        roots = connected_components(links.unionByName(more))
    labelled = cut(nodes.join(small(roots, n_pairs + n), "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root")))
    of_root = cut(gathered(labelled.groupBy("root").agg(F.min("least").alias("shared"), F.count("*").alias("n")), total))
    classes = join_counted(labelled, of_root, ["root"], total).groupBy("node").agg(F.min("shared").alias("least"), F.sum("copies").alias("n"))
    return join_counted(own.select("row", "node"), cut(gathered(classes, total)), ["node"], total).select("row", "least")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE, exact: bool = False) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the least doc_id (nulls last), and of
    the least text hash among equals. Of rows that repeat both doc_id and text one stays.

    Classes are those of fingerprints within `radius`, or with `exact` those of five-word shingle
    sets that are 0.8 alike or more. Null, empty and wordless texts are one class. Further columns
    pass whatever their names; of rows equal in doc_id and text any may be the one that stays. Empty
    in, empty out.

    Texts move only for the rows that are left out or repeated: the lists of those are joined to
    the table, by broadcast while they are short.
    """
    plain = docs.select("doc_id", "text")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("hash"))
    if exact:
        judged = _alike_classes(plain, row, words, radius, blocks, tree)
    else:
        own = cut(plain.select(row.alias("row"), text_column(lambda t: fingerprint(t, words), "bigint")("text").alias("fp")))
        classes, total = _classes(own, radius, blocks, tree)
        judged = join_counted(own, classes, ["fp"], total)
    out = judged.groupBy("row").agg(F.max(F.col("row") != F.col("least")).alias("left_out"), F.count("*").alias("n")).where("left_out or n > 1")
    id_, hash_, gone = (fresh(x, docs) for x in ("id", "hash", "gone"))
    out = cut(out.select(F.col("row.doc_id").alias(id_), F.col("row.hash").alias(hash_), F.col("left_out").alias(gone)))
    listed = broadcast_if_small(out, out.count())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    own_columns = [f"`{c}`" for c in docs.columns]
    once = docs.join(listed.where(~F.col(gone)), same).dropDuplicates(["doc_id", "text"]).select(own_columns)
    return docs.join(listed, same, "left_anti").unionByName(once)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document. Nulls, empty and long texts, ties, repeats, empty
    tables and further columns: as `near_duplicates` says."""
    return near_duplicates(table(spark, sf_dir, "documents"))
