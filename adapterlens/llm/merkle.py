"""A Merkle manifest of a table, with proofs by butterfly exchange.

The rows of a group are leaves in a fixed order, and every `FAN` neighbours hash to their parent. Leaves
are dealt into aligned blocks of FAN ** LOCAL, each of which builds its own subtree. Then the blocks
exchange roots: in round k, the FAN aligned neighbours of a block's subtree swap their roots, and every
block hashes the parent itself. After the last round each block has the root and all siblings on its
way up, so nothing needs to be sent down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adapterlens.llm.common import BROADCAST_ROWS, ROWS_A_PART, ascii_lower, broadcast_if_small, cut, table

#: Children of a node.
FAN = 8
#: Levels that a block builds by itself: it holds FAN ** LOCAL leaves.
LOCAL = 3
#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _levels(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    out = F.lit(0)
    for k in range(1, 63 // 3 + 1):
        out = out + F.when(n > F.lit(FAN ** (k - 1)), 1).otherwise(0)
    return out


def _parents(nodes: Column) -> Column:
    """The hashes of every FAN neighbours of an array of digests, the last ones of what is left."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1)), F.lit(FAN))
    return F.transform(starts, lambda at: F.sha2(F.array_join(F.slice(nodes, at, FAN), ""), 256))


def _siblings(nodes: Column, at: Column) -> Column:
    """The digests beside node `at` (from 0) in its run, to its left and to its right."""
    start = at - F.pmod(at, F.lit(FAN))
    left, right = F.slice(nodes, start + 1, at - start), F.slice(nodes, at + 2, start + (FAN - 1) - at)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings, level by level, give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def placed(leaves: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add place (from 0) and n of each row in its group by `order`, nulls first; rows that are alike
    in all of it follow each other in any order.

    Rows are dealt by ranges of group and order, so a group of any size is spread, and numbered in
    their partition; the counts of the partitions before, one row per group and partition, lift
    them. leaves is best cut before, as it is read twice.
    """
    parts = max(leaves.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // ROWS_A_PART))
    # The number of a row in the stored table parts rows that are alike.
    numbered = leaves.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    dealt = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), F.col("_first"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(whole).alias("n")))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = dealt.join(broadcast_if_small(offsets, offsets.count()), same)
    return joined.withColumn("place", F.col("_at") - F.col("_first") + F.col("_o")).drop("_at", "_part", "_p", "_first", "_o", *[f"_g_{g}" for g in group])


def blocks(leaves: DataFrame, group: list[str]) -> DataFrame:
    """group, block, n, level0, rows: per aligned block of leaves(group, place, n, digest, ...) the arrays of
    digests and of what else a leaf has."""
    rest = [c for c in leaves.columns if c not in (*group, "place", "n", "digest")]
    size = FAN**LOCAL
    block = F.floor(F.col("place") / size).alias("block")
    rows = F.sort_array(F.collect_list(F.struct(F.pmod("place", F.lit(size)).cast("int").alias("at"), "digest", *rest)))
    dealt = leaves.groupBy(*group, block).agg(F.first("n").alias("n"), rows.alias("rows"))
    own = F.transform("rows", lambda r: F.struct(r["at"].alias("at"), *[r[c].alias(c) for c in rest]))
    return dealt.withColumns({"level0": F.transform("rows", lambda r: r["digest"]), "rows": own})


def with_levels(dealt: DataFrame) -> DataFrame:
    """Add the digests of every level that a block builds above level0, its leaves; the last is its root.
    A group of one block stops where one node is left, and repeats it above."""
    out = dealt
    for k in range(LOCAL):
        below = F.col(f"level{k}")
        done = (F.col("n") <= FAN**LOCAL) & (F.size(below) == 1)
        out = out.withColumn(f"level{k + 1}", F.when(done, below).otherwise(_parents(below)))
    return out


def butterfly(roots: DataFrame, group: list[str]) -> DataFrame:
    """group, block, root, path: what roots(group, block, n_blocks, digest) know after the exchange.

    Round k: a block's subtree is block // FAN ** k. It asks one block of each of the other subtrees in
    its run for their root: the one at its own offset, taken modulo the blocks that subtree has, so
    the blocks of a subtree are asked alike often. Each block then hashes its parent itself. A group
    that is down to one node waits.
    """
    state = cut(roots.withColumn("path", F.expr(f"cast(array() as {PATH})")))
    most = state.agg(F.max("n_blocks")).first()[0] or 1
    width = 1
    while width < most:
        last = F.floor((F.col("n_blocks") - 1) / width)
        mine = F.floor(F.col("block") / width)
        run = mine - F.pmod(mine, F.lit(FAN))
        goes = F.col("n_blocks") > width
        asked = state.where(goes).select(*group, "block", "n_blocks", F.explode(F.sequence(run, F.least(run + FAN - 1, last))).alias("tree"))
        there = F.least(F.col("n_blocks") - F.col("tree") * width, F.lit(width))
        asked = asked.withColumn("partner", F.col("tree") * width + F.pmod(F.pmod("block", F.lit(width)), there))
        given = state.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("block").alias("partner_"), F.col("digest").alias("theirs"))
        same = F.col("partner") == F.col("partner_")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        told = asked.join(given, same).groupBy(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("block").alias("block_"))
        told = told.agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "theirs"))), lambda x: x["theirs"]).alias("run"))
        same = F.col("block") == F.col("block_")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        at = F.pmod(mine, F.lit(FAN)).cast("int")
        met = state.join(told, same, "left").drop("block_", *[f"_g_{g}" for g in group])
        state = cut(
            met.withColumn("path", F.when(goes, F.concat("path", F.array(_siblings(F.col("run"), at)))).otherwise(F.col("path")))
            .withColumn("digest", F.when(goes, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("digest")))
            .drop("run")
        )
        width *= FAN
    return state.select(*group, "block", F.col("digest").alias("root"), "path")


def forest(leaves: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Trees over leaves(group, order, digest, ...), one for each group.

    Returns (blocks with their levels and rows, and per block what the exchange gave: root, path).
    """
    dealt = cut(with_levels(blocks(placed(leaves, group, order), group)))
    top = F.element_at(f"level{LOCAL}", 1)
    roots = dealt.select(*group, "block", F.ceil(F.col("n") / FAN**LOCAL).alias("n_blocks"), top.alias("digest"))
    return dealt, butterfly(roots, group)


def _local_path(at: Column) -> Column:
    """The siblings of a leaf in its block, as many levels as its group builds there."""
    steps = [_siblings(F.col(f"level{k}"), F.floor(at / FAN**k).cast("int")) for k in range(LOCAL)]
    return F.slice(F.array(*steps), F.lit(1), F.least(_levels(F.col("n")), F.lit(LOCAL)))


def leaves_of(dealt: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """The rows of all blocks, with root and path (siblings, level by level) of each."""
    renamed = state.withColumnsRenamed({g: f"_g_{g}" for g in group} | {"block": "_b", "path": "_upper"})
    same = F.col("block") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    rows = dealt.join(renamed, same).drop("_b", *[f"_g_{g}" for g in group])
    path = lambda r: F.concat(_local_path(r["at"]), F.col("_upper"))
    made = F.transform("rows", lambda r: F.struct(r.alias("row"), F.get("level0", r["at"]).alias("digest"), path(r).alias("path")))
    kept = [c for c in (*group, "root", *[c for c in state.columns if c not in (*group, "block", "path", "root")])]
    return rows.select(*kept, F.explode(made).alias("_made")).select(*kept, "_made.row.*", "_made.digest", "_made.path")


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path, tampered: the Merkle manifest of docs(FIELDS, ...).

    Each lang has a tree whose leaves ascend by doc_id, and the trees' roots have one in the order
    of lang. path holds the siblings of a leaf up to the root. `tampered` is a text column: the leaf
    with it in place of text is in column tampered.

    Nulls are values of their own: a null lang is a group, the first, a null doc_id comes first in its
    group. Rows that share lang and doc_id go by their leaf; rows alike in all fields are leaves of
    their own. Texts are hashed whole and shuffled nowhere. Further columns are ignored. An empty
    table gives no rows.
    """
    values = [F.col(c) for c in FIELDS]
    hashed = docs.select("doc_id", "lang", leaf(*values).alias("digest"), leaf(*values[:-1], tampered).alias("tampered"))
    hashed = cut(hashed.withColumn("tampered", F.nullif("tampered", "digest")))
    dealt, state = forest(hashed, ["lang"], ["doc_id", "digest"])

    # The second tree: subroots in the order of lang, one group.
    subroots = cut(state.where("block = 0").select(F.lit(0).alias("all"), "lang", F.col("root").alias("digest")))
    above = leaves_of(*forest(subroots, ["all"], ["lang"]), ["all"])
    above = above.select(F.col("lang").alias("_lang"), F.col("root").alias("_root"), F.col("path").alias("_above"))
    named = state.withColumnRenamed("root", "subroot")
    few = subroots.limit(BROADCAST_ROWS // 10 + 1).count()
    named = named.join(broadcast_if_small(above, few, BROADCAST_ROWS // 10), F.col("lang").eqNullSafe(F.col("_lang")))
    named = named.select("lang", "block", F.concat("path", "_above").alias("path"), "subroot", F.col("_root").alias("root"))
    rows = leaves_of(dealt, named, ["lang"])
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("tampered", "digest").alias("tampered"))


def verified(rows: DataFrame) -> DataFrame:
    """Add folded_root, from the tampered leaf and its siblings, and whether it is the root."""
    out = rows.withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, where the text
    of those whose doc_id's checksum 3 divides is tampered with. Nulls, ties, repeats: as `manifest`
    says; a null doc_id has no checksum and is left alone."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    tampered = F.when(F.coalesce(third, F.lit(False)), ascii_lower(F.col("text"))).otherwise(F.col("text"))
    rows = verified(manifest(table(spark, sf_dir, "documents"), tampered))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _sql_tree(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs of trees over leaves(g, pos, h), a level each: {name}<k>(g, pos, h, n) and the siblings of its nodes,
    {name}s<k>(g, pos, lft, rgt). A group of one node repeats it, without siblings."""
    ctes = [f"{name}0 as materialized (select g, pos, h, count(*) over (partition by g) as n from {leaves})"]
    for k in range(levels):
        ctes.append(f"""{name}s{k} as materialized (select a.g, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as lft, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as rgt
  from {name}{k} a join {name}{k} b on b.g = a.g and b.pos // {FAN} = a.pos // {FAN} where a.n > 1 group by a.g, a.pos)""")
        ctes.append(f"""{name}{k + 1} as materialized (select g, pos, h, count(*) over (partition by g) as n from (
  select g, pos // {FAN} as pos, case when max(n) > 1 then sha256(string_agg(h, '' order by pos)) else max(h) end as h from {name}{k} group by g, pos // {FAN}))""")
    return ctes


def _sql_climb(name: str, rows: str, levels: int, group: str, place: str) -> tuple[list[str], str]:
    """CTEs that take rows(..., now, said) up the trees: `now` folds the siblings in, `said` names them."""
    ctes, last = [], rows
    for k in range(levels):
        step = f"{rows}_{name}{k}"
        ctes.append(f"""{step} as materialized (select r.* replace (case when s.g is null then now else sha256(s.lft || now || s.rgt) end as now, case when s.g is null then said else said || s.lft || s.rgt end as said)
  from {last} r left join {name}s{k} s on s.g = r.{group} and s.pos = r.{place} // {FAN**k})""")
        last = step
    return ctes, last


def op12_sql(levels: int = 7, groups: int = 4) -> str:
    """The manifest in DuckDB SQL, for FAN ** levels leaves a lang and FAN ** groups langs at most."""
    value = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    hashed = lambda text: "sha256(" + " || ".join(value(c) for c in (*FIELDS[:-1], text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: {byte}), 4294967295)"
    first, upto = _sql_climb("t", "start", levels, "g", "pos")
    second, top = _sql_climb("u", upto, groups, "one", "g")
    return f"""with hashed as materialized (select doc_id, dense_rank() over (order by lang nulls first) - 1 as g, {hashed('text')} as leaf, case when {crc} % 3 = 0 then {hashed(f'({lower})')} else {hashed('text')} end as now from documents),
numbered as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos from hashed),
leaves as (select g, pos, leaf as h from numbered), {", ".join(_sql_tree("t", "leaves", levels))},
roots as (select 0 as g, g as pos, h from t{levels}), {", ".join(_sql_tree("u", "roots", groups))},
start as (select doc_id, leaf, g, pos, 0 as one, now, '' as said from numbered), {", ".join([*first, *second])}
select doc_id, leaf, (select h from t{levels} t where t.g = r.g) as subroot, (select h from u{groups}) as root, sha256(said) as proof_sha256, now as folded_root, now = (select h from u{groups}) as verified from {top} r"""
