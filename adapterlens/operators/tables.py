"""Operators over long feature tables: select, align, merge, subset, trace, report, pivot.

A missing cell is a missing row; nothing is filled before a dense form is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adapterlens.functions import names as N
from adapterlens.operators import catalogue as C
from adapterlens.sources.shared import cut

CELL = ["model_name", "block", "feature"]
#: Overlapping cells agree if |old - new| <= ATOL + RTOL * |new|.
ATOL, RTOL = 1e-6, 1e-5
#: Columns whose order is broadcast.
BROADCAST_COLUMNS = 100_000


def select_feature_groups(feature: DataFrame, groups: list[str] | None) -> DataFrame:
    """Cells of the requested groups; all for none or `all`."""
    if not groups or "all" in groups:
        return feature
    return feature.where(N.feature_group(F.col("feature")).isin(groups))


def few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast in a join if they are counted as few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_COLUMNS else rows


def block_names(feature: DataFrame, **columns: Column) -> DataFrame:
    """_block, columns: every distinct block and what follows from it, computed once."""
    return cut(feature.select("block").distinct().select(F.col("block").alias("_block"), *[c.alias(k) for k, c in columns.items()]))


def by_block(feature: DataFrame, **columns: Column) -> DataFrame:
    """feature with columns that follow from `block` alone: computed once for every distinct block instead of
    once a cell, and joined back."""
    return feature.join(few(block_names(feature, **columns)), F.col("block").eqNullSafe(F.col("_block"))).drop("_block")


def missing_feature_groups(feature: DataFrame, groups: list[str]) -> DataFrame:
    """Requested groups that no cell has: grp."""
    wanted = feature.sparkSession.createDataFrame([(g,) for g in groups], "grp string")
    have = feature.select("feature").distinct().select(N.feature_group(F.col("feature")).alias("grp")).distinct()
    return wanted.join(have, "grp", "left_anti")


def filter_qv_mode(feature: DataFrame, mode: str) -> DataFrame:
    """none drops q+v sums, only keeps nothing else, append keeps all."""
    is_sum = N.role_bucket(F.col("block")) == "qv_sum"
    return {"none": feature.where(~is_sum), "only": feature.where(is_sum), "append": feature}[mode]


def project_config(feature: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of expected(block, feature, place), with place; and the expected columns that nothing has."""
    cells = feature.join(expected, ["block", "feature"])
    missing = expected.join(feature.select("block", "feature").distinct(), ["block", "feature"], "left_anti")
    return cells, missing


def align_to_manifest(feature: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the models in manifest(model_name, pos), with pos; and one row of counts:
    matched, missing (in the manifest only), extra (in the table only)."""
    aligned = feature.join(manifest.select("model_name", "pos"), "model_name")
    have = feature.select("model_name").distinct().withColumn("t", F.lit(1))
    both = manifest.select("model_name").distinct().withColumn("m", F.lit(1)).join(have, "model_name", "full")
    count = lambda c: F.count(F.when(c, 1))
    t, m = F.col("t").isNotNull(), F.col("m").isNotNull()
    return aligned, both.agg(count(t & m).alias("matched"), count(m & ~t).alias("missing"), count(t & ~m).alias("extra"))


def _sources(*tables: DataFrame, parts: int | None = None) -> DataFrame:
    """Cells of all tables with src; brought together by model in `parts` parts, if said."""
    rows = reduce(DataFrame.unionByName, [t.select(*CELL, "value", F.lit(i).alias("src")) for i, t in enumerate(tables)])
    return rows.repartition(parts, "model_name") if parts else rows


def _size(rows: DataFrame) -> DataFrame:
    """One row: n_models, n_features, n_cells."""
    models = rows.groupBy("model_name").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_models"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells"))
    columns = rows.select("block", "feature").distinct().agg(F.count("*").alias("n_features"))
    return models.join(columns).select("n_models", "n_features", "n_cells")


def merge_dense(base: DataFrame, incoming: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of cells, the base's value where both have one; and one row of counts: n_models,
    n_features, n_cells, overlap, conflicts, missing, repeated (cells that a source has more than
    once). A strict merge needs the last three to be 0.

    One aggregation on the cell, in `parts` parts by model if said. Values agree if they are equal (NaN and NaN, an infinity and
    itself), or both finite and close.
    """
    of = lambda i: F.max(F.when(F.col("src") == i, F.col("value")))
    times = lambda i: F.count(F.when(F.col("src") == i, 1))
    cells = _sources(base, incoming, parts=parts).groupBy(*CELL).agg(of(0).alias("old"), of(1).alias("new"), F.greatest(times(0), times(1)).alias("times"))
    old, new = F.col("old"), F.col("new")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    close = (old == new) | (finite(old) & finite(new) & (F.abs(old - new) <= ATOL + RTOL * F.abs(new)))
    cells = cells.withColumn("overlap", old.isNotNull() & new.isNotNull()).withColumn("conflict", F.col("overlap") & ~close)
    merged = cells.select(*CELL, F.coalesce("old", "new").alias("value"))
    # figures of every model, which add up, and the distinct columns: two passes
    marks = {"overlap": F.col("overlap"), "conflicts": F.col("conflict"), "repeated": F.col("times") > 1}
    models = cells.groupBy("model_name").agg(F.count("*").alias("n_cells"), *[F.count(F.when(c, 1)).alias(k) for k, c in marks.items()])
    sums = models.agg(F.count("*").alias("n_models"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n_cells", *marks)])
    columns = _sources(base, incoming).select("block", "feature").distinct().agg(F.count("*").alias("n_features"))
    return merged, sums.join(columns).select("n_models", "n_features", "n_cells", *marks, F.expr("n_models * n_features - n_cells").alias("missing"))


def merge_zero_fill(base: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of tables without a model in common; and counts: n_models, n_features, n_cells,
    shared_models (must be 0), zero_filled (cells that a dense form fills)."""
    merged = _sources(base, incoming).select(*CELL, "value")
    shared = base.select("model_name").distinct().join(incoming.select("model_name").distinct(), "model_name", "left_semi").agg(F.count("*").alias("shared_models"))
    return merged, _size(merged).join(shared).withColumn("zero_filled", F.expr("n_models * n_features - n_cells"))


def merge_auto(base: DataFrame, incoming: DataFrame, parts: int | None = None) -> tuple[DataFrame, str]:
    """The dense merge, or zero-fill if cells would be missing and no model is shared; and which."""
    merged, stats = merge_dense(base, incoming, parts)
    found = stats.first()
    if found.conflicts or found.repeated:
        raise ValueError(f"{found.conflicts} overlapping cells disagree, {found.repeated} are repeated")
    if not found.missing:
        return merged, "dense"
    if base.select("model_name").distinct().join(incoming.select("model_name").distinct(), "model_name", "left_semi").isEmpty():
        return merge_zero_fill(base, incoming)[0], "zero_fill"
    raise ValueError(f"{found.missing} cells are missing and models are shared")


def merge_schema_groups(*tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zero-fill merge of any number of tables, as one union: cells and counts."""
    merged = _sources(*tables).select(*CELL, "value")
    return merged, _size(merged).withColumn("zero_filled", F.expr("n_models * n_features - n_cells"))


def merge_labels(*tables: DataFrame) -> DataFrame:
    """model_name, label, conflict, unknown from tables (model_name, label): labels must agree per model."""
    rows = reduce(DataFrame.unionByName, [t.select("model_name", "label") for t in tables])
    return rows.groupBy("model_name").agg(F.min("label").alias("label"), (F.coalesce(F.min("label") != F.max("label"), F.lit(False))).alias("conflict"), F.min("label").isNull().alias("unknown"))


def stack_shards(shards: list[DataFrame], manifest: DataFrame, known_bad: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of all shards in manifest order, and the models that do not fit: model_name, reason. One
    without a cell has `MissingShardRow`, or what known_bad(model_name, reason) says; one that the
    manifest does not name has `NotInManifest`. A strict stacking needs none of the latter.
    Shards are brought together in `parts` parts by model, if said."""
    every = _sources(*shards, parts=parts).select(*CELL, "value")
    rows = every.join(manifest.select("model_name", "pos"), "model_name")
    extra = every.select("model_name").distinct().join(manifest, "model_name", "left_anti").select("model_name", F.lit("NotInManifest").alias("reason"))
    absent = manifest.select("model_name").join(rows.select("model_name").distinct(), "model_name", "left_anti")
    bad = absent.join(known_bad, "model_name", "left").select("model_name", F.coalesce("reason", F.lit("MissingShardRow")).alias("reason"))
    return rows, bad.unionByName(extra)


def labels_all_or_none(shards: DataFrame) -> DataFrame:
    """One row: n_shards, n_labelled, ok. shards(shard, model_name, label): either every shard has
    labels or none has."""
    per = shards.groupBy("shard").agg((F.count("label") > 0).alias("labelled"))
    counts = per.agg(F.count("*").alias("n_shards"), F.count(F.when(F.col("labelled"), 1)).alias("n_labelled"))
    return counts.withColumn("ok", F.col("n_labelled").isin(0) | (F.col("n_labelled") == F.col("n_shards")))


def shard_compatible(shards: DataFrame) -> DataFrame:
    """One row: n_signatures, ok. shards(shard, block, feature): every shard has the same columns."""
    per = shards.select("shard", "block", "feature").distinct().groupBy("shard").agg(F.sha1(F.array_join(F.sort_array(F.collect_list(F.concat_ws(".", "block", "feature"))), "|")).alias("signature"))
    return per.agg(F.count_distinct("signature").alias("n_signatures")).withColumn("ok", F.col("n_signatures") == 1)


def subset_rows(feature: DataFrame, catalogue: DataFrame, **filters: list[str]) -> DataFrame:
    """Cells of the models whose catalogue columns lie in all of the given sets."""
    picked = catalogue
    for column, values in filters.items():
        picked = picked.where(F.col(column).isin(values))
    return feature.join(picked.select("model_name").distinct(), "model_name", "left_semi")


def subset_columns(feature: DataFrame, owned: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Cells whose (block, feature) any row of owned has, in the requested groups."""
    return select_feature_groups(feature.join(owned.select("block", "feature").distinct(), ["block", "feature"], "left_semi"), groups)


def lineage_leaves(lineage: DataFrame, roots: DataFrame) -> DataFrame:
    """root, leaf: tables that root was merged from and that were not merged themselves.

    lineage(child, parent): child was made from parent. By pointer doubling: after round k, every
    merged table knows its leaves within 2 ** k steps and the merged tables at exactly so many, so the
    rounds are the logarithm of the depth. Each is cut with a checkpoint. Merged tables that are left
    when more steps than there are tables have been taken lie above a cycle, which is an error.
    """
    edges = cut(lineage.select("child", "parent").distinct())
    children = cut(edges.select(F.col("child").alias("_child")).distinct())
    reached = cut(edges.join(children, F.col("parent") == F.col("_child"), "left").select(F.col("child").alias("at"), F.col("parent").alias("up"), F.col("_child").isNull().alias("leaf")))
    steps, most = 1, children.count()
    while not reached.where("not leaf").isEmpty():
        if steps > most:
            raise ValueError("lineage has a cycle")
        further = reached.select(F.col("at").alias("up"), F.col("up").alias("next"), F.col("leaf").alias("ends"))
        jumped = reached.where("not leaf").join(further, "up").select("at", F.col("next").alias("up"), F.col("ends").alias("leaf"))
        reached, steps = cut(reached.where("leaf").unionByName(jumped).distinct()), 2 * steps
    known = roots.select("root").distinct().join(reached.select(F.col("at").alias("root"), F.col("up").alias("leaf")), "root", "left")
    return known.select("root", F.coalesce("leaf", "root").alias("leaf"))


def owned_features(leaves: DataFrame, members: DataFrame, columns: DataFrame, parts: int | None = None) -> DataFrame:
    """model_name, block, feature: what the leaf tables that hold a model have as columns.

    leaves(leaf), members(leaf, model_name), columns(leaf, block, feature). Rows go by leaf, then by model, to
    `parts` parts, or as many as the session says.
    """
    to = lambda df, key: df.repartition(parts, key) if parts else df.repartition(key)
    kept = to(members.select("leaf", "model_name"), "leaf").join(leaves.select("leaf").distinct(), "leaf", "left_semi")
    found = kept.join(to(columns.select("leaf", "block", "feature"), "leaf").distinct(), "leaf")
    return to(found.select("model_name", "block", "feature"), "model_name").distinct()


def filter_catalogue(catalogue: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue rows of the models, and the models without one."""
    names = models.select("model_name").distinct()
    return catalogue.join(names, "model_name", "left_semi"), names.join(catalogue, "model_name", "left_anti")


def merge_catalogue(*catalogues: DataFrame) -> DataFrame:
    """model_name, dataset_group, label, gap: the first table's entry, its null label filled by later
    ones; gap tells that tables differ."""
    rows = reduce(DataFrame.unionByName, [c.select("model_name", "dataset_group", "label", F.lit(i).alias("pos")) for i, c in enumerate(catalogues)])
    known = F.min_by("label", F.when(F.col("label").isNotNull(), F.col("pos")))
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return rows.groupBy("model_name").agg(F.min_by("dataset_group", "pos").alias("dataset_group"), known.alias("label"), (differ("dataset_group") | differ("label")).alias("gap"))


def catalogue_from_names(names: DataFrame) -> DataFrame:
    """Catalogue of names(model_name) alone, marked incomplete."""
    rows = names.select("model_name", F.col("model_name").alias("model_dir"), N.parse_label(F.col("model_name")).alias("label"))
    return C.identities(rows).select("model_name", "label", "model_family", "attack_name", "dataset_group", F.lit(False).alias("complete"))


def _counts(rows: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """<by>, map of key -> count."""
    per = rows.groupBy(by, F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))


def dataset_report(catalogue: DataFrame, first: int = 10) -> DataFrame:
    """dataset_group, n_samples, labels, attacks (maps of counts), n_subsets, subsets (the first ten names)."""
    base = catalogue.groupBy("dataset_group").agg(F.count("*").alias("n_samples"))
    names = catalogue.select("dataset_group", "subset").distinct().groupBy("dataset_group").agg(F.count("*").alias("n_subsets"), F.slice(F.sort_array(F.collect_list("subset")), 1, first).alias("subsets"))
    out = base.join(names, "dataset_group")
    for key, name in (("label", "labels"), ("attack_name", "attacks")):
        out = out.join(_counts(catalogue, "dataset_group", key, name), "dataset_group")
    return out


def dataset_layouts(catalogue: DataFrame, dims: DataFrame) -> DataFrame:
    """dataset_group, layout (if all its models have one) or n_variants of them.

    dims(model_name, block, m, n, r); a model's layout is its sorted list of distinct m x n x r.
    """
    dim = F.concat_ws("x", *[F.col(c).cast("string") for c in ("m", "n", "r")])
    per = dims.groupBy("model_name").agg(F.array_join(F.sort_array(F.collect_set(dim)), "|").alias("layout"))
    joined = catalogue.select("model_name", "dataset_group").join(per, "model_name")
    sets = joined.groupBy("dataset_group").agg(F.sort_array(F.collect_set("layout")).alias("v"))
    return sets.select("dataset_group", F.size("v").alias("n_variants"), F.when(F.size("v") == 1, F.get("v", F.lit(0))).alias("layout"))


def feature_order(feature: DataFrame) -> DataFrame:
    """block, feature, place: distinct columns by name; as many rows as columns."""
    from pyspark.sql import Window

    columns = feature.select("block", "feature").distinct()
    return columns.withColumn("place", F.row_number().over(Window.orderBy("block", "feature")) - 1)


def pivot_vectors(feature: DataFrame, order: DataFrame) -> DataFrame:
    """model_name, features array<double>: dense rows in the given column order, gaps as 0.

    One aggregation per model over (place, value) pairs; no pivot over thousands of columns. The
    order table has one short row per column and is broadcast if it is counted as short.
    """
    width = order.count()
    cells = feature.join(F.broadcast(order) if width <= BROADCAST_COLUMNS else order, ["block", "feature"]).groupBy("model_name").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("value").cast("double")))).alias("cells"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return cells.select("model_name", dense.alias("features"))
