"""Architecture-independent aggregation of long feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adapterlens.functions import names as N
from adapterlens.operators.tables import block_names, by_block, few
from adapterlens.sources.shared import cut

ROLES = ["q", "v", "qv_sum", "other"]


def aggregate_flat_avg(feature: DataFrame) -> DataFrame:
    """model_name, role, feature, value: the mean of the means of structural groups."""
    rows = by_block(feature, role=N.role_bucket(F.col("block")), grp=N.structural_group(F.col("block")))
    inner = rows.groupBy("model_name", "role", "feature", "grp").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return inner.groupBy("model_name", "role", "feature").agg(F.avg("value").alias("value"))


def aggregate_flat_minmax(feature: DataFrame, op: str) -> DataFrame:
    """model_name, role, feature, value: least (min) or greatest (max) cell."""
    if op not in ("min", "max"):
        raise ValueError("op is min or max")
    return by_block(feature, role=N.role_bucket(F.col("block"))).groupBy("model_name", "role", "feature").agg(getattr(F, op)(F.col("value").cast("double")).alias("value"))


def aggregate_single_group(feature: DataFrame, op: str, models: DataFrame) -> DataFrame:
    """model_name, value of all cells of each model of models(model_name); 0 for a model without any."""
    per = feature.groupBy("model_name").agg(getattr(F, op)(F.col("value").cast("double")).alias("value"))
    return models.select("model_name").join(per, "model_name", "left").select("model_name", F.coalesce("value", F.lit(0.0)).alias("value"))


def flat_columns(feature: DataFrame) -> DataFrame:
    """place, role, feature: output columns in order, roles first; as many as names there are."""
    named = feature.select("block", "feature").distinct().select(N.role_bucket(F.col("block")).alias("role"), "feature").distinct()
    order = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return named.withColumn("place", F.row_number().over(Window.orderBy(order, "feature")) - 1)


def flat_empty_fill(agg: DataFrame, columns: DataFrame) -> DataFrame:
    """role, feature, place, n_models, n_filled: how often each output column has no value and becomes 0."""
    have, n = agg.groupBy("role", "feature").agg(F.count("*").alias("n")), agg.select("model_name").distinct().count()
    return columns.join(F.broadcast(have), ["role", "feature"], "left").select("role", "feature", "place", F.lit(n).cast("long").alias("n_models"), (F.lit(n) - F.coalesce("n", F.lit(0))).cast("long").alias("n_filled"))


def depth_names(feature: DataFrame) -> DataFrame:
    """arch, layer, depth_label, slot, feature: what names the rows of layer_sequence, each once. Every cell has its
    place there, so they follow from the distinct columns, and no value is summed up."""
    depth, slot = N.canonical_depth(F.col("block")), N.canonical_slot(F.col("block"))
    columns = cut(feature.select("block", "feature").distinct())
    return columns.select(depth.alias("d"), slot["label"].alias("slot"), "feature").select("d.arch", "d.layer", F.col("d.label").alias("depth_label"), "slot", "feature").distinct()


def layer_sequence(feature: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """depth_feature(model_name, arch, layer, depth_label, slot, feature, value, n): every cell at its
    depth and slot; n over 1 marks a place taken twice. Then the block that is first by name owns it,
    and of its repeats the least value. columns(block): all blocks of the table, where they are known
    without reading it."""
    depth, slot = N.canonical_depth(F.col("block")), N.canonical_slot(F.col("block"))
    # Blocks are few: their order and their places are numbers, so that cells are summed up by short keys, in
    # hash tables, first those of a block, then those of a place, where any place has several blocks.
    numbers = {"_rank": F.row_number().over(Window.orderBy("block")), "_place": F.dense_rank().over(Window.orderBy(depth, slot["label"]))}
    names = block_names(feature if columns is None else columns, d=depth, slot=slot["label"], **numbers)
    rows = feature.join(few(names.select("_block", "_rank", "_place")), F.col("block").eqNullSafe(F.col("_block")))
    least = F.when(F.count("value") == F.count("*"), F.min("value"))  # nulls are least
    sums = [least.alias("value"), F.count("*").alias("n")]
    if names.groupBy("_place").count().where("count > 1").isEmpty():
        one = rows.groupBy("model_name", "_place", "feature").agg(*sums)
    else:
        per = rows.groupBy("model_name", "_place", "_rank", "feature").agg(*sums)
        one = per.groupBy("model_name", "_place", "feature").agg(F.min_by("value", "_rank").alias("value"), F.sum("n").alias("n"))
    places = few(names.select("_place", "d.arch", "d.layer", F.col("d.label").alias("depth_label"), "slot").distinct())
    return one.join(places, "_place").select("model_name", "arch", "layer", "depth_label", "slot", "feature", "value", "n")


def sequence_masks(depth_feature: DataFrame) -> DataFrame:
    """model_name, n_depths, padding, n_values, groups (depth labels in order)."""
    order = F.struct(F.when(F.col("arch") == "encoder", 0).when(F.col("arch") == "decoder", 1).otherwise(2).alias("a"), F.col("layer").alias("l"), F.col("depth_label").alias("label"))
    depths = depth_feature.groupBy("model_name", "arch", "layer", "depth_label").agg(F.count("*").alias("n"))
    per = depths.groupBy("model_name").agg(F.sort_array(F.collect_set(order)).alias("g"), F.sum("n").alias("n_values"))
    deepest = depth_feature.select("depth_label").distinct().count()
    return per.select("model_name", F.size("g").alias("n_depths"), (F.lit(deepest) - F.size("g")).alias("padding"), "n_values", F.array_join(F.transform("g", lambda x: x["label"]), "|").alias("groups"))


def sequence_axes(depth_feature: DataFrame) -> DataFrame:
    """axis, place, label: depths, slots and features in canonical order; as many rows as names."""
    depth = F.struct(F.when(F.col("arch") == "encoder", 0).when(F.col("arch") == "decoder", 1).otherwise(2).alias("a"), F.col("layer").alias("l"))
    kind, role = F.substring_index("slot", ".", 1), F.substring_index("slot", ".", -1)
    slot = F.struct(F.when(kind == "self", 0).when(kind == "cross", 1).otherwise(2).alias("a"), F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)), F.lit(9)).cast("int").alias("l"))
    none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("l"))
    axes = [("depth", depth, "depth_label"), ("slot", slot, "slot"), ("feature", none, "feature")]
    rows, depth_feature = None, cut(depth_feature.select("arch", "layer", "depth_label", "slot", "feature").distinct())
    for name, key, label in axes:
        part = depth_feature.select(F.lit(name).alias("axis"), key.alias("key"), F.col(label).alias("label")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("axis", (F.row_number().over(Window.partitionBy("axis").orderBy("key", "label")) - 1).alias("place"), "label")


def sv_topk_from_names(feature: DataFrame, by: str, default: int = 8) -> DataFrame:
    """<by>, top_k: the largest i of a feature sv_<i>, else the default."""
    i = F.nullif(F.regexp_extract("feature", r"^sv_(\d+)$", 1), F.lit("")).cast("int")
    return feature.groupBy(by).agg(F.coalesce(F.max(i), F.lit(default)).alias("top_k"))
