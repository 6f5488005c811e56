"""Training inputs: normalisation, sequence vectors, class weights. Statistics are joined, not windowed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adapterlens.operators.tables import few
from adapterlens.sources.shared import cut

FLAT, VAR_FLOOR = 1e-6, 1e-6


def _standardized(rows: DataFrame, keys: list[str], floor: bool) -> DataFrame:
    v = F.col("value").cast("double")
    stats = cut(rows.groupBy(*keys).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std")))
    std = F.sqrt(F.greatest(F.col("_std") * F.col("_std"), F.lit(VAR_FLOOR))) if floor else F.when(F.col("_std") <= FLAT, 1.0).otherwise(F.col("_std"))
    return rows.join(few(stats), keys).withColumn("value", (v - F.col("_mean")) / std).drop("_mean", "_std")


def standardize_by_dataset(feature: DataFrame) -> DataFrame:
    """z-scores of feature(slice, dataset_group, block, feature, value) per slice, dataset and column;
    population deviation, 1 where it is 1e-6 or less. Each slice uses its own statistics."""
    return _standardized(feature, ["slice", "dataset_group", "block", "feature"], floor=False)


def standardize_by_dataset_masked(feature: DataFrame) -> DataFrame:
    """The same over present cells with the variance floored at 1e-6; absent cells stay absent (0 when dense)."""
    return _standardized(feature, ["slice", "dataset_group", "block", "feature"], floor=True)


def fitted_statistics(train: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, std (population; 1 where next to nothing) of the training rows."""
    v = F.col("value").cast("double")
    return train.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("_s")).select(*keys, "mean", F.when(F.col("_s") <= FLAT, 1.0).otherwise(F.col("_s")).alias("std"))


def standard_scaler(train: DataFrame, apply: DataFrame) -> DataFrame:
    """Scale apply(model_name, block, feature, value) by the training rows' column statistics."""
    stats = fitted_statistics(train, ["block", "feature"])
    return apply.join(stats, ["block", "feature"]).withColumn("value", (F.col("value").cast("double") - F.col("mean")) / F.col("std")).drop("mean", "std")


def masked_feature_stats(depth_feature: DataFrame) -> DataFrame:
    """feature, mean, std over all present places of the training rows' sequences."""
    return fitted_statistics(depth_feature, ["feature"])


#: Channels of a layer that are not cells: its places in its model.
POSITIONAL = ("layer", "layer_share", "position_share", "n_layers")


def channel_sums(depth_feature: DataFrame, positional: bool = False) -> DataFrame:
    """slot, feature, depth_label, n, total, spread: per channel and depth over the layers that have it, how
    many, the sum and the sum of squared distances from the mean. Those of several shards may be put
    together. They are few, and computed once, however often they are read. positional: also of the layers' own channels, with slot `position`."""
    cells = depth_feature.select("depth_label", "slot", "feature", F.col("value").cast("double").alias("value"))
    if positional:
        own = F.inline(F.array(*[F.struct(F.lit("position").alias("slot"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in POSITIONAL]))
        cells = cells.unionByName(layer_vectors(depth_feature).select("depth_label", own))
    sums = cells.groupBy("slot", "feature", "depth_label").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.var_pop("value").alias("var"))
    return cut(sums.select("slot", "feature", "depth_label", "n", "total", (F.col("n") * F.col("var")).alias("spread")))


def stats_of_sums(*shards: DataFrame, by: tuple[str, ...] = ("slot", "feature")) -> DataFrame:
    """<by>, n, mean, std of channel_sums of one or more shards; variances count as 1e-6 at least."""
    rows = reduce(DataFrame.unionByName, shards).where("n > 0")
    means = rows.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("mean"))
    off = F.col("total") / F.col("n") - F.col("mean")
    sums = rows.join(means, list(by)).groupBy(*by, "mean").agg(F.sum("n").alias("n"), F.sum(F.col("spread") + F.col("n") * off * off).alias("spread"))
    return sums.select(*by, "n", "mean", F.sqrt(F.greatest(F.col("spread") / F.col("n"), F.lit(VAR_FLOOR))).alias("std"))


def masked_channel_stats(depth_feature: DataFrame, positional: bool = False, by_depth: bool = False) -> DataFrame:
    """slot, feature (and depth_label), n, mean, std per channel over the layers that have it."""
    return stats_of_sums(channel_sums(depth_feature, positional), by=("depth_label", "slot", "feature") if by_depth else ("slot", "feature"))


def observed_channels(depth_feature: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """model_name, depth_label, channel, observed (0 or 1) for every layer of a model and every channel.

    The channel list, one entry per slot and feature name, is a literal array; the channels of a layer are
    bits, 64 to a number. names(slot, feature): all of the table, where they are known without reading it.
    """
    cell = F.concat_ws("::", "slot", "feature")
    names = sorted(r.c for r in (depth_feature if names is None else names).select(cell.alias("c")).distinct().collect())
    every = F.posexplode(F.array(*map(F.lit, names)).cast("array<string>"))
    numbers = depth_feature.sparkSession.range(1).select(every.alias("_at", "_channel"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at") % 64)
    words = [F.bit_or(F.when(F.floor(F.col("_at") / 64) == w, bit)) for w in range(-(-len(names) // 64))]
    rows = depth_feature.withColumn("_channel", cell).join(F.broadcast(numbers), "_channel")
    per = rows.groupBy("model_name", "depth_label").agg(F.array(*words).cast("array<long>").alias("_have"))
    each = per.select("model_name", "depth_label", every.alias("_at", "channel"), "_have")
    has = F.getbit(F.get("_have", F.floor(F.col("_at") / 64).cast("int")), F.col("_at") % 64)
    return each.select("model_name", "depth_label", "channel", F.coalesce(has.cast("int"), F.lit(0)).alias("observed"))


def layer_vectors(depth_feature: DataFrame) -> DataFrame:
    """One row per model and layer: cells (map of channel to value), n_slots, has_self, has_cross,
    is_encoder, layer, layer_share (of the greatest in the architecture), position_share, n_layers.

    Layers are numbered inside their model, whose layer list is bounded by its depth.
    """
    channel = F.concat_ws("::", "slot", "feature")
    per = depth_feature.groupBy("model_name", "arch", "layer", "depth_label").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(channel.alias("c"), F.col("value").cast("double").alias("v"))))).alias("cells"),
        F.size(F.collect_set("slot")).cast("long").alias("n_slots"),
        F.bool_or(F.col("slot").startswith("self.")).alias("has_self"),
        F.bool_or(F.col("slot").startswith("cross.")).alias("has_cross"),
    )
    key = F.struct(F.when(F.col("arch") == "encoder", 0).otherwise(1).alias("a"), F.col("layer").alias("l"))
    layers = F.sort_array(F.collect_set(key).over(Window.partitionBy("model_name")))
    joined = per.where("model_name is not null").withColumn("layers", layers).withColumn("_at", F.array_position("layers", key))
    top = F.array_max(F.transform(F.filter("layers", lambda x: x["a"] == key["a"]), lambda x: x["l"]))
    return joined.select(
        "model_name", "depth_label", "cells", "n_slots", "has_self", "has_cross", (F.col("arch") == "encoder").alias("is_encoder"), "layer",
        (F.col("layer") / F.greatest(top, F.lit(1))).alias("layer_share"),
        ((F.col("_at") - 1) / F.greatest(F.size("layers") - 1, F.lit(1))).alias("position_share"),
        F.size("layers").alias("n_layers"),
    )


def retain_slots(depth_feature: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of self and cross slots, and one row of counts: kept, other (must be 0)."""
    named = F.col("slot").rlike(r"^(self|cross)\.")
    return depth_feature.where(named), depth_feature.agg(F.count(F.when(named, 1)).alias("kept"), F.count(F.when(~named, 1)).alias("other"))


def sequence_validity(depth_feature: DataFrame, models: DataFrame) -> DataFrame:
    """model_name, n_layers, valid: whether a model has any layer."""
    per = depth_feature.groupBy("model_name").agg(F.count_distinct("depth_label").alias("n"))
    return models.select("model_name").distinct().join(per, "model_name", "left").select("model_name", F.coalesce("n", F.lit(0)).alias("n_layers"), F.col("n").isNotNull().alias("valid"))


def pool_layers(depth_feature: DataFrame) -> DataFrame:
    """model_name, slot, feature, mean, max over the model's present layers."""
    v = F.col("value").cast("double")
    return depth_feature.groupBy("model_name", "slot", "feature").agg(F.avg(v).alias("mean"), F.max(v).alias("max"))


def class_weights(rows: DataFrame, n_classes: int = 2) -> DataFrame:
    """class, n, weight = total / (present classes * n), 1 for absent ones; binary_pos_weight for two classes."""
    counts = {r.label: r.n for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("no labelled row")
    total = sum(counts.values())
    positive = counts[0] / counts[1] if n_classes == 2 and counts.get(0) and counts.get(1) else 1.0
    table = [(c, counts.get(c, 0), total / (len(counts) * counts[c]) if counts.get(c) else 1.0, positive) for c in range(n_classes)]
    return rows.sparkSession.createDataFrame(table, "class int, n long, weight double, binary_pos_weight double")


def rank_label_weights(rows: DataFrame) -> DataFrame:
    """rank, label, n, weight = total / (buckets * n)."""
    per = rows.where("label is not null").groupBy("rank", "label").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_t"), F.count("*").alias("_b"))
    return per.join(F.broadcast(total)).select("rank", "label", "n", (F.col("_t") / (F.col("_b") * F.col("n"))).alias("weight"))


def rank_domains(rows: DataFrame, source_rank: int = 256, inference: DataFrame | None = None) -> DataFrame:
    """rank, domain (source 0, others ascending), label, n, part: needs the source and another rank.

    inference(rank, label): rows that are only scored. Their ranks must be none of the training rows'
    and have no domain; they are counted apart.
    """
    ranks = sorted(r["rank"] for r in rows.select("rank").distinct().collect())
    if source_rank not in ranks or len(ranks) < 2:
        raise ValueError("the source rank and another are needed")
    order = [source_rank, *[r for r in ranks if r != source_rank]]
    domain = (F.array_position(F.array(*map(F.lit, order)), F.col("rank")) - 1).cast("int")
    counted = rows.groupBy("rank", domain.alias("domain"), "label").agg(F.count("*").alias("n")).withColumn("part", F.lit("train"))
    if inference is None:
        return counted
    shared = sorted(r["rank"] for r in inference.select("rank").distinct().where(F.col("rank").isin(ranks)).collect())
    if shared:
        raise ValueError(f"inference rows have ranks of training rows: {shared}")
    apart = inference.groupBy("rank", "label").agg(F.count("*").alias("n"))
    return counted.unionByName(apart.select("rank", F.lit(None).cast("int").alias("domain"), "label", "n", F.lit("inference").alias("part")))
