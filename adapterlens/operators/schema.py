"""Operators over block schemas: pairing, shapes, signatures, layouts, quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adapterlens.functions import names as N
from adapterlens.functions.rank import near_equal_part, ordered


def tensors_of(block_factor: DataFrame) -> DataFrame:
    """tensor(model_name, tensor_key, shape, values): one row per stored key of block_factor."""
    keys = F.array(
        F.struct(F.concat("block_raw", F.lit(".lora_A.weight")).alias("tensor_key"), F.array("r", "n").alias("shape"), F.col("a").alias("values")),
        F.struct(F.concat("block_raw", F.lit(".lora_B.weight")).alias("tensor_key"), F.array("m", "r").alias("shape"), F.col("b").alias("values")),
    )
    return block_factor.select("model_name", F.inline(keys))


def pair_factors(tensor: DataFrame) -> DataFrame:
    """block_factor of tensor: A and B of each block by one aggregation on (model, block), E if stored.

    Adds block_idx by the A key's order, and status: ok, missing A, missing B or rank mismatch.
    """
    parsed = tensor.select(
        "model_name",
        F.regexp_extract("tensor_key", r"^(.*)\.lora_([ABE])(\.weight)?$", 1).alias("block_raw"),
        F.regexp_extract("tensor_key", r"^(.*)\.lora_([ABE])(\.weight)?$", 2).alias("part"),
        "shape",
        "values",
    ).where("part <> ''")
    of = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    wide = parsed.groupBy("model_name", "block_raw").agg(*[of(p, c).alias(f"{p.lower()}_{c}") for p in "ABE" for c in ("shape", "values")])
    order = Window.partitionBy("model_name").orderBy("block_raw")
    return wide.select(
        "model_name",
        "block_raw",
        (F.row_number().over(order) - 1).alias("block_idx"),
        F.get("a_shape", F.lit(0)).alias("r"),
        F.get("a_shape", F.lit(1)).alias("n"),
        F.get("b_shape", F.lit(0)).alias("m"),
        F.col("a_values").alias("a"),
        F.col("b_values").alias("b"),
        F.col("e_values").alias("e"),
        F.when(F.col("a_values").isNull(), "missing A").when(F.col("b_values").isNull(), "missing B").when(F.get("a_shape", F.lit(0)) != F.get("b_shape", F.lit(1)), "rank mismatch").otherwise("ok").alias("status"),
    )


def qv_pairs(block_factor: DataFrame) -> DataFrame:
    """model_name, block_raw (of the sum), q_idx, v_idx, status per attention group."""
    role = N.qv_role(F.col("block_raw"))
    rows = block_factor.withColumn("qv", role).where("qv is not null")
    pick = lambda r, c: F.max(F.when(F.col("qv.role") == r, F.col(c)))
    count = lambda r: F.count(F.when(F.col("qv.role") == r, 1))
    wide = rows.groupBy("model_name", F.col("qv.group").alias("block_raw")).agg(
        pick("q", "block_idx").alias("q_idx"), pick("v", "block_idx").alias("v_idx"), count("q").alias("nq"), count("v").alias("nv"),
        F.min(F.struct("n", "m")).alias("lo"), F.max(F.struct("n", "m")).alias("hi"),
    )
    status = F.when((F.col("nq") > 1) | (F.col("nv") > 1), "duplicate role").when((F.col("nq") == 0) | (F.col("nv") == 0), "missing role").when(F.col("lo") != F.col("hi"), "dim mismatch").otherwise("ok")
    return wide.select("model_name", "block_raw", "q_idx", "v_idx", status.alias("status"))


def head_layout(block_factor: DataFrame) -> DataFrame:
    """Add head_dim and n_heads; status says why a block cannot be split: where the q and v blocks of an
    attention group both split but into different heads, neither can be."""
    width = N.head_width(F.col("block_raw"))
    rows = block_factor.withColumn("head_dim", width)
    fits = (F.col("m") > 0) & (F.col("m") % F.col("head_dim") == 0)
    status = F.when(F.col("head_dim").isNull(), "unknown layout").when(fits, "ok").otherwise("dim not divisible")
    rows = rows.withColumn("n_heads", F.when(fits, (F.col("m") / F.col("head_dim")).cast("int"))).withColumn("status", status)
    # A model's attention group has one q and one v block, so its windows are short.
    group = Window.partitionBy("model_name", F.coalesce(N.qv_role(F.col("block_raw"))["group"], F.col("block_raw")))
    layout = F.when(F.col("status") == "ok", F.struct("head_dim", "n_heads"))
    apart = F.min(layout).over(group) != F.max(layout).over(group)
    return rows.withColumn("status", F.when(apart, "q and v differ").otherwise(F.col("status")))


def _scale_length(block_factor: DataFrame):
    """Length of a block's scale vector (E), null where it has none."""
    return F.when(F.col("e").isNotNull(), F.size("e")) if "e" in block_factor.columns else F.lit(None).cast("int")


def schema_signature(block_factor: DataFrame, adaptive: bool | None = None) -> DataFrame:
    """model_name, signature: 12 hex digits of the digest of its sorted blocks and shapes.

    An adaptive signature leaves ranks out and says which blocks have a scale vector, so models that
    differ in rank alone share it. adaptive None: that of a model with a scale vector in any block is.
    """
    scale = _scale_length(block_factor)
    exact = F.concat_ws(":", "block_raw", F.col("r").cast("string"), F.col("n").cast("string"), F.col("m").cast("string"), scale.cast("string"))
    loose = F.concat_ws(":", "block_raw", F.lit("*"), F.col("n").cast("string"), F.col("m").cast("string"), F.when(scale.isNotNull(), "E"))
    digest = lambda c: F.substring(F.sha1(F.array_join(F.sort_array(F.collect_list(c)), "|")), 1, 12)
    own = F.when(F.count(scale) > 0, digest(loose)).otherwise(digest(exact))
    chosen = own if adaptive is None else digest(loose if adaptive else exact)
    return block_factor.groupBy("model_name").agg(chosen.alias("signature"))


def consensus_schema(block_factor: DataFrame) -> DataFrame:
    """block_raw, n, m, r, r_min, r_max, e_len, n_models: per block the sides and the rank that most models
    have, the least of equally frequent ones, and the range of ranks. A reference for check_schema."""
    rows = block_factor.select("block_raw", F.struct("n", "m", "r", _scale_length(block_factor).alias("e_len")).alias("dims"))
    counts = rows.groupBy("block_raw", "dims").agg(F.count("*").alias("c"))
    # Of equally frequent ones the least: numbers are negated, so that the greatest struct is the least.
    order = F.struct("c", (-F.col("dims.n")).alias("n"), (-F.col("dims.m")).alias("m"), (-F.col("dims.r")).alias("r"), (-F.coalesce("dims.e_len", F.lit(0))).alias("e"))
    per = counts.groupBy("block_raw").agg(F.max_by("dims", order).alias("d"), F.min("dims.r").alias("r_min"), F.max("dims.r").alias("r_max"), F.sum("c").alias("n_models"))
    return per.select("block_raw", "d.n", "d.m", "d.r", "r_min", "r_max", "d.e_len", "n_models")


def check_schema(block_factor: DataFrame, reference: DataFrame, adaptive: bool = False) -> DataFrame:
    """model_name, ok, reason of each model against reference(block_raw, r, n, m, and e or e_len if any).

    adaptive: ranks may differ, but both sides must be the reference's and a scale vector, which
    blocks have as the reference does, as long as the block's rank. The reference is one model's
    block list, bounded by its depth, and is broadcast.
    """
    length = F.col("e_len") if "e_len" in reference.columns else _scale_length(reference)
    ref = F.broadcast(reference.select("block_raw", *[F.col(c).alias(f"ref_{c}") for c in ("r", "n", "m")], length.alias("ref_e")))
    n_ref = reference.count()
    joined = block_factor.withColumn("_e", _scale_length(block_factor)).join(ref, "block_raw", "left")
    sides = F.col("ref_r").isNotNull() & (F.col("n") == F.col("ref_n")) & (F.col("m") == F.col("ref_m"))
    scaled = F.col("_e").isNotNull() == F.col("ref_e").isNotNull()
    same = sides & scaled if adaptive else sides & (F.col("r") == F.col("ref_r")) & F.col("_e").eqNullSafe(F.col("ref_e"))
    fits = F.coalesce(F.col("_e") == F.col("r"), F.lit(True)) if adaptive else F.lit(True)
    per = joined.groupBy("model_name").agg(
        F.count(F.when(F.col("ref_r").isNull(), 1)).alias("extra"), F.count(F.when(same, 1)).alias("same"), F.count("ref_r").alias("known"), F.count(F.when(~fits, 1)).alias("unfit"),
    )
    reason = (
        F.when(F.col("extra") > 0, "unexpected blocks").when(F.col("known") < n_ref, "missing blocks").when(F.col("same") < F.col("known"), "shape mismatch").when(F.col("unfit") > 0, "scale length").otherwise("ok")
    )
    return per.select("model_name", (reason == "ok").alias("ok"), reason.alias("reason"))


def schema_groups(adapter: DataFrame, signature: DataFrame, by_rank: bool = True) -> DataFrame:
    """Adapters per signature (and rank): n_models, n_clean, n_backdoor, n_unknown, first_model, place."""
    rows = adapter.join(signature, "model_name").withColumn("rank", N.parse_rank(F.col("model_name")) if by_rank else F.lit(None).cast("int"))
    count = lambda c: F.count(F.when(c, 1))
    label = F.col("label")
    groups = rows.groupBy("signature", "rank").agg(
        F.count("*").alias("n_models"), count(label == 0).alias("n_clean"), count(label == 1).alias("n_backdoor"), count(label.isNull()).alias("n_unknown"),
        F.min_by("model_name", "adapter_id").alias("first_model"), F.min("adapter_id").alias("first_id"),
    )
    return groups


def balanced_shards(rows: DataFrame, shards: int, group: list[str], order: str) -> DataFrame:
    """Add `shard`: contiguous parts per group, of which the first n % shards get one more.

    Places in the order are exact ranks by parts, so that no task holds a group.
    """
    placed = ordered(rows, group, order)
    return placed.withColumn("shard", near_equal_part(F.col("place"), F.col("n"), F.lit(shards))).drop("place", "n")


def qv_mode_fallback(block_factor: DataFrame, groups: DataFrame, mode: str) -> DataFrame:
    """Per group of groups(model_name, group): n_pairs, mode in force, status."""
    pairs = qv_pairs(block_factor).where("status = 'ok'").groupBy("model_name").agg(F.count("*").alias("n"))
    per = groups.join(pairs, "model_name", "left").groupBy("group").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    none = F.col("n_pairs") == 0
    used = F.when(none & (F.lit(mode) == "append"), "none").otherwise(mode)
    return per.select("group", "n_pairs", used.alias("mode"), F.when(none & (F.lit(mode) == "only"), "error").when(none & (F.lit(mode) == "append"), "warning").otherwise("ok").alias("status"))


def block_dims(block_factor: DataFrame) -> DataFrame:
    """model_name, block, m, n, r of every block and of every q+v sum with equal sides."""
    own = block_factor.select("model_name", F.col("block_raw").alias("block"), "m", "n", "r")
    sums = (
        block_factor.withColumn("qv", N.qv_role(F.col("block_raw"))).where("qv is not null").groupBy("model_name", F.col("qv.group").alias("block"))
        .agg(F.min("m").alias("m"), F.max("m").alias("m2"), F.min("n").alias("n"), F.max("n").alias("n2"), F.sum("r").cast("int").alias("r"), F.count("*").alias("k"))
        .where("k = 2 and m = m2 and n = n2").select("model_name", "block", "m", "n", "r")
    )
    return own.unionByName(sums)


def merge_block_dims(*dims: DataFrame) -> DataFrame:
    """block, m, n, r over all tables; conflict where they disagree."""
    rows = reduce(DataFrame.unionByName, [d.select("block", "m", "n", "r") for d in dims])
    dim = F.struct("m", "n", "r")
    return rows.groupBy("block").agg(F.min(dim).alias("lo"), F.max(dim).alias("hi")).select("block", "lo.m", "lo.n", "lo.r", (F.col("lo") != F.col("hi")).alias("conflict"))


def schema_layout_summary(block_factor: DataFrame, group: str) -> DataFrame:
    """Per group: layer count, number of (m, n, r), kind single, adaptive (ranks differ) or mixed, rank range."""
    rows = block_factor.withColumn("depth", N.layer_index(F.col("block_raw")))
    per = rows.groupBy(group).agg(
        F.size(F.collect_set("depth")).alias("n_layers"), F.size(F.collect_set(F.struct("m", "n", "r"))).alias("n_dims"), F.size(F.collect_set(F.struct("m", "n"))).alias("n_sides"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"),
    )
    return per.select(group, "n_layers", "n_dims", F.when(F.col("n_dims") == 1, "single").when(F.col("n_sides") == 1, "adaptive").otherwise("mixed").alias("kind"), "r_min", "r_max")


def resolved_qv_mode(feature: DataFrame, by: str) -> DataFrame:
    """Per table (<by>): none, only or append, from the blocks present."""
    is_sum = N.role_bucket(F.col("block")) == "qv_sum"
    return feature.groupBy(by).agg(F.bool_or(is_sum).alias("s"), F.bool_or(~is_sum).alias("o")).select(by, F.when(F.col("s") & F.col("o"), "append").when(F.col("s"), "only").otherwise("none").alias("mode"))


def quarantine(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split result(model_name, status, ...) into rows of good models and the list of bad ones.

    A model is bad if any of its rows is; reasons are joined in order.
    """
    bad = result.where("status <> 'ok'").groupBy("model_name").agg(F.array_join(F.sort_array(F.collect_set("status")), "; ").alias("reason"))
    return result.join(bad, "model_name", "left_anti"), bad


def merge_quarantine(*bad: DataFrame) -> DataFrame:
    """One entry per model: that of the last table that names it."""
    rows = reduce(DataFrame.unionByName, [b.select("model_name", "reason", F.lit(i).alias("pos")) for i, b in enumerate(bad)])
    return rows.groupBy("model_name").agg(F.max_by("reason", "pos").alias("reason"))
