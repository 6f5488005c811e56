"""Operators over the adapter catalogue: identities, labels and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adapterlens.functions import names as N


def _fixed(df: DataFrame, **columns) -> DataFrame:
    """Add columns behind a generator, which the planner does not copy into what refers to them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_subsets(adapter: DataFrame) -> DataFrame:
    """Add subset and its stem tokens to adapter(model_dir, model_name, ...)."""
    named = _fixed(adapter, subset=N.subset_name(F.col("model_dir"), F.col("model_name")))
    return _fixed(named, stem=N.strip_rank_tokens(F.col("subset")))


def cohort_prefix(adapter: DataFrame, by: str) -> DataFrame:
    """Longest common token prefix of adapter(stem, <by>) per cohort: <by>, tokens.

    Tokens are compared place by place: partial aggregates, no row of the cohort meets another.
    """
    rows = adapter.where(F.size("stem") > 0)
    total = rows.groupBy(by).agg(F.count("*").alias("rows"))
    places = rows.select(by, F.posexplode("stem").alias("at", "token")).groupBy(by, "at").agg(F.min("token").alias("token"), F.max("token").alias("last"), F.count("*").alias("n"))
    judged = places.join(F.broadcast(total), by).withColumn("same", (F.col("token") == F.col("last")) & (F.col("n") == F.col("rows")))
    ordered = F.sort_array(F.collect_list(F.struct("at", "same", "token")))
    whole = F.transform(ordered, lambda x: x["same"])
    stop = F.array_position(whole, False)
    kept = F.when(stop > 0, F.slice(ordered, F.lit(1), (F.greatest(stop, F.lit(1)) - 1).cast("int"))).otherwise(ordered)
    return judged.groupBy(by).agg(kept.alias("kept")).select(by, F.transform("kept", lambda x: x["token"]).alias("tokens"))


def subset_label_flags(adapter: DataFrame) -> DataFrame:
    """subset, subset_has_clean, subset_has_backdoor."""
    has = lambda v: F.coalesce(F.bool_or(F.col("label") == v), F.lit(False))
    return adapter.groupBy("subset").agg(has(0).alias("subset_has_clean"), has(1).alias("subset_has_backdoor"))


def identities(adapter: DataFrame, prefix: list[str] | None = None) -> DataFrame:
    """All identity columns of adapter(model_dir, model_name, label): subset, family, attack, flags, groups."""
    rows = with_subsets(adapter)
    cohort = F.array(*map(F.lit, prefix)) if prefix else F.expr("cast(array() as array<string>)")
    rows = _fixed(rows, model_family=N.model_family(F.col("stem"), cohort), remainder=N.family_remainder(F.col("stem"), cohort))
    rows = rows.join(subset_label_flags(rows), "subset")
    attack = N.attack_name(F.col("remainder"), F.col("subset_has_clean") & F.col("subset_has_backdoor"))
    group, variant = N.dataset_group(F.col("subset"), F.col("model_family")), N.adapter_variant(F.col("subset"), F.col("model_family"))
    rows = _fixed(rows, attack=attack, dataset_group=group, variant=variant)
    return rows.select("*", F.col("attack.name").alias("attack_name"), F.col("attack.source").alias("attack_name_source")).drop("attack", "stem", "remainder")


def assert_unique_adapters(adapter: DataFrame, key: str = "model_name") -> DataFrame:
    """Report of repeated adapters: <key>, n; empty when all are unique."""
    return adapter.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_disjoint(train: DataFrame, infer: DataFrame, key: str = "model_name") -> DataFrame:
    """One row: train, infer, shared (counts of adapters) and ok: both sides have some, none is shared."""
    sides = train.select(key, F.lit(1).alias("t"), F.lit(0).alias("i")).unionByName(infer.select(key, F.lit(0).alias("t"), F.lit(1).alias("i")))
    per = sides.groupBy(key).agg(F.max("t").alias("t"), F.max("i").alias("i"))
    counts = per.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("train"), F.coalesce(F.sum("i"), F.lit(0)).alias("infer"), F.coalesce(F.sum(F.col("t") * F.col("i")), F.lit(0)).alias("shared"))
    return counts.withColumn("ok", F.expr("train > 0 and infer > 0 and shared = 0"))


def task_labels(adapter: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Add `target`: the binary label, or with classes (attack names in order) 0 for clean and the
    attack's place from 1; `ok` is false for a positive whose attack is not listed."""
    if classes is None:
        return adapter.withColumn("target", F.col("label")).withColumn("ok", F.lit(True))
    if set(classes) & {"clean", "unknown"} or len(set(classes)) < len(classes):
        raise ValueError("class names must be distinct, and neither clean nor unknown")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("attack_name")).cast("int")
    return adapter.withColumn("target", F.when(F.col("label") == 0, 0).when(F.col("label") == 1, F.nullif(place, F.lit(0)))).withColumn("ok", F.col("label").isNull() | F.col("target").isNotNull())


def project_binary(target: str = "target"):
    """0 for class 0 (clean), 1 for every other, null for unknown."""
    return F.when(F.col(target).isNull(), None).when(F.col(target) == 0, 0).otherwise(1)
