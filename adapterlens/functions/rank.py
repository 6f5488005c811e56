"""Exact ranks and running sums without a window over all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adapterlens.sources.shared import cut


def hash_order(seed: int, name: str = "model_name") -> Column:
    """The shuffled order of names for a seed: the same on every engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)))


def ranked(rows: DataFrame, keys: list[str], seed: int, name: str = "model_name") -> DataFrame:
    """Add place (from 1) and n of each row in its group by `hash_order`, ties by name.

    Groups are cut by the first three digits of the hash (4096 parts). Rows are numbered in their
    part and lifted by the counts of the parts before, so a group of a third of all rows is still
    spread; what is windowed per group is one row per part.
    """
    parted = rows.withColumn("_h", hash_order(seed, name)).withColumn("_part", F.substring("_h", 1, 3))
    counts = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    place = Window.partitionBy(*keys, "_part").orderBy("_h", name)
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = parted.withColumn("_r", F.row_number().over(place)).join(offsets, same)
    return joined.withColumn("place", (F.col("_r") + F.col("_o")).cast("long")).drop("_h", "_part", "_p", "_r", "_o", *[f"_k_{k}" for k in keys])


def ordered(rows: DataFrame, keys: list[str], by: str, parts: int = 256) -> DataFrame:
    """Add place (from 1) and n of each row in its group by the number in column `by`, ties in any order.

    Numbers are cut at approximate quantiles over all rows (a few hundred numbers come to the
    driver); rows are numbered in their part and lifted by the counts of the group's parts before.
    """
    bounds = sorted(set(rows.select(F.col(by).cast("double").alias(by)).approxQuantile(by, [i / parts for i in range(1, parts)], 0.01)))
    edges = F.array(*map(F.lit, bounds)) if bounds else F.expr("cast(array() as array<double>)")
    parted = rows.withColumn("_part", F.size(F.filter(edges, lambda e: e <= F.col(by))))
    counts = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(by))
    joined = parted.withColumn("_r", place).join(offsets, same)
    return joined.withColumn("place", (F.col("_r") + F.col("_o")).cast("long")).drop("_part", "_p", "_r", "_o", *[f"_k_{k}" for k in keys])


def near_equal_part(place: Column, n: Column, k: Column) -> Column:
    """Part (from 0) of a place when n rows go into k contiguous parts, the first n % k one longer."""
    q, r = F.floor(n / k), n % k
    long = r * (q + 1)
    return F.when(place - 1 < long, F.floor((place - 1) / (q + 1))).otherwise(r + F.floor((place - 1 - long) / F.greatest(q, F.lit(1)))).cast("int")


def running(counts: DataFrame, by: list[str], score: str, sums: list[str], parts: int = 256) -> DataFrame:
    """Add `<sum>_from` per row of counts(by, score distinct, sums): totals over scores >= its own.

    Scores are cut at approximate quantiles (a few hundred numbers come to the driver); each part
    is summed in its own window, and the totals of higher parts, one row each, are added.
    """
    bounds = counts.approxQuantile(score, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    edges = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.expr("cast(array() as array<double>)")
    parted = counts.withColumn("_part", F.size(F.filter(edges, lambda e: e <= F.col(score))))
    totals = parted.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    above = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per part and group; cut, so that the join below is not one of a table with itself.
    lifted = cut(totals.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_a_{s}") for s in sums]))
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    out = parted
    for s in sums:
        out = out.withColumn(f"{s}_from", F.sum(s).over(inside))
    out = out.join(lifted, same)
    for s in sums:
        out = out.withColumn(f"{s}_from", F.col(f"{s}_from") + F.col(f"_a_{s}"))
    return out.drop("_part", "_p", *[f"_b_{b}" for b in by], *[f"_a_{s}" for s in sums])
