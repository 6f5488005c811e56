"""Leak-free splits. A split is a column of roles or folds; order is that of a seeded hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adapterlens.functions.rank import near_equal_part, ranked


def _share(n: Column, pct: int) -> Column:
    """floor(n * pct / 100 + 0.5), at least 1 and at most n - 1."""
    return F.greatest(F.lit(1), F.least(n - 1, F.floor(n * pct / F.lit(100.0) + 0.5)))


def guard_groups(rows: DataFrame, keys: list[str], least: int = 2, classes: int = 0) -> None:
    """An error if a group of `keys` has fewer than `least` rows, or there are fewer than `classes` labels.
    One row of figures comes to the driver."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("label").alias("_label"))
    small = F.when(F.col("_n") < least, F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    found = counts.agg(F.min(small).alias("small"), F.count(small).alias("n_small"), F.count_distinct("_label").alias("classes")).first()
    if found.classes < classes:
        raise ValueError(f"{classes} classes or more are needed; there are {found.classes}")
    if found.n_small:
        raise ValueError(f"{found.n_small} groups of {keys} have fewer than {least} rows, such as {found.small!r}")


def holdout(rows: DataFrame, keys: list[str], train_pct: int, seed: int, strict: bool = True, classes: int = 0) -> DataFrame:
    """Add partition (train, infer): the first share of each group trains; 100 % trains all.

    A group of one row cannot be split: that is an error, as are fewer than `classes` labels. If not
    strict, it trains. `adjusted` is true where the share was clamped.
    """
    if not 1 <= train_pct <= 100:
        raise ValueError("train_pct is 1 to 100")
    if train_pct == 100:
        return rows.withColumn("partition", F.lit("train")).withColumn("adjusted", F.lit(False))
    if strict:
        guard_groups(rows, keys, 2, classes)
    placed, n = ranked(rows, keys, seed), F.col("n")
    wanted = F.floor(n * train_pct / F.lit(100.0) + 0.5)
    train = (n < 2) | (F.col("place") <= _share(n, train_pct))
    return placed.withColumn("adjusted", (n < 2) | (wanted < 1) | (wanted > n - 1)).withColumn("partition", F.when(train, "train").otherwise("infer")).drop("place", "n")


def holdout_stratified(rows: DataFrame, train_pct: int, seed: int, strict: bool = True) -> DataFrame:
    """By label; two classes at least, each of two rows at least."""
    return holdout(rows, ["label"], train_pct, seed, strict, classes=2)


def holdout_folder_label(rows: DataFrame, train_pct: int, seed: int, folder: str = "folder", strict: bool = True) -> DataFrame:
    """By folder and label, each pair of two rows at least."""
    return holdout(rows, [folder, "label"], train_pct, seed, strict)


def calibration(rows: DataFrame, keys: list[str], pct: int, seed: int) -> DataFrame:
    """Add role (fit, calibration): the last share of each group calibrates; single rows fit."""
    placed, n = ranked(rows, keys, seed), F.col("n")
    late = (n >= 2) & (F.col("place") > n - _share(n, pct))
    return placed.withColumn("role", F.when(late, "calibration").otherwise("fit")).drop("place", "n")


def calibration_stratified(rows: DataFrame, pct: int, seed: int) -> DataFrame:
    return calibration(rows, ["label"], pct, seed)


def calibration_rank_label(rows: DataFrame, pct: int, seed: int) -> DataFrame:
    return calibration(rows, ["rank", "label"], pct, seed)


def calibration_folder_label(rows: DataFrame, pct: int, seed: int, folder: str = "folder") -> DataFrame:
    return calibration(rows, [folder, "label"], pct, seed)


def split_summary(rows: DataFrame, part: str, bucket: str) -> DataFrame:
    """<part>, <bucket>, n, n_clean, n_backdoor."""
    count = lambda v: F.count(F.when(F.col("label") == v, 1))
    return rows.groupBy(part, bucket).agg(F.count("*").alias("n"), count(0).alias("n_clean"), count(1).alias("n_backdoor"))


def sanitize_folds(rows: DataFrame, k: int) -> DataFrame:
    """One row: folds (1 if a class has one member, else k or the least class's size), min_count."""
    if k < 2:
        raise ValueError("two folds or more")
    least = rows.groupBy("label").count().agg(F.min("count").alias("min_count"))
    return least.select(F.when(F.col("min_count") < 2, 1).otherwise(F.least(F.lit(k), F.col("min_count"))).cast("int").alias("folds"), "min_count")


def kfold_stratified(rows: DataFrame, k: int, seeds: list[int], keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """model_name, seed, fold (in which the row validates; it trains in the others).

    A row's fold is its place in its class plus the class's offset, modulo k, so classes spread
    evenly and folds stay within one row of each other. Offsets are one short row per class.
    """
    from pyspark.sql import Window

    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    offsets = F.broadcast(sizes.select(*[F.col(c).alias(f"_o_{c}") for c in keys], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))
    out = None
    for seed in seeds:
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        one = ranked(rows, list(keys), seed).join(offsets, same)
        one = one.select("model_name", F.lit(seed).alias("seed"), ((F.col("place") - 1 + F.col("_offset")) % k).cast("int").alias("fold"))
        out = one if out is None else out.unionByName(one)
    return out


def strata_keys(rows: DataFrame, kind: str) -> DataFrame:
    """Add stratum: rank_<r>_label_<l> or folder_<f>_label_<l>; label alone if there are fewer than two
    buckets or one has fewer than two rows."""
    column = {"rank": "rank", "folder": "folder"}[kind]
    named = rows.withColumn("_s", F.concat_ws("_", F.lit(kind), F.col(column).cast("string"), F.lit("label"), F.col("label").cast("string")))
    ok = named.groupBy("_s").count().agg(F.count("*").alias("b"), F.min("count").alias("m")).select((F.expr("b >= 2 and m >= 2")).alias("_ok"))
    return named.join(F.broadcast(ok)).withColumn("stratum", F.when(F.col("_ok"), F.col("_s")).otherwise(F.concat(F.lit("label_"), F.col("label").cast("string")))).drop("_s", "_ok")


def kfold_leave_attack_out(rows: DataFrame, seed: int) -> DataFrame:
    """model_name, fold: positives validate in their attack's fold (attacks by name), clean rows in one
    of as many near-equal parts; each row trains in the other folds.

    Labels are 0 and 1; there are two attacks at least, and as many clean rows as attacks. A positive
    without an attack's name has the attack `unknown`.
    """
    rows = rows.withColumn("attack_name", F.coalesce("attack_name", F.lit("unknown")))
    found = rows.agg(F.count(F.when(F.col("label") == 0, 1)).alias("clean"), F.count(F.when(F.col("label").isNull() | ~F.col("label").isin(0, 1), 1)).alias("other"), F.count_distinct(F.when(F.col("label") == 1, F.col("attack_name"))).alias("attacks")).first()
    if found.other:
        raise ValueError(f"{found.other} rows have another label than 0 and 1")
    if found.attacks < 2:
        raise ValueError("two attacks or more")
    if found.clean < found.attacks:
        raise ValueError(f"a clean row for each fold is needed; there are {found.clean} for {found.attacks} attacks")
    attacks = sorted(r.attack_name for r in rows.where("label = 1").select("attack_name").distinct().collect())
    place = F.array_position(F.array(*map(F.lit, attacks)), F.col("attack_name")).cast("int") - 1
    positive = rows.where("label = 1").select("model_name", place.alias("fold"))
    clean = ranked(rows.where("label = 0"), ["label"], seed)
    return positive.unionByName(clean.select("model_name", near_equal_part(F.col("place"), F.col("n"), F.lit(len(attacks))).alias("fold")))


def kfold_leave_dataset_out(rows: DataFrame) -> DataFrame:
    """dataset_group, fold, n_valid, valid_classes, ok: one fold per dataset; both sides need two classes."""
    from pyspark.sql import Window

    per = rows.groupBy("dataset_group").agg(F.count("*").alias("n_valid"), F.count_distinct("label").alias("valid_classes"))
    groups = rows.groupBy("label").agg(F.count_distinct("dataset_group").alias("g"), F.min("dataset_group").alias("only"))
    alone = groups.where("g = 1").select(F.col("only").alias("dataset_group")).distinct().withColumn("_lost", F.lit(True))  # a class lives in this dataset alone
    n_classes = rows.select("label").distinct().count()
    fold = (F.row_number().over(Window.orderBy("dataset_group")) - 1).alias("fold")  # one row per dataset
    ok = (F.col("valid_classes") >= 2) & (F.col("_lost").isNull() | (F.lit(n_classes) > 2))
    return per.join(alone, "dataset_group", "left").select("dataset_group", fold, "n_valid", "valid_classes", ok.alias("ok"))


def pin_always_train(folds: DataFrame, pinned: DataFrame, k: int) -> DataFrame:
    """model_name, fold, role over all k folds; pinned rows leave the pool and train in every fold."""
    pool = folds.join(pinned.select("model_name"), "model_name", "left_anti")
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("at")
    rows = pool.select("model_name", "fold", each).select("model_name", F.col("at").alias("fold"), F.when(F.col("at") == F.col("fold"), "valid").otherwise("train").alias("role"))
    return rows.unionByName(pinned.select("model_name", each).select("model_name", F.col("at").alias("fold"), F.lit("train").alias("role")))


def reconcile_sections(train: DataFrame, infer: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """model_name, section, status of explicit manifests(model_name), decided in one aggregation.

    status: ok, overlap (in both), repeated (more than once in its section), and with a complete
    manifest `not in manifest` and `missing` (in neither, without a section).
    """
    parts = {"train": train, "infer": infer} | ({"complete": complete} if complete is not None else {})
    rows = reduce(DataFrame.unionByName, [df.select("model_name", F.lit(name).alias("_part")) for name, df in parts.items()])
    n = {name: F.count(F.when(F.col("_part") == name, 1)) for name in ("train", "infer", "complete")}
    per = rows.groupBy("model_name").agg(*[c.alias(f"n_{name}") for name, c in n.items()])
    unlisted = (F.col("n_complete") == 0) if complete is not None else F.lit(False)
    status = (
        F.when((F.col("n_train") > 0) & (F.col("n_infer") > 0), "overlap").when((F.col("n_train") > 1) | (F.col("n_infer") > 1), "repeated")
        .when(F.col("n_train") + F.col("n_infer") == 0, "missing").when(unlisted, "not in manifest").otherwise("ok")
    )
    section = F.when(F.col("n_train") > 0, "train").when(F.col("n_infer") > 0, "infer")
    return per.select("model_name", section.alias("section"), status.alias("status"))


def materialize_split(manifest: DataFrame | None, pct: int | None = None, seed: int = 0, train: DataFrame | None = None, infer: DataFrame | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """model_name, section, status of a complete manifest(model_name, label) cut by label share, or of
    explicit manifests, reconciled with the complete one if there is one.

    A share is 1 to 99 and goes without pinned rows, which need explicit manifests. A row without a
    label has status `unlabelled` and no section. `checked_split` makes any status but ok an error.
    """
    explicit = train is not None or infer is not None
    if explicit and (train is None or infer is None):
        raise ValueError("explicit manifests come in pairs")
    if explicit == (pct is not None):
        raise ValueError("either a share or explicit manifests")
    if explicit:
        return reconcile_sections(train, infer, manifest)
    if not 1 <= pct <= 99:
        raise ValueError("the share is 1 to 99")
    if pinned is not None:
        raise ValueError("rows that always train need explicit manifests")
    known = holdout_stratified(manifest.where("label is not null"), pct, seed).select("model_name", F.col("partition").alias("section"), F.lit("ok").alias("status"))
    unknown = manifest.where("label is null").select("model_name", F.lit(None).cast("string").alias("section"), F.lit("unlabelled").alias("status"))
    return known.unionByName(unknown)


def checked_split(split: DataFrame) -> DataFrame:
    """The split itself, if all its rows are ok and neither section is empty; else an error."""
    found = {(r.section, r.status): r["count"] for r in split.groupBy("section", "status").count().collect()}
    bad = {status: n for (_, status), n in found.items() if status != "ok"}
    if bad:
        raise ValueError(f"rows that do not fit: {dict(sorted(bad.items()))}")
    if empty := [s for s in ("train", "infer") if (s, "ok") not in found]:
        raise ValueError(f"empty sections: {empty}")
    return split


def partition_plan(rows: DataFrame, train_pct: int, calibration_pct: int, seed: int, by: str = "label") -> DataFrame:
    """Add role: fit, calibration or inference. by: label, folder (folder and label) or rank (rank and label)."""
    keys = {"label": ["label"], "folder": ["folder", "label"], "rank": ["rank", "label"]}[by]
    held = holdout(rows, ["folder", "label"] if by == "folder" else ["label"], train_pct, seed).drop("adjusted")
    train = calibration(held.where("partition = 'train'"), keys, calibration_pct, seed + 1)
    return train.unionByName(held.where("partition = 'infer'").withColumn("role", F.lit("inference"))).drop("partition")
