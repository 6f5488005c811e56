"""Exact evaluation: scores are counted once per distinct value, and sums run over those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adapterlens.functions.rank import running
from adapterlens.sources.shared import cut

EPS = 1e-12


def sigmoid(x: Column) -> Column:
    """Overflow-safe logistic function."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softmax(values: Column) -> Column:
    """Overflow-safe shares of array<double>."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def align_classes(values: Column, observed: Column, n: int, fill: float = 0.0) -> Column:
    """Scatter values of observed classes to places 0..n-1; `fill` elsewhere. A class out of range, or
    another number of values than classes, is an error."""
    bad = F.exists(observed, lambda c: (c < 0) | (c >= n)) | (F.size(observed) != F.size(values))
    message = F.raise_error(F.concat(F.lit("classes that do not fit: "), F.array_join(observed.cast("array<string>"), ","))).cast("array<double>")
    return F.when(F.coalesce(bad, F.lit(False)), message).otherwise(_placed(values, observed, n, fill))


def _placed(values: Column, observed: Column, n: int, fill: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.get(values, (F.array_position(observed, c) - 1).cast("int")), F.lit(fill)))


def backdoor_score(probabilities: Column) -> Column:
    """1 - P(clean); class 0 is clean."""
    return 1 - F.get(probabilities, F.lit(0))


def margin_outputs(margin: Column, negative: int = 0, positive: int = 1) -> tuple[Column, Column]:
    """(score, predicted) of a margin between two classes of which one is 0, clean: the margin turned
    towards the other, and the class on its side, the positive one at 0."""
    if 0 not in (negative, positive) or negative == positive:
        raise ValueError("one of two different classes must be 0")
    return (margin if negative == 0 else -margin), F.when(margin >= 0, positive).otherwise(negative)


def decision_outputs(values: Column) -> tuple[Column, Column]:
    """(score, predicted) of values by class: 1 - the softmax of class 0, and the greatest one's place."""
    return backdoor_score(softmax(values)), predicted_label(values)


def predicted_label(probabilities: Column) -> Column:
    """Place of the greatest value, the first of equal ones."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def score_counts(prediction: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg of labelled rows: one row per distinct score, partial sums first."""
    known = prediction.where("label is not null and score is not null")
    return known.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))


def _cumulated(prediction: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The counts of distinct scores and their sums from above. The counts are computed once and cut: the
    sums read them several times, and a detector's plan may be large."""
    counts = cut(score_counts(prediction, by))
    return counts, running(counts, by, "score", ["pos", "neg"])


def _grouped(df: DataFrame, by: list[str]):
    return df.groupBy(*by) if by else df.groupBy()


def auroc_auprc(prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, auroc, auprc: ties count half; average precision over distinct scores; null without both classes."""
    by = by or []
    counts, rows = _cumulated(prediction, by)
    totals = _grouped(counts, by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    joined = rows.join(totals.withColumnsRenamed({b: f"_b_{b}" for b in by}), same) if by else rows.join(F.broadcast(totals))
    p, n = F.col("_p"), F.col("_n")
    below = n - F.col("neg_from")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.first(F.nullif(p * n, F.lit(0)))
    precision = F.col("pos_from") / (F.col("pos_from") + F.col("neg_from"))
    average = F.when(F.first(p * n) > 0, F.sum(F.col("pos") / F.nullif(p, F.lit(0)) * precision))
    return _grouped(joined, by).agg(area.alias("auroc"), average.alias("auprc"))


def auroc(prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    return auroc_auprc(prediction, by).drop("auprc")


def auprc(prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    return auroc_auprc(prediction, by).drop("auroc")


def multiclass_binary_auroc(prediction: DataFrame) -> DataFrame:
    """auroc of prediction(target, probabilities): positives are all classes but 0, score 1 - P(clean)."""
    label = F.when(F.col("target").isNotNull(), (F.col("target") > 0).cast("int"))
    return auroc(prediction.select(label.alias("label"), backdoor_score(F.col("probabilities")).alias("score")))


def confusion_at(prediction: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """by, threshold, tn, fp, fn, tp, accuracy, precision, recall at score >= threshold; null where
    nothing is divided by."""
    known = prediction.where("label is not null").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, one = F.col("score") >= F.col("threshold"), F.col("label") == 1
    count = lambda c: F.count(F.when(c, 1))
    out = known.groupBy(*(by or []), "threshold").agg(count(~one & ~hit).alias("tn"), count(~one & hit).alias("fp"), count(one & ~hit).alias("fn"), count(one & hit).alias("tp"))
    ratio = lambda a, b: F.try_divide(F.expr(a), F.expr(b))
    return out.withColumn("accuracy", ratio("tp + tn", "tp + tn + fp + fn")).withColumn("precision", ratio("tp", "tp + fp")).withColumn("recall", ratio("tp", "tp + fn"))


def threshold_candidates(prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, threshold, above_max: every distinct score, and one place just above the greatest."""
    by = by or []
    scores = prediction.where("score is not null").select(*by, F.col("score").alias("threshold")).distinct().withColumn("above_max", F.lit(False))
    top = _grouped(scores, by).agg(F.max("threshold").alias("threshold")).withColumn("above_max", F.lit(True))
    return scores.unionByName(top.select(*by, "threshold", "above_max"))


def threshold_metrics(prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All measures at every candidate threshold, in one pass over distinct scores.

    Where nothing is flagged precision is 1; other quotients of nothing are 0. The row above the
    greatest score has above_max.
    """
    by = by or []
    counts, rows = _cumulated(prediction, by)
    rows = rows.select(*by, F.col("score").alias("threshold"), F.lit(False).alias("above_max"), F.col("pos_from").alias("tp"), F.col("neg_from").alias("fp"))
    totals = _grouped(counts, by).agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), F.max("score").alias("_max"))
    top = totals.select(*by, F.col("_max").alias("threshold"), F.lit(True).alias("above_max"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    all_ = rows.unionByName(top)
    joined = all_.join(totals.drop("_max"), by) if by else all_.join(F.broadcast(totals.drop("_max")))
    out = joined.withColumn("fn", F.expr("n_positive - tp")).withColumn("tn", F.expr("n_negative - fp"))
    zero = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    out = out.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.expr("tp + fp")), F.lit(1.0))).withColumn("recall", zero("tp", "n_positive"))
    out = out.withColumn("false_positive_rate", zero("fp", "n_negative")).withColumn("specificity", zero("tn", "n_negative")).withColumn("accuracy", zero("tp + tn", "n_positive + n_negative"))
    out = out.withColumn("balanced_accuracy", F.expr("(recall + specificity) / 2")).withColumn("f1", zero("2 * precision * recall", "precision + recall"))
    return out.withColumn("fraction_flagged", zero("tp + fp", "n_positive + n_negative"))


def select_threshold(metrics: DataFrame, fprs: list[float], by: list[str] | None = None) -> DataFrame:
    """by, accepted_fpr and the best row of threshold_metrics within it: greatest recall, least
    false-positive rate, greatest precision, greatest threshold."""
    wanted = list(dict.fromkeys(float(f) for f in fprs))
    if any(not 0 <= f <= 1 for f in wanted):
        raise ValueError("accepted rates lie in [0, 1]")
    rows = metrics.withColumn("accepted_fpr", F.explode(F.array(*map(F.lit, wanted)))).where(F.col("false_positive_rate") <= F.col("accepted_fpr") + EPS)
    order = F.struct("recall", (-F.col("false_positive_rate")).alias("f"), "precision", "above_max", "threshold")
    kept = ["threshold", "above_max", "tp", "fp", "fn", "tn", "precision", "recall", "false_positive_rate"]
    best = rows.groupBy(*(by or []), "accepted_fpr").agg(F.max_by(F.struct(*kept), order).alias("best"))
    return best.select(*(by or []), "accepted_fpr", "best.*")


def apply_thresholds(prediction: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """kind (default or calibrated), accepted_fpr, threshold and the confusion of prediction at each.

    thresholds(accepted_fpr, threshold) is one short row per accepted rate and comes to the driver.
    """
    chosen = [(None, default)] + [(r.accepted_fpr, r.threshold) for r in thresholds.select("accepted_fpr", "threshold").collect()]
    listed = F.explode(F.array(*[F.struct(F.lit(f).cast("double").alias("accepted_fpr"), F.lit(float(t)).alias("threshold")) for f, t in chosen]))
    known = prediction.where("label is not null").select("label", "score", listed.alias("t")).select("label", "score", "t.*")
    hit, one = F.col("score") >= F.col("threshold"), F.col("label") == 1
    count = lambda c: F.count(F.when(c, 1))
    out = known.groupBy("accepted_fpr", "threshold").agg(count(~one & ~hit).alias("tn"), count(~one & hit).alias("fp"), count(one & ~hit).alias("fn"), count(one & hit).alias("tp"))
    return out.select(F.when(F.col("accepted_fpr").isNull(), "default").otherwise("calibrated").alias("kind"), "*")


def evaluate_binary(prediction: DataFrame, by: list[str] | None = None, threshold: float = 0.5, calibrated: DataFrame | None = None) -> DataFrame:
    """by, total, known, clean, backdoored, unknown, auroc, auprc, tn, fp, fn, tp at the threshold.

    With calibrated(accepted_fpr, threshold), and no groups, one row for the threshold and one for
    each calibrated one, with kind, accepted_fpr and threshold.
    """
    by = by or []
    one, hit = F.col("label") == 1, F.col("score") >= threshold
    count = lambda c: F.count(F.when(c, 1))
    zero = F.col("label") == 0
    base = _grouped(prediction, by).agg(
        F.count("*").alias("total"), F.count("label").alias("known"), count(zero).alias("clean"), count(one).alias("backdoored"), count(F.col("label").isNull()).alias("unknown"),
        count(zero & ~hit).alias("tn"), count(zero & hit).alias("fp"), count(one & ~hit).alias("fn"), count(one & hit).alias("tp"),
    )
    areas = auroc_auprc(prediction, by)
    whole = base.join(areas, by, "left") if by else base.join(areas)
    if calibrated is None:
        return whole
    if by:
        raise ValueError("calibrated thresholds go without groups")
    return whole.drop("tn", "fp", "fn", "tp").join(apply_thresholds(prediction, calibrated, threshold))


def evaluate_groups(prediction: DataFrame, by: str) -> DataFrame:
    """evaluate_binary per group; empty when there is one group only."""
    out = evaluate_binary(prediction, [by])
    return out if out.select(by).distinct().count() > 1 else out.where("false")


def evaluate_attacks(prediction: DataFrame) -> DataFrame:
    """Per attack: its positives and unknowns with all clean rows; empty when there is one attack only.

    Clean rows are counted once per attack by an explode over the short list of attacks.
    """
    attacks = sorted(r.attack_name for r in prediction.where("label = 1").select("attack_name").distinct().collect())
    if len(attacks) < 2:
        return evaluate_binary(prediction, ["attack_name"]).where("false")
    clean = prediction.where("label = 0").withColumn("attack_name", F.explode(F.array(*map(F.lit, attacks))))
    own = prediction.where((F.col("label") == 1) | F.col("label").isNull()).where(F.col("attack_name").isin(attacks))
    return evaluate_binary(clean.unionByName(own), ["attack_name"])
