"""Queries over scores, metrics and thresholds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from adapterlens.operators import metrics as M
from adapterlens.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = V.with_views(sql, *(needs or ("fx_prediction",)), more=more)
        return function

    return add


def predictions(spark, sf_dir):
    return V.prediction(spark, sf_dir)


def rounded(df, *columns, digits=9):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


LOGITS = "logit as (select vec_id, label, embedding[1]::double * 40 as x, [embedding[1]::double, embedding[2]::double, embedding[3]::double] as e from embeddings)"


def logits(spark, sf_dir):
    e = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return V.read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.get("embedding", F.lit(0)).cast("double") * 40).alias("x"), e.alias("e"))


SOFT = "list_transform(e, lambda v: exp(v) / (exp(e[1]) + exp(e[2]) + exp(e[3])))"


@query("sigmoid_softmax", f"select vec_id, round(1 / (1 + exp(-x)), 9) as sigmoid, round({SOFT}[1], 9) as p0, round({SOFT}[3], 9) as p2 from logit", "fx_adapter", more=LOGITS)
def _(spark, sf_dir):
    p = M.softmax(F.col("e"))
    return rounded(logits(spark, sf_dir).select("vec_id", M.sigmoid(F.col("x")).alias("sigmoid"), F.get(p, F.lit(0)).alias("p0"), F.get(p, F.lit(2)).alias("p2")), "sigmoid", "p0", "p2")


@query("align_classes", "select vec_id, round(e[3], 6) as c0, 0.0::double as c1, round(e[1], 6) as c2, round(e[2], 6) as c3 from logit", "fx_adapter", more=LOGITS)
def _(spark, sf_dir):
    placed = M.align_classes(F.col("e"), F.array(F.lit(2), F.lit(3), F.lit(0)), 4)
    return logits(spark, sf_dir).select("vec_id", *[F.round(F.get(placed, F.lit(i)), 6).alias(f"c{i}") for i in range(4)])


@query("backdoor_score", f"select vec_id, round(1 - {SOFT}[1], 9) as score from logit", "fx_adapter", more=LOGITS)
def _(spark, sf_dir):
    return rounded(logits(spark, sf_dir).select("vec_id", M.backdoor_score(M.softmax(F.col("e"))).alias("score")), "score")


@query("predicted_label", "select vec_id, cast(list_position(e, list_max(e)) - 1 as int) as predicted from logit", "fx_adapter", more=LOGITS)
def _(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", M.predicted_label(F.col("e")).alias("predicted"))


def area_sql(source: str, by: str = "") -> str:
    key, part, group = (f"{by}, ", f"partition by {by}", f"group by {by}") if by else ("", "", "")
    return f"""select {key}sum(pos * (n - neg_from + neg / 2)) / nullif(any_value(p * n), 0) as auroc, sum(pos / p * pos_from / (pos_from + neg_from)) as auprc from (
      select *, sum(pos) over ({part} order by score desc) as pos_from, sum(neg) over ({part} order by score desc) as neg_from, sum(pos) over ({part}) as p, sum(neg) over ({part}) as n
      from (select {key}score, sum(label) as pos, sum(1 - label) as neg from {source} where label is not null group by {key}score)) {group}"""


@query("auroc", f"select round(auroc, 9) as auroc from ({area_sql('fx_prediction')})")
def _(spark, sf_dir):
    return rounded(M.auroc(predictions(spark, sf_dir)), "auroc")


@query("auprc", f"select dataset_group, round(auprc, 9) as auprc from ({area_sql('fx_prediction', 'dataset_group')})")
def _(spark, sf_dir):
    return rounded(M.auprc(predictions(spark, sf_dir), ["dataset_group"]), "auprc")


@query("multiclass_binary_auroc", f"select round(auroc, 9) as auroc from ({area_sql('multi')})", "fx_adapter", more=LOGITS + f", multi as (select case when label % 3 > 0 then 1 else 0 end as label, round(1 - {SOFT}[1], 12) as score from logit)")
def _(spark, sf_dir):
    rows = logits(spark, sf_dir).select((F.col("label") % 3).alias("target"), F.transform(M.softmax(F.col("e")), lambda p: F.round(p, 12)).alias("probabilities"))
    return rounded(M.multiclass_binary_auroc(rows), "auroc")


CONFUSION = "count(*) filter (label = 0 and score < {0}) as tn, count(*) filter (label = 0 and score >= {0}) as fp, count(*) filter (label = 1 and score < {0}) as fn, count(*) filter (label = 1 and score >= {0}) as tp"


@query(
    "confusion_at",
    "select dataset_group, threshold, tn, fp, fn, tp, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 9) as accuracy, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall from (select dataset_group, t::double as threshold, "
    + CONFUSION.format("t")
    + " from fx_prediction, (select unnest([0.3, 0.5, 0.9, 2.0]) as t) where label is not null group by dataset_group, t)",
)
def _(spark, sf_dir):
    return rounded(M.confusion_at(predictions(spark, sf_dir), [0.3, 0.5, 0.9, 2.0], ["dataset_group"]), "accuracy", "precision", "recall")


@query("threshold_candidates", "select distinct score as threshold, false as above_max from fx_prediction union all select max(score), true from fx_prediction")
def _(spark, sf_dir):
    return M.threshold_candidates(predictions(spark, sf_dir))


METRICS = """cum as (select score as threshold, false as above_max, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from (select score, sum(label) as pos, sum(1 - label) as neg from fx_prediction where label is not null group by score)
    union all select max(score), true, 0, 0 from fx_prediction where label is not null),
tot as (select sum(label) as p, sum(1 - label) as n from fx_prediction where label is not null),
met as (select threshold, above_max, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(p - tp as bigint) as fn, cast(n - fp as bigint) as tn, cast(p as bigint) as n_positive, cast(n as bigint) as n_negative,
  case when tp + fp > 0 then tp / (tp + fp) else 1 end as precision, tp / p as recall, fp / n as false_positive_rate, (n - fp) / n as specificity, (tp + n - fp) / (p + n) as accuracy, (tp / p + (n - fp) / n) / 2 as balanced_accuracy, (tp + fp) / (p + n) as fraction_flagged from cum, tot)"""
QUOTIENTS = ("precision", "recall", "false_positive_rate", "specificity", "accuracy", "balanced_accuracy", "f1", "fraction_flagged")


@query(
    "threshold_metrics",
    "select threshold, above_max, tp, fp, fn, tn, n_positive, n_negative, "
    + ", ".join(f"round({q}, 9) as {q}" for q in QUOTIENTS if q != "f1")
    + ", round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1 from met",
    more=METRICS,
)
def _(spark, sf_dir):
    return rounded(M.threshold_metrics(predictions(spark, sf_dir)), *QUOTIENTS)


SELECT = "select a as accepted_fpr, threshold, above_max, tp, fp, fn, tn, round(precision, 9) as precision, round(recall, 9) as recall, round(false_positive_rate, 9) as false_positive_rate from (select *, row_number() over (partition by a order by recall desc, false_positive_rate, precision desc, above_max desc, threshold desc) as place from met, (select unnest([0.0::double, 0.01, 0.05, 0.2]) as a) where false_positive_rate <= a + 1e-12) where place = 1"


def selected(spark, sf_dir):
    return M.select_threshold(M.threshold_metrics(predictions(spark, sf_dir)), [0.0, 0.01, 0.05, 0.2])


@query("select_threshold", SELECT, more=METRICS)
def _(spark, sf_dir):
    return rounded(selected(spark, sf_dir), "precision", "recall", "false_positive_rate")


@query(
    "apply_thresholds",
    "select kind, accepted_fpr, threshold, " + CONFUSION.format("threshold") + f" from fx_prediction, (select 'default' as kind, null::double as accepted_fpr, 0.5::double as threshold union all select 'calibrated', accepted_fpr, threshold from ({SELECT})) where label is not null group by kind, accepted_fpr, threshold",
    more=METRICS,
)
def _(spark, sf_dir):
    return M.apply_thresholds(predictions(spark, sf_dir), selected(spark, sf_dir))


BASE = "count(*) as total, count(label) as known, count(*) filter (label = 0) as clean, count(*) filter (label = 1) as backdoored, count(*) filter (label is null) as unknown, " + CONFUSION.format("0.5")


def evaluation_sql(source: str, by: str) -> str:
    return f"select b.*, round(a.auroc, 9) as auroc, round(a.auprc, 9) as auprc from (select {by}, {BASE} from {source} group by {by}) b left join ({area_sql(source, by)}) a on a.{by} = b.{by}"


COUNTS = "count(*) as total, count(label) as known, count(*) filter (label = 0) as clean, count(*) filter (label = 1) as backdoored, count(*) filter (label is null) as unknown"


@query(
    "evaluate_binary",
    f"""select b.*, round(a.auroc, 9) as auroc, round(a.auprc, 9) as auprc, t.* from (select {COUNTS} from fx_prediction) b, ({area_sql('fx_prediction')}) a,
    (select kind, accepted_fpr, threshold, {CONFUSION.format("threshold")} from fx_prediction, (select 'default' as kind, null::double as accepted_fpr, 0.5::double as threshold union all select 'calibrated', accepted_fpr, threshold from ({SELECT})) where label is not null group by kind, accepted_fpr, threshold) t""",
    more=METRICS,
)
def _(spark, sf_dir):
    return rounded(M.evaluate_binary(predictions(spark, sf_dir), calibrated=selected(spark, sf_dir)), "auroc", "auprc")


@query("evaluate_groups", evaluation_sql("fx_prediction", "dataset_group"))
def _(spark, sf_dir):
    return rounded(M.evaluate_groups(predictions(spark, sf_dir), "dataset_group"), "auroc", "auprc")


@query(
    "evaluate_attacks",
    evaluation_sql("spread", "attack_name"),
    more="spread as (select label, score, attack_name from fx_prediction where label = 1 or label is null union all select p.label, p.score, a.attack_name from fx_prediction p, (select distinct attack_name from fx_prediction where label = 1) a where p.label = 0)",
)
def _(spark, sf_dir):
    return rounded(M.evaluate_attacks(predictions(spark, sf_dir)), "auroc", "auprc")
