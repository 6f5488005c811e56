"""Queries over detectors and candidate selection. Their SQL fits the same detectors on two features: by normal
equations, Newton steps, a narrowing grid, or split by split."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from adapterlens.operators import aggregate as A
from adapterlens.operators import inputs as I
from adapterlens.operators import models as M
from adapterlens.operators import splits as S
from adapterlens.plans.storing import scratch
from adapterlens.sources.shared import cut
from adapterlens.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = V.with_views(sql, *(needs or ("fx_prediction",)), more=more)
        return function

    return add


# Two features of all numbers of an embedding, for which a fit's optimum can be found in SQL: x sets the
# first two apart, with two more as noise, y sums the others. u and v are the same in whole steps.
PAIRS = """vec as (select 'v' || vec_id as model_name, cast(embedding[1] > embedding[2] as int) as label, embedding[1]::double - embedding[2]::double + embedding[3]::double + embedding[4]::double as a,
    list_sum(list_transform(embedding[5:64], lambda z: z::double)) as b from embeddings)"""
STEPS = ", steps as (select model_name, label, greatest(-9, least(9, floor(3 * a))) as u, greatest(-9, least(9, floor(b))) as v from vec)"


def pairs(spark, sf_dir):
    """model_name, label, features (two) of every embedding."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rest = F.aggregate(F.slice("embedding", 5, 60), F.lit(0.0), lambda t, z: t + z.cast("double"))
    rows = V.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("model_name"), (at(0) > at(1)).cast("int").alias("label"), F.array(at(0) - at(1) + at(2) + at(3), rest).alias("features"))
    return M.as_vectors(rows)


def steps(spark, sf_dir):
    """pairs in whole steps, few enough that trees try a threshold between any two."""
    held = lambda c: F.greatest(F.lit(-9.0), F.least(F.lit(9.0), F.floor(c).cast("double")))
    rows = pairs(spark, sf_dir).withColumn("x", vector_to_array("features"))
    return M.as_vectors(rows.withColumn("features", F.array(held(3 * F.get("x", F.lit(0))), held(F.get("x", F.lit(1))))).drop("x"))


def scaled_sql(source: str, name: str = "std", fit: str = "true", balanced: bool = False) -> str:
    """CTE: model_name, label, x, y, w; scaled as the rows of `fit` say, which alone have a weight."""
    own = lambda c: f"({c} - avg({c}) filter ({fit}) over ()) / stddev_pop({c}) filter ({fit}) over ()"
    weight = f"(count(*) filter ({fit}) over ()) / (2.0 * count(*) filter ({fit}) over (partition by label))" if balanced else "1.0"
    return f"{name} as materialized (select *, {own('a')} as x, {own('b')} as y, case when {fit} then {weight} else 0.0 end as w from {source})"


def newton_sql(C: float, rows: str = "std", n: int = 10) -> str:
    """CTEs up to `fitted`: the logistic fit (b0, b1, b2) with penalty 1 / C by n Newton steps from 0, and its
    objective. Each step solves three equations by determinants."""
    ctes = ["n0 as (select 0.0::double as b0, 0.0::double as b1, 0.0::double as b2)"]
    for k in range(n):
        ctes.append(f"""n{k + 1} as materialized (select b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d as b0,
    b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d as b1, b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d as b2
  from (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as d from (
    select b0, b1, b2, sum(w * (p - label)) as g0, sum(w * (p - label) * x) + b1 / {C} as g1, sum(w * (p - label) * y) + b2 / {C} as g2, sum(w * q) as h00, sum(w * q * x) as h01, sum(w * q * y) as h02,
      sum(w * q * x * x) + 1 / {C} as h11, sum(w * q * x * y) as h12, sum(w * q * y * y) + 1 / {C} as h22
    from (select *, p * (1 - p) as q from (select *, 1 / (1 + exp(-(b0 + b1 * x + b2 * y))) as p from {rows}, n{k})) group by b0, b1, b2)))""")
    ctes.append(f"fitted as materialized (select b0, b1, b2, (sum(w * (ln(1 + exp(-abs(m))) + greatest(m, 0) - label * m)) + (b1 * b1 + b2 * b2) / (2 * {C})) / sum(w) as objective from (select *, b0 + b1 * x + b2 * y as m from {rows}, n{n}) group by b0, b1, b2)")
    return ", ".join(ctes)


SHARE = "1 / (1 + exp(-(b0 + b1 * x + b2 * y)))"
LOGISTIC = f"select model_name, label, round({SHARE}, 4) as score, cast({SHARE} > 0.5 as int) as predicted, round(objective, 6) as objective from std, fitted"


def hinge_sql(C: float, rows: str = "std", n: int = 12) -> str:
    """CTEs up to `least`: the least objective of a linear SVM on x and y, by a grid of 9 values a side around the
    best point so far, whose width halves in each of n rounds."""
    ctes = ["g0 as (select 0.0::double as w1, 0.0::double as w2, 0.0::double as w0, 4.0::double as width)"]
    for k in range(n):
        ctes.append(f"""g{k + 1} as materialized (select w1, w2, w0, width / 2 as width from (select w1, w2, w0, width, (sum(w * greatest(1 - (2 * label - 1) * (w1 * x + w2 * y + w0), 0)) + (w1 * w1 + w2 * w2) / (2 * {C})) / sum(w) as o
    from {rows}, (select w1 + i * width / 4 as w1, w2 + j * width / 4 as w2, w0 + l * width / 4 as w0, width from g{k}, (select unnest(range(-4, 5)) as i), (select unnest(range(-4, 5)) as j), (select unnest(range(-4, 5)) as l)) group by w1, w2, w0, width order by o limit 1))""")
    ctes.append(f"least as (select (sum(w * greatest(1 - (2 * label - 1) * (w1 * x + w2 * y + w0), 0)) + (w1 * w1 + w2 * w2) / (2 * {C})) / sum(w) as objective from {rows}, g{n} group by w1, w2)")
    return ", ".join(ctes)


def split_cte(name: str, rows: str, where: str = "true") -> str:
    """CTE: f, t, ls, rs: the split of rows(label, w, u, v) that lowers the weighted impurity most, and the shares
    of label 1 on its sides; of equal ones the first feature's least threshold."""
    return f"""{name} as materialized (select f, t, l1 / lw as ls, (t1 - l1) / (tw - lw) as rs from (
    select f, (val + lead(val) over s) / 2 as t, sum(cw) over s as lw, sum(c1) over s as l1, sum(cw) over (partition by f) as tw, sum(c1) over (partition by f) as t1 from (
      select f, val, sum(w) as cw, sum(w * label) as c1 from (select 0 as f, u as val, w, label from {rows} where {where} union all select 1, v, w, label from {rows} where {where}) group by f, val)
    window s as (partition by f order by val)) where t is not null order by round((l1 * (lw - l1) / lw + (t1 - l1) * (tw - lw - t1 + l1) / (tw - lw)) / tw, 12), f, t limit 1)"""


SIDE = "(case when f = 0 then u else v end) > t"


@query("train_logistic", LOGISTIC, "fx_adapter", more=", ".join([PAIRS, scaled_sql("vec", balanced=True), newton_sql(1.0)]))
def _(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return with_objective(M.train_logistic(rows, 1.0, "balanced"), rows, 1.0, "balanced")


def with_objective(scorer, rows, C: float, class_weight: str = "none", fit: str = "true"):
    objective = M.linear_objective(scorer, rows.where(fit), "logistic", C, class_weight, output="rawPrediction").select(F.round("objective", 6).alias("objective"))
    return scorer.score(rows).select("model_name", "label", F.round("score", 4).alias("score"), "predicted").join(F.broadcast(objective))


@query(
    "train_linear_svm",
    "select model_name, label, (select round(objective, 4) from least) as objective from vec",
    "fx_adapter",
    more=", ".join([PAIRS, scaled_sql("vec", balanced=True), hinge_sql(1.0)]),
)
def _(spark, sf_dir):
    # scores go through a curve fitted on held-out halves; what is least by definition is the objective
    rows = pairs(spark, sf_dir)
    scorer = M.train_linear_svm(rows, 1.0, "balanced")
    objective = M.linear_objective(scorer, rows, "hinge", 1.0, "balanced").select(F.round("objective", 4).alias("objective"))
    return scorer.score(rows).where("score between 0 and 1").select("model_name", "label").join(F.broadcast(objective))


@query(
    "train_rbf_svm",
    "select model_name, label, round(greatest(1 - x * x - y * y, 0), 6) as gap, (select round(objective, 4) from least) as objective from lifted",
    "fx_adapter",
    more=", ".join([
        PAIRS, scaled_sql("vec"), "gamma as (select 1 / (2 * (var_pop(x) + var_pop(y)) / 2) as g from std)",
        "marks as (select max(x) filter (p = 1) as x1, max(y) filter (p = 1) as y1, max(x) filter (p = 2) as x2, max(y) filter (p = 2) as y2 from (select x, y, row_number() over (order by md5('42:' || model_name), model_name) as p from std))",
        "kernels as (select model_name, label, w, exp(-g * ((x - x1) ** 2 + (y - y1) ** 2)) as k1, exp(-g * ((x - x2) ** 2 + (y - y2) ** 2)) as k2, exp(-g * ((x1 - x2) ** 2 + (y1 - y2) ** 2)) as c from std, gamma, marks)",
        "lifted as materialized (select model_name, label, w, k1 as x, (k2 - c * k1) / sqrt(1 - c * c) as y from kernels)", hinge_sql(10.0, "lifted", 16),
    ]),
)
def _(spark, sf_dir):
    # two landmarks, for which the factor and the gap of every row fit into SQL; objectives do not depend on
    # which root of the kernel is taken
    rows = pairs(spark, sf_dir)
    scorer = M.train_rbf_svm(rows, 10.0, n_landmarks=2)
    objective = M.linear_objective(scorer, rows, "hinge", 10.0).select(F.round("objective", 4).alias("objective"))
    gaps = M.kernel_gap(scorer, rows).select("model_name", F.round("gap", 6).alias("gap"))
    return scorer.score(rows).select("model_name", "label").join(gaps, "model_name").join(F.broadcast(objective))


def boosted_sql(rounds: int) -> str:
    """CTEs r0 to r<rounds> with weights and summed votes of stumps: each round's best split, the classes of its
    sides, its error and vote, and the weights that follow."""
    ctes = ["r0 as (select *, 1.0::double as w, 0.0::double as vote, 0.0::double as whole from steps)"]
    for k in range(rounds):
        ctes.append(split_cte(f"s{k}", f"r{k}"))
        ctes.append(f"""r{k + 1} as materialized (select model_name, label, u, v, w * case when c <> label then exp(alpha) else 1 end as w, vote + case when c = 1 then alpha else -alpha end as vote, whole + abs(alpha) as whole
    from (select *, ln((1 - e) / e) as alpha from (select *, sum(case when c <> label then w else 0 end) over () / sum(w) over () as e from (select r.*, cast(case when {SIDE} then rs else ls end > 0.5 as int) as c from r{k} r, s{k}))))""")
    return ", ".join(ctes)


ROUNDS = 6


@query("train_adaboost", f"select model_name, label, round(1 / (1 + exp(-2 * vote / whole)), 6) as score, cast(vote > 0 as int) as predicted from r{ROUNDS}", "fx_adapter", more=PAIRS + STEPS + ", " + boosted_sql(ROUNDS))
def _(spark, sf_dir):
    rows = steps(spark, sf_dir)
    scored = M.train_adaboost(rows, n_estimators=ROUNDS, learning_rate=1.0, max_depth=1).score(rows)
    return scored.select("model_name", "label", F.round("score", 6).alias("score"), "predicted")


@query(
    "train_random_forest",
    """select model_name, label, round(share, 6) as score, cast(share > 0.5 as int) as predicted from (
      select d.model_name, d.label, case when d.upper and (h.ls > 0.5) = (h.rs > 0.5) then d.rs when d.upper then case when (case when h.f = 0 then u else v end) > h.t then h.rs else h.ls end
        when (l.ls > 0.5) = (l.rs > 0.5) then d.ls else case when (case when l.f = 0 then u else v end) > l.t then l.rs else l.ls end end as share from dealt d, lower_split l, upper_split h)""",
    "fx_adapter",
    more=PAIRS + STEPS + ", weighted as (select *, (count(*) over ()) / (2.0 * count(*) over (partition by label)) as w from steps), " + split_cte("top_split", "weighted") + f", dealt as materialized (select w.*, ls, rs, {SIDE} as upper from weighted w, top_split), " + split_cte("lower_split", "dealt", "not upper") + ", " + split_cte("upper_split", "dealt", "upper"),
)
def _(spark, sf_dir):
    # without bootstrap, and with both features at every node, the trees are one tree, of depth two; a node
    # whose leaves are of one class is a leaf
    rows = steps(spark, sf_dir)
    scored = M.train_random_forest(rows, n_estimators=3, max_depth=2, class_weight="balanced", bootstrap=False).score(rows)
    return scored.select("model_name", "label", F.round("score", 6).alias("score"), "predicted")


@query(
    "train_ridge",
    """select model_name, label, round(m + ((n + 1) * p - r * q) / ((n + 1) * (n + 1) - r * r) * x + ((n + 1) * q - r * p) / ((n + 1) * (n + 1) - r * r) * y, 6) as score
      from (select model_name, label, x, y, avg(t) over () as m, count(*) over () as n, sum(x * y) over () as r, sum(x * t) over () as p, sum(y * t) over () as q from (select *, 2.0 * label - 1 as t from std))""",
    "fx_adapter",
    more=PAIRS + ", " + scaled_sql("vec"),
)
def _(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return M.train_ridge(rows, alpha=1.0).score(rows).select("model_name", "label", F.round("score", 6).alias("score"))


#: The channel whose mean and greatest value over the layers are the two features of sequences.
CHANNEL = "self.q::energy"


@query(
    "train_sequence",
    LOGISTIC,
    "fx_feature",
    "fx_catalogue",
    more=", ".join([
        """vec as (select f.model_name, c.label, coalesce(avg(value) filter (ends_with(block, 'q_proj') and feature = 'energy'), 0)::double as a, coalesce(max(value) filter (ends_with(block, 'q_proj') and feature = 'energy'), 0)::double as b
        from fx_feature f join fx_catalogue c on c.model_name = f.model_name group by f.model_name, c.label)""",
        scaled_sql("vec"), newton_sql(1.0),
    ]),
)
def _(spark, sf_dir):
    pooled = I.pool_layers(A.layer_sequence(V.feature(spark, sf_dir), V.columns(spark, sf_dir)))
    rows = cut(M.sequence_inputs(pooled, [CHANNEL]).join(V.catalogue(spark, sf_dir).select("model_name", "label"), "model_name"))
    # parts of cells are small; the fit, which sums up part by part, takes four of them at a time
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, V.n_parts(spark, sf_dir) // 4))
    return with_objective(M.train_sequence(rows, 1.0), rows, 1.0)


@query("candidate_grid", "select cast(row_number() over (order by rank, attack_name) - 1 as int) as task_index, rank, attack_name from (select distinct rank from fx_prediction), (select distinct attack_name from fx_prediction)")
def _(spark, sf_dir):
    p = V.prediction(spark, sf_dir)
    axes = {"rank": sorted(r["rank"] for r in p.select("rank").distinct().collect()), "attack_name": sorted(r.attack_name for r in p.select("attack_name").distinct().collect())}
    return spark.createDataFrame(M.candidate_grid(axes), "task_index int, rank int, attack_name string")


# Every candidate of the ridge grid on two folds: weighted normal equations of the training rows, and the
# area on the others from average ranks.
RIDGE_FOLDS = """placed as (select v.*, cast((row_number() over (partition by label order by md5('42:' || model_name), model_name) - 1 + coalesce((select count(*) from vec p where p.label < v.label), 0)) % 2 as int) as fold from vec v),
  parts as (select p.*, f.held, p.fold <> f.held as train from placed p, (select cast(unnest(range(2)) as int) as held) f),
  moved as materialized (select model_name, label, held, train, (a - avg(a) filter (train) over o) / stddev_pop(a) filter (train) over o as x, (b - avg(b) filter (train) over o) / stddev_pop(b) filter (train) over o as y, 2.0 * label - 1 as t,
    (count(*) filter (train) over o) / (2.0 * count(*) filter (train) over (partition by held, label)) as balance from parts window o as (partition by held)),
  named as (select cast((i - 1) * 2 + balanced::int as int) as task_index, alpha, balanced from (select unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0]) as alpha, unnest(range(1, 7)) as i), (select unnest([false, true]) as balanced)),
  sums as (select task_index, held, alpha, balanced, sum(k) as n, sum(k * x) as sx, sum(k * y) as sy, sum(k * t) as st, sum(k * x * x) as sxx, sum(k * y * y) as syy, sum(k * x * y) as sxy, sum(k * x * t) as sxt, sum(k * y * t) as syt
    from (select *, case when balanced then balance else 1.0 end as k from moved, named where train) group by all),
  centred as (select task_index, held, sxx - sx * sx / n + alpha as p, syy - sy * sy / n + alpha as q, sxy - sx * sy / n as r, sxt - sx * st / n as u, syt - sy * st / n as v from sums),
  judged as (select task_index, m.held, label, ((q * u - r * v) * x + (p * v - r * u) * y) / (p * q - r * r) as score from moved m join centred c on c.held = m.held where not train),
  ranks as (select task_index, held, label, rank() over (partition by task_index, held order by score) + (count(*) over (partition by task_index, held, score) - 1) / 2.0 as place from judged)"""


@query(
    "evaluate_candidates",
    "select task_index, 42 as seed, held as fold, 'ok' as status, round((sum(place) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) as metric from ranks group by task_index, held",
    "fx_adapter",
    more=PAIRS + ", " + RIDGE_FOLDS,
)
def _(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    folds = S.kfold_stratified(rows.select("model_name", "label"), 2, [42])
    found = M.evaluate_candidates(rows, folds, "ridge", M.model_grid("ridge"))
    return found.select("task_index", "seed", "fold", "status", F.round("metric", 6).alias("metric"))


# fold results out of predictions: a candidate per attack, a fold per dataset and rank
FOLDS = "folds as (select cast(substr(attack_name, 7) as int) as task_index, cast(substr(dataset_group, 3) as int) as fold, rank as grp, cast(substr(attack_name, 7) as int) % 2 as complexity, avg(score) as metric from fx_prediction where user_bucket group by all)".replace(" where user_bucket", "")


def fold_results(spark, sf_dir):
    number = lambda c, at: F.substring(c, at, 9).cast("int")
    p = V.prediction(spark, sf_dir)
    rows = p.groupBy(number("attack_name", 7).alias("task_index"), number("dataset_group", 3).alias("fold"), F.col("rank").alias("grp")).agg(F.avg("score").alias("metric"))
    return rows.withColumn("complexity", F.col("task_index") % 2).withColumn("seed", F.lit(42))


SUMMARY = "summary as (select task_index, any_value(complexity) as complexity, count(*) as n_folds, avg(metric) as mean, stddev_pop(metric) as std from folds group by task_index)"


def summaries(spark, sf_dir):
    rows = fold_results(spark, sf_dir)
    return M.summarize_candidates(rows).withColumn("complexity", F.col("task_index") % 2)


@query("summarize_candidates", "select task_index, n_folds, round(mean, 9) as mean, round(std, 9) as std from summary", more=FOLDS + ", " + SUMMARY)
def _(spark, sf_dir):
    return M.summarize_candidates(fold_results(spark, sf_dir)).select("task_index", "n_folds", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("select_winner", "select task_index, round(mean, 9) as mean from summary order by summary.mean desc, std nulls last, complexity, task_index limit 1", more=FOLDS + ", " + SUMMARY)
def _(spark, sf_dir):
    return M.select_winner(summaries(spark, sf_dir)).select("task_index", F.round("mean", 9).alias("mean"))


@query("best_fold", "select task_index, fold, grp, round(metric, 9) as metric from folds order by folds.metric desc, grp, fold limit 1", more=FOLDS)
def _(spark, sf_dir):
    return M.best_fold(fold_results(spark, sf_dir)).select("task_index", "fold", "grp", F.round("metric", 9).alias("metric"))


@query("tuning_report", "select count(*) filter (task_index <> 2) as n_ok, count(*) filter (task_index = 2) as n_failed, '2' as failed, max_by(task_index, mean) filter (task_index <> 2) as winner from summary", more=FOLDS + ", " + SUMMARY)
def _(spark, sf_dir):
    status = F.when(F.col("task_index") == 2, "failed: no fit").otherwise("ok")
    return M.tuning_report(summaries(spark, sf_dir).withColumn("status", status))


FIT = "place <= n - greatest(1, least(n - 1, floor(n * 20 / 100.0 + 0.5)))"
CUT = "cut as (select *, row_number() over (partition by label order by md5('42:' || model_name), model_name) as place, count(*) over (partition by label) as n from vec)"


@query("refit_and_score", LOGISTIC.replace("label,", f"label, case when {FIT} then 'fit' else 'calibration' end as role,", 1), "fx_adapter", more=", ".join([PAIRS, CUT, scaled_sql("cut", fit=FIT), newton_sql(1.0)]))
def _(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    split = S.calibration_stratified(rows.select("model_name", "label"), 20, 42)
    scorer, scored = M.refit_and_score(rows, split, "logistic", {"C": 1.0})
    fit = rows.join(split.where("role = 'fit'").select("model_name"), "model_name", "left_semi")
    objective = M.linear_objective(scorer, fit, "logistic", 1.0, output="rawPrediction").select(F.round("objective", 6).alias("objective"))
    return scored.select("model_name", "label", "role", F.round("score", 4).alias("score"), "predicted").join(F.broadcast(objective))


CONTRACTS = {"logistic": {"C": 1.0}, "adaboost": {"n_estimators": 2}}


@query(
    "infer_with_contract",
    f"""select model_name, 'logistic' as model, round({SHARE}, 4) as score, case when {SHARE} > 0.5 then 'backdoored' else 'clean' end as predicted, {SHARE} >= 0.5 as even, {SHARE} >= 0.9 as strict from std, fitted
    union all select model_name, 'adaboost', round(score, 4), case when vote > 0 then 'backdoored' else 'clean' end, score >= 0.5, score >= 0.9 from (select *, 1 / (1 + exp(-2 * vote / whole)) as score from r2)""",
    "fx_adapter",
    more=", ".join([PAIRS + STEPS, scaled_sql("vec"), newton_sql(1.0), boosted_sql(2)]),
)
def _(spark, sf_dir):
    # a detector of MLlib's steps and one of steps of this library's, saved, read again and applied
    out = None
    for model, rows in (("logistic", pairs(spark, sf_dir)), ("adaboost", steps(spark, sf_dir))):
        path, names = scratch(spark), ["x", "y"]
        M.save_contract(rows, path, names, {"even": 0.5, "strict": 0.9}, model=model, **CONTRACTS[model])
        found = M.infer_with_contract(path, rows, names, ["clean", "backdoored"], rows.select("model_name"))
        flag = lambda k: F.try_element_at("flagged", F.lit(k))
        part = found.select("model_name", F.lit(model).alias("model"), F.round("score", 4).alias("score"), "predicted", flag("even").alias("even"), flag("strict").alias("strict"))
        out = part if out is None else out.unionByName(part)
    return out
