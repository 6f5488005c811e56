"""Detectors with MLlib, candidate search and selection.

Training tables have model_name, label (0 to k - 1; 0 is clean) and features (vector). scikit-style
penalties are turned into MLlib's: regParam = 1 / (C * sum of weights), no standardisation inside the
learner. Logistic, ridge and both SVMs see features scaled to mean 0 and population deviation 1;
trees see them as they are.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adapterlens.functions.rank import hash_order
from adapterlens.operators.metrics import auroc, backdoor_score, decision_outputs, margin_outputs, predicted_label
from adapterlens.operators.stages import KernelMap, Margins, Shares, Stacked, TreeVotes, flat_tree, load_stages, save_stages
from adapterlens.sources.shared import cut

#: Fits that run side by side.
PARALLEL = 4
#: Steps of an SVM fit at most, and of one on a kernel's many features.
SVM_STEPS, KERNEL_STEPS = 60, 250
# Axes of the registered candidate grids.
GRIDS = {
    "logistic": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "class_weight": ["none", "balanced"]},
    "ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "class_weight": ["none", "balanced"]},
    "linear_svm": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "class_weight": ["none", "balanced"]},
    "adaboost": {"max_depth": [1, 2], "n_estimators": [50, 100, 200, 400], "learning_rate": [0.05, 0.1, 0.5, 1.0]},
    "rbf_svm": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "gamma": ["scale", 0.01, 0.1, 1.0], "class_weight": ["none", "balanced"]},
    "random_forest": {"n_estimators": [200, 400, 800], "max_depth": [None, 8, 16], "min_leaf": [1, 2, 4], "class_weight": ["none", "balanced"]},
}


def candidate_grid(axes: dict[str, list]) -> list[dict]:
    """Candidates in key order with task_index; every axis needs values."""
    if not axes or any(not v for v in axes.values()):
        raise ValueError("every axis needs values")
    return [{"task_index": i, **dict(zip(axes, values, strict=True))} for i, values in enumerate(product(*axes.values()))]


def model_grid(model: str, axes: dict[str, list] | None = None) -> list[dict]:
    """Candidates of a registered model: of its own grid, or of other axes with exactly its keys."""
    own = GRIDS[model]
    if axes is not None and set(axes) != set(own):
        raise ValueError(f"the axes of {model} are {sorted(own)}")
    return candidate_grid({k: (axes or own)[k] for k in own})


def as_vectors(rows: DataFrame, column: str = "features") -> DataFrame:
    return rows.withColumn(column, array_to_vector(column))


def weighted(train: DataFrame, class_weight: str = "none") -> DataFrame:
    """Add weight: 1, or total / (classes * class size)."""
    if class_weight == "none":
        return train.withColumn("weight", F.lit(1.0))
    counts = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total, cases = sum(counts.values()), None
    for label, n in counts.items():
        w = total / (len(counts) * n)
        cases = F.when(F.col("label") == label, w) if cases is None else cases.when(F.col("label") == label, w)
    return train.withColumn("weight", cases)


def scaling(train: DataFrame) -> list:
    """Stages features -> scaled: less the mean, over the population deviation (1 where it is 0)."""
    found = train.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).select("s.variance", "s.count").first()
    share = (found["count"] - 1) / found["count"]
    by = [1 / math.sqrt(v * share) if v * share > 0 else 1.0 for v in found.variance]
    centre = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(train)
    return [centre, ElementwiseProduct(scalingVec=Vectors.dense(by), inputCol="centred", outputCol="scaled")]


def through(stages: list, rows: DataFrame) -> DataFrame:
    for s in stages:
        rows = s.transform(rows)
    return rows


def classes_of(train: DataFrame) -> int:
    """k of labels 0 to k - 1, all of which must occur."""
    seen = sorted(r.label for r in train.select("label").distinct().collect())
    if len(seen) < 2 or seen != list(range(len(seen))):
        raise ValueError(f"labels must be 0 to k - 1, each with rows, and two at least; they are {seen}")
    return len(seen)


class Scorer:
    """A fitted detector. `score(rows)` adds score (higher: more suspect) and predicted (a label).

    `output` is the column that the last steps leave. kind `probability`: shares by label. `margin`:
    one value, whose sign decides between two labels. `decision`, `softmax`: values by label, whose
    softmax gives the score.
    """

    def __init__(self, stages: list, output: str, kind: str):
        self.stages, self.output, self.kind = stages, output, kind

    def values(self, rows: DataFrame) -> DataFrame:
        """rows with all the columns that the steps add."""
        return through(self.stages, rows)

    def score(self, rows: DataFrame) -> DataFrame:
        outputs = {"margin": margin_outputs, "decision": decision_outputs, "softmax": decision_outputs, "probability": lambda v: (backdoor_score(v), predicted_label(v))}
        made = self.values(rows)
        kind = dict(made.dtypes)[self.output]
        value = vector_to_array(self.output) if kind == "vector" else F.col(self.output)
        score, predicted = outputs[self.kind](F.get("_values", F.lit(0)) if self.kind == "margin" and kind != "double" else F.col("_values"))
        return made.withColumn("_values", value).select(*[f"`{c}`" for c in rows.columns], score.alias("score"), predicted.alias("predicted"))


def train_logistic(train: DataFrame, C: float = 1.0, class_weight: str = "none") -> Scorer:
    classes_of(train)
    scale, rows = scaling(train), weighted(train, class_weight)
    total = rows.agg(F.sum("weight")).first()[0]
    fit = LogisticRegression(featuresCol="scaled", regParam=1 / (C * total), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=500, tol=1e-14)
    return Scorer([*scale, fit.fit(through(scale, rows))], "probability", "probability")


def train_ridge(train: DataFrame, alpha: float = 1.0, class_weight: str = "none") -> Scorer:
    """Least squares on -1 and 1 with an L2 penalty; the score is the fitted value. Of three labels or
    more, one fit each against the rest."""
    k, scale = classes_of(train), scaling(train)
    rows = through(scale, weighted(train, class_weight))
    weights = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    total = sum(weights.values())

    def fit(label: int):
        target = rows.withColumn("target", F.when(F.col("label") == label, 1.0).otherwise(-1.0))
        # MLlib divides the penalty by the target's deviation, so that is put in before.
        share = weights[label] / total
        penalty = alpha / total * 2 * math.sqrt(share * (1 - share))
        return LinearRegression(featuresCol="scaled", labelCol="target", predictionCol=f"r{label}", regParam=penalty, elasticNetParam=0.0, standardization=False, weightCol="weight", solver="normal").fit(target)

    if k == 2:
        return Scorer([*scale, fit(1)], "r1", "margin")
    return Scorer([*scale, *map(fit, range(k)), Stacked([f"r{c}" for c in range(k)])], "stacked", "decision")


def _margins(rows: DataFrame, features: str, label: int, C: float, total: float, steps: int = SVM_STEPS):
    """A linear SVM of one label against the others."""
    target = rows.withColumn("target", (F.col("label") == label).cast("double"))
    model = LinearSVC(featuresCol=features, labelCol="target", rawPredictionCol=f"raw{label}", predictionCol=f"p{label}", regParam=1 / (C * total), standardization=False, weightCol="weight", maxIter=steps)
    return model.fit(target)


def train_linear_svm(train: DataFrame, C: float = 1.0, class_weight: str = "none", seed: int = 42) -> Scorer:
    """Hinge loss; margins become probabilities by a logistic fit on margins of held-out halves. Of
    three labels or more, one fit each against the rest, and the shares are made to sum to 1."""
    k, scale = classes_of(train), scaling(train)
    rows = through(scale, weighted(train, class_weight))
    total = rows.agg(F.sum("weight")).first()[0]
    half = F.pmod(F.xxhash64(F.lit(seed), "model_name"), F.lit(2))
    labels = [1] if k == 2 else list(range(k))
    models, slopes, offsets = [], [], []
    for label in labels:
        held_out = None
        for part in (0, 1):
            model = _margins(rows.where(half != part), "scaled", label, C, total)
            margin = F.get(vector_to_array(f"raw{label}"), F.lit(1))
            held = model.transform(rows.where(half == part)).select((F.col("label") == label).cast("double").alias("label"), "weight", array_to_vector(F.array(margin)).alias("margin"))
            held_out = held if held_out is None else held_out.unionByName(held)
        platt = LogisticRegression(featuresCol="margin", weightCol="weight", maxIter=60).fit(held_out)
        models.append(_margins(rows, "scaled", label, C, total))
        slopes.append(float(platt.coefficients[0]))
        offsets.append(float(platt.intercept))
    return Scorer([*scale, *models, Margins([f"raw{c}" for c in labels]), Shares(slopes, offsets)], "shares", "probability")


def train_adaboost(train: DataFrame, n_estimators: int = 20, learning_rate: float = 1.0, max_depth: int = 1) -> Scorer:
    """SAMME: small trees on rows reweighted where the last one erred. Each round's weights are cut
    with a checkpoint, so that no round scores the trees before its last. The trees are kept as flat
    arrays, which one function walks: the plan of a scored table does not grow with them."""
    k = classes_of(train)
    rows = cut(train.select("label", "features", F.lit(1.0).alias("weight")))
    n, trees, alphas = rows.count(), [], []
    for i in range(n_estimators):
        tree = DecisionTreeClassifier(maxDepth=max_depth, weightCol="weight", predictionCol="p", rawPredictionCol="r", probabilityCol="q", seed=i).fit(rows)
        judged, erred = tree.transform(rows), F.col("p") != F.col("label")
        sums = judged.agg(F.sum(F.when(erred, F.col("weight")).otherwise(0.0)).alias("wrong"), F.sum("weight").alias("all")).first()
        wrong = min(max(sums.wrong / sums.all, 1e-10), 1 - 1e-10)
        if wrong >= 1 - 1 / k and trees:
            break
        alpha = learning_rate * (math.log((1 - wrong) / wrong) + math.log(k - 1))
        trees.append(flat_tree(tree, max_depth))
        alphas.append(alpha)
        if wrong <= 1e-10 or i == n_estimators - 1:
            break
        changed = F.col("weight") * F.when(erred, math.exp(alpha)).otherwise(1.0) * (n / sums.all)
        rows = cut(judged.select("label", "features", changed.alias("weight")))
    return Scorer([TreeVotes(*(list(x) for x in zip(*trees, strict=True)), alphas, k)], "votes", "softmax")


def landmarks_of(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """`n` different points of rows(model_name, scaled), all if there are no more: those first in the
    seeded hash order of their names. They come to the driver: n rows of bounded width."""
    chosen = rows.orderBy(hash_order(seed), "model_name").limit(n).select(vector_to_array("scaled").alias("x")).collect()
    return np.unique(np.array([r.x for r in chosen]), axis=0)


def train_rbf_svm(train: DataFrame, C: float = 1.0, gamma: str | float = "scale", class_weight: str = "none", n_landmarks: int = 512, seed: int = 42) -> Scorer:
    """A linear SVM on the RBF kernel through landmarks (KernelMap); gamma `scale` is 1 / (d * variance).
    Of three labels or more, one fit each against the rest. With no more rows than landmarks the
    kernel is exact; `kernel_gap` tells how far it is off."""
    k, scale = classes_of(train), scaling(train)
    rows, values = through(scale, weighted(train, class_weight)), vector_to_array("scaled")
    d = rows.select(F.size(values).alias("d")).first().d
    if gamma == "scale":
        gamma = 1 / (d * max(rows.select(F.explode(values).alias("x")).agg(F.var_pop("x")).first()[0], 1e-12))
    lift = KernelMap.through(landmarks_of(rows, n_landmarks, seed), float(gamma))
    total = rows.agg(F.sum("weight")).first()[0]
    mapped = cut(lift.transform(rows).select("label", "weight", "mapped"))
    labels = [1] if k == 2 else list(range(k))
    stages = [*scale, lift, *[_margins(mapped, "mapped", c, C, total, KERNEL_STEPS) for c in labels], Margins([f"raw{c}" for c in labels])]
    return Scorer(stages, "margins", "margin" if k == 2 else "decision")


def linear_objective(scorer: Scorer, train: DataFrame, loss: str, C: float, class_weight: str = "none", output: str = "raw1", features: str = "scaled") -> DataFrame:
    """One row, objective and gradient, of a fitted detector of two labels on its training rows: the mean of
    the losses plus the penalty, and for `logistic` the greatest part of the gradient, 0 at the optimum.

    The losses are taken from the scored rows, the penalty from the coefficients; `hinge` has no
    gradient everywhere, and its objective is held against the least one.
    """
    model = next(m for m in reversed(scorer.stages) if hasattr(m, "coefficients"))
    w = [float(x) for x in model.coefficients.toArray()]
    made = scorer.values(weighted(train, class_weight))
    margin = F.get(vector_to_array(output), F.lit(1))
    y, p = F.col("label").cast("double"), 1 / (1 + F.exp(-margin))
    total = F.sum("weight")
    each = F.greatest(1 - (2 * y - 1) * margin, F.lit(0.0)) if loss == "hinge" else F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - y * margin
    x = vector_to_array(features)
    parts = [F.sum(F.col("weight") * (p - y) * F.get(x, F.lit(i))) / total + F.lit(c / C) / total for i, c in enumerate(w)] if loss == "logistic" else []
    inner = [F.sum(F.col("weight") * (p - y)) / total, *parts] if parts else []
    gradient = F.greatest(*map(F.abs, inner)) if inner else F.lit(None).cast("double")
    return made.agg((F.sum(F.col("weight") * each) / total + F.lit(sum(c * c for c in w) / (2 * C)) / total).alias("objective"), gradient.alias("gradient"))


def kernel_gap(scorer: Scorer, rows: DataFrame) -> DataFrame:
    """model_name, gap of a fitted train_rbf_svm: the kernel of two rows is off by sqrt(gap * gap) at most."""
    mapped = F.aggregate(vector_to_array("mapped"), F.lit(0.0), lambda s, x: s + x * x)
    return scorer.values(rows).select("model_name", F.greatest(1 - mapped, F.lit(0.0)).alias("gap"))


def train_random_forest(train: DataFrame, n_estimators: int = 50, max_depth: int | None = 8, min_leaf: int = 1, class_weight: str = "none", seed: int = 42, bootstrap: bool = True) -> Scorer:
    """A forest; no depth means MLlib's greatest, 30. Without bootstrap each tree sees all rows."""
    classes_of(train)
    forest = RandomForestClassifier(bootstrap=bootstrap, numTrees=n_estimators, maxDepth=30 if max_depth is None else max_depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed)
    return Scorer([forest.fit(weighted(train, class_weight))], "probability", "probability")


def sequence_inputs(pooled: DataFrame, order: list[str]) -> DataFrame:
    """model_name, features: mean and max of every channel of pool_layers, gaps as 0, in the given order."""
    cell = F.concat_ws("::", "slot", "feature")
    parts = [F.coalesce(F.max(F.when(cell == c, F.col(v))), F.lit(0.0)) for c in order for v in ("mean", "max")]
    return pooled.groupBy("model_name").agg(array_to_vector(F.array(*parts)).alias("features"))


def train_sequence(train: DataFrame, C: float = 1.0) -> Scorer:
    """A logistic model over pooled layer sequences (sequence_inputs)."""
    return train_logistic(train, C)


TRAINERS = {"logistic": train_logistic, "ridge": train_ridge, "linear_svm": train_linear_svm, "adaboost": train_adaboost, "rbf_svm": train_rbf_svm, "random_forest": train_random_forest}
SEEDED = {"linear_svm", "rbf_svm", "random_forest"}
#: Detectors that scale their features themselves.
SCALED = {"logistic", "ridge", "linear_svm", "rbf_svm"}


def evaluate_candidates(data: DataFrame, folds: DataFrame, model: str, candidates: list[dict]) -> DataFrame:
    """fold_result(task_index, seed, fold, metric, status): every candidate on every fold of every seed,
    several at once; the metric is the area for clean against all other labels.

    data(model_name, label, features), folds(model_name, seed, fold). A fit that its parameters or
    its rows make impossible keeps its message; any other failure ends the search.
    """
    spark = data.sparkSession
    placed = data.join(folds.select("model_name", "seed", "fold"), "model_name").persist()
    jobs = sorted((r.seed, r.fold) for r in placed.select("seed", "fold").distinct().collect())

    def one(job: tuple[dict, tuple[int, int]]) -> tuple:
        candidate, (seed, fold) = job
        params = {k: v for k, v in candidate.items() if k != "task_index"} | ({"seed": seed} if model in SEEDED else {})
        rows, here = placed.where(F.col("seed") == seed), F.col("fold") == fold
        try:
            scored = TRAINERS[model](rows.where(~here).drop("seed", "fold"), **params).score(rows.where(here))
            value = auroc(scored.select((F.col("label") > 0).cast("int").alias("label"), "score")).first().auroc
            return candidate["task_index"], seed, fold, float(value) if value is not None else None, "ok"
        except (ValueError, IllegalArgumentException) as e:
            return candidate["task_index"], seed, fold, None, f"failed: {str(e)[:200]}"

    with ThreadPoolExecutor(PARALLEL) as pool:
        rows = list(pool.map(one, [(c, j) for c in candidates for j in jobs]))
    placed.unpersist()
    return spark.createDataFrame(rows, "task_index int, seed int, fold int, metric double, status string")


def summarize_candidates(fold_result: DataFrame) -> DataFrame:
    """task_index, n_folds, mean, std (population) over folds with a value."""
    ok = fold_result.where("metric is not null")
    return ok.groupBy("task_index").agg(F.count("*").alias("n_folds"), F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("std"))


def select_winner(candidates: DataFrame) -> DataFrame:
    """The row with the greatest mean, then least std (null last), complexity and task_index."""
    return candidates.where("mean is not null").orderBy(F.desc("mean"), F.asc_nulls_last("std"), "complexity", "task_index").limit(1)


def best_fold(fold_result: DataFrame) -> DataFrame:
    """The row with the greatest metric, then least group, fold and seed."""
    return fold_result.where("metric is not null").orderBy(F.desc("metric"), "grp", "fold", "seed").limit(1)


def refit_and_score(data: DataFrame, split: DataFrame, model: str, params: dict) -> tuple[Scorer, DataFrame]:
    """Fit on rows of role fit; prediction(model_name, label, role, score, predicted) of all."""
    placed = data.join(split.select("model_name", "role"), "model_name")
    scorer = TRAINERS[model](placed.where("role = 'fit'"), **params)
    return scorer, scorer.score(placed).select("model_name", "label", "role", "score", "predicted")


def save_contract(train: DataFrame, path: str, features: list[str], thresholds: dict[str, float], classes: list[str] | None = None, model: str = "logistic", **params) -> None:
    """A fitted detector of any kind, its scaling included, and its contract in a folder: feature names in
    order, how they are normalised, the classes (the first is clean) and the named thresholds."""
    k = classes_of(train)
    classes = classes or (["clean", "backdoored"] if k == 2 else [f"class{i}" for i in range(k)])
    if len(classes) != k:
        raise ValueError(f"{len(classes)} class names for {k} labels")
    scorer = TRAINERS[model](train, **params)
    save_stages(train.sparkSession, scorer.stages, f"{path}/model")
    row = (features, "standard_scaler" if model in SCALED else "none", classes, thresholds, model, scorer.output, scorer.kind)
    schema = "features array<string>, normalisation string, classes array<string>, thresholds map<string,double>, model string, output string, kind string"
    train.sparkSession.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/contract")


def infer_with_contract(path: str, rows: DataFrame, features: list[str], classes: list[str] | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """model_name, score, predicted (a class), flagged (by threshold) under a saved contract.

    The features, and the classes if given, must be those it names; with manifest(model_name), the
    rows must be exactly its models.
    """
    spark = rows.sparkSession
    contract = spark.read.parquet(f"{path}/contract").first()
    if list(contract.features) != features:
        raise ValueError("the features are not those of the contract")
    if classes is not None and list(contract.classes) != classes:
        raise ValueError("the classes are not those of the contract")
    if manifest is not None:
        have, want = rows.groupBy("model_name").count(), manifest.select("model_name").distinct().withColumn("wanted", F.lit(1))
        unfit = have.join(want, "model_name", "full").where("`count` is null or wanted is null or `count` > 1").count()
        if unfit:
            raise ValueError(f"{unfit} models are missing, repeated or not in the manifest")
    scored = Scorer(load_stages(spark, f"{path}/model"), contract.output, contract.kind).score(rows)
    flags = F.create_map(*[x for k, v in sorted(contract.thresholds.items()) for x in (F.lit(k), F.col("score") >= v)])
    return scored.select("model_name", "score", F.get(F.array(*map(F.lit, contract.classes)), F.col("predicted")).alias("predicted"), flags.alias("flagged"))


def tuning_report(candidates: DataFrame) -> DataFrame:
    """One row: n_ok, n_failed, failed (task indices), winner."""
    ok = F.col("status") == "ok"
    rank = F.struct("mean", (-F.coalesce("std", F.lit(math.inf))).alias("s"), (-F.col("complexity")).alias("c"), (-F.col("task_index")).alias("t"))
    return candidates.agg(
        F.count(F.when(ok, 1)).alias("n_ok"), F.count(F.when(~ok, 1)).alias("n_failed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~ok, F.col("task_index")))), lambda x: x.cast("string")), ",").alias("failed"),
        F.max_by("task_index", F.when(ok & F.col("mean").isNotNull(), rank)).alias("winner"),
    )
