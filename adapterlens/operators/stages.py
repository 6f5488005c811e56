"""Fitted steps of detectors that MLlib has none of: each adds one column, and has a state that JSON holds."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.operators.metrics import sigmoid


class TreeVotes:
    """votes: by class, the weighted votes of small trees on `features`.

    Trees are whole binary trees of one depth as flat arrays: per inner node the feature and the
    threshold (greater goes right), per leaf the class. All trees of a batch are walked level by level.
    """

    name, output = "tree_votes", "votes"

    def __init__(self, features: list, thresholds: list, leaves: list, weights: list, k: int):
        self.features, self.thresholds, self.leaves = np.array(features, np.int64), np.array(thresholds, float), np.array(leaves, np.int64)
        self.weights, self.k = np.array(weights, float), k

    def state(self) -> dict:
        # JSON has no infinity; a place without a split is null
        thresholds = [[None if np.isinf(t) else t for t in row] for row in self.thresholds.tolist()]
        return {"features": self.features.tolist(), "thresholds": thresholds, "leaves": self.leaves.tolist(), "weights": self.weights.tolist(), "k": self.k}

    @classmethod
    def of(cls, state: dict) -> TreeVotes:
        return cls(**(state | {"thresholds": [[np.inf if t is None else t for t in row] for row in state["thresholds"]]}))

    def votes(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes) of x(rows, features)."""
        trees, node = np.arange(len(self.weights)), np.zeros((len(x), len(self.weights)), np.int64)
        inner = self.features.shape[1]
        while inner and node[0, 0] < inner:
            at = self.features[trees, node]
            node = 2 * node + 1 + (np.take_along_axis(x, at, axis=1) > self.thresholds[trees, node])
        chosen = self.leaves[trees, node - inner]
        whole = max(np.abs(self.weights).sum(), 1e-12)
        own = np.stack([np.where(chosen == c, self.weights, 0.0).sum(axis=1) for c in range(self.k)], axis=1) / whole
        others = (self.weights.sum() / whole - own) / (self.k - 1)
        return (own - others) / (self.k - 1)

    def transform(self, rows: DataFrame) -> DataFrame:
        votes = self.votes

        @F.pandas_udf("array<double>")
        def run(x):
            import pandas as pd

            blocks = [votes(np.stack(x.to_numpy()[i : i + 2048])) for i in range(0, len(x), 2048)]
            return pd.Series(list(np.concatenate(blocks)) if blocks else [])

        return rows.withColumn(self.output, run(vector_to_array("features")))


def flat_tree(model, depth: int) -> tuple[list[int], list[float], list[int]]:
    """A fitted decision tree as arrays of a whole tree of `depth`. A node that is a leaf before sends
    all rows left, to leaves of its class."""
    features, thresholds, leaves = [0] * (2**depth - 1), [float("inf")] * (2**depth - 1), [0] * 2**depth

    def walk(node, place: int, left: int) -> None:
        if left == 0:
            leaves[place - (2**depth - 1)] = int(node.prediction())
            return
        if node.getClass().getSimpleName() == "InternalNode":
            features[place], thresholds[place] = int(node.split().featureIndex()), float(node.split().threshold())
            walk(node.leftChild(), 2 * place + 1, left - 1)
            walk(node.rightChild(), 2 * place + 2, left - 1)
        else:
            walk(node, 2 * place + 1, left - 1)
            walk(node, 2 * place + 2, left - 1)

    walk(model._java_obj.rootNode(), 0, depth)
    return features, thresholds, leaves


class KernelMap:
    """mapped: features of the RBF kernel exp(-gamma |x - y|^2) through landmarks (Nystroem).

    With K the kernel between landmarks, a row maps to its kernels with the landmarks times
    K^(-1/2). What a row's own kernel, 1, lacks of its squared length is its `gap`; the kernel of two
    rows is off by the root of the product of their gaps at most.
    """

    name, output = "kernel_map", "mapped"

    def __init__(self, landmarks: list, factor: list, gamma: float):
        self.landmarks, self.factor, self.gamma = np.array(landmarks, float), np.array(factor, float), float(gamma)

    def state(self) -> dict:
        return {"landmarks": self.landmarks.tolist(), "factor": self.factor.tolist(), "gamma": self.gamma}

    @classmethod
    def of(cls, state: dict) -> KernelMap:
        return cls(**state)

    @classmethod
    def through(cls, landmarks: np.ndarray, gamma: float) -> KernelMap:
        """The factor is solved once; directions that the landmarks do not span are left out."""
        values, axes = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
        kept = values > 1e-10 * values.max()
        return cls(landmarks, axes[:, kept] / np.sqrt(values[kept]), gamma)

    def transform(self, rows: DataFrame) -> DataFrame:
        landmarks, factor, gamma = self.landmarks, self.factor, self.gamma

        @F.pandas_udf("array<double>")
        def run(x):
            import pandas as pd

            blocks = [kernel(np.stack(x.to_numpy()[i : i + 2048]), landmarks, gamma) @ factor for i in range(0, len(x), 2048)]
            return pd.Series(list(np.concatenate(blocks)) if blocks else [])

        return rows.withColumn(self.output, array_to_vector(run(vector_to_array("scaled"))))


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    far = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(far, 0))


class Margins:
    """margins: the second numbers of raw outputs, which are the margins of their classes."""

    name, output = "margins", "margins"

    def __init__(self, columns: list[str]):
        self.columns = columns

    def state(self) -> dict:
        return {"columns": self.columns}

    @classmethod
    def of(cls, state: dict) -> Margins:
        return cls(**state)

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.output, F.array(*[F.get(vector_to_array(c), F.lit(1)) for c in self.columns]))


class Shares:
    """shares: margins as probabilities by class, through a logistic curve each; of two classes one
    margin, of more they are made to sum to 1."""

    name, output = "shares", "shares"

    def __init__(self, slopes: list[float], offsets: list[float]):
        self.slopes, self.offsets = slopes, offsets

    def state(self) -> dict:
        return {"slopes": self.slopes, "offsets": self.offsets}

    @classmethod
    def of(cls, state: dict) -> Shares:
        return cls(**state)

    def transform(self, rows: DataFrame) -> DataFrame:
        each = [sigmoid(s * F.get("margins", F.lit(i)) + o) for i, (s, o) in enumerate(zip(self.slopes, self.offsets, strict=True))]
        if len(each) == 1:
            return rows.withColumn(self.output, F.array(1 - each[0], each[0]))
        whole = sum(each[1:], each[0])
        return rows.withColumn(self.output, F.array(*[x / whole for x in each]))


class Stacked:
    """<output>: columns of numbers as one array."""

    name = "stacked"

    def __init__(self, columns: list[str], output: str = "stacked"):
        self.columns, self.output = columns, output

    def state(self) -> dict:
        return {"columns": self.columns, "output": self.output}

    @classmethod
    def of(cls, state: dict) -> Stacked:
        return cls(**state)

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.output, F.array(*self.columns))


OWN = {c.name: c for c in (TreeVotes, KernelMap, Margins, Shares, Stacked)}


def save_stages(spark: SparkSession, stages: list, path: str) -> None:
    """Steps in order: runs of MLlib's as pipelines, the others by name and state in one table."""
    rows = []
    for i, stage in enumerate(stages):
        own = type(stage) in OWN.values()
        if not own:
            PipelineModel([stage]).write().overwrite().save(f"{path}/{i}")
        rows.append((i, stage.name if own else None, json.dumps(stage.state()) if own else None))
    spark.createDataFrame(rows, "place int, name string, state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")


def load_stages(spark: SparkSession, path: str) -> list:
    steps = spark.read.parquet(f"{path}/steps").orderBy("place").collect()
    return [OWN[r.name].of(json.loads(r.state)) if r.name else PipelineModel.load(f"{path}/{r.place}") for r in steps]
