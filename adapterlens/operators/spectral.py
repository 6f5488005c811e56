"""Spectral operators over block factors: delta = B A, one row per (model, block).

Rows are independent, so Spark deals them; two small kernels (QR and SVD, and power sums of a
chunk of columns) run inside tasks over Arrow batches. All else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adapterlens.functions import names as N
from adapterlens.functions import spectral as X

#: Entries of a delta that are formed at once.
CHUNK_ENTRIES = 131_072


def effective_factors(block_factor: DataFrame) -> DataFrame:
    """A with row i scaled by e[i] where a block has e; status tells of a wrong length."""
    wrong = F.col("e").isNotNull() & (F.size("e") != F.col("r"))
    scaled = F.transform("a", lambda x, i: x * F.get("e", F.floor(i / F.col("n")).cast("int")))
    return block_factor.withColumn("status", F.when(wrong, "scale length").otherwise("ok")).withColumn("a", F.when(F.col("e").isNull() | wrong, F.col("a")).otherwise(scaled))


def qv_sum_factors(block_factor: DataFrame, mode: str = "append") -> DataFrame:
    """Factors of q + v as one block: A stacked, B side by side. mode: none, append or only.

    One aggregation on (model, group) brings the two blocks together.
    """
    columns = ["model_name", "block_raw", "r", "n", "m", "a", "b"]
    own = block_factor.select(columns)
    if mode == "none":
        return own
    rows = block_factor.withColumn("qv", N.qv_role(F.col("block_raw"))).where("qv is not null")
    of = lambda role: F.max(F.when(F.col("qv.role") == role, F.struct("r", "n", "m", "a", "b"))).alias(role)
    pairs = rows.groupBy("model_name", F.col("qv.group").alias("block_raw")).agg(of("q"), of("v")).where("q.n = v.n and q.m = v.m")
    row = lambda side, i: F.slice(F.col(f"{side}.b"), i * F.col(f"{side}.r") + 1, F.col(f"{side}.r"))
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.col("q.m") - 1), lambda i: F.concat(row("q", i), row("v", i))))
    sums = pairs.select("model_name", "block_raw", (F.col("q.r") + F.col("v.r")).alias("r"), "q.n", "q.m", F.concat("q.a", "v.a").alias("a"), wide.alias("b"))
    return sums if mode == "only" else own.unionByName(sums)


def head_slices(block_factor: DataFrame, head_dim: Column | None = None) -> DataFrame:
    """One row per attention head: its rows of B, A as it is. head_dim: by default the architecture's.

    Blocks that cannot be split are left out.
    """
    rows = block_factor.withColumn("head_dim", N.head_width(F.col("block_raw")) if head_dim is None else head_dim)
    rows = rows.where("head_dim is not null and m % head_dim = 0").withColumn("head", F.explode(F.sequence(F.lit(0), (F.col("m") / F.col("head_dim")).cast("int") - 1)))
    part = F.slice("b", F.col("head") * F.col("head_dim") * F.col("r") + 1, F.col("head_dim") * F.col("r"))
    return rows.withColumn("b", part).withColumn("m", F.col("head_dim")).drop("head_dim")


def gram_energy(block_factor: DataFrame) -> DataFrame:
    """Add energy = trace(A A' B' B), the squared Frobenius norm of the delta, without forming it.

    Needs no kernel: two small Gram matrices in array functions.
    """
    step = F.sequence(F.lit(0), F.col("r") - 1)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    row = lambda i: F.slice("a", i * F.col("n") + 1, F.col("n"))
    column = lambda i: F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.get("b", (k * F.col("r") + i).cast("int")))
    rows = block_factor.withColumn("_rows", F.transform(step, row)).withColumn("_columns", F.transform(step, column))
    cell = F.transform(step, lambda i: F.aggregate(step, F.lit(0.0), lambda s, j: s + dot(F.get("_rows", i), F.get("_rows", j)) * dot(F.get("_columns", i), F.get("_columns", j))))
    return rows.withColumn("energy", F.aggregate(cell, F.lit(0.0), lambda s, v: s + v)).drop("_rows", "_columns")


def _factors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    columns = [batch.column(c) for c in ("r", "n", "m", "a", "b")]
    for i in range(batch.num_rows):
        r, n, m = (c[i].as_py() for c in columns[:3])
        a, b = (c[i].values.to_numpy(zero_copy_only=False) for c in columns[3:])
        yield i, a.reshape(r, n), b.reshape(m, r)


def delta_singular_values(block_factor: DataFrame, keys: tuple[str, ...] = ("model_name", "block_raw")) -> DataFrame:
    """keys, r, n, m, sv: singular values of B A, descending, from QR of both factors and an SVD of
    the small core; never of the whole delta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, a, b in _factors(batch):
                core = np.linalg.qr(b, mode="r") @ np.linalg.qr(a.T, mode="r").T
                out.append(np.linalg.svd(core, compute_uv=False))
            kept = [batch.column(k) for k in (*keys, "r", "n", "m")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], names=[*keys, "r", "n", "m", "sv"])

    narrow = block_factor.select(*keys, "r", "n", "m", "a", "b")
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "r", "n", "m")) + ", sv array<double>")


def delta_chunk_partials(block_factor: DataFrame, block_size: int = CHUNK_ENTRIES) -> DataFrame:
    """model_name, block_raw, chunk and mergeable sums over the entries of a chunk of delta's columns:
    n_entries, s1..s4 (power sums), sa (absolute), mx (largest absolute).

    A chunk has max(1, block_size // m) columns. Chunks are rows, so a large block is spread.
    """
    step = F.greatest(F.lit(1), F.floor(F.lit(block_size) / F.col("m"))).cast("int")
    chunks = block_factor.withColumn("_step", step).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("_step")).cast("int") - 1)))
    width = F.least(F.col("_step"), F.col("n") - F.col("chunk") * F.col("_step"))
    part = F.flatten(F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda i: F.slice("a", i * F.col("n") + F.col("chunk") * F.col("_step") + 1, width)))
    narrow = chunks.withColumn("_part", part).select("model_name", "block_raw", "chunk", "r", width.cast("int").alias("n"), "m", F.col("_part").alias("a"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, a, b in _factors(batch):
                x = b @ a
                y = np.abs(x)
                out.append((x.size, x.sum(), (x**2).sum(), (x**3).sum(), (x**4).sum(), y.sum(), y.max(initial=0)))
            cells = [pa.array(c) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] + [pa.array([], pa.float64())] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("model_name", "block_raw", "chunk")), *cells], names=["model_name", "block_raw", "chunk", "n_entries", "s1", "s2", "s3", "s4", "sa", "mx"])

    return narrow.mapInArrow(run, "model_name string, block_raw string, chunk int, n_entries bigint, s1 double, s2 double, s3 double, s4 double, sa double, mx double")


def entrywise_moments(block_factor: DataFrame, block_size: int = CHUNK_ENTRIES) -> DataFrame:
    """model_name, block_raw and population moments of the delta's entries, merged from chunk sums."""
    sums = delta_chunk_partials(block_factor, block_size).groupBy("model_name", "block_raw").agg(*[F.sum(c).alias(c) for c in ("n_entries", "s1", "s2", "s3", "s4", "sa")], F.max("mx").alias("mx"))
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n_entries", "s1", "s2", "s3", "s4"))
    mean = s1 / n
    return sums.select(
        "model_name", "block_raw", F.col("n_entries").alias("count"), mean.alias("mean"), F.greatest(s2 / n - mean * mean, F.lit(0.0)).alias("var"),
        F.col("sa").alias("l1_norm"), F.sqrt(s2).alias("l2_norm"), F.col("mx").alias("linf_norm"), (F.col("sa") / n).alias("mean_abs"), X.kurtosis(n, s1, s2, s3, s4).alias("kurtosis"),
    )


def extract_features(block_factor: DataFrame, groups: list[str] | None = None, qv_mode: str = "none", source: str = "sv", top_k: int = 8, block_size: int = CHUNK_ENTRIES) -> DataFrame:
    """feature(model_name, block, feature, value float) of all blocks for the requested groups.

    Only what is asked for is computed: without a feature of singular values there is no SVD, and
    energy, l2_norm and block_rank then come from Gram matrices; entrywise moments only on demand.
    """
    emitted = [e for g in N.expand_groups(groups, source) for e in ([f"sv_{i + 1}" for i in range(top_k)] if g == "sv_topk" else [g])]
    factors = qv_sum_factors(block_factor, qv_mode)
    entrywise = [e for e in emitted if e in N.MOMENTS]
    rest = [e for e in emitted if e not in N.MOMENTS]
    rank = X.block_rank(F.col("r"), F.col("n"), F.col("m"))

    def long(df: DataFrame, columns: dict[str, Column], wanted: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(e).alias("feature"), columns[e].cast("float").alias("value")) for e in wanted])
        return df.select("model_name", N.shorten_block(F.col("block_raw")).alias("block"), F.inline(cells))

    parts = []
    if rest and set(rest) <= {"energy", "l2_norm", "block_rank"}:
        rows = gram_energy(factors)
        parts.append(long(rows, {"energy": F.col("energy"), "l2_norm": X.l2_norm(F.col("energy")), "block_rank": rank.cast("double")}, rest))
    elif rest:
        parts.append(long(delta_singular_values(factors), X.singular_features(F.col("sv"), rank, top_k), rest))
    if entrywise:
        rows = entrywise_moments(factors, block_size)
        parts.append(long(rows, {e: F.col(e) for e in N.MOMENTS}, entrywise))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
