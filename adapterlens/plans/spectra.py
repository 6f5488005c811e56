"""Queries over spectra of block factors; the SQL uses the closed form of rank-2 blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from adapterlens.functions import spectral as X
from adapterlens.operators import aggregate as A
from adapterlens.operators import spectral as S
from adapterlens.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = V.with_views(sql, *(needs or ("fx_block_factor",)), more=more)
        return function

    return add


SV = """gram as (select *, list_dot_product(a[1:16], a[1:16]) as a11, list_dot_product(a[1:16], a[17:32]) as a12, list_dot_product(a[17:32], a[17:32]) as a22,
  list_dot_product(b[1:31:2], b[1:31:2]) as b11, list_dot_product(b[1:31:2], b[2:32:2]) as b12, list_dot_product(b[2:32:2], b[2:32:2]) as b22 from fx_block_factor),
td as (select *, a11 * b11 + 2 * a12 * b12 + a22 * b22 as t, (a11 * a22 - a12 * a12) * (b11 * b22 - b12 * b12) as d from gram),
lam as (select *, (t + sqrt(greatest(t * t - 4 * d, 0))) / 2 as l1 from td),
sv as (select *, sqrt(l1) as s1, sqrt(d / l1) as s2, l1 + d / l1 as energy from lam),
ent as (select *, -(l1 / energy * ln(l1 / energy) + s2 * s2 / energy * ln(s2 * s2 / energy)) as entropy from sv)"""
SUMS = r"sums as (select q.model_name, regexp_replace(q.block_raw, '\.[^.]*$', '.qv_sum') as block_raw, q.a as qa, q.b as qb, v.a as va, v.b as vb from fx_block_factor q join fx_block_factor v on v.adapter_id = q.adapter_id and v.block_idx = q.block_idx + 1 and q.block_idx % 2 = 0)"
ENTRY = """entry as (select model_name, block_raw, (j - 1) // 4 as chunk, b[2 * i - 1] * a[j] + b[2 * i] * a[16 + j] as x from fx_block_factor, (select unnest(range(1, 17)) as i) is_, (select unnest(range(1, 17)) as j) js)"""


def sigma(spark, sf_dir):
    return S.delta_singular_values(V.block_factor(spark, sf_dir))


def rounded(column):
    return F.round(column, 6)


@query("effective_factors", "select model_name, block_idx, round(list_sum(a[1:16]) * (1 + adapter_id % 3), 6) as first_row, round(list_sum(a[17:32]), 6) as second_row, 'ok' as status from fx_block_factor")
def _(spark, sf_dir):
    scaled = V.block_factor(spark, sf_dir).withColumn("e", F.array((F.col("adapter_id") % 3 + 1).cast("double"), F.lit(1.0)))
    total = lambda lo: rounded(F.aggregate(F.slice("a", lo, 16), F.lit(0.0), lambda s, x: s + x))
    return S.effective_factors(scaled).select("model_name", "block_idx", total(1).alias("first_row"), total(17).alias("second_row"), "status")


@query(
    "qv_sum_factors",
    "select model_name, block_raw, 4 as r, 16 as n, 16 as m, round(list_sum(qa) + list_sum(va), 6) as sum_a, round(qb[1] + 10 * qb[2] + 100 * vb[1] + 1000 * vb[2] + 10000 * qb[3] + 100000 * vb[32], 5) as mark_b from sums",
    more=SUMS,
)
def _(spark, sf_dir):
    b = lambda i: F.get("b", F.lit(i))
    mark = b(0) + 10 * b(1) + 100 * b(2) + 1000 * b(3) + 10000 * b(4) + 100000 * b(63)
    return S.qv_sum_factors(V.block_factor(spark, sf_dir), "only").select("model_name", "block_raw", "r", "n", "m", rounded(F.aggregate("a", F.lit(0.0), lambda s, x: s + x)).alias("sum_a"), F.round(mark, 5).alias("mark_b"))


@query("head_slices", "select model_name, block_raw, h as head, 4 as m, round(list_sum(b[8 * h + 1:8 * h + 8]), 6) as sum_b from fx_block_factor, (select cast(unnest(range(0, 4)) as int) as h) hs")
def _(spark, sf_dir):
    heads = S.head_slices(V.block_factor(spark, sf_dir), F.lit(4))
    return heads.select("model_name", "block_raw", "head", "m", rounded(F.aggregate("b", F.lit(0.0), lambda s, x: s + x)).alias("sum_b"))


@query("delta_singular_values", "select model_name, block_raw, round(s1, 6) as sv_1, round(s2, 6) as sv_2 from sv", more=SV)
def _(spark, sf_dir):
    return sigma(spark, sf_dir).select("model_name", "block_raw", rounded(F.get("sv", F.lit(0))).alias("sv_1"), rounded(F.get("sv", F.lit(1))).alias("sv_2"))


@query("sv_topk", "select model_name, block_raw, round(s1, 6) as sv_1, round(s2, 6) as sv_2, 0.0::double as sv_3 from sv", more=SV)
def _(spark, sf_dir):
    top = X.sv_topk(F.col("sv"), 3)
    return sigma(spark, sf_dir).select("model_name", "block_raw", *[rounded(F.get(top, F.lit(i))).alias(f"sv_{i + 1}") for i in range(3)])


@query("energy", "select model_name, block_raw, round(energy, 6) as energy from sv", more=SV)
def _(spark, sf_dir):
    return S.gram_energy(V.block_factor(spark, sf_dir)).select("model_name", "block_raw", rounded(F.col("energy")).alias("energy"))


@query("l2_norm", "select model_name, block_raw, round(sqrt(energy), 6) as l2_norm from sv", more=SV)
def _(spark, sf_dir):
    return S.gram_energy(V.block_factor(spark, sf_dir)).select("model_name", "block_raw", rounded(X.l2_norm(F.col("energy"))).alias("l2_norm"))


def scalar(name: str, sql: str, function):
    @query(name, f"select model_name, block_raw, round({sql}, 6) as {name} from ent", more=SV)
    def _(spark, sf_dir):
        return sigma(spark, sf_dir).select("model_name", "block_raw", rounded(function(F.col("sv"))).alias(name))


scalar("stable_rank", "energy / l1", X.stable_rank)
scalar("spectral_entropy", "entropy", X.spectral_entropy)
scalar("effective_rank", "exp(entropy)", X.effective_rank)
scalar("concentration_of_energy", "s1 / (s1 + s2)", X.concentration_of_energy)


@query("block_rank", "select model_name, block_idx, greatest(1, least(r, n, m)) as block_rank from fx_block_factor")
def _(spark, sf_dir):
    return V.block_factor(spark, sf_dir).select("model_name", "block_idx", X.block_rank(F.col("r"), F.col("n"), F.col("m")).alias("block_rank"))


NORMALIZED = {
    "energy_per_rank": "energy / 2", "l2_norm_per_sqrt_rank": "sqrt(energy) / sqrt(2)", "stable_rank_frac": "energy / l1 / 2", "effective_rank_frac": "exp(entropy) / 2",
    "normalized_spectral_entropy": "entropy / ln(2)", "sv_l1_norm_per_rank": "(s1 + s2) / 2", "sv_mean_abs_per_rank": "(s1 + s2) / 4",
}


@query("rank_normalized", "select model_name, block_raw, " + ", ".join(f"round({v}, 6) as {k}" for k, v in NORMALIZED.items()) + " from ent", more=SV)
def _(spark, sf_dir):
    columns = X.rank_normalized(F.col("sv"), X.block_rank(F.col("r"), F.col("n"), F.col("m")))
    return sigma(spark, sf_dir).select("model_name", "block_raw", *[rounded(columns[k]).alias(k) for k in NORMALIZED])


@query("sv_moments", "select model_name, block_raw, case when pow((s1 - s2) / 2, 2) > 1e-18 then -2.0 else 0.0 end as sv_kurtosis, round(s1 + s2, 6) as sv_l1_norm, round(s1, 6) as sv_linf_norm, round((s1 + s2) / 2, 6) as sv_mean_abs from sv", more=SV)
def _(spark, sf_dir):
    m = sigma(spark, sf_dir).withColumn("m", X.sv_moments(F.col("sv")))
    return m.select("model_name", "block_raw", F.round("m.sv_kurtosis", 2).alias("sv_kurtosis"), *[rounded(F.col(f"m.{c}")).alias(c) for c in ("sv_l1_norm", "sv_linf_norm", "sv_mean_abs")])


@query("spectrum_and_fro", "select model_name, block_raw, round(s1, 6) as top_1, round(sqrt(energy), 6) as fro from sv", more=SV)
def _(spark, sf_dir):
    s = X.spectrum_and_fro(F.col("sv"), 1)
    return sigma(spark, sf_dir).select("model_name", "block_raw", rounded(F.get(s["top"], F.lit(0))).alias("top_1"), rounded(s["fro"]).alias("fro"))


@query(
    "delta_chunk_partials",
    "select model_name, block_raw, cast(chunk as int) as chunk, count(*) as n_entries, round(sum(x), 5) as s1, round(sum(x * x), 5) as s2, round(sum(abs(x)), 5) as sa, round(max(abs(x)), 5) as mx from entry group by model_name, block_raw, chunk",
    more=ENTRY,
)
def _(spark, sf_dir):
    return S.delta_chunk_partials(V.block_factor(spark, sf_dir), 64).select("model_name", "block_raw", "chunk", "n_entries", *[F.round(c, 5).alias(c) for c in ("s1", "s2", "sa", "mx")])


@query(
    "entrywise_moments",
    """select model_name, block_raw, n as count, round(mean, 5) as mean, round(var, 5) as var, round(l1, 5) as l1_norm, round(sqrt(s2), 5) as l2_norm, round(mx, 5) as linf_norm, round(l1 / n, 5) as mean_abs,
      round((s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * pow(mean, 4)) / (var * var) - 3, 4) as kurtosis
    from (select *, s1 / n as mean, s2 / n - (s1 / n) * (s1 / n) as var from (select model_name, block_raw, count(*) as n, sum(x) as s1, sum(x * x) as s2, sum(pow(x, 3)) as s3, sum(pow(x, 4)) as s4, sum(abs(x)) as l1, max(abs(x)) as mx from entry group by model_name, block_raw))""",
    more=ENTRY,
)
def _(spark, sf_dir):
    m = S.entrywise_moments(V.block_factor(spark, sf_dir), 64)
    return m.select("model_name", "block_raw", "count", *[F.round(c, 5).alias(c) for c in ("mean", "var", "l1_norm", "l2_norm", "linf_norm", "mean_abs")], F.round("kurtosis", 4).alias("kurtosis"))


SHORT_RAW = "regexp_replace(regexp_replace(block_raw, '^.*encoder\\.block\\.(\\d+)\\.layer\\.(\\d+)\\.', 'encoder.block\\1.layer\\2.'), '^.*layers\\.(\\d+)\\.', 'layer\\1.')"
LONG = {"energy": "energy", "sv_kurtosis": "case when pow((s1 - s2) / 2, 2) > 1e-18 then -2.0 else 0.0 end", "sv_l1_norm": "s1 + s2", "l2_norm": "sqrt(energy)", "concentration_of_energy": "s1 / (s1 + s2)", "sv_1": "s1", "sv_2": "s2", "spectral_entropy": "entropy"}
LONG_SQL = f"select model_name, {SHORT_RAW} as block, unnest({list(LONG)}) as feature, unnest([{', '.join(f'({v})::double' for v in LONG.values())}]) as value from ent"
LONG_GROUPS = ["energy", "kurtosis", "l1_norm", "l2_norm", "concentration_of_energy", "sv_topk", "spectral_entropy"]


@query("extract_features", f"select model_name, block, feature, round(value, 3) as value from ({LONG_SQL})", more=SV)
def _(spark, sf_dir):
    return S.extract_features(V.block_factor(spark, sf_dir), LONG_GROUPS, top_k=2).select("model_name", "block", "feature", F.round(F.col("value").cast("double"), 3).alias("value"))


def flagship(spark, sf_dir):
    """Factors -> spectra -> features -> role averages -> mean per role, feature and label."""
    features = S.extract_features(V.block_factor(spark, sf_dir), LONG_GROUPS, qv_mode="none", top_k=2)
    averages = A.aggregate_flat_avg(features).join(V.adapter(spark, sf_dir).select("model_name", "label"), "model_name")
    return averages.groupBy("role", "feature", "label").agg(F.count("*").alias("n_models"), F.round(F.avg("value"), 2).alias("mean_value"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = V.with_views(
    f"""select role, feature, label, count(*) as n_models, round(avg(value), 2) as mean_value from (
      select f.model_name, case when string_split(f.block, '.')[-1] in ('q_proj', 'query', 'q') then 'q' else 'v' end as role, f.feature, a.label, avg(f.value) as value
      from ({LONG_SQL}) f join fx_adapter a on a.model_name = f.model_name group by all) group by role, feature, label""",
    "fx_block_factor",
    more=SV,
)
