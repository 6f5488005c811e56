"""Column functions over singular values (array<double>, descending) and block shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, FLAT = 1e-12, 1e-18


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def sv_topk(sv: Column, k: int) -> Column:
    """The first k, zero-padded."""
    return F.slice(F.concat(sv, F.array_repeat(F.lit(0.0), k)), 1, k)


def energy(sv: Column) -> Column:
    return _sum(sv, lambda x: x * x)


def l2_norm(energy: Column) -> Column:
    return F.sqrt(F.greatest(energy, F.lit(0.0)))


def _largest(sv: Column) -> Column:
    return F.coalesce(F.get(sv, F.lit(0)), F.lit(0.0))


def stable_rank(sv: Column) -> Column:
    s = _largest(sv)
    return F.when(s > 0, energy(sv) / F.greatest(F.lit(TINY), s * s)).otherwise(0.0)


def spectral_entropy(sv: Column) -> Column:
    """Entropy of squared singular values as shares of the energy, shares clipped to [1e-12, 1]."""
    total = energy(sv)
    share = lambda x: F.greatest(F.lit(TINY), F.least(F.lit(1.0), x * x / total))
    return F.when(total > 0, -_sum(sv, lambda x: share(x) * F.ln(share(x)))).otherwise(0.0)


def effective_rank(sv: Column) -> Column:
    return F.when(energy(sv) > 0, F.exp(spectral_entropy(sv))).otherwise(0.0)


def concentration_of_energy(sv: Column) -> Column:
    """The largest singular value over the sum of all."""
    total = _sum(sv)
    return F.when(total > 0, _largest(sv) / total).otherwise(0.0)


def block_rank(r: Column, n: Column, m: Column) -> Column:
    return F.greatest(F.lit(1), F.least(r, n, m))


def kurtosis(count: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Excess kurtosis of a population from its power sums; 0 if the variance is next to nothing."""
    mean = s1 / count
    var = F.greatest(s2 / count - mean * mean, F.lit(0.0))
    fourth = s4 / count - 4 * mean * s3 / count + 6 * mean * mean * s2 / count - 3 * F.pow(mean, F.lit(4))
    return F.when(var > FLAT, fourth / (var * var) - 3).otherwise(0.0)


def sv_moments(sv: Column) -> Column:
    """struct(sv_kurtosis, sv_l1_norm, sv_linf_norm, sv_mean_abs) of the values as they are, unpadded."""
    n = F.size(sv).cast("double")
    sums = [_sum(sv, lambda x, p=p: F.pow(x, F.lit(p))) for p in (1.0, 2.0, 3.0, 4.0)]
    return F.struct(
        kurtosis(n, *sums).alias("sv_kurtosis"),
        _sum(sv, F.abs).alias("sv_l1_norm"),
        F.coalesce(F.array_max(F.transform(sv, F.abs)), F.lit(0.0)).alias("sv_linf_norm"),
        F.when(n > 0, _sum(sv, F.abs) / n).otherwise(0.0).alias("sv_mean_abs"),
    )


def spectrum_and_fro(sv: Column, k: int) -> Column:
    return F.struct(sv_topk(sv, k).alias("top"), F.sqrt(energy(sv)).alias("fro"))


def rank_normalized(sv: Column, rank: Column) -> dict[str, Column]:
    """Features of singular values in proportion to the block's rank."""
    r = rank.cast("double")
    moments = sv_moments(sv)
    return {
        "energy_per_rank": energy(sv) / r,
        "l2_norm_per_sqrt_rank": l2_norm(energy(sv)) / F.sqrt(r),
        "stable_rank_frac": stable_rank(sv) / r,
        "effective_rank_frac": effective_rank(sv) / r,
        "normalized_spectral_entropy": F.when(r <= 1, 0.0).otherwise(spectral_entropy(sv) / F.ln(F.greatest(F.lit(2.0), r))),
        "sv_l1_norm_per_rank": moments["sv_l1_norm"] / r,
        "sv_mean_abs_per_rank": moments["sv_mean_abs"] / r,
    }


def singular_features(sv: Column, rank: Column, top_k: int = 8) -> dict[str, Column]:
    """Every feature that singular values and the rank decide, by emitted name."""
    moments = sv_moments(sv)
    return {
        "energy": energy(sv),
        "l2_norm": l2_norm(energy(sv)),
        "stable_rank": stable_rank(sv),
        "spectral_entropy": spectral_entropy(sv),
        "effective_rank": effective_rank(sv),
        "concentration_of_energy": concentration_of_energy(sv),
        "block_rank": rank.cast("double"),
        **{k: moments[k] for k in ("sv_kurtosis", "sv_l1_norm", "sv_linf_norm", "sv_mean_abs")},
        **rank_normalized(sv, rank),
        **{f"sv_{i + 1}": F.get(sv_topk(sv, top_k), F.lit(i)) for i in range(top_k)},
    }
