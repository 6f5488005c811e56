"""Operators against NumPy, closed forms and the edge cases that the tables do not hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adapterlens.functions import names as N
from adapterlens.functions import rank as R
from adapterlens.functions import spectral as X
from adapterlens.operators import aggregate, catalogue, inputs, metrics, models, schema, spectral, splits, tables
from adapterlens.sources import manifests, storage


def column(spark, function, *values):
    """function applied to a one-column table of values."""
    return [r.out for r in spark.createDataFrame([(v,) for v in values], "x string").select(function(F.col("x")).alias("out")).collect()]


BLOCK = "model_name string, block_idx int, block_raw string, r int, n int, m int, a array<double>, b array<double>"


def blocks(spark, seed=0, ranks=(1, 2, 5, 8), n=24, m=16):
    g = np.random.default_rng(seed)
    rows, deltas = [], {}
    for i, r in enumerate(ranks):
        for j, role in enumerate(("q_proj", "v_proj")):
            a, b = g.normal(size=(r, n)), g.normal(size=(m, r))
            raw = f"base.layers.{i}.self_attn.{role}"
            rows.append(("m", 2 * i + j, raw, r, n, m, a.ravel().tolist(), b.ravel().tolist()))
            deltas[raw] = b @ a
    return spark.createDataFrame(rows, BLOCK), deltas


def test_singular_values_and_features_match_numpy(spark):
    df, deltas = blocks(spark)
    zero = spark.createDataFrame([("m", 9, "zero", 2, 4, 4, [0.0] * 8, [0.0] * 8)], BLOCK)
    rows = spectral.delta_singular_values(df.unionByName(zero))
    got = {r.block_raw: r for r in rows.select("*", *[c.alias(f"f_{k}") for k, c in X.singular_features(F.col("sv"), X.block_rank(F.col("r"), F.col("n"), F.col("m")), 3).items()]).collect()}
    for raw, delta in deltas.items():
        s = np.linalg.svd(delta, compute_uv=False)[: got[raw].r]
        p = s**2 / (s**2).sum()
        entropy = -(p * np.log(np.clip(p, 1e-12, 1))).sum()
        assert np.allclose(got[raw].sv[: len(s)], s)
        assert np.isclose(got[raw].f_energy, (delta**2).sum()) and np.isclose(got[raw].f_stable_rank, (s**2).sum() / s[0] ** 2)
        assert np.isclose(got[raw].f_spectral_entropy, entropy) and np.isclose(got[raw].f_concentration_of_energy, s[0] / s.sum())
        r = got[raw].r
        assert np.isclose(got[raw].f_normalized_spectral_entropy, 0 if r == 1 else entropy / math.log(r))
        assert np.isclose(got[raw].f_sv_3, s[2] if r > 2 else 0)
    z = got["zero"]
    assert (z.f_energy, z.f_stable_rank, z.f_effective_rank, z.f_spectral_entropy, z.f_concentration_of_energy) == (0, 0, 0, 0, 0)


def test_gram_energy_needs_no_delta(spark):
    df, deltas = blocks(spark, 1)
    for r in spectral.gram_energy(df).collect():
        assert np.isclose(r.energy, (deltas[r.block_raw] ** 2).sum())


@pytest.mark.parametrize("size", [1, 50, 10_000])
def test_entrywise_moments_do_not_depend_on_chunks(spark, size):
    df, deltas = blocks(spark, 2)
    for r in spectral.entrywise_moments(df, size).collect():
        x = deltas[r.block_raw].ravel()
        c = x - x.mean()
        assert r["count"] == x.size and np.allclose([r.mean, r.var, r.l1_norm, r.l2_norm, r.linf_norm], [x.mean(), x.var(), np.abs(x).sum(), np.sqrt((x**2).sum()), np.abs(x).max()])
        assert np.isclose(r.kurtosis, (c**4).mean() / x.var() ** 2 - 3)


def test_sums_heads_and_scales(spark):
    df, deltas = blocks(spark, 3, ranks=(2, 3))
    uneven = df.where("not (block_idx = 3)").unionByName(df.where("block_idx = 3").withColumn("m", F.col("m")))
    for r in spectral.qv_sum_factors(uneven, "only").collect():
        stem = r.block_raw.removesuffix(".qv_sum")
        made = np.array(r.b).reshape(r.m, r.r) @ np.array(r.a).reshape(r.r, r.n)
        assert np.allclose(made, deltas[f"{stem}.q_proj"] + deltas[f"{stem}.v_proj"])
    heads = spectral.head_slices(df, F.lit(4)).collect()
    assert len(heads) == 16
    for h in heads:
        assert np.allclose(np.array(h.b).reshape(4, h.r) @ np.array(h.a).reshape(h.r, h.n), deltas[h.block_raw][4 * h.head : 4 * h.head + 4])
    scaled = spectral.effective_factors(df.withColumn("e", F.when(F.col("r") == 2, F.array(F.lit(2.0), F.lit(3.0)))).withColumn("e", F.when(F.col("block_idx") == 3, F.array(F.lit(1.0))).otherwise(F.col("e"))))
    got = {r.block_idx: r for r in scaled.collect()}
    first = {r.block_idx: r for r in df.collect()}
    assert np.allclose(np.array(got[0].a).reshape(2, -1), np.diag([2, 3]) @ np.array(first[0].a).reshape(2, -1))
    assert got[2].a == first[2].a and got[3].status == "scale length"


def test_only_what_is_asked_for_is_computed(spark):
    df, _ = blocks(spark, 4)
    plan = spectral.extract_features(df, ["energy", "block_rank"])._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    long = spectral.extract_features(df, ["energy", "kurtosis", "sv_topk"], qv_mode="append", source="both", top_k=2)
    assert {r.feature for r in long.select("feature").distinct().collect()} == {"energy", "kurtosis", "sv_kurtosis", "sv_1", "sv_2"}
    assert long.select("block").distinct().count() == 12


def test_names(spark):
    assert column(spark, N.shorten_block, "x.layers.3.self_attn.q_proj", "a.decoder.block.1.layer.2.EncDecAttention.v", "t.block.4.layer.0.x", "odd") == ["layer3.self_attn.q_proj", "decoder.block1.layer2.EncDecAttention.v", "block4.layer0.x", "odd"]
    assert column(spark, N.parse_label, "a_label0_label1", "a_label10", "none", None) == [0, 1, None, None]
    assert column(spark, N.parse_rank, "a_RANK16_b", "rank8.5_x", "xrank8", "a_rank4") == [16, 8, None, 4]
    assert [r and tuple(r) for r in column(spark, N.qv_role, "l.self_attn.q_proj", "l.mlp.q_proj", "q_proj", "l.attention.self.value")] == [("l.self_attn.qv_sum", "q"), None, None, ("l.attention.self.qv_sum", "v")]
    assert column(spark, N.role_bucket, "a.qv_sum.head03", "a.Query", "a.v.HEAD1", "a.dense") == ["qv_sum", "q", "v", "other"]
    assert column(spark, lambda c: N.canonical_depth(c)["label"], "encoder.block2.layer1.x", "layer7.self_attn.q_proj", "roberta.encoder.layer.5.attention", "decoder.block.3.y", "none") == ["encoder.layer2", "decoder.layer7", "encoder.layer5", "decoder.layer3", None]
    assert column(spark, N.structural_group, "encoder.block2.layer1.x.y", "layer7.a.b", "a.b.c.d", "x") == ["encoder.block2", "layer7", "a.b", "x"]
    assert column(spark, N.feature_group, "sv_12", "sv_kurtosis", "sv_x", "energy") == ["sv_topk", "kurtosis", None, "energy"]
    family = F.lit("fam_7b")
    assert column(spark, lambda c: N.dataset_group(c, family), "fam_7b_dora_lora_plus_imdb_RIPPLE_rank8", "fam_7b_lora_imdb", "fam_7b_rank8_x", "other_ag", "fam_7b_ripple", "fam_7b_lora") == ["imdb", "lora_imdb", "x", "other_ag", "ripple", "lora"]
    assert column(spark, lambda c: N.adapter_variant(c, family), "fam_7b_dora_imdb", "fam_7b_dora_lora_plus_x", "fam_7b_imdb", "fam_7b_adalora_qlora") == ["dora", "lora_plus", "lora", "qlora"]


def test_family_uses_the_cohort(spark):
    rows = spark.createDataFrame([("d/acme_net_ds_a/x_label0_1", "x_label0_1", 0, "c"), ("d/acme_net_ds_b/x_label1_2", "x_label1_2", 1, "c"), ("y_label1_3", "y_label1_3", None, "d")], "model_dir string, model_name string, label int, cohort string")
    prefix = {r.cohort: r.tokens for r in catalogue.cohort_prefix(catalogue.with_subsets(rows), "cohort").collect()}
    assert prefix == {"c": ["acme", "net", "ds"], "d": ["y"]}
    got = {r.model_name: r for r in catalogue.identities(rows.where("cohort = 'c'"), prefix["c"]).collect()}
    assert got["x_label0_1"].model_family == "acme_net_ds" and got["x_label0_1"].attack_name == "a"


FEATURE = "model_name string, block string, feature string, value float"


def feature(spark, *rows):
    return spark.createDataFrame(list(rows), FEATURE)


def test_merges(spark):
    base = feature(spark, ("a", "l", "energy", 1.0), ("b", "l", "energy", float("nan")))
    same = feature(spark, ("a", "l", "energy", 1.000001), ("b", "l", "energy", float("nan")))
    other = feature(spark, ("c", "k", "energy", 3.0))
    merged, stats = tables.merge_dense(base, same)
    assert (stats.first().conflicts, stats.first().overlap, stats.first().missing) == (0, 2, 0)
    assert {r.model_name: r.value for r in merged.collect()}["a"] == 1.0
    assert tables.merge_dense(base, feature(spark, ("a", "l", "energy", 1.1)))[1].first().conflicts == 1
    assert tables.merge_auto(base, same)[1] == "dense" and tables.merge_auto(base, other)[1] == "zero_fill"
    with pytest.raises(ValueError, match="disagree"):
        tables.merge_auto(base, feature(spark, ("a", "l", "energy", 2.0)))
    with pytest.raises(ValueError, match="shared"):
        tables.merge_auto(base, feature(spark, ("a", "k", "energy", 2.0)))
    zero = tables.merge_zero_fill(base, other)[1].first()
    assert (zero.shared_models, zero.zero_filled) == (0, 3)
    assert tables.merge_dense(base, base)[0].count() == 2  # merging a table with itself changes nothing


def test_values_that_are_not_finite_agree_only_with_themselves(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(1.0, 1.0000001, 0), (1.0, 1.1, 1), (1.0, nan, 1), (nan, 1.0, 1), (nan, nan, 0), (1.0, inf, 1), (inf, 1.0, 1), (inf, inf, 0), (inf, -inf, 1), (-inf, -inf, 0)]
    for old, new, conflicts in pairs:
        found = tables.merge_dense(feature(spark, ("a", "k", "energy", old)), feature(spark, ("a", "k", "energy", new)))[1].first()
        assert (found.overlap, found.conflicts, found.repeated) == (1, conflicts, 0), (old, new)
    twice = feature(spark, ("a", "k", "energy", 1.0), ("a", "k", "energy", 2.0))
    assert tables.merge_dense(twice, feature(spark, ("b", "k", "energy", 1.0)))[1].first().repeated == 1
    with pytest.raises(ValueError, match="repeated"):
        tables.merge_auto(twice, feature(spark, ("b", "k", "energy", 1.0)))


def test_stacking_names_models_that_do_not_fit(spark):
    shards = [feature(spark, ("a", "k", "energy", 1.0)), feature(spark, ("z", "k", "energy", 1.0))]
    manifest = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "model_name string, pos int")
    rows, unfit = tables.stack_shards(shards, manifest, spark.createDataFrame([("c", "unreadable")], "model_name string, reason string"))
    assert [r.model_name for r in rows.collect()] == ["a"]
    assert {tuple(r) for r in unfit.collect()} == {("b", "MissingShardRow"), ("c", "unreadable"), ("z", "NotInManifest")}
    labels = spark.createDataFrame([(0, "a", 1), (0, "b", None), (1, "c", None)], "shard int, model_name string, label int")
    assert tuple(tables.labels_all_or_none(labels).first()) == (2, 1, False)
    assert tables.labels_all_or_none(labels.where("shard = 0")).first().ok


def test_deep_lineage_is_followed(spark):
    lineage = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "child string, parent string")
    assert [tuple(r) for r in tables.lineage_leaves(lineage, spark.createDataFrame([("n0",)], "root string")).collect()] == [("n0", "n5")]


def test_order_by_parts_is_exact(spark):
    from adapterlens.functions.rank import ordered

    rows = spark.createDataFrame([(k % 3, (k * 7919) % 1009) for k in range(900)], "g int, v long")
    got = {(r.g, r.v): (r.place, r.n) for r in ordered(rows, ["g"], "v").collect()}
    for g in range(3):
        values = sorted(v for h, v in got if h == g)
        assert all(got[g, v] == (i + 1, len(values)) for i, v in enumerate(values))
    assert ordered(rows.where("false"), ["g"], "v").count() == 0


def test_lineage_cycle_is_an_error(spark):
    roots = spark.createDataFrame([("r",)], "root string")
    lineage = spark.createDataFrame([("r", "m"), ("m", "l1"), ("m", "l2"), ("r", "l1")], "child string, parent string")
    assert {tuple(r) for r in tables.lineage_leaves(lineage, roots).collect()} == {("r", "l1"), ("r", "l2")}
    with pytest.raises(ValueError, match="cycle"):
        tables.lineage_leaves(lineage.unionByName(spark.createDataFrame([("l1", "r")], "child string, parent string")), roots)


def test_lineage_of_any_depth_and_shape(spark):
    """A chain of 10,000, a ladder in which every table has two parents, and a cycle out of reach of roots."""
    chain = spark.range(10_000).select(F.concat(F.lit("n"), "id").alias("child"), F.concat(F.lit("n"), F.col("id") + 1).alias("parent"))
    roots = spark.createDataFrame([("n0",), ("n9990",), ("lone",)], "root string")
    assert sorted(map(tuple, tables.lineage_leaves(chain, roots).collect())) == [("lone", "lone"), ("n0", "n10000"), ("n9990", "n10000")]
    ladder = spark.createDataFrame([(f"{a}{i}", f"{b}{i + 1}") for i in range(30) for a in "xy" for b in "xy"], "child string, parent string")
    assert sorted(r.leaf for r in tables.lineage_leaves(ladder, spark.createDataFrame([("x0",)], "root string")).collect()) == ["x30", "y30"]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        tables.lineage_leaves(chain.where("child in ('n1', 'n2')").unionByName(ring), roots)


def test_missing_and_repeated_places(spark):
    f = feature(spark, ("a", "layer0.self_attn.q_proj", "energy", 1.0), ("a", "layer.0.self_attn.q", "energy", 2.0), ("a", "layer1.mlp.up", "energy", 4.0))
    rows = {(r.depth_label, r.slot): r.n for r in aggregate.layer_sequence(f).collect()}
    assert rows == {("decoder.layer0", "self.q"): 2, ("decoder.layer1", "other.other"): 1}
    for parts in (1, 2, 3):
        values = {(r.depth_label, r.slot): r.value for r in aggregate.layer_sequence(f.repartition(parts, "value")).collect()}
        assert values == {("decoder.layer0", "self.q"): 2.0, ("decoder.layer1", "other.other"): 4.0}  # layer.0 sorts before layer0
    kept, counts = inputs.retain_slots(aggregate.layer_sequence(f))
    assert kept.count() == 1 and counts.first().other == 1
    assert [r.grp for r in tables.missing_feature_groups(f, ["energy", "kurtosis"]).collect()] == ["kurtosis"]


def adapters(spark, counts):
    rows = [(f"m{g}_{label}_{i}", label, g, 8 * (1 + g)) for (g, label), n in counts.items() for i in range(n)]
    return spark.createDataFrame([(a, b, f"f{c}", d) for a, b, c, d in rows], "model_name string, label int, folder string, rank int")


def test_splits_hold_their_counts_whatever_the_partitioning(spark):
    df = adapters(spark, {(0, 0): 37, (0, 1): 5, (1, 0): 2, (1, 1): 1})
    for pct in (1, 50, 80, 99, 100):
        got = splits.holdout_folder_label(df, pct, 3, strict=False)
        assert sorted(got.drop("adjusted").collect()) == sorted(splits.holdout_folder_label(df.repartition(7), pct, 3, strict=False).drop("adjusted").collect())
        train = {(r.folder, r.label): r["count"] for r in got.where("partition = 'train'").groupBy("folder", "label").count().collect()}
        for (g, label), n in {(0, 0): 37, (0, 1): 5, (1, 0): 2, (1, 1): 1}.items():
            want = n if pct == 100 or n < 2 else max(1, min(n - 1, math.floor(n * pct / 100 + 0.5)))
            assert train.get((f"f{g}", label), 0) == want


def test_guards_of_splits(spark):
    df = adapters(spark, {(0, 0): 9, (0, 1): 5, (1, 0): 2, (1, 1): 1})
    with pytest.raises(ValueError, match="1 groups of .* fewer than 2 rows, such as 'f1 1'"):
        splits.holdout_folder_label(df, 50, 3)
    assert splits.holdout_folder_label(df, 100, 3).count() == 17
    with pytest.raises(ValueError, match="2 classes"):
        splits.holdout_stratified(df.where("label = 0"), 50, 3)
    with pytest.raises(ValueError, match="fewer than 2 rows"):
        splits.holdout_stratified(df.where("label = 0 or folder = 'f1'"), 50, 3)
    attacks = df.withColumn("attack_name", F.when(F.col("folder") == "f0", "a"))  # that of f1 is unknown
    folds = {(r.fold, r.label) for r in splits.kfold_leave_attack_out(attacks, 1).join(df, "model_name").collect()}
    assert folds == {(0, 0), (0, 1), (1, 0), (1, 1)}
    with pytest.raises(ValueError, match="another label"):
        splits.kfold_leave_attack_out(attacks.withColumn("label", F.col("label") * 2), 1)
    with pytest.raises(ValueError, match="clean row"):
        splits.kfold_leave_attack_out(attacks.where("label = 1 or model_name = 'm0_0_0'"), 1)
    with pytest.raises(ValueError, match="two attacks"):
        splits.kfold_leave_attack_out(attacks.where("folder = 'f0'"), 1)


def test_explicit_manifests_are_reconciled(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "model_name string")
    split = splits.materialize_split(names("a", "b", "c", "d", "gone"), train=names("a", "b", "b", "c"), infer=names("c", "d", "odd"))
    assert {tuple(r) for r in split.collect()} == {("a", "train", "ok"), ("b", "train", "repeated"), ("c", "train", "overlap"), ("d", "infer", "ok"), ("odd", "infer", "not in manifest"), ("gone", None, "missing")}
    with pytest.raises(ValueError, match="overlap.*repeated"):
        splits.checked_split(split)
    good = splits.materialize_split(None, train=names("a"), infer=names("b"))
    assert splits.checked_split(good).count() == 2
    with pytest.raises(ValueError, match="empty sections: .'infer'"):
        splits.checked_split(splits.materialize_split(None, train=names("a"), infer=names()))
    df = adapters(spark, {(0, 0): 9, (0, 1): 5})
    assert splits.checked_split(splits.materialize_split(df, 50, 1)).count() == 14
    for wrong in ({"pct": 100}, {"pct": 50, "pinned": names("a")}, {"pct": 50, "train": names("a"), "infer": names("b")}, {"train": names("a")}, {}):
        with pytest.raises(ValueError):
            splits.materialize_split(df, **wrong)
    unlabelled = splits.materialize_split(df.withColumn("label", F.when(F.col("model_name") != "m0_0_0", F.col("label"))), 50, 1)
    with pytest.raises(ValueError, match="unlabelled': 1"):
        splits.checked_split(unlabelled)


def test_folds_partition_the_pool_evenly(spark):
    df = adapters(spark, {(0, 0): 41, (0, 1): 13})
    rows = splits.kfold_stratified(df, 5, [1]).join(df, "model_name").collect()
    assert len(rows) == 54
    for label, n in ((0, 41), (1, 13)):
        sizes = [sum(r.fold == k and r.label == label for r in rows) for k in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    total = [sum(r.fold == k for r in rows) for k in range(5)]
    assert max(total) - min(total) <= 1
    assert splits.sanitize_folds(adapters(spark, {(0, 0): 4, (0, 1): 1}), 5).first().folds == 1
    assert {r.stratum for r in splits.strata_keys(adapters(spark, {(0, 0): 4, (0, 1): 1}), "rank").collect()} == {"label_0", "label_1"}


def test_ranks_and_running_sums_are_exact(spark):
    df = spark.range(3000).select(F.concat(F.lit("n"), F.col("id")).alias("model_name"), (F.col("id") % 3).alias("k"), (F.col("id") % 700 / 7).alias("score"), F.lit(1).cast("long").alias("c"))
    places = {}
    for r in R.ranked(df, ["k"], 9).collect():
        places.setdefault(r.k, []).append(r.place)
    assert all(sorted(p) == list(range(1, 1001)) for p in places.values())
    counts = df.groupBy("score").agg(F.sum("c").alias("c"))
    got = {r.score: r.c_from for r in R.running(counts, [], "score", ["c"], parts=16).collect()}
    scores = [r.score for r in df.collect()]
    assert all(got[s] == sum(x >= s for x in scores) for s in list(got)[::50])


def test_areas_match_pair_counting_and_single_class_is_null(spark):
    g = np.random.default_rng(5)
    y, s = g.integers(0, 2, 300), g.integers(0, 40, 300) / 10
    df = spark.createDataFrame([(int(a), float(b), "x") for a, b in zip(y, s, strict=True)] + [(1, 0.5, "one"), (None, 0.1, "none")], "label int, score double, grp string")
    got = {r.grp: r for r in metrics.auroc_auprc(df, ["grp"]).collect()}
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(got["x"].auroc, want) and got["one"].auroc is None and got["one"].auprc is None
    order = np.unique(s)[::-1]
    recall = [(pos >= t).sum() / len(pos) for t in order]
    precision = [(pos >= t).sum() / ((pos >= t).sum() + (neg >= t).sum()) for t in order]
    assert np.isclose(got["x"].auprc, sum((r - p) * q for r, p, q in zip(recall, [0, *recall], precision, strict=False)))


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    best = {r.accepted_fpr: (r.threshold, r.above_max) for r in metrics.select_threshold(metrics.threshold_metrics(df), [0.0, 0.5, 0.5]).collect()}
    assert best == {0.0: (0.9, False), 0.5: (0.7, False)}
    worst = spark.createDataFrame([(0, 0.9), (1, 0.1)], "label int, score double")
    assert metrics.select_threshold(metrics.threshold_metrics(worst), [0.0]).first().above_max
    row = metrics.confusion_at(df, [2.0]).first()
    assert row.precision is None and row.recall == 0


def test_models_agree_with_closed_forms(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(160, 4))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0]) + 0.3 * g.normal(size=160) > 0).astype(int)
    df = models.as_vectors(spark.createDataFrame([(f"m{i}", int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "model_name string, label int, features array<double>").repartition(3))
    scored = {r.model_name: r.score for r in models.train_ridge(df, alpha=3.0).score(df).collect()}
    c, t = (x - x.mean(0)) / x.std(0), 2.0 * y - 1
    w = np.linalg.solve(c.T @ c + 3.0 * np.eye(4), c.T @ (t - t.mean()))
    assert np.allclose([scored[f"m{i}"] for i in range(160)], c @ w + t.mean(), atol=1e-9)
    rare = df.where("label = 1 or model_name < 'm13'")  # a tenth of label 0, whose deviation is far from 1
    kept = np.array([f"m{i}" < "m13" or y[i] == 1 for i in range(160)])
    c, t = (x[kept] - x[kept].mean(0)) / x[kept].std(0), 2.0 * y[kept] - 1
    w = np.linalg.solve(c.T @ c + 30.0 * np.eye(4), c.T @ (t - t.mean()))
    scored = {r.model_name: r.score for r in models.train_ridge(rare, alpha=30.0).score(rare).collect()}
    assert np.allclose([scored[f"m{i}"] for i in np.flatnonzero(kept)], c @ w + t.mean(), atol=1e-9)
    for name in ("logistic", "linear_svm", "random_forest", "rbf_svm", "adaboost"):
        assert metrics.auroc(models.TRAINERS[name](df).score(df).select("label", "score")).first().auroc > 0.95, name


def test_fits_are_optimal(spark):
    """The gradient of the logistic fit vanishes; SVM and kernel SVM reach the least objective; decision values of
    the kernel SVM equal those of the exact kernel's dual on 300 rows."""
    g = np.random.default_rng(8)
    x = g.normal(size=(300, 2))
    y = ((x**2).sum(1) + 0.4 * g.normal(size=300) > 1.3).astype(int)
    df = models.as_vectors(spark.createDataFrame([(f"m{i}", int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "model_name string, label int, features array<double>").repartition(3)).persist()
    fit = models.train_logistic(df, 0.5, "balanced")
    assert models.linear_objective(fit, df, "logistic", 0.5, "balanced", output="rawPrediction").first().gradient < 1e-6

    scorer = models.train_rbf_svm(df, C=1.0)
    assert models.kernel_gap(scorer, df).agg(F.max("gap")).first()[0] < 1e-6
    c = (x - x.mean(0)) / x.std(0)
    t, k = 2.0 * y - 1, np.exp(-((c[:, None] - c[None]) ** 2).sum(2) / (2 * c.var()))
    dual, grad = np.zeros(300), np.ones(300)
    for _ in range(20_000):  # pairs that violate the conditions most, as in sequential minimal optimisation
        up, down = np.where(((t > 0) & (dual < 1)) | ((t < 0) & (dual > 0)), t * grad, -np.inf), np.where(((t > 0) & (dual > 0)) | ((t < 0) & (dual < 1)), t * grad, np.inf)
        i, j = up.argmax(), down.argmin()
        if up[i] - down[j] < 1e-6:
            break
        step = (up[i] - down[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, 1 - dual[i] if t[i] > 0 else dual[i], dual[j] if t[j] > 0 else 1 - dual[j])
        dual[i] += t[i] * step
        dual[j] -= t[j] * step
        grad -= t * step * (k[:, i] - k[:, j])
    exact = k @ (dual * t) + (up[i] + down[j]) / 2
    got = {r.model_name: r.score for r in scorer.score(df).collect()}
    off = np.abs(np.array([got[f"m{i}"] for i in range(300)]) - exact)
    assert off.max() < 0.15 and off.mean() < 0.03  # of values between -3 and 3
    least = (np.maximum(1 - t * exact, 0).sum() + (dual * t) @ k @ (dual * t) / 2) / 300
    assert abs(models.linear_objective(scorer, df, "hinge", 1.0).first().objective - least) < 1e-4

    scale = models.scaling(df)
    points = models.landmarks_of(models.through(scale, df), 20, 42)
    few = models.Scorer([*scale, models.KernelMap.through(points, 1 / (2 * c.var()))], "mapped", "margin")
    gap = {r.model_name: r.gap for r in models.kernel_gap(few, df).collect()}
    gap = np.array([gap[f"m{i}"] for i in range(300)])
    mapped = {r.model_name: r.mapped.toArray() for r in few.values(df).select("model_name", "mapped").collect()}
    near = np.array([mapped[f"m{i}"] for i in range(300)])
    assert (np.abs(near @ near.T - k) <= np.sqrt(np.outer(gap, gap)) + 1e-9).all() and gap.max() > 0.01
    df.unpersist()


def test_many_trees_are_scored_and_evaluated_quickly(spark):
    import time

    from adapterlens.operators.stages import TreeVotes

    g = np.random.default_rng(9)
    features, thresholds, leaves = g.integers(0, 6, (400, 3)), g.normal(size=(400, 3)), g.integers(0, 2, (400, 4))
    votes = TreeVotes(features.tolist(), thresholds.tolist(), leaves.tolist(), g.random(400).tolist(), 2)
    x = g.normal(size=(10_000, 6))
    df = models.as_vectors(spark.createDataFrame([(f"m{i}", int(a[0] > 0), [float(v) for v in a]) for i, a in enumerate(x)], "model_name string, label int, features array<double>").repartition(4))
    began = time.time()
    scored = models.Scorer([votes], "votes", "softmax").score(df)
    assert 0 < metrics.auroc(scored.select("label", "score")).first().auroc < 1
    assert time.time() - began < 60
    row, total = x[7], np.zeros(2)
    for f, t, leaf, w in zip(votes.features, votes.thresholds, votes.leaves, votes.weights, strict=True):
        node = 1 + int(row[f[0]] > t[0])
        node = 2 * node + 1 + int(row[f[node]] > t[node])
        total[leaf[node - 3]] += w / votes.weights.sum()
    assert np.allclose(votes.votes(x[7:8])[0], [total[0] - total[1], total[1] - total[0]])


@pytest.mark.parametrize("model", ["ridge", "linear_svm", "rbf_svm", "random_forest"])
def test_contracts_hold_any_detector(spark, tmp_path, model):
    df = models.as_vectors(spark.createDataFrame([(f"m{i}", i % 2, [float(i % 2 + i % 5), float(i % 3)]) for i in range(30)], "model_name string, label int, features array<double>"))
    params = {"n_estimators": 3} if model == "random_forest" else {}
    models.save_contract(df, str(tmp_path), ["x", "y"], {"even": 0.5}, model=model, **params)
    want = {r.model_name: (r.score, r.predicted) for r in models.TRAINERS[model](df, **params).score(df).collect()}
    got = {r.model_name: (r.score, ["clean", "backdoored"].index(r.predicted)) for r in models.infer_with_contract(str(tmp_path), df, ["x", "y"]).collect()}
    assert set(got) == set(want) and all(abs(got[m][0] - want[m][0]) < 1e-9 and got[m][1] == want[m][1] for m in want)


def test_three_classes(spark):
    """Ridge against the normal equations of each class, and every detector tells three clouds apart."""
    g = np.random.default_rng(7)
    y = np.arange(150) % 3
    x = g.normal(size=(150, 3)) + 4 * np.eye(3)[y]
    df = models.as_vectors(spark.createDataFrame([(f"m{i}", int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "model_name string, label int, features array<double>").repartition(2))
    c = (x - x.mean(0)) / x.std(0)
    values = np.column_stack([c @ np.linalg.solve(c.T @ c + 2.0 * np.eye(3), c.T @ (t - t.mean())) + t.mean() for t in (2.0 * (y == k) - 1 for k in range(3))])
    e = np.exp(values - values.max(1, keepdims=True))
    got = {r.model_name: r for r in models.train_ridge(df, alpha=2.0).score(df).collect()}
    assert np.allclose([got[f"m{i}"].score for i in range(150)], 1 - e[:, 0] / e.sum(1), atol=1e-9)
    assert [got[f"m{i}"].predicted for i in range(150)] == values.argmax(1).tolist()
    for name in ("logistic", "linear_svm", "adaboost", "rbf_svm", "random_forest"):
        params = {"n_estimators": 8, "max_depth": 2} if name in ("adaboost", "random_forest") else {}
        rows = models.TRAINERS[name](df, **params).score(df).collect()
        assert sum(r.predicted == r.label for r in rows) > 130 and all(0 <= r.score <= 1 for r in rows), name
    with pytest.raises(ValueError, match="labels"):
        models.train_ridge(df.where("label <> 1"))


def test_grids_have_their_registered_sizes():
    assert {k: len(models.model_grid(k)) for k in models.GRIDS} == {"logistic": 12, "ridge": 12, "linear_svm": 12, "adaboost": 32, "rbf_svm": 40, "random_forest": 54}
    assert [c["task_index"] for c in models.model_grid("ridge", {"class_weight": ["none"], "alpha": [1.0, 2.0]})] == [0, 1]
    with pytest.raises(ValueError, match="axes"):
        models.model_grid("ridge", {"alpha": [1.0]})


def test_candidates_are_judged_by_seed_and_fold(spark):
    df = models.as_vectors(spark.createDataFrame([(f"m{i}", i % 2, [float(i % 2 * 3 + i % 5), 1.0]) for i in range(40)], "model_name string, label int, features array<double>").repartition(2))
    folds = splits.kfold_stratified(df.select("model_name", "label"), 2, [1, 2])
    found = models.evaluate_candidates(df, folds, "ridge", [{"task_index": 0, "alpha": 1.0}, {"task_index": 1, "alpha": -1.0}]).collect()
    assert sorted((r.task_index, r.seed, r.fold) for r in found) == [(t, s, f) for t in (0, 1) for s in (1, 2) for f in (0, 1)]
    assert all(r.metric > 0.8 and r.status == "ok" for r in found if r.task_index == 0)
    assert all(r.metric is None and r.status.startswith("failed") for r in found if r.task_index == 1)


def test_margins_and_classes_that_do_not_fit(spark):
    row = spark.createDataFrame([(-0.5, [0.1, 0.9], [2, 0])], "m double, v array<double>, c array<int>")
    for ends, want in (((0, 1), (-0.5, 0)), ((1, 0), (0.5, 1)), ((0, 2), (-0.5, 0))):
        assert tuple(row.select(*metrics.margin_outputs(F.col("m"), *ends)).first()) == want
    with pytest.raises(ValueError, match="0"):
        metrics.margin_outputs(F.col("m"), 1, 2)
    assert row.select(metrics.align_classes(F.col("v"), F.col("c"), 3)).first()[0] == [0.9, 0.0, 0.1]
    with pytest.raises(Exception, match="do not fit"):
        row.select(metrics.align_classes(F.col("v"), F.col("c"), 2)).collect()


def test_contract_is_kept(spark, tmp_path):
    df = models.as_vectors(spark.createDataFrame([("a", 0, [0.0, 1.0]), ("b", 1, [1.0, 0.0])], "model_name string, label int, features array<double>"))
    models.save_contract(df, str(tmp_path), ["x", "y"], {"even": 0.5, "all": 0.0})
    got = {r.model_name: (r.predicted, r.flagged) for r in models.infer_with_contract(str(tmp_path), df, ["x", "y"], ["clean", "backdoored"], df).collect()}
    assert got == {"a": ("clean", {"even": False, "all": True}), "b": ("backdoored", {"even": True, "all": True})}
    with pytest.raises(ValueError, match="classes"):
        models.infer_with_contract(str(tmp_path), df, ["x", "y"], ["clean", "other"])
    with pytest.raises(ValueError, match="manifest"):
        models.infer_with_contract(str(tmp_path), df, ["x", "y"], manifest=df.where("model_name = 'a'"))
    with pytest.raises(ValueError, match="contract"):
        models.infer_with_contract(str(tmp_path), df, ["y", "x"])


def test_manifest_forms_and_errors(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"path": ["plain", {"path": "a{i}b", "indices": [3, 5]}, {"path": "c", "indices": "[5,3]"}, {"path": "d", "indices": [-1]}, {"indices": [1]}]}')
    rows = manifests.scan_manifest(spark, str(tmp_path / "m.json")).orderBy("item", "entry_pos").collect()
    assert [r.raw_entry for r in rows if r.status == "ok"] == ["plain", "a3b", "a4b", "a5b", "c5", "c3"]
    assert [(r.item, r.status) for r in rows if r.status != "ok"] == [(3, "bad indices"), (4, "no path")]


def test_tensor_files_are_read_and_bad_ones_quarantined(spark, tmp_path):
    for name, content in (("good", storage.tensor_file({"l.lora_A.weight": np.ones((2, 3)), "l.lora_B.weight": np.ones((4, 2))})), ("bad", b"\x05")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "adapter_model.safetensors").write_bytes(content)
    rows = storage.scan_adapter_tensors(spark, str(tmp_path))
    good, bad = schema.quarantine(rows)
    assert [r.model_name for r in bad.collect()] == ["bad"] and good.count() == 2
    (pair,) = schema.pair_factors(good).collect()
    assert (pair.r, pair.n, pair.m, pair.status) == (2, 3, 4, "ok")
    lone = schema.pair_factors(good.where("tensor_key like '%A.weight'")).first()
    assert lone.status == "missing B"


def test_ranges_of_tensor_files_equal_the_whole_read(spark, tmp_path):
    g = np.random.default_rng(3)
    tensors = {"l.1.lora_A.weight": g.normal(size=(4, 300)), "l.1.lora_B.weight": g.normal(size=(200, 4)), "l.0.none": np.zeros((0, 3))}
    content = storage.tensor_file(tensors)
    for name, data in (("good", content), ("short", content[:-40]), ("bad", b"\x05")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "adapter_model.safetensors").write_bytes(data)
    rows = storage.scan_tensor_ranges(spark, str(tmp_path), range_bytes=1000)
    assert rows.rdd.getNumPartitions() > 1
    got = rows.collect()
    assert {(r.model_name, r.status) for r in got} == {("good", "ok"), ("short", "ok"), ("short", "truncated"), ("bad", "unreadable: error")}
    whole = {r.tensor_key: r["values"] for r in storage.scan_adapter_tensors(spark, str(tmp_path / "good")).collect()}
    for key, values in whole.items():
        parts = sorted((r.first, r["values"]) for r in got if r.model_name == "good" and r.tensor_key == key)
        assert [x for _, p in parts for x in p] == values and all(len(p) <= 250 for _, p in parts)
    assert len([r for r in got if r.model_name == "good" and r.tensor_key == "l.1.lora_A.weight"]) == 5
    chunks = {(r.tensor_key, r.write_offset): r.chunk for r in storage.flat_chunks_of_ranges(rows.where("model_name = 'good'")).collect()}
    flat = [x for key in sorted(whole) for x in whole[key]]
    assert all(flat[at : at + len(c)] == c for (_, at), c in chunks.items()) and sum(map(len, chunks.values())) == len(flat)


def test_interrupted_writes_go_on_without_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    cells = feature(spark, *[(m, "layer0.q", f, float(i)) for i, m in enumerate("abc") for f in ("energy", "l2_norm")])
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", None)], "model_name string, label int")
    storage.write_feature_table(cells.where("model_name = 'a'"), names, path)
    storage.append_features(cells.where("model_name = 'b'"), path)  # ends before its state is written
    assert {r.model_name for r in storage.read_feature_table(spark, path)[0].collect()} == {"a"}
    assert sorted(r.model_name for r in storage.pending_models(names, path).collect()) == ["b", "c"]
    for _ in range(2):
        storage.write_feature_table(cells, names, path)
        back, listed = storage.read_feature_table(spark, path)
        assert sorted((r.model_name, r.block, r.feature, r.value) for r in back.collect()) == sorted(map(tuple, cells.collect()))
        assert sorted(r.model_name for r in listed.collect()) == ["a", "b", "c"]
    assert {(r.model_name, r.n_cells) for r in storage.stored_state(spark, path).collect()} == {("a", 2), ("b", 2), ("c", 2)}
    columns = spark.createDataFrame([("layer0.q", "energy"), ("layer0.q", "l2_norm"), ("layer0.q", "rank")], "block string, feature string")
    odd = feature(spark, ("a", "layer0.q", "energy", 1.0), ("a", "layer0.q", "other", 1.0), ("b", "layer0.q", "energy", 1.0), ("b", "layer0.q", "l2_norm", 1.0), ("b", "layer0.q", "rank", 1.0))
    assert [tuple(r) for r in storage.width_errors(odd, columns).collect()] == [("a", 2, 1)]
    assert storage.table_checks(cells, names).first().unlabelled_models == 1


BLOCKS = "model_name string, block_raw string, r int, n int, m int, e array<double>"


def test_adaptive_schemas_leave_ranks_out(spark):
    rows = [("a", "x", 2, 8, 4, [1.0, 1.0]), ("a", "y", 2, 8, 4, [1.0, 1.0]), ("b", "x", 3, 8, 4, [1.0] * 3), ("b", "y", 2, 8, 4, [1.0] * 2), ("c", "x", 3, 8, 4, [1.0]), ("c", "y", 2, 8, 4, [1.0, 1.0]), ("d", "x", 2, 8, 4, None), ("d", "y", 2, 8, 4, None), ("e", "x", 2, 9, 4, None), ("e", "y", 2, 8, 4, None)]
    df = spark.createDataFrame(rows, BLOCKS)
    sign = {flag: {r.model_name: r.signature for r in schema.schema_signature(df, flag).collect()} for flag in (None, True, False)}
    assert sign[None]["a"] == sign[None]["b"] == sign[None]["c"] != sign[None]["d"] and len(set(sign[False].values())) == 5
    assert sign[True]["d"] != sign[True]["a"] and sign[None]["d"] == sign[False]["d"]
    of_a = df.where("model_name = 'a'")
    assert {r.model_name: r.reason for r in schema.check_schema(df, of_a, adaptive=True).collect()} == {"a": "ok", "b": "ok", "c": "scale length", "d": "shape mismatch", "e": "shape mismatch"}
    assert {r.model_name: r.reason for r in schema.check_schema(df, of_a).collect()} == {"a": "ok", "b": "shape mismatch", "c": "shape mismatch", "d": "shape mismatch", "e": "shape mismatch"}
    (x, y) = schema.consensus_schema(df).orderBy("block_raw").collect()
    assert (x.n, x.m, x.r, x.r_min, x.r_max, x.e_len, x.n_models) == (8, 4, 2, 2, 3, None, 5) and (y.r_min, y.r_max, y.e_len) == (2, 2, 2)


def test_heads_of_q_and_v_must_agree(spark):
    rows = [("m", "l.0.self_attn.q_proj", 256), ("m", "l.0.self_attn.v_proj", 128), ("m", "l.1.self_attn.q_proj", 256), ("m", "l.1.self_attn.v_proj", 256), ("m", "l.2.self_attn.q_proj", 100), ("m", "l.2.self_attn.v_proj", 256)]
    got = {r.block_raw: r.status for r in schema.head_layout(spark.createDataFrame(rows, "model_name string, block_raw string, m int")).collect()}
    assert [got[b] for _, b, _ in rows] == ["q and v differ"] * 2 + ["ok"] * 2 + ["dim not divisible", "ok"]


def test_channel_sums_of_shards_add_up(spark):
    cells = [(m, f"layer{i}.self_attn.{p}", "energy", float(3 * i + j)) for j, m in enumerate("abcd") for i in range(3) for p in ("q_proj", "v_proj")]
    whole = aggregate.layer_sequence(feature(spark, *cells))
    names = lambda df: {(r.slot, r.feature): (r.n, round(r.mean, 9), round(r.std, 9)) for r in df.collect()}
    parts = [inputs.channel_sums(whole.where(F.col("model_name").isin(*m)), positional=True) for m in (["a"], ["b", "c"], ["d"])]
    assert names(inputs.stats_of_sums(*parts)) == names(inputs.masked_channel_stats(whole, positional=True))
    got = names(inputs.masked_channel_stats(whole, positional=True))
    assert got["position", "layer"] == (12, 1.0, round(math.sqrt(2 / 3), 9)) and got["position", "n_layers"] == (12, 3.0, 1e-3)
    assert inputs.masked_channel_stats(whole, by_depth=True).count() == 6


def test_inference_ranks_are_held_apart(spark):
    train = spark.createDataFrame([(256, 0), (8, 1), (8, 1)], "rank int, label int")
    infer = spark.createDataFrame([(64, None)], "rank int, label int")
    assert {tuple(r) for r in inputs.rank_domains(train, inference=infer).collect()} == {(256, 0, 0, 1, "train"), (8, 1, 1, 2, "train"), (64, None, None, 1, "inference")}
    with pytest.raises(ValueError, match="ranks of training rows: .8"):
        inputs.rank_domains(train, inference=train.where("rank = 8"))


def test_results_do_not_depend_on_shuffle_partitions(spark):
    from adapterlens import plans

    sf = "/root/testdata/sf0.001"
    for name in ("auroc", "kfold_stratified", "aggregate_flat_avg", "merge_dense"):
        query, seen = plans.queries()[name], []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, query(spark, sf).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1], name


def test_features_are_spread_by_size_and_stay_with_their_model(spark, sf_dir, monkeypatch, capsys):
    from adapterlens.sources import views

    monkeypatch.setattr(views, "PART_ROWS", 1000)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert views.n_parts(spark, sf_dir) == -(-rows // 1000) > 4
    capsys.readouterr()
    inputs.pool_layers(aggregate.layer_sequence(views.feature(spark, sf_dir))).explain()
    plan = capsys.readouterr().out
    # one shuffle of the line items, none of the cells
    assert plan.count("Exchange hashpartitioning(model_name") == 1 and "SortAggregate" not in plan


def test_block_names_are_joined_for_null_blocks_and_least_cells_win(spark):
    rows = [("m", "layer1.self_attn.q_proj", "f", 2.0), ("m", "layer1.self_attn.q_proj", "f", None), ("m", None, "f", 3.0), ("m", "layer1.self_attn.query", "f", 0.5)]
    found = aggregate.layer_sequence(spark.createDataFrame(rows, "model_name string, block string, feature string, value double")).collect()
    assert {(r.layer, r.slot, r.value, r.n) for r in found} == {(1, "self.q", None, 3), (None, None, 3.0, 1)}


def test_layer_sequences_sum_up_once_where_no_place_is_shared(spark, sf_dir, capsys):
    from adapterlens.sources import views

    cells = views.feature(spark, sf_dir)
    columns = views.columns(spark, sf_dir)
    assert sorted(columns.collect()) == sorted(cells.select("block", "feature").distinct().collect())
    found = aggregate.layer_sequence(cells, columns)
    assert found.exceptAll(aggregate.layer_sequence(cells)).isEmpty() and found.count() == cells.count()
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("HashAggregate(keys=[model_name") == 4  # cells and places, not also blocks


def test_names_of_sequences_come_from_columns(spark):
    rows = feature(spark, ("a", "layer0.self_attn.q_proj", "energy", 1.0), ("b", "layer.0.self_attn.q", "energy", 2.0), ("b", "layer1.mlp.up", "l2_norm", 4.0), ("c", "odd", "energy", 4.0))
    names, whole = aggregate.depth_names(rows), aggregate.layer_sequence(rows)
    assert sorted(names.collect(), key=str) == sorted(whole.select(*names.columns).distinct().collect(), key=str)
    assert sorted(aggregate.sequence_axes(names).collect(), key=str) == sorted(aggregate.sequence_axes(whole).collect(), key=str)


def test_tables_are_read_in_parts_of_bounded_rows(spark, monkeypatch):
    from adapterlens.sources import views

    sf, before = "/root/testdata/sf0.1", spark.conf.get("spark.sql.files.minPartitionNum", None)
    monkeypatch.setattr(views, "READ_ROWS", 75_000)
    table = views.read_evenly(spark, sf, "lineitem")
    whole = views.read(spark, sf, "lineitem")
    assert table.rdd.getNumPartitions() >= 8 > whole.rdd.getNumPartitions()
    assert table.count() == whole.count() and spark.conf.get("spark.sql.files.minPartitionNum", None) == before


def test_layers_are_pooled_in_tables_of_few_cells(spark, sf_dir, monkeypatch):
    from adapterlens import plans
    from adapterlens.sources import views

    # a part's hash tables hold the cells of 2^15 line items; smaller parts give the same rows
    assert views.PART_ROWS * 3 <= 100_000
    want = sorted(plans.queries()["pool_layers"](spark, sf_dir).collect())
    monkeypatch.setattr(views, "PART_ROWS", 500)
    assert views.n_parts(spark, sf_dir) > 10 and sorted(plans.queries()["pool_layers"](spark, sf_dir).collect()) == want


def test_more_channels_than_bits_are_observed(spark):
    have = {("m", 0): range(0, 130, 3), ("m", 1): range(63, 66), ("k", 0): [129]}
    cells = [(m, f"layer{i}.self_attn.q_proj", f"f{c}", None if c % 2 else 1.0) for (m, i), cs in have.items() for c in cs]
    rows = aggregate.layer_sequence(spark.createDataFrame(cells, "model_name string, block string, feature string, value double"))
    used = sorted({c for cs in have.values() for c in cs})
    want = sorted((m, f"decoder.layer{i}", f"self.q::f{c}", int(c in cs)) for (m, i), cs in have.items() for c in used)
    names = rows.select("slot", "feature").distinct()
    for found in (inputs.observed_channels(rows), inputs.observed_channels(rows, names)):
        assert sorted(map(tuple, found.collect())) == want
