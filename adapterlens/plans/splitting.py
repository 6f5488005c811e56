"""Queries over splits, training inputs and weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from adapterlens.operators import aggregate as A
from adapterlens.operators import inputs as I
from adapterlens.operators import splits as S
from adapterlens.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = V.with_views(sql, *(needs or ("fx_prediction",)), more=more)
        return function

    return add


def labelled(spark, sf_dir):
    return V.prediction(spark, sf_dir).where("label is not null").withColumn("folder", F.col("dataset_group"))


LAB = "lab as (select *, dataset_group as folder from fx_prediction where label is not null)"
RANKED = "row_number() over (partition by {0} order by md5('{1}:' || model_name), model_name)"
SIZE = "count(*) over (partition by {0})"


def share(n: str, pct: int) -> str:
    return f"greatest(1, least({n} - 1, floor({n} * {pct} / 100.0 + 0.5)))"


def split_sql(keys: str, pct: int, seed: int) -> str:
    return f"select model_name, case when n < 2 or place <= {share('n', pct)} then 'train' else 'infer' end as partition from (select *, {RANKED.format(keys, seed)} as place, {SIZE.format(keys)} as n from lab)"


def cal_sql(keys: str, pct: int, seed: int) -> str:
    return f"select model_name, case when n >= 2 and place > n - {share('n', pct)} then 'calibration' else 'fit' end as role from (select *, {RANKED.format(keys, seed)} as place, {SIZE.format(keys)} as n from lab)"


@query("holdout_stratified", split_sql("label", 80, 42), more=LAB)
def _(spark, sf_dir):
    return S.holdout_stratified(labelled(spark, sf_dir), 80, 42).select("model_name", "partition")


@query("holdout_folder_label", split_sql("folder, label", 70, 7), more=LAB)
def _(spark, sf_dir):
    return S.holdout_folder_label(labelled(spark, sf_dir), 70, 7).select("model_name", "partition")


@query("calibration_stratified", cal_sql("label", 20, 42), more=LAB)
def _(spark, sf_dir):
    return S.calibration_stratified(labelled(spark, sf_dir), 20, 42).select("model_name", "role")


@query("calibration_rank_label", cal_sql("rank, label", 20, 43), more=LAB)
def _(spark, sf_dir):
    return S.calibration_rank_label(labelled(spark, sf_dir), 20, 43).select("model_name", "role")


@query("calibration_folder_label", cal_sql("folder, label", 15, 44), more=LAB)
def _(spark, sf_dir):
    return S.calibration_folder_label(labelled(spark, sf_dir), 15, 44).select("model_name", "role")


@query("split_summary", f"select partition, folder, count(*) as n, count(*) filter (label = 0) as n_clean, count(*) filter (label = 1) as n_backdoor from ({split_sql('label', 80, 42).replace('select model_name,', 'select folder, label,')}) group by partition, folder", more=LAB)
def _(spark, sf_dir):
    return S.split_summary(S.holdout_stratified(labelled(spark, sf_dir), 80, 42), "partition", "folder")


FOLD = "select model_name, {1} as seed, cast((place - 1 + o) % {2} as int) as fold from (select l.model_name, row_number() over (partition by {0} order by md5('{1}:' || model_name), model_name) as place, coalesce((select count(*) from lab p where p.label < l.label), 0) as o from lab l)"


@query("kfold_stratified", FOLD.format("label", 42, 5) + " union all " + FOLD.format("label", 43, 5), more=LAB)
def _(spark, sf_dir):
    return S.kfold_stratified(labelled(spark, sf_dir), 5, [42, 43])


@query("sanitize_folds", "select case when min(n) < 2 then 1 else cast(least(5, min(n)) as int) end as folds, min(n) as min_count from (select label, count(*) as n from lab group by label)", more=LAB)
def _(spark, sf_dir):
    return S.sanitize_folds(labelled(spark, sf_dir), 5)


@query("strata_keys", "select model_name, 'rank_' || rank || '_label_' || label as stratum from lab", more=LAB)
def _(spark, sf_dir):
    return S.strata_keys(labelled(spark, sf_dir), "rank").select("model_name", "stratum")


@query(
    "kfold_leave_attack_out",
    """select model_name, cast(substr(attack_name, 7) as int) as fold from lab where label = 1
    union all select model_name, cast(ntile(4) over (order by md5('42:' || model_name), model_name) - 1 as int) from lab where label = 0""",
    more=LAB,
)
def _(spark, sf_dir):
    return S.kfold_leave_attack_out(labelled(spark, sf_dir), 42)


@query("kfold_leave_dataset_out", "select dataset_group, cast(row_number() over (order by dataset_group) - 1 as int) as fold, count(*) as n_valid, count(distinct label) as valid_classes, true as ok from lab group by dataset_group", more=LAB)
def _(spark, sf_dir):
    return S.kfold_leave_dataset_out(labelled(spark, sf_dir))


@query(
    "pin_always_train",
    f"""select f.model_name, cast(k as int) as fold, case when f.fold = k then 'valid' else 'train' end as role from ({FOLD.format('label', 42, 3)}) f, (select unnest(range(3)) as k) where f.model_name not in (select model_name from lab where attack_name = 'attack1')
    union all select model_name, cast(k as int), 'train' from lab, (select unnest(range(3)) as k) where attack_name = 'attack1'""",
    more=LAB,
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return S.pin_always_train(S.kfold_stratified(rows, 3, [42]), rows.where("attack_name = 'attack1'"), 3)


# explicit manifests with faults: a dataset's attack in both, one in neither, one that the complete manifest lacks
SECTIONS = """sections as (select model_name, dataset_group <> 'ds2' as train, (dataset_group = 'ds2' and attack_name <> 'attack3') or (dataset_group = 'ds1' and attack_name = 'attack1') as infer,
  not (dataset_group = 'ds0' and attack_name = 'attack2') as complete from fx_prediction)"""


@query(
    "materialize_split",
    f"""select 'share' as form, model_name, partition as section, 'ok' as status from ({split_sql('label', 60, 5)}) union all select 'share', model_name, null, 'unlabelled' from fx_prediction where label is null
    union all select 'explicit', model_name, case when train then 'train' when infer then 'infer' end, case when train and infer then 'overlap' when not train and not infer then 'missing' when not complete then 'not in manifest' else 'ok' end from sections""",
    more=LAB + ", " + SECTIONS,
)
def _(spark, sf_dir):
    p = V.prediction(spark, sf_dir)
    train, infer = p.where("dataset_group <> 'ds2'"), p.where("(dataset_group = 'ds2' and attack_name <> 'attack3') or (dataset_group = 'ds1' and attack_name = 'attack1')")
    explicit = S.materialize_split(p.where("not (dataset_group = 'ds0' and attack_name = 'attack2')"), train=train, infer=infer)
    return S.materialize_split(p, 60, 5).withColumn("form", F.lit("share")).unionByName(explicit.withColumn("form", F.lit("explicit")))


@query(
    "partition_plan",
    f"""select model_name, 'inference' as role from held where partition = 'infer' union all
    select model_name, case when n >= 2 and place > n - {share('n', 20)} then 'calibration' else 'fit' end from (select *, {RANKED.format('rank, label', 43)} as place, {SIZE.format('rank, label')} as n from held where partition = 'train')""",
    more=LAB + ", held as (" + split_sql("label", 80, 42).replace("select model_name,", "select model_name, label, rank,") + ")",
)
def _(spark, sf_dir):
    return S.partition_plan(labelled(spark, sf_dir), 80, 20, 42, by="rank").select("model_name", "role")


# ---- inputs
SLICED = "sliced as (select f.model_name, f.l_orderkey % 2 as slice, c.dataset_group, f.block, f.feature, f.value::double as value from fx_feature f join fx_catalogue c on c.o_orderkey = f.l_orderkey)"


def sliced(spark, sf_dir):
    keys = V.catalogue(spark, sf_dir).select("model_name", "dataset_group")
    return V.feature(spark, sf_dir).join(keys, "model_name").select("model_name", (F.col("l_orderkey") % 2).alias("slice"), "dataset_group", "block", "feature", "value")


STD = "select s.model_name, s.block, s.feature, round((s.value - m) / {0}, 4) as value from sliced s join (select slice, dataset_group, block, feature, avg(value) as m, stddev_pop(value) as sd from sliced group by all) t using (slice, dataset_group, block, feature)"


@query("standardize_by_dataset", STD.format("case when sd <= 1e-6 then 1 else sd end"), "fx_feature", "fx_catalogue", more=SLICED)
def _(spark, sf_dir):
    return I.standardize_by_dataset(sliced(spark, sf_dir)).select("model_name", "block", "feature", F.round("value", 4).alias("value"))


@query("standardize_by_dataset_masked", STD.format("sqrt(greatest(sd * sd, 1e-6))"), "fx_feature", "fx_catalogue", more=SLICED)
def _(spark, sf_dir):
    return I.standardize_by_dataset_masked(sliced(spark, sf_dir)).select("model_name", "block", "feature", F.round("value", 4).alias("value"))


@query(
    "standard_scaler",
    "select s.model_name, s.block, s.feature, round((s.value - m) / case when sd <= 1e-6 then 1 else sd end, 4) as value from sliced s join (select block, feature, avg(value) as m, stddev_pop(value) as sd from sliced where slice = 0 group by all) t using (block, feature) where s.slice = 1",
    "fx_feature",
    "fx_catalogue",
    more=SLICED,
)
def _(spark, sf_dir):
    rows = sliced(spark, sf_dir)
    return I.standard_scaler(rows.where("slice = 0"), rows.where("slice = 1")).select("model_name", "block", "feature", F.round("value", 4).alias("value"))


ROLE = "case when ends_with(block, 'q_proj') then 'q' else 'v' end"
DEPTHS = f"depths as (select model_name, l_orderkey, cast(regexp_extract(block, 'layer(\\d+)', 1) as int) as layer, 'decoder.' || string_split(block, '.')[1] as depth_label, 'self.' || {ROLE} as slot, feature, value::double as value from fx_feature)"


def depths(spark, sf_dir, train: bool = False):
    f = V.feature(spark, sf_dir)
    return A.layer_sequence(f.where("l_orderkey % 4 > 0") if train else f, V.columns(spark, sf_dir))


@query("masked_feature_stats", "select feature, round(avg(value), 3) as mean, round(stddev_pop(value), 3) as std from depths where l_orderkey % 4 > 0 group by feature", "fx_feature", more=DEPTHS)
def _(spark, sf_dir):
    return I.masked_feature_stats(depths(spark, sf_dir, True)).select("feature", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


CHANNELS = """layers as (select d.model_name, d.depth_label, any_value(d.layer) as layer, any_value(d.layer) / greatest(any_value(m.top), 1) as layer_share, (any_value(r.place) - 1) / greatest(any_value(m.n) - 1, 1) as position_share, any_value(m.n) as n_layers
    from kept d join (select model_name, max(layer) as top, count(distinct layer) as n from kept group by model_name) m on m.model_name = d.model_name
    join (select model_name, depth_label, row_number() over (partition by model_name order by layer) as place from (select distinct model_name, depth_label, layer from kept)) r on r.model_name = d.model_name and r.depth_label = d.depth_label group by d.model_name, d.depth_label),
  channels as (select slot, feature, depth_label, value from kept union all select 'position', u.f, depth_label, u.v from layers, lateral (select unnest(['layer', 'layer_share', 'position_share', 'n_layers']) as f, unnest([layer, layer_share, position_share, n_layers]::double[]) as v) u)"""


@query(
    "masked_channel_stats",
    """select slot, feature, '' as depth_label, count(*) as n, round(avg(value), 3) as mean, round(sqrt(greatest(var_pop(value), 1e-6)), 3) as std from channels group by slot, feature
    union all select slot, feature, depth_label, count(*), round(avg(value), 3), round(sqrt(greatest(var_pop(value), 1e-6)), 3) from channels group by slot, feature, depth_label""",
    "fx_feature",
    more=DEPTHS + ", kept as (select * from depths where l_orderkey % 4 > 0), " + CHANNELS,
)
def _(spark, sf_dir):
    f = V.feature(spark, sf_dir)
    # the sums of three shards of models, put together
    shards = [I.channel_sums(A.layer_sequence(f.where(f"l_orderkey % 4 = {k}"), V.columns(spark, sf_dir)), positional=True) for k in (1, 2, 3)]
    whole = I.stats_of_sums(*shards).withColumn("depth_label", F.lit(""))
    by_depth = I.stats_of_sums(*shards, by=("slot", "feature", "depth_label"))
    return whole.unionByName(by_depth).select("slot", "feature", "depth_label", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query(
    "observed_channels",
    "select g.model_name, g.depth_label, c.channel, cast(max(case when d.slot || '::' || d.feature = c.channel then 1 else 0 end) as int) as observed from (select distinct model_name, depth_label from depths) g, (select distinct slot || '::' || feature as channel from depths) c, depths d where d.model_name = g.model_name and d.depth_label = g.depth_label group by all",
    "fx_feature",
    more=DEPTHS,
)
def _(spark, sf_dir):
    return I.observed_channels(depths(spark, sf_dir), A.depth_names(V.columns(spark, sf_dir)))


@query(
    "layer_vectors",
    """select d.model_name, d.depth_label, count(*) as n_cells, round(sum(value), 2) as total, count(distinct slot) as n_slots, true as has_self, false as has_cross, false as is_encoder, any_value(layer) as layer,
      any_value(layer) / greatest(any_value(m.top), 1) as layer_share, (any_value(r.place) - 1) / greatest(any_value(m.n) - 1, 1) as position_share, cast(any_value(m.n) as int) as n_layers
    from depths d join (select model_name, max(layer) as top, count(distinct layer) as n from depths group by model_name) m on m.model_name = d.model_name
    join (select model_name, depth_label, row_number() over (partition by model_name order by layer) as place from (select distinct model_name, depth_label, layer from depths)) r on r.model_name = d.model_name and r.depth_label = d.depth_label
    group by d.model_name, d.depth_label""",
    "fx_feature",
    more=DEPTHS,
)
def _(spark, sf_dir):
    rows = I.layer_vectors(depths(spark, sf_dir))
    total = F.round(F.aggregate(F.map_values("cells"), F.lit(0.0), lambda s, x: s + x), 2)
    return rows.withColumn("n_cells", F.size("cells").cast("long")).withColumn("total", total).drop("cells")


@query("retain_slots", "select count(*) as kept, 0::bigint as other from depths", "fx_feature", more=DEPTHS)
def _(spark, sf_dir):
    return I.retain_slots(depths(spark, sf_dir))[1]


@query("sequence_validity", "select c.model_name, count(distinct d.depth_label) as n_layers, count(d.depth_label) > 0 as valid from fx_catalogue c left join (select * from depths where layer = 2) d on d.model_name = c.model_name group by c.model_name", "fx_feature", "fx_catalogue", more=DEPTHS)
def _(spark, sf_dir):
    return I.sequence_validity(depths(spark, sf_dir).where("layer = 2"), V.catalogue(spark, sf_dir))


@query("pool_layers", "select model_name, slot, feature, round(avg(value), 3) as mean, round(max(value), 3) as max from depths group by model_name, slot, feature", "fx_feature", more=DEPTHS)
def _(spark, sf_dir):
    return I.pool_layers(depths(spark, sf_dir)).select("model_name", "slot", "feature", F.round("mean", 3).alias("mean"), F.round("max", 3).alias("max"))


@query("class_weights", "select label as class, count(*) as n, round((select count(*) from lab) / (2.0 * count(*)), 9) as weight, round((select count(*) from lab where label = 0) / (select count(*) from lab where label = 1), 9) as binary_pos_weight from lab group by label", more=LAB)
def _(spark, sf_dir):
    return I.class_weights(labelled(spark, sf_dir)).select("class", "n", F.round("weight", 9).alias("weight"), F.round("binary_pos_weight", 9).alias("binary_pos_weight"))


@query("rank_label_weights", "select rank, label, count(*) as n, round((select count(*) from lab) / (6.0 * count(*)), 9) as weight from lab group by rank, label", more=LAB)
def _(spark, sf_dir):
    return I.rank_label_weights(labelled(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(
    "rank_domains",
    "select rank, case rank when 256 then 0 else 1 end as domain, label, count(*) as n, 'train' as part from lab where rank <> 64 group by rank, label union all select rank, null, label, count(*), 'inference' from fx_prediction where rank = 64 group by rank, label",
    more=LAB,
)
def _(spark, sf_dir):
    return I.rank_domains(labelled(spark, sf_dir).where("rank <> 64"), inference=V.prediction(spark, sf_dir).where("rank = 64"))
