"""Queries over catalogue and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.functions import names as N
from adapterlens.operators import catalogue as C
from adapterlens.operators import schema as S
from adapterlens.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = V.with_views(sql, *needs, more=more)
        return function

    return add


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters with a model_dir; every seventh has no parent folder."""
    whole = F.concat(F.lit("data/"), "folder", F.lit("/"), "model_name")
    return V.adapter(spark, sf_dir).withColumn("model_dir", F.when(F.col("adapter_id") % 7 == 0, F.col("model_name")).otherwise(whole))


TOKENS = "list_filter(string_split({0}, '_'), lambda t: t <> '')"
FIRST = "coalesce(list_position(list_transform({0}, lambda t: regexp_full_match(lower(t), '{1}')), true), 0)"
RANK, SIZE = r"rank\d+(\.\d+)?", r"\d+(\.\d+)?[bm]"
LOCATED = """located as (select *, case when adapter_id % 7 = 0 then model_name else 'data/' || folder || '/' || model_name end as model_dir from fx_adapter),
sub as (select *, case when adapter_id % 7 = 0 then regexp_replace(model_name, '_label\\d+_\\d+$', '') else folder end as subset from located)"""
STEM = LOCATED + f""",
tok as (select *, {TOKENS.format('subset')} as t from sub),
stems as (select *, case when {FIRST.format('t', RANK)} > 0 then t[1:{FIRST.format('t', RANK)} - 1] else t end as stem from tok),
fam as (select *, case when {FIRST.format('stem', SIZE)} > 0 then {FIRST.format('stem', SIZE)} else least(len(stem), 2) end as k from stems),
idn as (select *, case when k = 0 then 'unknown' else array_to_string(stem[1:k], '_') end as model_family, stem[k + 1:] as rest from fam)"""
ATTACK = "case {0} when 'ripple' then 'RIPPLE' when 'syntactic' then 'syntactic' when 'insertsent' then 'insertsent' when 'stybkd' then 'stybkd' when 'stykbd' then 'stybkd' end"
BY_LABEL = "case when contains({0}, 'label0') then 0 when contains({0}, 'label1') then 1 end"


@query("parse_label", f"select model_name, {BY_LABEL.format('model_name')} as parsed from fx_adapter", "fx_adapter")
def _(spark, sf_dir):
    return V.adapter(spark, sf_dir).select("model_name", N.parse_label(F.col("model_name")).alias("parsed"))


@query("subset_name", "select model_name, subset from sub", "fx_adapter", more=LOCATED)
def _(spark, sf_dir):
    return C.with_subsets(located(spark, sf_dir)).select("model_name", "subset")


@query("strip_rank_tokens", "select model_name, array_to_string(stem, '|') as stem from stems", "fx_adapter", more=STEM)
def _(spark, sf_dir):
    return C.with_subsets(located(spark, sf_dir)).select("model_name", F.array_join("stem", "|").alias("stem"))


@query(
    "cohort_prefix",
    """select fam, coalesce(string_agg(token, '|' order by pos) filter (pos < stop), '') as prefix from (
      select *, coalesce(min(pos) filter (not same) over (partition by fam), 1000) as stop from (
        select p.fam, pos, min(token) as token, min(token) = max(token) and count(*) = any_value(n.rows) as same from (
          select fam, unnest(stem) as token, generate_subscripts(stem, 1) as pos from stems) p
        join (select fam, count(*) as rows from stems group by fam) n on n.fam = p.fam group by p.fam, pos)) group by fam""",
    "fx_adapter",
    more=STEM.replace("fam as (select *, case", "famk as (select *, case").replace("from fam)", "from famk)"),
)
def _(spark, sf_dir):
    return C.cohort_prefix(C.with_subsets(located(spark, sf_dir)), "fam").select("fam", F.array_join("tokens", "|").alias("prefix"))


@query("model_family", "select model_name, model_family, array_to_string(rest, '_') as remainder from idn", "fx_adapter", more=STEM)
def _(spark, sf_dir):
    rows, none = C.with_subsets(located(spark, sf_dir)), F.expr("cast(array() as array<string>)")
    return rows.select("model_name", N.model_family(F.col("stem"), none).alias("model_family"), F.array_join(N.family_remainder(F.col("stem"), none), "_").alias("remainder"))


FLAGS = "flags as (select subset, coalesce(bool_or(label = 0), false) as subset_has_clean, coalesce(bool_or(label = 1), false) as subset_has_backdoor from sub group by subset)"


@query("subset_label_flags", "select * from flags", "fx_adapter", more=LOCATED + ", " + FLAGS)
def _(spark, sf_dir):
    return C.subset_label_flags(C.with_subsets(located(spark, sf_dir)))


@query(
    "attack_name",
    f"""select model_name, coalesce(known, case when len(rest) = 0 then 'unknown' else array_to_string(rest, '_') end) as attack_name,
      case when known is not null then 'known_attack_name' when subset_has_clean and subset_has_backdoor then 'mixed_clean_backdoor_folder' else 'folder_name' end as attack_name_source
    from (select i.*, f.subset_has_clean, f.subset_has_backdoor, list_filter(list_transform(rest, lambda t: {ATTACK.format('lower(t)')}), lambda a: a is not null)[1] as known
      from idn i join flags f on f.subset = i.subset)""",
    "fx_adapter",
    more=STEM + ", " + FLAGS,
)
def _(spark, sf_dir):
    return C.identities(located(spark, sf_dir)).select("model_name", "attack_name", "attack_name_source")


# The views' folders have at most one leading variant, of one token or a pair.
REST = "own as (select *, t[len(string_split(model_family, '_')) + 1:] as r0 from idn), trimmed as (select *, case when r0[1] in ('dora') then r0[2:] when r0[1] = 'lora' and r0[2] in ('plus', 'only') then r0[3:] when r0[1] = 'xl' then r0[2:] else r0 end as r1 from own)"


@query(
    "dataset_group",
    f"select model_name, array_to_string(r2[1:coalesce(nullif(list_position(list_transform(r2, lambda t: regexp_full_match(lower(t), '{RANK}') or lower(t) in ('ripple', 'syntactic', 'insertsent', 'stybkd', 'stykbd')), true), 0), 1000) - 1], '_') as dataset_group from (select *, case when r1[1] = 'dora' then r1[2:] when r1[1] = 'lora' and r1[2] = 'plus' then r1[3:] else r1 end as r2 from trimmed)",
    "fx_adapter",
    more=STEM + ", " + REST,
)
def _(spark, sf_dir):
    return C.identities(located(spark, sf_dir)).select("model_name", "dataset_group")


@query(
    "adapter_variant",
    "select model_name, case when contains('_' || subset || '_', '_lora_plus_') then 'lora_plus' when contains('_' || subset || '_', '_lora_only_') then 'lora_only' when list_contains(t, 'dora') then 'dora' else 'lora' end as variant from tok",
    "fx_adapter",
    more=STEM,
)
def _(spark, sf_dir):
    return C.identities(located(spark, sf_dir)).select("model_name", "variant")


@query("parse_rank", "select model_name, try_cast(nullif(regexp_extract(lower(model_name), '(?:^|_)rank(\\d+)(?:\\.\\d+)?(?:_|$)', 1), '') as int) as rank from fx_adapter", "fx_adapter")
def _(spark, sf_dir):
    return V.adapter(spark, sf_dir).select("model_name", N.parse_rank(F.col("model_name")).alias("rank"))


@query("split_folder", "select model_name, case when adapter_id % 7 = 0 then model_name else folder end as split_folder from fx_adapter", "fx_adapter")
def _(spark, sf_dir):
    return located(spark, sf_dir).select("model_name", N.split_folder(F.col("model_dir")).alias("split_folder"))


@query("dataset_location", "select model_name, case when adapter_id % 7 = 0 then model_name else folder end as location from fx_adapter", "fx_adapter")
def _(spark, sf_dir):
    return located(spark, sf_dir).select("model_name", N.dataset_location(F.col("model_dir"), "data").alias("location"))


@query("assert_unique_adapters", "select folder, count(*) as n from fx_adapter group by folder having count(*) > 1", "fx_adapter")
def _(spark, sf_dir):
    return C.assert_unique_adapters(V.adapter(spark, sf_dir), "folder")


@query(
    "assert_disjoint",
    """select cast(sum(t) as bigint) as train, cast(sum(i) as bigint) as infer, cast(sum(t * i) as bigint) as shared, sum(t) > 0 and sum(i) > 0 and sum(t * i) = 0 as ok
    from (select model_name, max((label = 1)::int) as t, max((rank = 8)::int) as i from fx_prediction where label = 1 or rank = 8 group by model_name)""".replace("max((label = 1)::int)", "coalesce(max((label = 1)::int), 0)"),
    "fx_prediction",
)
def _(spark, sf_dir):
    p = V.prediction(spark, sf_dir)
    return C.assert_disjoint(p.where("label = 1"), p.where("rank = 8"))


CLASSES = ["attack2", "attack0", "attack1"]


@query(
    "task_labels",
    "select model_name, case when label = 0 then 0 when label = 1 then case attack_name when 'attack2' then 1 when 'attack0' then 2 when 'attack1' then 3 end end as target, label is null or label = 0 or attack_name in ('attack2', 'attack0', 'attack1') as ok from fx_prediction",
    "fx_prediction",
)
def _(spark, sf_dir):
    return C.task_labels(V.prediction(spark, sf_dir), CLASSES).select("model_name", "target", "ok")


@query("project_binary", "select model_name, case when label is null then null when label = 0 then 0 when attack_name = 'attack3' then null else 1 end as projected from fx_prediction", "fx_prediction")
def _(spark, sf_dir):
    return C.task_labels(V.prediction(spark, sf_dir), CLASSES).select("model_name", C.project_binary().alias("projected"))


# ---- block and feature names
SHORT = "short as (select *, regexp_replace(regexp_replace(regexp_replace(block_raw, '^.*encoder\\.block\\.(\\d+)\\.layer\\.(\\d+)\\.', 'encoder.block\\1.layer\\2.'), '^.*layers\\.(\\d+)\\.', 'layer\\1.'), '^$', '') as block from fx_block_factor)"
ROLE = "case when string_split({0}, '.')[-1] in ('q_proj', 'q', 'query') then 'q' when string_split({0}, '.')[-1] in ('v_proj', 'v', 'value') then 'v' end"
LAYER = r"cast(coalesce(nullif(regexp_extract({0}, '(?:^|\.)block\.?(\d+)', 1), ''), regexp_extract({0}, '(?:^|\.)layers?\.?(\d+)', 1)) as int)"
ARCH = "case when contains(block_raw, 'encoder') then 'encoder' else 'decoder' end"


@query("shorten_block", "select model_name, block_idx, block from short", "fx_block_factor", more=SHORT)
def _(spark, sf_dir):
    return V.block_factor(spark, sf_dir).select("model_name", "block_idx", N.shorten_block(F.col("block_raw")).alias("block"))


@query("qv_role", f"select model_name, block_idx, regexp_replace(block_raw, '\\.[^.]*$', '.qv_sum') as qv_group, {ROLE.format('block_raw')} as role from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    rows = V.block_factor(spark, sf_dir).withColumn("qv", N.qv_role(F.col("block_raw")))
    return rows.select("model_name", "block_idx", F.col("qv.group").alias("qv_group"), F.col("qv.role").alias("role"))


@query("pair_factors", "select model_name, block_raw, cast(row_number() over (partition by model_name order by block_raw) - 1 as int) as block_idx, r, n, m, round(list_sum(a), 6) as sum_a, round(list_sum(b), 6) as sum_b, 'ok' as status from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), 6)
    pairs = S.pair_factors(S.tensors_of(V.block_factor(spark, sf_dir)))
    return pairs.select("model_name", "block_raw", "block_idx", "r", "n", "m", total("a").alias("sum_a"), total("b").alias("sum_b"), "status")


@query("qv_pairs", f"select model_name, regexp_replace(block_raw, '\\.[^.]*$', '.qv_sum') as block_raw, max(block_idx) filter ({ROLE.format('block_raw')} = 'q') as q_idx, max(block_idx) filter ({ROLE.format('block_raw')} = 'v') as v_idx, 'ok' as status from fx_block_factor group by model_name, regexp_replace(block_raw, '\\.[^.]*$', '.qv_sum')", "fx_block_factor")
def _(spark, sf_dir):
    return S.qv_pairs(V.block_factor(spark, sf_dir))


@query("head_layout", "select model_name, block_idx, case when contains(block_raw, 'self_attn') then 128 else 64 end as head_dim, (8 * m) // case when contains(block_raw, 'self_attn') then 128 else 64 end as n_heads from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    wide = V.block_factor(spark, sf_dir).withColumn("m", F.col("m") * 8)  # eight times as tall, so that heads fit
    return S.head_layout(wide).select("model_name", "block_idx", "head_dim", "n_heads")


@query("head_block_name", "select model_name, block_idx, unnest([block || '.head00', block || '.head07', block || '.head11']) as head_block from short", "fx_block_factor", more=SHORT)
def _(spark, sf_dir):
    rows = V.block_factor(spark, sf_dir).select("model_name", "block_idx", N.shorten_block(F.col("block_raw")).alias("block"), F.explode(F.array(F.lit(0), F.lit(7), F.lit(11))).alias("i"))
    return rows.select("model_name", "block_idx", N.head_block_name(F.col("block"), F.col("i"), F.lit(2)).alias("head_block"))


EMITTED = ["energy", "sv_kurtosis", "sv_3", "mean_abs_per_rank", "sv_l1_norm", "block_rank", "other"]
NAMED = f"named as (select model_name, block_idx, block || '.' || e as name, block, e from short, (select unnest({EMITTED}) as e))"


def named_features(spark, sf_dir):
    rows = V.block_factor(spark, sf_dir)
    return rows.select("model_name", "block_idx", F.explode(F.array(*[F.concat(N.shorten_block(F.col("block_raw")), F.lit(f".{e}")) for e in EMITTED])).alias("name"))


@query("parse_feature_name", "select name, model_name, block, e as emitted from named", "fx_block_factor", more=SHORT + ", " + NAMED)
def _(spark, sf_dir):
    return named_features(spark, sf_dir).select("name", "model_name", N.feature_block(F.col("name")).alias("block"), N.emitted_feature(F.col("name")).alias("emitted"))


GROUP_SQL = "case e when 'energy' then 'energy' when 'sv_kurtosis' then 'kurtosis' when 'sv_3' then 'sv_topk' when 'mean_abs_per_rank' then 'mean_abs_per_rank' when 'sv_l1_norm' then 'l1_norm' when 'block_rank' then 'block_rank' end"


@query("feature_group", f"select model_name, name, {GROUP_SQL} as feature_group from named", "fx_block_factor", more=SHORT + ", " + NAMED)
def _(spark, sf_dir):
    return named_features(spark, sf_dir).select("model_name", "name", N.feature_group(N.emitted_feature(F.col("name"))).alias("feature_group"))


@query("rank_normalized_group", f"select model_name, name, case {GROUP_SQL} when 'energy' then 'energy_per_rank' when 'l1_norm' then 'sv_l1_norm_per_rank' else {GROUP_SQL} end as normalized from named", "fx_block_factor", more=SHORT + ", " + NAMED)
def _(spark, sf_dir):
    return named_features(spark, sf_dir).select("model_name", "name", N.rank_normalized_group(N.feature_group(N.emitted_feature(F.col("name")))).alias("normalized"))


@query("build_feature_names", "select distinct block, f.i as place, block || '.' || f.e as name from short, (select unnest(['energy', 'kurtosis', 'sv_kurtosis', 'sv_1', 'sv_2', 'stable_rank']) as e, generate_subscripts([1, 2, 3, 4, 5, 6], 1) - 1 as i) f", "fx_block_factor", more=SHORT)
def _(spark, sf_dir):
    emitted = [x for e in N.expand_groups(["energy", "kurtosis", "sv_topk", "stable_rank"], "both") for x in ([f"sv_{i}" for i in (1, 2)] if e == "sv_topk" else [e])]
    blocks = V.block_factor(spark, sf_dir).select(N.shorten_block(F.col("block_raw")).alias("block")).distinct()
    names = blocks.select("block", F.posexplode(F.array(*map(F.lit, emitted))).alias("place", "e"))
    return names.select("block", F.col("place").cast("long").alias("place"), F.concat("block", F.lit("."), "e").alias("name"))


@query("ordered_blocks", "select block, cast(row_number() over (order by first_id, block) as bigint) as place from (select block, min(adapter_id * 4 + block_idx) as first_id from short group by block)", "fx_block_factor", more=SHORT)
def _(spark, sf_dir):
    from pyspark.sql import Window

    first = V.block_factor(spark, sf_dir).groupBy(N.shorten_block(F.col("block_raw")).alias("block")).agg(F.min(F.col("adapter_id") * 4 + F.col("block_idx")).alias("first_id"))
    return first.select("block", F.row_number().over(Window.orderBy("first_id", "block")).cast("long").alias("place"))  # one row per distinct block


@query("layer_identifier", "select model_name, block_raw, array_to_string(string_split(block_raw, '.')[:-3], '.') as layer from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    return V.block_factor(spark, sf_dir).select("model_name", "block_raw", N.layer_identifier(F.col("block_raw")).alias("layer"))


@query("structural_group", r"select model_name, block, case when contains(block, '.block') then regexp_extract(block, '^(.*?block\d+)', 1) when starts_with(block, 'layer') then regexp_extract(block, '^(layer\d+)', 1) else regexp_extract(block, '^(.*layer\.\d+)', 1) end as grp, case when contains(block, '.block') then regexp_extract(block, '^.*?block\d+\.(.*)$', 1) when starts_with(block, 'layer') then regexp_extract(block, '^layer\d+\.(.*)$', 1) else regexp_extract(block, '^.*layer\.\d+\.(.*)$', 1) end as relative from short", "fx_block_factor", more=SHORT)
def _(spark, sf_dir):
    rows = V.block_factor(spark, sf_dir).select("model_name", N.shorten_block(F.col("block_raw")).alias("block"))
    return rows.select("model_name", "block", N.structural_group(F.col("block")).alias("grp"), N.relative_block(F.col("block")).alias("relative"))


@query("role_bucket", f"select model_name, block_idx, unnest([{ROLE.format('block_raw')}, 'qv_sum', {ROLE.format('block_raw')}, 'other']) as role, unnest([0, 1, 2, 3]) as form from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    b = F.col("block_raw")
    forms = F.array(b, F.regexp_replace(b, r"\.[^.]*$", ".qv_sum"), F.concat(b, F.lit(".head03")), F.concat(b, F.lit(".dense")))
    rows = V.block_factor(spark, sf_dir).select("model_name", "block_idx", F.posexplode(forms).alias("form", "block"))
    return rows.select("model_name", "block_idx", N.role_bucket(F.col("block")).alias("role"), "form")


@query("canonical_depth", f"select model_name, block_raw, {ARCH} as arch, {LAYER.format('block_raw')} as layer, {ARCH} || '.layer' || {LAYER.format('block_raw')} as label from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    return V.block_factor(spark, sf_dir).select("model_name", "block_raw", F.inline(F.array(N.canonical_depth(F.col("block_raw")))))


@query("canonical_slot", f"select model_name, block_raw, 'self' as kind, {ROLE.format('block_raw')} || '.head02' as adapter, 'self.' || {ROLE.format('block_raw')} || '.head02' as label from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    slot = N.canonical_slot(F.concat("block_raw", F.lit(".Head02")))
    return V.block_factor(spark, sf_dir).select("model_name", "block_raw", F.inline(F.array(slot)))


@query("canonical_order", f"select distinct block_raw, cast(dense_rank() over (order by case {ARCH} when 'encoder' then 0 else 1 end, {LAYER.format('block_raw')}) as bigint) as depth_place, cast(dense_rank() over (order by {ROLE.format('block_raw')}) as bigint) as slot_place from fx_block_factor", "fx_block_factor")
def _(spark, sf_dir):
    from pyspark.sql import Window

    blocks = V.block_factor(spark, sf_dir).select("block_raw").distinct()  # one row per block name
    place = lambda key: F.dense_rank().over(Window.orderBy(key)).cast("long")
    keyed = blocks.withColumn("d", N.depth_order(F.col("block_raw"))).withColumn("s", N.slot_order(F.col("block_raw")))
    return keyed.select("block_raw", place("d").alias("depth_place"), place("s").alias("slot_place"))
