"""Queries over feature tables and their aggregation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from adapterlens.operators import aggregate as A
from adapterlens.operators import catalogue as C
from adapterlens.operators import tables as T
from adapterlens.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = V.with_views(sql, *(needs or ("fx_feature",)), more=more)
        return function

    return add


def cells(spark, sf_dir):
    return V.feature(spark, sf_dir)


def parts(spark, sf_dir):
    """Two tables that share a third of the models."""
    f = cells(spark, sf_dir)
    return f.where("l_orderkey % 3 < 2"), f.where("l_orderkey % 3 > 0")


def value(column: str = "value"):
    return F.round(F.col(column).cast("double"), 3).alias("value")


CELLS = "select model_name, block, feature, round(value::double, 3) as value from {0}"
MIXED = "mixed as (select model_name, l_orderkey, case when l_orderkey % 2 = 0 then replace(replace(block, 'q_proj', 'qv_sum'), 'v_proj', 'qv_sum') else block end as block, feature, value from fx_feature)"


def mixed(spark, sf_dir):
    summed = F.regexp_replace("block", "[qv]_proj$", "qv_sum")
    return cells(spark, sf_dir).withColumn("block", F.when(F.col("l_orderkey") % 2 == 0, summed).otherwise(F.col("block")))


@query("select_feature_groups", CELLS.format("fx_feature") + " where feature in ('energy', 'stable_rank')")
def _(spark, sf_dir):
    return T.select_feature_groups(cells(spark, sf_dir), ["energy", "stable_rank"]).select(*T.CELL, value())


@query("filter_qv_mode", CELLS.format("mixed") + " where not ends_with(block, 'qv_sum')", more=MIXED)
def _(spark, sf_dir):
    return T.filter_qv_mode(mixed(spark, sf_dir), "none").select(*T.CELL, value())


@query("project_config", "select model_name, block, feature, round(value::double, 3) as value, dense_rank() over (order by block desc) - 1 as place from fx_feature where feature = 'l2_norm' and block like 'layer1%'")
def _(spark, sf_dir):
    expected = cells(spark, sf_dir).where("feature = 'l2_norm' and block like 'layer1%'").select("block", "feature").distinct()
    from pyspark.sql import Window

    placed = expected.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("block"))) - 1).cast("long"))
    return T.project_config(cells(spark, sf_dir), placed)[0].select(*T.CELL, value(), "place")


@query(
    "align_to_manifest",
    """select count(*) filter (t and m) as matched, count(*) filter (m and not t) as missing, count(*) filter (t and not m) as extra from (
      select model_name, bool_or(t) as t, bool_or(m) as m from (select model_name, true as t, false as m from fx_cells union all select model_name, false, true from fx_catalogue where o_orderkey % 2 = 0) group by model_name)""",
    "fx_cells",
    "fx_catalogue",
)
def _(spark, sf_dir):
    manifest = V.catalogue(spark, sf_dir).where("o_orderkey % 2 = 0").select("model_name", F.col("o_orderkey").alias("pos"))
    return T.align_to_manifest(cells(spark, sf_dir), manifest)[1]


SIZES = "(select count(distinct model_name) from {0}) as n_models, (select count(distinct (block, feature)) from {0}) as n_features, (select count(*) from {0}) as n_cells"


@query(
    "merge_dense",
    """select model_name, block, feature, round(case when l_orderkey % 3 = 2 and feature = 'energy' and l_orderkey % 5 = 0 then value::double * 2 + 1 when l_orderkey % 3 = 2 then value::double * 2 else value::double end, 3) as value, s.* from fx_feature,
      (select *, 0::bigint as repeated, n_models * n_features - n_cells as missing from (select {sizes}, (select count(*) from fx_feature where l_orderkey % 3 = 1) as overlap, (select count(*) from fx_feature where l_orderkey % 3 = 1 and feature = 'energy' and l_orderkey % 5 = 0) as conflicts)) s""".format(sizes=SIZES.format("fx_feature")),
)
def _(spark, sf_dir):
    # the overlap differs within the tolerance, but for some cells; what only the incoming table has is doubled
    base, incoming = parts(spark, sf_dir)
    odd = ((F.col("feature") == "energy") & (F.col("l_orderkey") % 5 == 0)).cast("int")
    own = F.col("value").cast("double")
    changed = F.when(F.col("l_orderkey") % 3 == 2, own * 2 + odd).otherwise(own * 1.000001 + odd * (own + 1))
    return with_counts(T.merge_dense(base.withColumn("value", own), incoming.withColumn("value", changed), V.n_parts(spark, sf_dir)))


def with_counts(merged):
    """Merged cells, each with the one row of counts beside it."""
    cells_, counts = merged
    return cells_.select(*T.CELL, value()).join(F.broadcast(counts))


WITH_FILL = "select model_name, block, feature, round(value::double, 3) as value, s.* from fx_feature, (select *, n_models * n_features - n_cells as zero_filled from (select {sizes})) s"


@query("merge_zero_fill", WITH_FILL.format(sizes=SIZES.format("fx_feature") + ", 0::bigint as shared_models"))
def _(spark, sf_dir):
    f = cells(spark, sf_dir)
    return with_counts(T.merge_zero_fill(f.where("l_orderkey % 3 = 0"), f.where("l_orderkey % 3 > 0")))


@query("merge_auto", CELLS.format("fx_feature"))
def _(spark, sf_dir):
    f = cells(spark, sf_dir)
    return T.merge_auto(f.where("l_orderkey % 3 = 0"), f.where("l_orderkey % 3 > 0"), V.n_parts(spark, sf_dir))[0].select(*T.CELL, value())


@query("merge_schema_groups", WITH_FILL.format(sizes=SIZES.format("fx_feature")))
def _(spark, sf_dir):
    f = cells(spark, sf_dir)
    return with_counts(T.merge_schema_groups(*[f.where(F.col("l_orderkey") % 3 == i) for i in range(3)]))


@query(
    "merge_labels",
    "select model_name, min(label) as label, coalesce(min(label) <> max(label), false) as conflict, min(label) is null as unknown from (select model_name, label from fx_prediction union all select model_name, case when attack_name = 'attack1' then 1 - label else label end from fx_prediction where dataset_group <> 'ds0') group by model_name",
    "fx_prediction",
)
def _(spark, sf_dir):
    p = V.prediction(spark, sf_dir)
    other = p.where("dataset_group <> 'ds0'").withColumn("label", F.when(F.col("attack_name") == "attack1", 1 - F.col("label")).otherwise(F.col("label")))
    return T.merge_labels(p, other)


@query(
    "stack_shards",
    """select coalesce(c.model_name, f.model_name) as model_name, coalesce(case when c.model_name is not null then n end, 0) as n_cells,
      case when c.model_name is null then 'NotInManifest' when n is null then case when c.o_orderkey % 7 = 3 then 'read' else 'MissingShardRow' end end as reason
      from (select model_name, o_orderkey from fx_catalogue where dataset_group <> '5-LOW' union all select 'x' || o_orderkey, o_orderkey from fx_catalogue where dataset_group = '5-LOW') c
      full join (select model_name, count(*) as n from fx_feature group by model_name) f on f.model_name = c.model_name""",
    "fx_feature",
    "fx_catalogue",
)
def _(spark, sf_dir):
    # models of one group have another name in the manifest, so that they are missing here and extra there
    f = cells(spark, sf_dir)
    other = F.when(F.col("dataset_group") == "5-LOW", F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("model_name"))
    manifest = V.catalogue(spark, sf_dir).withColumn("model_name", other).withColumn("pos", F.col("o_orderkey"))
    bad = manifest.where("o_orderkey % 7 = 3").select("model_name", F.lit("read").alias("reason"))
    rows, unfit = T.stack_shards([f.where(F.col("l_orderkey") % 4 == i) for i in range(4)], manifest, bad, V.n_parts(spark, sf_dir))
    per = rows.groupBy("model_name").agg(F.count("*").alias("n_cells"))
    return per.withColumn("reason", F.lit(None).cast("string")).unionByName(unfit.select("model_name", F.lit(0).cast("long").alias("n_cells"), "reason"))


@query("shard_compatible", "select count(distinct s) as n_signatures, count(distinct s) = 1 as ok from (select l_orderkey % 4 as k, string_agg(distinct block || '.' || feature, '|' order by block || '.' || feature) as s from fx_feature group by 1)")
def _(spark, sf_dir):
    return T.shard_compatible(cells(spark, sf_dir).withColumn("shard", F.col("l_orderkey") % 4))


@query("subset_rows", CELLS.format("fx_feature") + " where model_name in (select model_name from fx_catalogue where dataset_group in ('1-URGENT', '5-LOW') and label = 1)", "fx_feature", "fx_catalogue")
def _(spark, sf_dir):
    return T.subset_rows(cells(spark, sf_dir), V.catalogue(spark, sf_dir), dataset_group=["1-URGENT", "5-LOW"], label=[1]).select(*T.CELL, value())


@query("subset_columns", "select f.model_name, f.block, f.feature, round(f.value::double, 3) as value from fx_feature f semi join (select distinct block, feature from fx_feature where l_orderkey < 5) o on o.block = f.block and o.feature = f.feature where f.feature = 'energy'")
def _(spark, sf_dir):
    owned = cells(spark, sf_dir).where("l_orderkey < 5")
    return T.subset_columns(cells(spark, sf_dir), owned, ["energy"]).select(*T.CELL, value())


LINEAGE = """lineage as (select 'region' || n_regionkey as child, 'nation' || n_nationkey as parent from nation union all select 'nation' || c_nationkey, 'customer' || c_custkey from customer),
reach as (select 'region' || r_regionkey as root, 'region' || r_regionkey as node from region union select r.root, l.parent from reach r join lineage l on l.child = r.node),
leaves as (select root, node as leaf from reach where node not in (select child from lineage))"""


def lineage(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nations, customers = V.read(spark, sf_dir, "nation"), V.read(spark, sf_dir, "customer")
    return nations.select(name("region", "n_regionkey").alias("child"), name("nation", "n_nationkey").alias("parent")).unionByName(customers.select(name("nation", "c_nationkey").alias("child"), name("customer", "c_custkey").alias("parent")))


def lineage_roots(spark, sf_dir):
    return V.read(spark, sf_dir, "region").select(F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("root"))


@query("lineage_leaves", "select root, leaf from leaves", "fx_adapter", more=LINEAGE)
def _(spark, sf_dir):
    return T.lineage_leaves(lineage(spark, sf_dir), lineage_roots(spark, sf_dir))


@query(
    "owned_features",
    """select model_name, count(*) as n_owned, min(block) as first_block from (select distinct o.model_name, f.block, f.feature from
      (select distinct 'm' || o_orderkey as model_name, 'customer' || o_custkey as leaf from orders) o
      join (select distinct 'customer' || o.o_custkey as leaf, f.block, f.feature from fx_feature f join orders o on o.o_orderkey = f.l_orderkey) f on f.leaf = o.leaf
      where o.leaf in (select leaf from leaves where root = 'region1')) group by model_name""",
    more=LINEAGE,
)
def _(spark, sf_dir):
    leaf = F.concat(F.lit("customer"), F.col("o_custkey").cast("string")).alias("leaf")
    orders = V.read(spark, sf_dir, "orders")
    members = orders.select(leaf, F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("model_name")).distinct()
    columns = cells(spark, sf_dir).join(orders.select(leaf, F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("model_name")), "model_name").select("leaf", "block", "feature")
    leaves = T.lineage_leaves(lineage(spark, sf_dir), lineage_roots(spark, sf_dir).where("root = 'region1'"))
    return T.owned_features(leaves, members, columns, V.n_parts(spark, sf_dir)).groupBy("model_name").agg(F.count("*").alias("n_owned"), F.min("block").alias("first_block"))


@query("filter_catalogue", "select model_name, dataset_group, label from fx_catalogue where model_name in (select model_name from fx_cells where l_orderkey % 2 = 0)", "fx_cells", "fx_catalogue")
def _(spark, sf_dir):
    return T.filter_catalogue(V.catalogue(spark, sf_dir), cells(spark, sf_dir).where("l_orderkey % 2 = 0"))[0].select("model_name", "dataset_group", "label")


@query(
    "merge_catalogue",
    """select model_name, dataset_group, case when o_orderkey % 4 = 0 and o_orderkey % 3 > 0 then null when o_orderkey % 4 = 0 then 1 - label else label end as label, o_orderkey % 3 = 0 and o_orderkey % 4 > 0 as gap from fx_catalogue""",
    "fx_catalogue",
)
def _(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    first = c.withColumn("label", F.when(F.col("o_orderkey") % 4 > 0, F.col("label")))
    second = c.where("o_orderkey % 3 = 0").withColumn("label", 1 - F.col("label"))
    return T.merge_catalogue(first, second)


@query("catalogue_from_names", "select model_name, label from fx_adapter", "fx_adapter")
def _(spark, sf_dir):
    return T.catalogue_from_names(V.adapter(spark, sf_dir)).select("model_name", "label")


def known(spark, sf_dir):
    whole = F.concat(F.lit("data/"), "folder", F.lit("/"), "model_name")
    return C.identities(V.adapter(spark, sf_dir).withColumn("model_dir", whole))


KNOWN = r"""known as (select *, folder as subset, case when contains(folder, 'insertsent') then 'insertsent' when contains(folder, 'RIPPLE') then 'RIPPLE' when contains(folder, 'stybkd') then 'stybkd' when contains(folder, 'syntactic') then 'syntactic' end as attack,
  case when contains(folder, 'toxic') then 'toxic_backdoors_hard' when contains(folder, 'ag_news') then 'ag_news' else 'imdb' end as dataset_group from fx_adapter)"""


@query(
    "dataset_report",
    """select dataset_group, count(*) as n_samples, count(distinct subset) as n_subsets, count(*) filter (label = 0) as n_clean, count(*) filter (attack = 'RIPPLE') as n_ripple,
      array_to_string((list_sort(list(distinct subset)))[1:10], '|') as subsets from known group by dataset_group""",
    "fx_adapter",
    more=KNOWN,
)
def _(spark, sf_dir):
    # T5 folders begin with a size token after the family, which the dataset's name leaves out
    report = T.dataset_report(known(spark, sf_dir))
    zero = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return report.select("dataset_group", "n_samples", "n_subsets", zero("labels", "0").alias("n_clean"), zero("attacks", "RIPPLE").alias("n_ripple"), F.array_join("subsets", "|").alias("subsets"))


@query(
    "dataset_layouts",
    "select dataset_group, cast(count(distinct l) as int) as n_variants, case when count(distinct l) = 1 then any_value(l) end as layout from (select k.dataset_group, case when k.adapter_id % 5 = 0 then '16x16x2|16x16x3' else '16x16x2' end as l from known k) group by dataset_group",
    "fx_adapter",
    more=KNOWN,
)
def _(spark, sf_dir):
    odd = (F.col("adapter_id") % 5 == 0) & (F.col("block_idx") == 1)
    dims = V.block_factor(spark, sf_dir).select("model_name", F.col("block_raw").alias("block"), "m", "n", F.when(odd, 3).otherwise(F.col("r")).alias("r"))
    return T.dataset_layouts(known(spark, sf_dir), dims)


@query(
    "pivot_vectors",
    """select f.model_name, len(list(f.value)) as n_cells, (select count(distinct (block, feature)) from fx_feature) as width, round(sum(f.value::double * (o.place + 1)), 0) as checksum
    from fx_feature f join (select block, feature, row_number() over (order by block, feature) - 1 as place from (select distinct block, feature from fx_feature)) o on o.block = f.block and o.feature = f.feature group by f.model_name""",
)
def _(spark, sf_dir):
    f = cells(spark, sf_dir)
    vectors = T.pivot_vectors(f, T.feature_order(f))
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    filled = f.groupBy("model_name").agg(F.count("*").alias("n_cells"))
    return vectors.select("model_name", F.size("features").cast("long").alias("width"), F.round(weighted, 0).alias("checksum")).join(filled, "model_name")


# ---- aggregation
ROLE = "case when ends_with(block, 'q_proj') then 'q' when ends_with(block, 'v_proj') then 'v' else 'qv_sum' end"


@query("aggregate_flat_avg", f"select model_name, role, feature, round(avg(v), 3) as value from (select model_name, {ROLE} as role, feature, string_split(block, '.')[1] as grp, avg(value::double) as v from mixed group by all) group by model_name, role, feature", more=MIXED)
def _(spark, sf_dir):
    return A.aggregate_flat_avg(mixed(spark, sf_dir)).select("model_name", "role", "feature", F.round("value", 3).alias("value"))


@query("aggregate_flat_minmax", f"select model_name, {ROLE} as role, feature, round(max(value::double), 3) as value from mixed group by all", more=MIXED)
def _(spark, sf_dir):
    return A.aggregate_flat_minmax(mixed(spark, sf_dir), "max").select("model_name", "role", "feature", F.round("value", 3).alias("value"))


@query("aggregate_single_group", "select c.model_name, round(coalesce(avg(f.value::double), 0), 3) as value from fx_catalogue c left join (select * from fx_feature where feature = 'energy' and block like 'layer2%') f on f.model_name = c.model_name group by c.model_name", "fx_feature", "fx_catalogue")
def _(spark, sf_dir):
    deep = cells(spark, sf_dir).where("feature = 'energy' and block like 'layer2%'")
    return A.aggregate_single_group(deep, "avg", V.catalogue(spark, sf_dir)).select("model_name", F.round("value", 3).alias("value"))


@query(
    "flat_empty_fill",
    f"select role, feature, cast(row_number() over (order by case role when 'q' then 1 when 'v' then 2 else 3 end, feature) - 1 as int) as place, (select count(distinct model_name) from mixed) as n_models, (select count(distinct model_name) from mixed) - count(distinct model_name) as n_filled from (select model_name, {ROLE} as role, feature from mixed) group by role, feature",
    more=MIXED,
)
def _(spark, sf_dir):
    rows = mixed(spark, sf_dir)
    return A.flat_empty_fill(A.aggregate_flat_avg(rows), A.flat_columns(rows))


DEPTHS = f"depths as (select model_name, 'decoder' as arch, cast(regexp_extract(block, 'layer(\\d+)', 1) as int) as layer, 'decoder.' || string_split(block, '.')[1] as depth_label, 'self.' || {ROLE} as slot, feature, value from fx_feature)"


@query("layer_sequence", "select model_name, arch, layer, depth_label, slot, feature, round(value::double, 3) as value, 1::bigint as n from depths", more=DEPTHS)
def _(spark, sf_dir):
    return A.layer_sequence(cells(spark, sf_dir), V.columns(spark, sf_dir)).withColumn("value", value())


@query(
    "sequence_masks",
    "select model_name, cast(count(distinct depth_label) as int) as n_depths, cast((select count(distinct depth_label) from depths) - count(distinct depth_label) as int) as padding, count(*) as n_values, array_to_string(list_sort(list(distinct depth_label)), '|') as groups from depths group by model_name",
    more=DEPTHS,
)
def _(spark, sf_dir):
    return A.sequence_masks(A.layer_sequence(cells(spark, sf_dir), V.columns(spark, sf_dir)))


@query(
    "sequence_axes",
    "select axis, cast(row_number() over (partition by axis order by label) - 1 as int) as place, label from (select distinct 'depth' as axis, depth_label as label from depths union select 'slot', slot from depths union select 'feature', feature from depths)",
    more=DEPTHS,
)
def _(spark, sf_dir):
    return A.sequence_axes(A.depth_names(cells(spark, sf_dir)))


@query("sv_topk_from_names", "select model_name, case when max(n) > 1 then cast(max(n) as int) else 8 end as top_k from (select model_name, l_orderkey % 5 as n from fx_cells) group by model_name", "fx_cells")
def _(spark, sf_dir):
    # values renamed to sv_<i> with i by model; those of one or none keep other names
    i = F.col("l_orderkey") % 5
    named = cells(spark, sf_dir).withColumn("feature", F.when(i > 1, F.concat(F.lit("sv_"), i.cast("string"))).otherwise(F.col("feature")))
    return A.sv_topk_from_names(named, "model_name")
