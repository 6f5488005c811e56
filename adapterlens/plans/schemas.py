"""Queries over block schemas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

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


def uneven(spark, sf_dir):
    """Blocks of which some models lack one and some have another rank."""
    rows = V.block_factor(spark, sf_dir).where("not (adapter_id % 11 = 3 and block_idx = 2)")
    return rows.withColumn("r", F.when((F.col("adapter_id") % 5 == 0) & (F.col("block_idx") == 1), 3).otherwise(F.col("r")))


UNEVEN = "uneven as (select * replace (case when adapter_id % 5 = 0 and block_idx = 1 then 3 else r end as r) from fx_block_factor where not (adapter_id % 11 = 3 and block_idx = 2))"
SIGN = "sign as (select model_name, substr(sha1(string_agg(b, '|' order by b)), 1, 12) as signature from (select model_name, block_raw || ':' || r || ':' || n || ':' || m as b from uneven) group by model_name)"


def scaled(spark, sf_dir):
    """uneven, and every seventh model with scale vectors of two numbers in its blocks."""
    return uneven(spark, sf_dir).withColumn("e", F.when(F.col("adapter_id") % 7 == 0, F.array(F.lit(1.0), F.lit(2.0))))


SCALED = UNEVEN + ", scaled as (select *, case when adapter_id % 7 = 0 then 2 end as e_len from uneven)"
SIGNS = """signs as (select model_name, substr(sha1(string_agg(exact, '|' order by exact)), 1, 12) as exact, substr(sha1(string_agg(loose, '|' order by loose)), 1, 12) as loose, count(e_len) as n_e
  from (select *, concat_ws(':', block_raw, r, n, m, e_len) as exact, concat_ws(':', block_raw, '*', n, m, case when e_len is not null then 'E' end) as loose from scaled) group by model_name)"""
CONSENSUS = """consensus as (select * from (select *, row_number() over (partition by block_raw order by c desc, n, m, r, e_len nulls first) as p from (select block_raw, n, m, r, e_len, count(*) as c from scaled group by all)) where p = 1)"""
REASON = """select model_name, '{0}' as mode, reason = 'ok' as ok, reason from (select u.model_name, case when count(*) filter (f.block_raw is null) > 0 then 'unexpected blocks' when count(f.block_raw) < (select count(*) from {1}) then 'missing blocks'
  when count(*) filter ({2}) < count(f.block_raw) then 'shape mismatch' when count(*) filter ({3}) > 0 then 'scale length' else 'ok' end as reason from scaled u left join {1} f on f.block_raw = u.block_raw group by u.model_name)"""
LOOSE = "f.n = u.n and f.m = u.m and (f.e_len is null) = (u.e_len is null)"


@query(
    "check_schema",
    " union all ".join([
        REASON.format("exact", "first_one", "f.r = u.r and f.n = u.n and f.m = u.m and f.e_len is not distinct from u.e_len", "false"),
        REASON.format("adaptive", "scaled_one", LOOSE, "u.e_len <> u.r"),
        REASON.format("consensus", "consensus", LOOSE, "u.e_len <> u.r"),
    ]),
    "fx_block_factor",
    more=SCALED + ", " + CONSENSUS + ", first_one as (select *, cast(null as int) as e_len from fx_block_factor where adapter_id = 1), scaled_one as (select * from scaled where adapter_id = 7)",
)
def _(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    found = {
        "exact": S.check_schema(rows, V.block_factor(spark, sf_dir).where("adapter_id = 1")),
        "adaptive": S.check_schema(rows, rows.where("adapter_id = 7"), adaptive=True),
        "consensus": S.check_schema(rows, S.consensus_schema(rows), adaptive=True),
    }
    exact, adaptive, consensus = (df.withColumn("mode", F.lit(mode)) for mode, df in found.items())
    return exact.unionByName(adaptive).unionByName(consensus)


@query(
    "schema_signature",
    "select model_name, 'exact' as mode, exact as signature from signs union all select model_name, 'adaptive', loose from signs union all select model_name, 'own', case when n_e > 0 then loose else exact end from signs",
    "fx_block_factor",
    more=SCALED + ", " + SIGNS,
)
def _(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    exact, adaptive, own = (S.schema_signature(rows, flag).withColumn("mode", F.lit(mode)) for mode, flag in (("exact", False), ("adaptive", True), ("own", None)))
    return exact.unionByName(adaptive).unionByName(own)


RANK = r"cast(regexp_extract(model_name, '_rank(\d+)_', 1) as int)"


@query(
    "schema_groups",
    f"""select signature, rank, count(*) as n_models, count(*) filter (label = 0) as n_clean, count(*) filter (label = 1) as n_backdoor, count(*) filter (label is null) as n_unknown,
      min_by(model_name, adapter_id) as first_model, min(adapter_id) as first_id from (select a.*, s.signature, {RANK.replace('model_name', 'a.model_name')} as rank from fx_adapter a join sign s on s.model_name = a.model_name) group by signature, rank""",
    "fx_block_factor",
    more=UNEVEN + ", " + SIGN,
)
def _(spark, sf_dir):
    return S.schema_groups(V.adapter(spark, sf_dir), S.schema_signature(uneven(spark, sf_dir)))


@query("balanced_shards", "select model_name, fam, ntile(4) over (partition by fam order by adapter_id) - 1 as shard from fx_adapter", "fx_adapter")
def _(spark, sf_dir):
    return S.balanced_shards(V.adapter(spark, sf_dir), 4, ["fam"], "adapter_id").select("model_name", "fam", "shard")


@query(
    "qv_mode_fallback",
    "select fam as \"group\", cast(case when fam = 'roberta_base' then 0 else count(*) * 2 end as bigint) as n_pairs, case when fam = 'roberta_base' then 'none' else 'append' end as mode, case when fam = 'roberta_base' then 'warning' else 'ok' end as status from fx_adapter group by fam",
    "fx_adapter",
)
def _(spark, sf_dir):
    rows = V.block_factor(spark, sf_dir)
    no_values = rows.where(~F.col("block_raw").endswith(".value"))
    return S.qv_mode_fallback(no_values, V.adapter(spark, sf_dir).select("model_name", F.col("fam").alias("group")), "append")


@query(
    "schema_layout_summary",
    """select fam, 2 as n_layers, cast(count(distinct (u.m, u.n, u.r)) as int) as n_dims, case when count(distinct (u.m, u.n, u.r)) = 1 then 'single' else 'adaptive' end as kind, min(u.r) as r_min, max(u.r) as r_max
    from uneven u join fx_adapter a on a.model_name = u.model_name group by fam""",
    "fx_block_factor",
    more=UNEVEN,
)
def _(spark, sf_dir):
    return S.schema_layout_summary(uneven(spark, sf_dir).join(V.adapter(spark, sf_dir).select("model_name", "fam"), "model_name"), "fam")


DIMS = r"dims as (select model_name, block_raw as block, m, n, r from uneven union all select model_name, regexp_replace(block_raw, '\.[^.]*$', '.qv_sum'), min(m), min(n), cast(sum(r) as int) from uneven group by model_name, regexp_replace(block_raw, '\.[^.]*$', '.qv_sum') having count(*) = 2)"


@query("block_dims", "select * from dims", "fx_block_factor", more=UNEVEN + ", " + DIMS)
def _(spark, sf_dir):
    return S.block_dims(uneven(spark, sf_dir))


@query(
    "merge_block_dims",
    "select block, min((m, n, r)).m as m, min((m, n, r)).n as n, min((m, n, r)).r as r, min((m, n, r)) <> max((m, n, r)) as conflict from dims group by block".replace("(m, n, r)", "{'m': m, 'n': n, 'r': r}"),
    "fx_block_factor",
    more=UNEVEN + ", " + DIMS,
)
def _(spark, sf_dir):
    dims = S.block_dims(uneven(spark, sf_dir)).withColumn("odd", F.xxhash64("model_name") % 2)
    return S.merge_block_dims(dims.where("odd = 0"), dims.where("odd <> 0"))


@query("resolved_qv_mode", "select model_name, case l_orderkey % 3 when 0 then 'none' when 1 then 'append' else 'only' end as mode from fx_cells group by all", "fx_cells")
def _(spark, sf_dir):
    f = V.feature(spark, sf_dir)
    sums = f.where("l_orderkey % 3 > 0").withColumn("block", F.regexp_replace("block", r"[^.]+$", "qv_sum"))
    return S.resolved_qv_mode(f.where("l_orderkey % 3 < 2").unionByName(sums), "model_name")


BAD = "bad as (select model_name, string_agg(distinct status, '; ' order by status) as reason from (select model_name, case when r = 3 then 'rank' when block_idx = 3 and adapter_id % 4 = 1 then 'read' else 'ok' end as status from uneven) where status <> 'ok' group by model_name)"


def marked(spark, sf_dir):
    rows = uneven(spark, sf_dir)
    return rows.withColumn("status", F.when(F.col("r") == 3, "rank").when((F.col("block_idx") == 3) & (F.col("adapter_id") % 4 == 1), "read").otherwise("ok"))


@query("quarantine", "select u.model_name, b.reason, count(*) as n_blocks from uneven u left join bad b on b.model_name = u.model_name group by all", "fx_block_factor", more=UNEVEN + ", " + BAD)
def _(spark, sf_dir):
    good, bad = S.quarantine(marked(spark, sf_dir))
    kept = good.groupBy("model_name").agg(F.lit(None).cast("string").alias("reason"), F.count("*").alias("n_blocks"))
    lost = bad.join(marked(spark, sf_dir).groupBy("model_name").agg(F.count("*").alias("n_blocks")), "model_name")
    return kept.unionByName(lost)


@query("merge_quarantine", "select model_name, coalesce(max(case when adapter_id % 2 = 0 then 'late' end), any_value(b)) as reason from (select distinct u.adapter_id, u.model_name, bad.reason as b from uneven u left join bad on bad.model_name = u.model_name) where b is not null or adapter_id % 2 = 0 group by model_name", "fx_block_factor", more=UNEVEN + ", " + BAD)
def _(spark, sf_dir):
    _, bad = S.quarantine(marked(spark, sf_dir))
    late = V.adapter(spark, sf_dir).where("adapter_id % 2 = 0").select("model_name", F.lit("late").alias("reason"))
    return S.merge_quarantine(bad, late)
