"""Queries over manifests, listings and stored tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adapterlens.operators import schema as S
from adapterlens.sources import manifests as M
from adapterlens.sources import storage as T
from adapterlens.sources import views as V
from adapterlens.sources.shared import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, *needs: str, more: str = ""):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = V.with_views(sql, *needs, more=more)
        return function

    return add


def scratch(spark) -> str:
    """A fresh folder where driver and executors share files."""
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


def manifest_texts(spark, sf_dir):
    """One manifest per document source: a range, plain entries, a list with repeats, a pattern with {i}."""
    docs = V.read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    lo, hi = F.col("lo").cast("string"), (F.col("lo") + F.col("n")).cast("string")
    path = F.concat(
        F.lit('{"path":[{"path":"'), "source", F.lit('_","indices":['), lo, F.lit(","), hi, F.lit(']},"plain/'), "source", F.lit('",{"path":"p{i}/'), "source",
        F.lit('","indices":"[7, 3,7,1]"}],"cv_always_train":{"path":"'), "source", F.lit('#","indices":[4,9]},"train":{"sources":["t/'), "source", F.lit('"]}}'),
    )
    return docs.select("source", path.alias("content"))


SOURCES = "src as (select source, min(doc_id) as lo, count(*) as n from documents group by source)"
PATH_ROWS = "select source, 'path' as section, 0 as item, i - lo as entry_pos, source || '_' || i as raw_entry, 'ok' as status from (select *, unnest(range(lo, lo + n + 1)) as i from src) union all select source, 'path', 1, 0, 'plain/' || source, 'ok' from src union all select source, 'path', 2, p, 'p' || i || '/' || source, 'ok' from src, (select unnest([0, 1, 2]) as p, unnest([7, 3, 1]) as i)"


@query("scan_manifest", PATH_ROWS, more=SOURCES)
def _(spark, sf_dir):
    return M.expand_manifests(manifest_texts(spark, sf_dir), ("path",)).withColumn("entry_pos", F.col("entry_pos").cast("long"))


@query("scan_manifest_sections", PATH_ROWS + " union all select source, 'cv_always_train', 0, i - 4, source || '#' || i, 'ok' from src, (select unnest(range(4, 10)) as i) union all select source, 'train', 0, 0, 't/' || source, 'ok' from src", more=SOURCES)
def _(spark, sf_dir):
    return M.expand_manifests(manifest_texts(spark, sf_dir)).withColumn("entry_pos", F.col("entry_pos").cast("long"))


@query(
    "resolve_adapter_file",
    "select raw_entry, case when k = 1 then raw_entry || '/adapter_model.safetensors' when k = 2 then raw_entry || '/best_model/adapter_model.safetensors' when k = 3 then raw_entry || '/adapter_model.safetensors' end as adapter_path, case when k = 0 then 'missing' else 'ok' end as status from (select source || '/' || doc_id as raw_entry, doc_id % 4 as k from documents)",
)
def _(spark, sf_dir):
    entries = V.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("raw_entry"), (F.col("doc_id") % 4).alias("k"))
    top, best = F.concat("raw_entry", F.lit("/adapter_model.safetensors")), F.concat("raw_entry", F.lit("/best_model/adapter_model.safetensors"))
    listing = entries.select(F.explode(F.array_compact(F.array(F.when(F.col("k") % 2 == 1, top), F.when(F.col("k") > 1, best), F.concat("raw_entry", F.lit("/config.json"))))).alias("path"))
    return M.resolve_adapter_file(entries, listing)


def tensor_files(spark, sf_dir):
    """model_name, content: the adapters' factors packed into one tensor file each."""

    def pack(frame):
        import numpy as np
        import pandas as pd

        tensors = {}
        for r in frame.itertuples():
            tensors[f"{r.block_raw}.lora_A.weight"] = np.asarray(r.a).reshape(r.r, r.n)
            tensors[f"{r.block_raw}.lora_B.weight"] = np.asarray(r.b).reshape(r.m, r.r)
        return pd.DataFrame({"model_name": [frame["model_name"].iloc[0]], "content": [T.tensor_file(tensors)]})

    return V.block_factor(spark, sf_dir).groupBy("model_name").applyInPandas(pack, "model_name string, content binary")


TENSORS = "tensors as (select model_name, block_raw || '.lora_A.weight' as tensor_key, a as x, [2, 16] as shape from fx_block_factor union all select model_name, block_raw || '.lora_B.weight', b, [16, 2] from fx_block_factor)"


@query("scan_adapter_tensors", "select model_name, tensor_key, shape[1] as rows, shape[2] as columns, round(list_sum(x), 4) as total, 'ok' as status from tensors", "fx_block_factor", more=TENSORS)
def _(spark, sf_dir):
    rows = T.decode_tensors(tensor_files(spark, sf_dir))
    total = F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4)
    return rows.select("model_name", "tensor_key", F.get("shape", F.lit(0)).alias("rows"), F.get("shape", F.lit(1)).alias("columns"), total.alias("total"), "status")


@query("inspect_tensor_schema", "select model_name, count(*) as n_keys, string_agg(tensor_key, '|' order by tensor_key) as keys, '0,1' as layers, 256::bigint as n_parameters from tensors group by model_name", "fx_block_factor", more=TENSORS)
def _(spark, sf_dir):
    return T.inspect_tensor_schema(S.tensors_of(V.block_factor(spark, sf_dir)))


@query(
    "tensor_flat_chunks",
    "select model_name, tensor_key, base + k * 12 as write_offset, cast(len(x[k * 12 + 1:k * 12 + 12]) as int) as n, round(list_sum(x[k * 12 + 1:k * 12 + 12]), 5) as total from (select *, (row_number() over (partition by model_name order by tensor_key) - 1) * 32 as base from tensors), (select unnest([0, 1, 2]) as k)",
    "fx_block_factor",
    more=TENSORS,
)
def _(spark, sf_dir):
    rows = T.tensor_flat_chunks(S.tensors_of(V.block_factor(spark, sf_dir)), 12)
    return rows.select("model_name", "tensor_key", "write_offset", F.size("chunk").alias("n"), F.round(F.aggregate("chunk", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(
    "read_feature_table",
    """select (select count(*) from fx_feature) as n_cells, 0::bigint as repeated_cells, w.n_columns, count(*) filter (w.width < w.n_columns) as wrong_width, (select count(distinct model_name) from fx_catalogue) as n_models,
      (select count(*) from (select model_name from fx_catalogue group by 1 having count(*) > 1)) as repeated_models, (select count(distinct model_name) from fx_cells where model_name not in (select model_name from fx_catalogue where o_orderkey % 2 = 0)) as unlisted_models,
      (select count(distinct model_name) from fx_catalogue where o_orderkey % 3 = 0) as unlabelled_models
    from (select model_name, count(*) as width, (select count(*) from (select distinct block, feature from fx_feature)) as n_columns from fx_feature group by model_name) w group by w.n_columns""",
    "fx_feature",
    "fx_catalogue",
)
def _(spark, sf_dir):
    catalogue = V.catalogue(spark, sf_dir)
    checks = T.cell_checks(V.feature(spark, sf_dir), catalogue.where("o_orderkey % 2 = 0"))
    partly = catalogue.withColumn("label", F.when(F.col("o_orderkey") % 3 > 0, F.col("label")))
    return checks.join(T.catalogue_checks(partly))


@query(
    "write_feature_table",
    "select model_name, block, feature, feature as feature_group, round(value::double, 3) as value, (select count(*) from fx_feature g where g.model_name = f.model_name) as n_stored from fx_feature f",
    "fx_feature",
)
def _(spark, sf_dir):
    # a third of the models, then a write that ends before its state, then all: what is there is not written again
    path, f, catalogue = scratch(spark), V.feature(spark, sf_dir), V.catalogue(spark, sf_dir)
    T.write_feature_table(f.where("l_orderkey % 3 = 0"), catalogue, path)
    T.append_features(f.where("l_orderkey % 3 = 1"), path)
    T.write_feature_table(f, catalogue, path)
    back = T.read_feature_table(spark, path)[0].join(T.stored_state(spark, path).select("model_name", F.col("n_cells").alias("n_stored")), "model_name")
    return back.select("model_name", "block", "feature", "feature_group", F.round(F.col("value").cast("double"), 3).alias("value"), "n_stored")


@query("write_predictions", "select row_number() over (order by model_name) - 1 as index, model_name, coalesce(label::varchar, '') as label, round(score, 9) as backdoor_score from fx_prediction", "fx_prediction")
def _(spark, sf_dir):
    path = scratch(spark)
    T.write_predictions(V.prediction(spark, sf_dir), path)
    back = spark.read.schema("index bigint, model_name string, label string, backdoor_score double").option("header", True).csv(path)
    return back.select("index", "model_name", F.coalesce("label", F.lit("")).alias("label"), F.round("backdoor_score", 9).alias("backdoor_score"))


@query("write_report_tables", "select attack_name, count(*) as n from fx_prediction group by attack_name", "fx_prediction")
def _(spark, sf_dir):
    path = scratch(spark)
    T.write_report_tables({"attacks": V.prediction(spark, sf_dir).groupBy("attack_name").agg(F.count("*").alias("n"))}, path)
    return spark.read.schema("attack_name string, n bigint").json(f"{path}/attacks")


AVAILABLE = "avail as (select dense_rank() over (order by source, doc_id % 2) - 1 as source_pos, doc_id as index, n_chars as bytes, source, doc_id % 2 as label from documents)"


def available(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents")
    names = docs.select("source", (F.col("doc_id") % 2).alias("label")).distinct()
    from pyspark.sql import Window

    placed = names.withColumn("source_pos", (F.row_number().over(Window.orderBy("source", "label")) - 1).cast("long"))  # one row per source and label
    return docs.withColumn("label", F.col("doc_id") % 2).join(F.broadcast(placed), ["source", "label"]).select("source_pos", F.col("doc_id").alias("index"), F.col("n_chars").alias("bytes"))


@query("round_robin_sample", "select source_pos, index from (select *, row_number() over (partition by source_pos order by index) as turn from avail) order by turn, source_pos limit 150", more=AVAILABLE)
def _(spark, sf_dir):
    return M.round_robin_sample(available(spark, sf_dir), 150).select("source_pos", "index")


@query("list_available_indices", "select source as subset, cast(doc_id % 2 as int) as label, doc_id as index from documents where doc_id % 5 > 0")
def _(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("_label"), (F.col("doc_id") % 2).cast("string"), F.lit("_"), F.col("doc_id").cast("string"))
    folder = F.when(F.col("doc_id") % 5 == 0, F.lit("elsewhere")).otherwise(F.col("source"))
    return M.list_available_indices(docs.select(F.concat_ws("/", F.lit("data"), folder, name).alias("path")))


@query("estimate_selection_size", "select source_pos, count(*) as n, count(*) * min_by(bytes, index) as bytes from avail group by source_pos", more=AVAILABLE)
def _(spark, sf_dir):
    rows = available(spark, sf_dir)
    return M.estimate_selection_size(rows, rows)
