"""Stored tables: tensors, feature tables, predictions and reports."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that cut the order of predictions, about.
BOUNDS = 256
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}


def tensors_in(content: bytes) -> Iterator[tuple[str, list[int], np.ndarray]]:
    """(key, shape, values) of a tensor file: length of a JSON header, the header, raw numbers."""
    size = struct.unpack("<Q", content[:8])[0]
    for key, spec in sorted(json.loads(content[8 : 8 + size]).items()):
        if key != "__metadata__" and spec["dtype"] in KINDS:
            start, end = spec["data_offsets"]
            yield key, spec["shape"], np.frombuffer(content[8 + size + start : 8 + size + end], dtype=KINDS[spec["dtype"]]).astype(np.float32)


def tensor_file(tensors: dict[str, np.ndarray]) -> bytes:
    """The bytes of a tensor file of 32-bit numbers."""
    head, data = {}, b""
    for key, x in tensors.items():
        raw = np.ascontiguousarray(x, dtype="<f4").tobytes()
        head[key] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + data


def decode_tensors(files: DataFrame) -> DataFrame:
    """tensor(model_name, tensor_key, shape, values, status) of files(model_name, content).

    A file that cannot be read keeps one row whose status says why, for `quarantine`.
    """
    schema = pa.schema([("model_name", pa.string()), ("tensor_key", pa.string()), ("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float32())), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("model_name").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [{"model_name": name, "tensor_key": k, "shape": s, "values": v, "status": "ok"} for k, s, v in tensors_in(content.as_py() or b"")]
                except (ValueError, KeyError, struct.error, UnicodeDecodeError) as e:
                    rows = [{"model_name": name, "status": f"unreadable: {type(e).__name__}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("model_name", "content").mapInArrow(run, "model_name string, tensor_key string, shape array<int>, values array<float>, status string")


def scan_adapter_tensors(spark: SparkSession, folder: str) -> DataFrame:
    """Tensors of all *.safetensors files below a folder; the model is the file's folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(folder)
    return decode_tensors(files.select(F.element_at(F.split("path", "/"), -2).alias("model_name"), "content"))


#: Bytes of one range of a tensor file.
RANGE_BYTES = 8 << 20


def _opened(uri: str):
    """A file of any store that pyarrow knows (local, s3, gs, hdfs), for reading at places."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def tensor_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """model_name, path, tensor_key, shape, dtype, first, start, stop, status of files(model_name, path).

    Reads only the headers, in the tasks. Each tensor is cut into ranges of `range_bytes` at most, of
    whole numbers; first is the place of a range's first number in its tensor, start and stop its
    bytes in the file. A header that cannot be read gives one row whose status says why.
    """
    ddl = "model_name string, path string, tensor_key string, shape array<int>, dtype string, first long, start long, stop long, status string"
    names = [c.split()[0] for c in ddl.split(", ")]

    def rows_of(name: str, path: str) -> Iterator[tuple]:
        try:
            with _opened(path) as file:
                size = struct.unpack("<Q", file.read(8))[0]
                header = json.loads(file.read(size))
            for key, spec in sorted(header.items()):
                if key == "__metadata__" or spec["dtype"] not in KINDS:
                    continue
                width = np.dtype(KINDS[spec["dtype"]]).itemsize
                start, end = (8 + size + x for x in spec["data_offsets"])
                step = max(1, range_bytes // width) * width
                for at in range(start, max(end, start + 1), step):
                    yield name, path, key, spec["shape"], spec["dtype"], (at - start) // width, at, min(at + step, end), "ok"
        except (OSError, ValueError, KeyError, struct.error) as e:
            yield name, path, None, None, None, None, None, None, f"unreadable: {type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("model_name", pa.string()), ("path", pa.string()), ("tensor_key", pa.string()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("first", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("status", pa.string())])
        for batch in batches:
            for name, path in zip(batch.column("model_name").to_pylist(), batch.column("path").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows_of(name, path)], schema=schema)

    return files.select("model_name", "path").mapInArrow(run, ddl)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges with values, the 32-bit numbers of each; those of one file are spread over all tasks.

    A range that ends before its bytes do has status `truncated` and no values.
    """
    ddl = "model_name string, tensor_key string, shape array<int>, first long, values array<float>, status string"
    schema = pa.schema([("model_name", pa.string()), ("tensor_key", pa.string()), ("shape", pa.list_(pa.int32())), ("first", pa.int64()), ("values", pa.list_(pa.float32())), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = {c: r[c] for c in ("model_name", "tensor_key", "shape", "first", "status")} | {"values": None}
                if r["status"] == "ok":
                    with _opened(r["path"]) as file:
                        file.seek(r["start"])
                        data = file.read(r["stop"] - r["start"])
                    whole = len(data) == r["stop"] - r["start"]
                    out |= {"values": np.frombuffer(data, KINDS[r["dtype"]]).astype(np.float32)} if whole else {"status": "truncated"}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    spread = F.xxhash64("path", "tensor_key", "first")
    parts = max(ranges.sparkSession.sparkContext.defaultParallelism, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(parts, spread).mapInArrow(run, ddl)


def scan_tensor_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """model_name, tensor_key, shape, first, values, status: all *.safetensors files below a folder, read by
    ranges, so that neither a file nor a tensor must fit a row or a task. For stores that pyarrow
    opens; `scan_adapter_tensors` reads whole files from any store that Spark reads."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(folder)
    files = listed.select(F.element_at(F.split("path", "/"), -2).alias("model_name"), "path")
    return read_ranges(tensor_ranges(files, range_bytes))


def flat_chunks_of_ranges(ranges: DataFrame) -> DataFrame:
    """model_name, tensor_key, write_offset, chunk: ranges at their place among all numbers of the model, in
    key order. Offsets are sums over a model's keys; no values are gathered."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda p, x: p * x)
    keys = ranges.where("status = 'ok'").select("model_name", "tensor_key", size.alias("_size")).distinct()
    before = Window.partitionBy("model_name").orderBy("tensor_key").rowsBetween(Window.unboundedPreceding, -1)
    bases = keys.select("model_name", "tensor_key", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    rows = ranges.where("status = 'ok' and size(values) > 0").join(bases, ["model_name", "tensor_key"])
    return rows.select("model_name", "tensor_key", (F.col("_base") + F.col("first")).alias("write_offset"), F.col("values").alias("chunk"))


def inspect_tensor_schema(tensor: DataFrame) -> DataFrame:
    """model_name, n_keys, keys (sorted, joined), layers (numbers in the keys), n_parameters."""
    layer = F.nullif(F.regexp_extract("tensor_key", r"\.(?:layers?|block)\.(\d+)\.", 1), F.lit("")).cast("int")
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda p, x: p * x)
    return tensor.groupBy("model_name").agg(
        F.count("*").alias("n_keys"), F.array_join(F.sort_array(F.collect_list("tensor_key")), "|").alias("keys"),
        F.array_join(F.transform(F.sort_array(F.collect_set(layer)), lambda x: x.cast("string")), ",").alias("layers"), F.sum(size).alias("n_parameters"),
    )


def tensor_flat_chunks(tensor: DataFrame, block_size: int) -> DataFrame:
    """model_name, tensor_key, write_offset, chunk: values in key order, cut into chunks of a fixed
    size; offsets run through the model. A model's key list bounds the window."""
    before = Window.partitionBy("model_name").orderBy("tensor_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = tensor.withColumn("_size", F.size("values").cast("long")).withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    rows = rows.where("_size > 0").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(block_size).cast("long"))))
    return rows.select("model_name", "tensor_key", (F.col("_base") + F.col("_at")).alias("write_offset"), F.slice("values", (F.col("_at") + 1).cast("int"), F.lit(block_size)).alias("chunk"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored_state(spark: SparkSession, path: str) -> DataFrame:
    """model_name, version, n_cells: the models whose features are stored completely, and where."""
    if _exists(spark, f"{path}/state"):
        return spark.read.schema("model_name string, n_cells long, version string").parquet(f"{path}/state")
    return spark.createDataFrame([], "model_name string, n_cells long, version string")


def pending_models(models: DataFrame, path: str) -> DataFrame:
    """The rows of models(model_name, ...) whose features are not stored yet."""
    return models.join(stored_state(models.sparkSession, path).select("model_name"), "model_name", "left_anti")


def append_features(feature: DataFrame, path: str, version: str | None = None) -> str:
    """First half of adding to a feature table: the cells, by version and feature group."""
    from adapterlens.functions.names import feature_group

    version = version or f"v-{uuid.uuid4().hex}"
    grouped = feature.withColumn("feature_group", F.coalesce(feature_group(F.col("feature")), F.lit("other"))).withColumn("version", F.lit(version))
    grouped.write.mode("append").partitionBy("version", "feature_group").parquet(f"{path}/feature")
    return version


def commit_features(spark: SparkSession, catalogue: DataFrame, path: str, version: str) -> None:
    """Second half: what the version holds is read back and becomes state; only then it counts.

    Beside the state go the catalogue rows of its models and metadata, one row per feature group.
    """
    if not _exists(spark, f"{path}/feature/version={version}"):
        return  # no cell was written
    stored = spark.read.parquet(f"{path}/feature/version={version}")
    state = stored.groupBy("model_name").agg(F.count("*").alias("n_cells"))
    catalogue.join(state.select("model_name"), "model_name", "left_semi").write.mode("append").parquet(f"{path}/catalogue")
    columns = stored.groupBy("feature_group").agg(F.count_distinct("block", "feature").alias("n_columns"), F.count_distinct("model_name").alias("n_models"), F.count("*").alias("n_cells"))
    columns.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/metadata")
    state.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/state")


def write_feature_table(feature: DataFrame, catalogue: DataFrame, path: str) -> None:
    """Add the models of feature(model_name, block, feature, value) that the table at `path` lacks.

    Features go by version and group (so that a reader of some groups opens only those folders); the
    state, written last, names the models that are complete. A write that was interrupted leaves
    cells without state, which no reader sees, and is taken up by writing again.
    """
    spark = feature.sparkSession
    commit_features(spark, catalogue, path, append_features(pending_models(feature, path), path))


def read_feature_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feature, catalogue) of the models that the state names."""
    state = stored_state(spark, path)
    # by model alone, so that what is joined by model after this stays in its part
    whole = state.groupBy("model_name").agg(F.collect_set("version").alias("_versions"))
    feature = spark.read.parquet(f"{path}/feature").join(whole, "model_name").where(F.array_contains("_versions", F.col("version"))).drop("version", "_versions")
    catalogue = spark.read.parquet(f"{path}/catalogue").dropDuplicates(["model_name"])
    return feature, catalogue.join(state.select("model_name"), "model_name", "left_semi")


def width_errors(feature: DataFrame, columns: DataFrame) -> DataFrame:
    """model_name, n_missing, n_extra of the models whose cells are not exactly columns(block, feature)."""
    wanted = columns.select("block", "feature").distinct().withColumn("_wanted", F.lit(True))
    n = wanted.count()
    cells = feature.select("model_name", "block", "feature").distinct().join(wanted, ["block", "feature"], "left")
    per = cells.groupBy("model_name").agg((F.lit(n) - F.count("_wanted")).alias("n_missing"), F.count(F.when(F.col("_wanted").isNull(), 1)).alias("n_extra"))
    return per.where("n_missing > 0 or n_extra > 0")


def table_checks(feature: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: n_cells, repeated_cells, n_columns, wrong_width (models that lack a column), n_models,
    repeated_models, unlisted_models, unlabelled_models (in the catalogue, without a label)."""
    return cell_checks(feature, catalogue).join(catalogue_checks(catalogue))


def cell_checks(feature: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: n_cells, repeated_cells, n_columns, wrong_width, unlisted_models. Figures of every model, which add up,
    in one pass, and the distinct columns in another."""
    cells = feature.groupBy("model_name", "block", "feature").count()
    per = cells.groupBy("model_name").agg(F.sum("count").alias("n"), F.count(F.when(F.col("count") > 1, 1)).alias("r"), F.count("*").alias("w"))
    listed = catalogue.select("model_name").distinct().withColumn("_listed", F.lit(True))
    columns = feature.select("block", "feature").distinct().agg(F.count("*").alias("n_columns"))
    return per.join(listed, "model_name", "left").join(F.broadcast(columns)).agg(
        F.sum("n").alias("n_cells"), F.coalesce(F.sum("r"), F.lit(0)).alias("repeated_cells"), F.max("n_columns").alias("n_columns"),
        F.count(F.when(F.col("w") < F.col("n_columns"), 1)).alias("wrong_width"), F.count(F.when(F.col("_listed").isNull(), 1)).alias("unlisted_models"),
    )


def catalogue_checks(catalogue: DataFrame) -> DataFrame:
    """One row: n_models, repeated_models, unlabelled_models."""
    per = catalogue.groupBy("model_name").agg(F.count("*").alias("count"), F.count("label").alias("_l"))
    return per.agg(F.count("*").alias("n_models"), F.count(F.when(F.col("count") > 1, 1)).alias("repeated_models"), F.count(F.when(F.col("_l") == 0, 1)).alias("unlabelled_models"))


def numbered_predictions(prediction: DataFrame) -> DataFrame:
    """index, model_name, label (empty if unknown), backdoor_score: the rows of the predictions file.

    Numbers follow the order of names: names are cut at sampled ones, which are values and so hold
    for every run over the rows; rows are numbered in their part and lifted by the counts of
    earlier parts.
    """
    n = prediction.count()
    share = F.pmod(F.xxhash64(F.lit("bound"), "model_name"), F.lit(max(1, n // BOUNDS))) == 0
    bounds = sorted(r.model_name for r in prediction.where(share).select("model_name").distinct().limit(4 * BOUNDS).collect() if r.model_name is not None)
    edges = F.array(*map(F.lit, bounds)) if bounds else F.expr("cast(array() as array<string>)")
    parts = prediction.withColumn("_part", F.size(F.filter(edges, lambda e: e <= F.col("model_name"))))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    lifted = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("model_name", "score")) - 1
    rows = parts.withColumn("_r", place).join(F.broadcast(lifted), F.col("_part") == F.col("_p"))
    return rows.select((F.col("_r") + F.col("_o")).cast("long").alias("index"), "model_name", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), F.col("score").alias("backdoor_score"))


def write_predictions(prediction: DataFrame, path: str) -> None:
    numbered_predictions(prediction).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
