"""Manifests and listings: expand JSON manifests, find adapter files, sample and size selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.functions.rank import ordered

SECTIONS = ("path", "train", "infer", "cv_always_train")
#: Candidate files of an adapter, best first.
ADAPTER_FILES = ("adapter_model.safetensors", "best_model/adapter_model.safetensors")


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, content: one row per manifest file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def _indices(value: Column) -> Column:
    """The numbers of an index list, also one written as a string: two rising values are an inclusive
    range, others stand once each in their order."""
    text = F.regexp_replace(F.regexp_replace(value, r'^\s*"?\s*\[', ""), r'\]\s*"?\s*$', "")
    numbers = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    return F.when((F.size(numbers) == 2) & (F.get(numbers, F.lit(1)) >= F.get(numbers, F.lit(0))), F.sequence(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)))).otherwise(F.array_distinct(numbers))


def expand_manifests(texts: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """manifest_entry(source, section, item, entry_pos, raw_entry, status) of texts(source, content).

    A section is a list, one {path, indices}, or {"sources": [...]}; items are strings or
    {path, indices}. `{i}` in a path is replaced by the index, else the index is put at its end.
    Malformed items keep a row with a status that says what is wrong.
    """
    parsed = texts.select("source", F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.get_json_object("content", f"$.{s}").alias("body")) for s in sections]))).where("body is not null")
    listed = F.coalesce(F.from_json(F.get_json_object("body", "$.sources"), "array<string>"), F.when(F.ltrim("body").startswith("{"), F.array("body")).otherwise(F.from_json("body", "array<string>")))
    items = parsed.select("source", "section", F.posexplode(listed).alias("item", "text"))
    structured = F.ltrim("text").startswith("{")
    items = items.select(
        "source", "section", "item",
        F.trim(F.when(structured, F.get_json_object("text", "$.path")).otherwise(F.col("text"))).alias("path"),
        F.when(structured, _indices(F.get_json_object("text", "$.indices"))).alias("indices"),
        structured.alias("structured"),
    )
    bad = F.col("structured") & (F.col("indices").isNull() | (F.size("indices") == 0) | F.exists("indices", lambda i: i.isNull() | (i < 0)))
    status = F.when(F.col("path").isNull() | (F.col("path") == ""), "no path").when(bad, "bad indices").otherwise("ok")
    rows = items.withColumn("status", status).select("source", "section", "item", "path", "status", F.posexplode_outer(F.when(F.col("status") == "ok", F.col("indices"))).alias("entry_pos", "i"))
    named = F.when(F.col("i").isNull(), F.col("path")).when(F.col("path").contains("{i}"), F.replace("path", F.lit("{i}"), F.col("i").cast("string"))).otherwise(F.concat("path", F.col("i").cast("string")))
    return rows.select("source", "section", "item", F.coalesce("entry_pos", F.lit(0)).alias("entry_pos"), named.alias("raw_entry"), "status")


def scan_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of the `path` sections of manifest files."""
    return expand_manifests(read_manifests(spark, paths), ("path",))


def resolve_adapter_file(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """raw_entry, adapter_path, status: the best file of listing(path) in the entry's folder, by priority.

    An equi-join on the folder; entries without a file have status `missing`.
    """
    names = [F.struct(F.lit(f"/{name}").alias("tail"), F.lit(i).alias("priority")) for i, name in enumerate(ADAPTER_FILES)]
    files = listing.select("path", F.explode(F.array(*names)).alias("t")).where(F.endswith(F.col("path"), F.col("t.tail")))
    files = files.select("path", "t.priority", F.expr("left(path, length(path) - length(t.tail))").alias("folder"))
    best = files.groupBy("folder").agg(F.min_by("path", "priority").alias("adapter_path"))
    return entries.join(best, entries.raw_entry == best.folder, "left").select("raw_entry", "adapter_path", F.when(F.col("adapter_path").isNull(), "missing").otherwise("ok").alias("status"))


def list_available_indices(listing: DataFrame) -> DataFrame:
    """subset, label, index of folder names `<subset>_label<k>_<i>` whose parent is the subset."""
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"^(.+)_label(\d+)_(\d+)$"
    rows = listing.select("path", F.regexp_extract(name, pattern, 1).alias("subset"), F.regexp_extract(name, pattern, 2).alias("label"), F.regexp_extract(name, pattern, 3).alias("index"))
    parent = F.element_at(F.split("path", "/"), -2)
    return rows.where((F.col("subset") != "") & (parent == F.col("subset"))).select("subset", F.col("label").cast("int").alias("label"), F.col("index").cast("long").alias("index")).distinct()


def round_robin_sample(available: DataFrame, n: int | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """Rows of available(source_pos, index) to take: all, those with an index in `span`, or n of them,
    one from each source in turn while it has any. Asking for more than there are is an error."""
    if span is not None:
        return available.where(F.col("index").between(*span))
    if n is None:
        return available
    total = available.count()
    if n > total:
        raise ValueError(f"{n} of {total} rows are asked for")
    turns = ordered(available, ["source_pos"], "index").withColumnRenamed("place", "turn").drop("n")
    return turns.orderBy("turn", "source_pos").limit(n)


def estimate_selection_size(selection: DataFrame, files: DataFrame) -> DataFrame:
    """source_pos, n, bytes: the size of a source's first adapter times the number selected.

    files(source_pos, index, bytes).
    """
    first = selection.groupBy("source_pos").agg(F.count("*").alias("n"), F.min("index").alias("index"))
    sizes = files.groupBy("source_pos", "index").agg(F.sum("bytes").alias("one"))
    return first.join(sizes, ["source_pos", "index"]).select("source_pos", "n", (F.col("n") * F.col("one")).alias("bytes"))
