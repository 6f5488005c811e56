"""Helpers that the text operators share: reading, cutting lineage, words, batch maps, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and the five ASCII controls after tab, tab included.
SPACE = r"\x20\x09-\x0D"
#: Rows that a batch map hands to its function at once, and their bytes: a longer one comes alone.
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 4 << 20
#: Rows of an Arrow batch of texts.
ROWS_A_BATCH = 1_000
#: Broadcasts are asked for up to this many rows of a few dozen bytes; beyond, the join is shuffled.
BROADCAST_ROWS = 100_000
#: Rows of a few dozen bytes that make a partition worth its files.
ROWS_A_PART = 50_000
#: A key of over so many rows is joined without a shuffle, if such keys are few.
HOT_ROWS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a local session (as in tests) gets one of its own; on a cluster that is an
    error, since executors would not see it.
    """
    context = spark.sparkContext
    named, set_ = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(stem: str, *taken: DataFrame | str) -> str:
    """A column name from `stem` that none of the tables has and none of the names is."""
    names = {c.lower() for t in taken for c in ([t] if isinstance(t, str) else t.columns)}
    name = f"_{stem}"
    while name.lower() in names:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a counted side for broadcast if it has `bound` rows at most."""
    return F.broadcast(df) if rows <= bound else df


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows of df (all, if it has no more): those whose hash of `keys` is low.

    A count and a filter; nothing is sorted or gathered. Rows with equal keys stand or fall together.
    """
    n, steps = df.count(), 1 << 30
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(steps)) < int(steps * rows / n))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_segments(text: str, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text as UTF-8, in lists of bounded size.

    `bytes.split` parts at exactly the six ASCII white-space characters of `SPACE`.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= size:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = start + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end].split()
        start = end


def short_batches(rows: int = ROWS_A_BATCH) -> None:
    """Let Spark hand texts to Python in Arrow batches of at most `rows` rows.

    The default of ten thousand rows would hold tens of megabytes of text in every worker, and as
    much in the JVM. A lower setting of the session stays.
    """
    conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)


def _unpartitioned(column: Column, kind: str) -> Column:
    """The same value in a form whose partitioning the planner does not know.

    A join on it shuffles both sides itself, so that adaptive execution may split a hot key.
    """
    return F.concat(column, F.lit("")) if kind == "string" else F.bitwise_not(F.bitwise_not(column))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as `rows` counted rows need, if it has more: few rows in hundreds of
    partitions cost a file each at every step. Nothing is shuffled."""
    return df.coalesce(max(1, -(-rows // ROWS_A_PART)))


def join_counted(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with lookup(*keys, n, ...), which has each key once, where n is how many
    rows have it and `total` how many rows there are. lookup is best cut before, as it is read twice
    and should bring no partitioning of its own.

    Keys of many rows are so few that they are broadcast, and their rows never meet in a task; the
    others are shuffled and have a bounded number of rows each.
    """
    hot = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    frequent = F.broadcast(lookup.where(F.col("n") > hot).drop("n"))
    rare = lookup.where(F.col("n") <= hot).drop("n")
    here = rows.join(frequent, keys)
    there = rows.join(frequent.select(keys), keys, "left_anti")
    return here.unionByName(there.join(broadcast_if_small(rare, total), keys))


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected graph.

    edges: columns a, b (both long or both string). Returns node, root, where root is the least
    node of the component; nodes without an edge to another node do not appear. Rows with a null
    end and self-links are ignored, an empty table gives an empty result.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need rounds in
    proportion to the logarithm of the longest path squared at most, until nothing changes. Each
    round shuffles the edges by one end and is cut by a checkpoint; nothing but two numbers comes to
    the driver.
    """
    kind = dict(edges.dtypes)["a"]
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before, after = None, state(now)
    while after[0] and after != before:
        before, few = after, 2 * after[0]

        def with_least(df: DataFrame, few: int = few) -> DataFrame:
            least = gathered(df.groupBy("u").agg(F.min("v").alias("m")), few)
            if few <= BROADCAST_ROWS:
                return df.join(F.broadcast(least), "u")
            return df.join(least.select(_unpartitioned(F.col("u"), kind).alias("u"), "m"), "u")

        now = gathered(now, few)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = gathered(with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), few)
        near = with_least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(gathered(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), few))
        after = state(now)
    return gathered(now, after[0]).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sizes(values: pa.Array) -> np.ndarray:
    """Bytes of each value of an array, about; items of lists count eight."""
    if pa.types.is_struct(values.type):
        return sum(map(_sizes, values.flatten()))
    lengths = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def by_size(values: pa.Array, rows: int = ROWS_AT_ONCE, size: int = BYTES_AT_ONCE) -> Iterator[pa.Array]:
    """Slices of `rows` values and `size` bytes at most, or of one value."""
    ends = np.cumsum(_sizes(values))
    at = 0
    while at < len(values):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        upto = max(at + 1, min(upto, at + rows))
        yield values.slice(at, upto - at)
        at = upto


def array_column(function: Callable[[pa.Array], pa.Array], ddl: str, rows: int = 1 << 14, size: int = BYTES_AT_ONCE):
    """A column function that maps arrays of texts, binaries or lists to arrays, slice by slice.

    Other columns of the row stay in the JVM. Marked nondeterministic so that a filter on the
    result is not pushed below it, which would run it twice.
    """
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(ddl))
    short_batches()

    @arrow_udf(ddl)
    def run(values: pa.Array) -> pa.Array:
        parts = [function(part).cast(kind) for part in by_size(values, rows, size)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run.asNondeterministic()


def batch_column(function: Callable[[list], list], ddl: str):
    """`array_column` of a function that maps short lists of texts to lists of values."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(ddl))
    return array_column(lambda texts: pa.array(function(texts.to_pylist()), type=kind), ddl, ROWS_AT_ONCE)


def text_column(function: Callable[[str | None], object], ddl: str):
    """`batch_column` of a function of one text."""
    return batch_column(lambda texts: [function(x) for x in texts], ddl)
