"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a data folder; only ``columns`` are read, if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows that a Python function turns into objects at once; an Arrow batch may hold more.
SLICE = 500


#: Rows of an Arrow batch, at most: texts can be long, and both sides of a Python function hold whole batches.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if more are set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches):
    """Arrow batches in slices of SLICE rows; memory of spent batches goes back to the system."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)
        del batch
        pa.default_memory_pool().release_unused()


def with_columns(df: DataFrame, inputs: Sequence[str], fields: list[T.StructField], factory: Callable[[], Callable]) -> DataFrame:
    """``df`` with ``fields`` computed from ``inputs`` by an Arrow-batched Python function.

    ``factory`` runs once a task and returns a function that takes one list per
    input and returns one list per field. A field replaces a column of the same
    name (whatever its case); all other columns pass through untouched.
    """
    bounded_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    places = [df.columns.index(c) for c in kept]
    read = [df.columns.index(c) for c in inputs]
    names = schema.names

    def run(batches):
        compute = factory()
        for batch in slices(batches):
            out = compute(*[batch.column(i).to_pylist() for i in read])
            arrays = [batch.column(i) for i in places] + [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A name for a passing column: ``name`` with as many underscores before it as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and all
    runs on one machine, as in tests, a temporary folder is set for the session;
    on a cluster that would not be shared, so there it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wordlattice-")
        sc.setCheckpointDir(base)
    return f"{base}/wordlattice-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned, once all that was computed from them is stored as well."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, modulus: int):
    """crc32 of a column's text modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Up to this many ids are broadcast (some MB); beyond it, both sides are shuffled.
BROADCAST_IDS = 200_000
#: A key with at least 1 in this many rows is hot, so there are at most this many hot keys.
HOT_SHARE = 1_000


def only_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``id_col`` is (left_semi) or is not (left_anti) in ``ids``, a stored table of distinct ids."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), id_col, how)


def look_up(df: DataFrame, found: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join of ``df`` with ``found``, which has one row for each key and its number of rows in ``df`` as ``_n``.

    Keys with a thousandth of ``rows`` or more, of which there are a thousand at
    most, are joined by broadcast, the others by shuffle; so no task gets more
    than its share of a hot key. ``_n`` isn't in the result.
    """
    least = max(HOT_SHARE, rows // HOT_SHARE)
    new = [c for c in found.columns if c not in (key, "_n")]
    hot = found.where(F.col("_n") >= least).select(F.col(key), F.struct(*new).alias("_hot"))
    cold = found.where(F.col("_n") < least).select(F.col(key), F.struct(*new).alias("_cold"))
    both = df.join(F.broadcast(hot), key, "left")
    # a hot row's key is salted away from the shuffle: it can't match a cold key
    both = both.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)))
    both = both.withColumn("_salt", F.when(F.col("_key").isNull(), F.spark_partition_id()).otherwise(F.lit(-1)))
    cold = cold.withColumnRenamed(key, "_key").withColumn("_salt", F.lit(-1))
    both = both.join(cold, ["_key", "_salt"], "left")
    return both.select(*df.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in new))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link, stored; ``links`` has (a, b), a component is its smallest node.

    Large-star and small-star rounds: each node's neighbours move to the smallest
    of them until nothing changes. Rounds end in stored tables; two numbers about
    each reach the driver. The star's joins are inner joins on one key, which
    adaptive execution splits where a node has very many links.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, spent = now, edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        edges = stored(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        release(spent)
    # every u now hangs on its component's smallest node
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()))
    release(edges)
    return out
