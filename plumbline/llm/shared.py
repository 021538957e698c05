"""Tables on shared storage, dense ranks and connected components for the operators of this package.

Everything that outlives a task is a table or file below the folder the session names in ``spark.checkpoint.dir`` (below
the warehouse where that is unset), so any executor can be lost: what it held is read again or recomputed.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

SLICE = 512  # texts that are Python objects at one time
ROW_BITS = 33  # monotonically_increasing_id() keeps the row's place in its partition in so many low bits


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder every executor can reach; removed when the session's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        if not spark.sparkContext.master.startswith("local") and root.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table on shared storage: evaluated once, its lineage cut, its size known to the planner.

    Such tables stay until the session ends, so they are written small.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(nullable(df.schema)).parquet(folder)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def numbered(df: DataFrame, order: list[Column], label: str, rank: str = "rank") -> DataFrame:
    """``df`` with its dense 0-based place in ``order`` (which should be total), without a one-task window.

    Range partitions are sorted on their own; only one count per partition meets in one place.
    """
    spark = df.sparkSession
    at = "_place"
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), label)
    part = F.shiftright(at, ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per partition of the sort
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(rank, F.col("_start") + F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("_part", "_start", at)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of ``edges``; component is the least node it is linked with. Rows with a null end are no edge.

    Alternating large-star and small-star steps: every step hands each node's neighbours to the least of them, so the
    number of rounds grows with the logarithm of a component's width. A hub is one row of the minima that are joined back,
    never a collected group. A node linked only with itself is its own component.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    links = pairs.select(F.greatest("_a", "_b").alias("hi"), F.least("_a", "_b").alias("lo")).distinct()
    folder = shared_folder(spark, "components")
    links = written(links, "", f"{folder}/0")
    loops = links.where("hi = lo").select("hi").distinct()
    links = links.where("hi <> lo")
    step = 0
    while not _stars(links):
        step += 1
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "", f"{folder}/{step}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "", f"{folder}/{step}-large")
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "", f"{folder}/{step}-least2")
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = written(moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "", f"{folder}/{step}")
        for old in (f"{step}-least", f"{step}-large", f"{step}-least2", str(step - 1) if step > 1 else ""):
            if old:
                remove(spark, f"{folder}/{old}")
    stars = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = links.select(F.col("lo").alias("node")).unionAll(loops.select(F.col("hi").alias("node"))).distinct()
    roots = roots.join(stars, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.unionAll(roots)


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one other, which itself hangs on none."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id, written as text, leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is executed inside; a batch is held by the JVM and by the worker, for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; at their end, memory that the worker has no more use for goes back to the system, as workers are reused."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def annotated(docs: DataFrame, text: str, into: str, kind: T.StructType, setup, *args) -> DataFrame:
    """``docs`` with a struct column ``into`` computed from whole texts inside the tasks; nothing is shuffled.

    ``setup(*args)`` runs once per task and returns a function from a list of UTF-8 texts (None where null) to one tuple per
    text. A column of ``docs`` that is already called ``into`` is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != into])
    schema = T.StructType([*nullable(docs.schema).fields, T.StructField(into, kind)])
    return docs.mapInArrow(partial(_annotate, text, into, kind, setup, args), schema)


def _annotate(text, into, kind, setup, args, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from given_back(_annotated(text, into, kind, setup, args, batches))


def _annotated(text, into, kind, setup, args, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_type(kind)
    score = setup(*args)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            rows = score(utf8(part.column(text)))
            fields = [pa.array(values, f.type) for f, values in zip(arrow, zip(*rows))]
            made = pa.StructArray.from_arrays(fields, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, into])


def utf8(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.string()).cast(pa.binary()).to_pylist()


# Bytes of a lower-cased text in which everything but letters, digits and what is beyond ASCII is a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
