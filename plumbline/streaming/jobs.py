"""Structured Streaming forms of the jobs whose input arrives continuously."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.ratios import STRATA, valid_population
from plumbline.session import checkpointed, delete_folder, shared_root

# Columns a collector may not see before the collection is complete.
BLIND_COLUMNS = ("text_chars", "payload_bytes", "usage", "input_tokens", "output_tokens")


def file_stream(spark: SparkSession, folder: str, name: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files called ``name`` below ``folder`` as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


@contextmanager
def replayed(rows: DataFrame, parts: int, part: Column) -> Iterator[str]:
    """A shared folder with ``rows`` as Parquet files, dealt by ``part`` (0 to ``parts`` - 1), each later than the one before.

    The folder is removed at the end, so whatever reads it has to be done by then.
    """
    spark = rows.sparkSession
    root = f"{shared_root(spark)}/replay-{uuid.uuid4().hex}"
    try:
        for i in range(parts):
            rows.filter(part == i).coalesce(1).write.mode("append").parquet(f"{root}/files")
        yield f"{root}/files"
    finally:
        delete_folder(spark, root)


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process what is available and return the sink's content.

    Each micro-batch overwrites a folder of its own, so a repeated batch changes nothing. In update
    mode the latest row per key counts. The stream's folder goes when the content was read.
    """
    spark = stream.sparkSession
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    try:
        run(stream, root, keep, mode)
        rows = checkpointed(spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/out"))
    finally:
        delete_folder(spark, root)
    if mode != "update":
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def run(stream: DataFrame, root: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> int:
    """Run ``each`` over the micro-batches that are available, from the checkpoint below ``root`` on; returns their number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p.numInputRows])


def stream_progress(events: DataFrame, stratum: str = "classe") -> DataFrame:
    """Running count of valid samples per stratum, and nothing that would reveal the ratio."""
    return valid_population(events).groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def progress_report(counts: DataFrame, strata: Sequence[str] = STRATA, n_min: int = 30, target: int = 300) -> DataFrame:
    """The stop rule over the drained counts: per stratum missing, and whether the target is met."""
    blind = [c for c in counts.columns if c in BLIND_COLUMNS]
    if blind:
        raise ValueError(f"progress may not carry {blind}")
    declared = F.array(*[F.lit(s) for s in strata])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    named = counts.sparkSession.createDataFrame([(s,) for s in strata], "stratum string")
    rows = counts.join(named, "stratum", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    missing = F.when(F.array_contains(declared, F.col("stratum")), F.greatest(F.lit(n_min) - F.col("n"), F.lit(0)))
    return rows.withColumn("missing", missing).crossJoin(total).withColumn("complete", F.col("n_total") >= target)


def stream_run_index(runs: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each run once, however often its row is delivered within the delay."""
    return runs.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["run_id"])


def index_once(runs: DataFrame, root: str) -> int:
    """Append each new run of the stream to the index below ``root``, once however late its row is delivered again.

    A micro-batch keeps the first of its rows per run (by all columns) that no earlier batch holds, in a folder of
    its own: repeated after a failure, or met again after a restart, it writes the same rows to the same place.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != "run_id"]
        rows = batch.groupBy("run_id").agg(F.min(F.struct(*rest)).alias("_r")).select("run_id", "_r.*")
        if batch_id:
            earlier = read_index(spark, root, batch.schema).filter(F.col("batch") < batch_id)
            rows = rows.join(earlier.select("run_id"), "run_id", "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{root}/index/batch={batch_id}")

    return run(runs, root, keep)


def read_index(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of :func:`index_once` and the ``batch`` that brought them."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/index")


def stream_repeats(results: DataFrame) -> DataFrame:
    """Overlap of each result list ``(session, seq, ids)`` with the one before it in its session.

    The state of a session is its last set of ids. Lists of one micro-batch are taken in ``seq``
    order; a session's first list yields no row.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = set(state.get[0]) if state.exists else None
        out = []
        for row in pd.concat(list(chunks)).sort_values("seq").itertuples(index=False):
            current = {x for x in row.ids if x}
            if last is not None and current:
                shared = len(last & current)
                out.append((key[0], row.seq, shared, shared >= min(2, len(current))))
            last = current
        state.update((sorted(last or set()),))
        yield pd.DataFrame(out, columns=["session", "seq", "overlap", "repeated"])

    return results.select("session", "seq", "ids").groupBy("session").applyInPandasWithState(
        step, "session bigint, seq bigint, overlap int, repeated boolean", "ids array<string>", "append", GroupStateTimeout.NoTimeout
    )


def stream_overlaps(samples: DataFrame, switches: DataFrame, by: str, root: str, cell: str = "1 hour") -> DataFrame:
    """Pairs ``(sample_id, by, start, end, at)`` of a sample ``(sample_id, by, start, end)`` and a switch ``(by, at)`` inside its interval.

    Samples are cut at the borders of time cells and a switch lies in one cell, so both meet by equality, whatever the length
    of a sample. What has arrived is kept in tables below ``root``, a folder per micro-batch, instead of operator state: new
    samples meet all switches and new switches the earlier samples, so each pair comes out in the batch of its later half,
    however late that is, and a repeated batch writes the same rows to the same place.
    """
    spark = samples.sparkSession
    width = F.expr(f"unix_seconds(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {cell})")
    cell_of = lambda t: F.floor(F.unix_timestamp(t) / width)
    sample_rows = samples.select(F.lit("sample").alias("side"), "sample_id", by, "start", "end", F.lit(None).cast("timestamp").alias("at"))
    switch_rows = switches.select(F.lit("switch").alias("side"), F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"), by, F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), "at")
    kinds = {"samples": T.StructType([*samples.select("sample_id", by, "start", "end").schema.fields, T.StructField("cell", T.LongType())]),
             "switches": T.StructType([*switches.select(by, "at").schema.fields, T.StructField("cell", T.LongType())])}

    def stored(name: str, batch_id: int) -> DataFrame:
        """What has arrived up to a batch."""
        kind = T.StructType([*kinds[name].fields, T.StructField("batch", T.LongType())])
        return spark.read.schema(kind).parquet(f"{root}/{name}").filter(F.col("batch") <= batch_id)

    def keep(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter("side = 'sample' AND start <= end").select("sample_id", by, "start", "end", F.explode(F.sequence(cell_of("start"), cell_of("end"))).alias("cell"))
        new.write.mode("overwrite").parquet(f"{root}/samples/batch={batch_id}")
        batch.filter("side = 'switch' AND at IS NOT NULL").select(by, "at", cell_of("at").alias("cell")).write.mode("overwrite").parquet(f"{root}/switches/batch={batch_id}")
        s, w = stored("samples", batch_id).withColumnRenamed("batch", "_s"), stored("switches", batch_id).withColumnRenamed("batch", "_w")
        pairs = s.join(w, [by, "cell"]).filter((F.greatest("_s", "_w") == batch_id) & F.col("at").between(F.col("start"), F.col("end")))
        pairs.select("sample_id", by, "start", "end", "at").write.mode("overwrite").parquet(f"{root}/pairs/batch={batch_id}")

    run(sample_rows.unionByName(switch_rows), root, keep)
    return spark.read.schema("sample_id " + samples.schema["sample_id"].dataType.simpleString() + f", {by} {samples.schema[by].dataType.simpleString()}, start timestamp, end timestamp, at timestamp").parquet(f"{root}/pairs")
