"""The run log: a thin index for filtering and heavy blobs with windows and responses.

Both are Parquet directories partitioned by month. Appending replaces file rotation, and a
reader always sees every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import comparability_hash, month_shard

INDEX_COLUMNS = (
    "run_id", "ts", "ts_verified", "modelo", "formato_id", "scope", "andaime_hash", "n_amostras", "metricas", "blob_ref", "month",
)
BLOB_COLUMNS = ("run_id", "ts", "modelo", "formato_id", "andaime", "janela_enviada", "secoes", "respostas", "month")


def split_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(index, blobs)`` rows of a run table; absent optional columns become null."""
    scaffold = runs.schema["andaime"].dataType.fieldNames() if "andaime" in runs.columns else []
    filled = runs
    for name, default in (
        ("scope", F.lit("sprint")), ("ts_verified", F.lit(None).cast("boolean")), ("metricas", F.lit(None).cast("string")),
        ("secoes", F.lit(None).cast("string")), ("janela_enviada", F.lit(None).cast("string")),
        ("andaime", F.struct(F.lit(None).cast("string").alias("experimento"))),
    ):
        if name not in filled.columns:
            filled = filled.withColumn(name, default)
    filled = (
        filled.withColumn("month", month_shard("ts"))
        .withColumn("andaime_hash", comparability_hash("andaime", scaffold))
        .withColumn("n_amostras", F.greatest(F.size("respostas"), F.lit(0)))
        .withColumn("blob_ref", F.concat("month", F.lit("/"), "run_id", F.lit(".json")))
    )
    return filled.select(*INDEX_COLUMNS), filled.select(*BLOB_COLUMNS)


def write_runs(runs: DataFrame, root: str) -> None:
    index, blobs = split_runs(runs)
    blobs.write.mode("append").partitionBy("month").parquet(f"{root}/blobs")
    index.write.mode("append").partitionBy("month").parquet(f"{root}/index")


def filter_runs(
    index: DataFrame,
    formato_id: str | None = None,
    modelo: str | None = None,
    andaime_hash: str | None = None,
    scope: str | None = None,
    since_ts: float | None = None,
) -> DataFrame:
    """Optional equality filters and a start time; the month predicate prunes partitions."""
    for name, value in (("formato_id", formato_id), ("modelo", modelo), ("andaime_hash", andaime_hash), ("scope", scope)):
        if value is not None:
            index = index.filter(F.col(name) == value)
    if since_ts is not None:
        index = index.filter((F.col("ts") >= since_ts) & (F.col("month") >= month_shard(F.lit(since_ts))))
    return index


def read_runs(spark: SparkSession, root: str, **filters) -> DataFrame:
    return filter_runs(spark.read.parquet(f"{root}/index"), **filters)


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/blobs")


def read_legacy_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Index files kept as JSON lines; corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_blobs(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Index rows joined to their blob; a run without a blob is left out."""
    return index.select("run_id", *[c for c in index.columns if c not in blobs.columns]).join(blobs, "run_id")


def responses_of(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row per response: ``run_id, i, experiment, condition, role, dry_run, text``."""
    return (
        with_blobs(index.select("run_id"), blobs.select("run_id", "formato_id", "andaime", "respostas"))
        .select("*", F.posexplode("respostas").alias("i", "text"))
        .select(
            "run_id", "i", F.col("andaime.experimento").alias("experiment"),
            F.coalesce("andaime.condicao_rotulo", "formato_id").alias("condition"),
            F.col("andaime.condicao_papel").alias("role"), F.coalesce("andaime.dry_run", F.lit(False)).alias("dry_run"), "text",
        )
    )


def run_stats(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Counts of the store: rows, runs, months, characters kept, and rows without a partner."""
    ix = index.select("run_id", "month")
    bl = blobs.select("run_id", F.length("janela_enviada").alias("n_chars"))
    sides = ix.select("run_id", F.lit(1).alias("i"), F.lit(0).alias("b")).unionByName(
        bl.select("run_id", F.lit(0).alias("i"), F.lit(1).alias("b"))
    )
    pairing = sides.groupBy("run_id").agg(F.sum("i").alias("i"), F.sum("b").alias("b")).agg(
        F.sum("i").alias("n_index"), F.sum("b").alias("n_blobs"), F.count_if(F.col("i") > 0).alias("n_runs"),
        F.count_if(F.col("b") == 0).alias("index_without_blob"), F.count_if(F.col("i") == 0).alias("blob_without_index"),
    )
    sizes = bl.agg(F.sum("n_chars").alias("blob_chars"))
    months = ix.agg(F.count_distinct("month").alias("n_months"))
    return pairing.crossJoin(sizes).crossJoin(months)
