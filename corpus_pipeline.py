"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark passages go, sources are mixed, ids are written.

Every stage takes the session, the documents its predecessor kept and the folder of the given tables. The order that the
mixing stage decides is the order of its files' rows, and the last stage writes its records in that order.

Defined cases, for every stage: columns beside those of documents are dropped; repeated rows and null ids stay rows of their own
(near copies keeps one row of equal id and text); an empty table gives an empty one.

* toxicity: a null or empty text scores by the intercept alone; without a toxic label nothing goes; equal texts score alike, so
  a tie goes one way.
* near copies: a null text, or one without words, is nobody's copy and stays; of equal ids the least hash of the text is kept.
* decontamination: a null text has no words and stays; an item without an id marks words but is no item.
* mixing: a null source is a source; ties in doc_id are broken by a hash of the row.
* token records: reads the order from the files that the documents were read from, so its input is a written table; a null or
  empty text is a record of the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import contamination, jaccard, mixing, queries, records, toxicity
from plumbline.llm.shared import shared_folder, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
EMPTY = r"^[\x20\x09-\x0D]*$"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the classifiers learn from the labels of these documents."""
    rated = toxicity.scored(docs.select(*COLUMNS), queries.toxicity_model(spark, docs, sf_dir))
    return rated.where(F.col("toxicity.score") < queries.TOXIC).select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each component with the least doc_id (one row of it), and every document without words."""
    kept = jaccard.near_duplicates(docs).where("first AND n_shingles > 0").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    worded = F.col("text").isNotNull() & ~F.col("text").rlike(EMPTY)
    rows = docs.select(*COLUMNS).where(worded).withColumn("_key", F.xxhash64("text"))
    once = rows.join(kept.withColumnRenamed("_key", "_kept"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_kept")), "left_semi")
    return once.dropDuplicates(["doc_id", "_key"]).select(*COLUMNS).unionAll(docs.select(*COLUMNS).where(~F.coalesce(worded, F.lit(False))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in benchmark windows."""
    found = contamination.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~queries.contaminated()).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixed sources."""
    rows = mixing.mixed(docs.select(*COLUMNS), queries.SOURCE_UNITS, queries.BLOCK_DOCS, queries.OTHER_UNITS)
    return rows.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS)


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids as records, in the order of the documents' files, and returns what the files hold."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    index = records.write_records(rows, shared_folder(spark, "records"), queries.tokenizer_path(), queries.END_ID, order=("file", "row"))
    return records.read_records(index).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_records", records_stage),
]

#: Scores, components and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
