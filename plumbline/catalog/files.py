"""Queries that write files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.catalog.inputs import ORDER_HITS_SQL, order_hits
from plumbline.operators import audit as A
from plumbline.operators import memory as Y
from plumbline.operators import ratios as R
from plumbline.session import shared_root
from plumbline.sources import retrieval as SR
from plumbline.sources import tables as ST


def _folder(spark, name):
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "export_files_neighbours",
    f"""WITH {ORDER_HITS_SQL}, q AS (SELECT seq, list(DISTINCT coalesce(id, text)) AS items, count(*) AS k FROM order_hits GROUP BY seq),
    p AS (SELECT seq, items, k, lag(seq) OVER w AS before_seq, lag(items) OVER w AS before_items FROM q WINDOW w AS (ORDER BY seq))
    SELECT seq, len(items)::BIGINT AS n_items, before_seq, len(list_intersect(items, before_items))::BIGINT AS overlap FROM p WHERE before_seq IS NOT NULL""",
)
def _(spark, sf_dir):
    """Results exported to several files, read in file order: each query with the one before it."""
    folder = _folder(spark, "export")
    rows = SR.to_retrieval_export(order_hits(spark, sf_dir)).repartitionByRange(7, "seq").sortWithinPartitions("seq")
    rows.select(F.to_json(F.struct("query", "results")).alias("value")).write.text(folder)
    hits, _rejects = SR.read_retrieval(spark, folder)
    named = hits.withColumn("order", F.substring_index("query", " ", -1).cast("long"))
    item = F.coalesce("id", "text")
    sets = named.groupBy("seq", "order").agg(F.collect_set(item).alias("items"), F.count(F.lit(1)).cast("int").alias("k"))
    pairs = A.with_previous(sets, "seq", ["order", "items"], out="_p").filter(F.col("_p").isNotNull())
    return pairs.select(
        F.col("order").alias("seq"), F.size("items").cast("long").alias("n_items"), F.col("_p.order").alias("before_seq"),
        F.size(F.array_intersect("items", "_p.items")).cast("long").alias("overlap"),
    )


@query(
    "label_csv_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS store, c_acctbal > 0 AS flag, round(c_acctbal, 6) AS number,
       CASE WHEN c_custkey % 3 <> 0 THEN replace(c_name, '#', ', "') END AS note FROM customer""",
)
def _(spark, sf_dir):
    """Features written as CSV with quotes and absent values, and scanned with types."""
    folder = _folder(spark, "labels")
    c = table(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 3 != 0, F.replace("c_name", F.lit("#"), F.lit(', "'))).otherwise("AUSENTE")
    flag = F.when(F.col("c_acctbal") > 0, "True").otherwise("False")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("store"), flag.alias("flag"), F.col("c_acctbal").alias("number"), note.alias("note"))
    rows.write.csv(folder, header=True, escape='"', quote='"')
    return rounded(ST.typed_features(ST.read_labels(spark, folder, multiline=False), ["flag"], ["number"]))


@query(
    "sequence_round_trip",
    """SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, conv_id, turn, text AS query FROM conversations WHERE role = 'user'""",
)
def _(spark, sf_dir):
    """User turns written in order as JSON lines and read back in the order of the files."""
    folder = _folder(spark, "sequence")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.col("text").alias("query"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit(None).cast("double").alias("timestamp"), (F.col("conv_id") * 1048576 + F.col("turn")).alias("seq"),
    )
    ST.write_sequence(turns, folder)
    rows = SR.ordered_lines(spark, folder).select("seq", F.from_json("value", "query string, id string").alias("r"))
    part = F.split("r.id", "/")
    return rows.select(F.col("seq").alias("place"), part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), F.col("r.query").alias("query"))


@query(
    "sample_log_scoring",
    """SELECT l_returnflag AS condition, count(*) AS n, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY 1""",
)
def _(spark, sf_dir):
    """Samples appended to a log in two batches; the score is a function of the log."""
    folder = _folder(spark, "samples")
    for status in ("O", "F"):
        lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
        ST.append_samples(lines.select(F.col("l_returnflag").alias("condition"), F.col("l_extendedprice").alias("num"), F.col("l_quantity").alias("den")), folder)
    return rounded(R.ratio_of_sums(ST.read_samples(spark, folder), by=["condition"]).select("condition", "n", "ratio"))


@query(
    "turns_in_time_order",
    """SELECT row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 5 <> 0 THEN epoch(ts) END, 0), event_id) - 1 AS place, event_id AS seq FROM events""",
)
def _(spark, sf_dir):
    """Entries by time, those without one first, and their places."""
    from plumbline.operators.ordering import with_dense_index

    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp")
    )
    folder = _folder(spark, "turns")
    Y.ordered_by_time(rows).write.json(folder)
    lines = SR.ordered_lines(spark, folder).select("seq", F.from_json("value", "seq long").alias("r"))
    return with_dense_index(lines, "seq", out="place").select("place", F.col("r.seq").alias("seq"))
