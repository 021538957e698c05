"""The given event files replayed as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.session import checkpointed, delete_folder, shared_root
from plumbline.streaming import jobs as J


def event_stream(spark, sf_dir):
    s = J.file_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events"))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_collection_progress",
    """WITH s AS (SELECT * FROM (VALUES ('click'), ('view'), ('codigo')) v(stratum)), c AS (SELECT event_type AS stratum, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1)
    SELECT stratum, coalesce(n, 0) AS n, CASE WHEN stratum IN (SELECT stratum FROM s) THEN greatest(30 - coalesce(n, 0), 0) END AS missing, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n_total,
    (SELECT sum(n) FROM c) >= 300 AS complete FROM s FULL JOIN c USING (stratum)""",
)
def _(spark, sf_dir):
    e = event_stream(spark, sf_dir).select(
        F.when(F.col("event_type") == "signup", "other").otherwise("token_usage").alias("event"), F.lit("anthropic").alias("provider"), F.lit("x").alias("format_state"),
        F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.col("event_type").alias("classe"),
    )
    counts = J.drain(J.stream_progress(e), "update", ["stratum"])
    return rounded(J.progress_report(counts, ("click", "view", "codigo")))


@query("stream_run_index_once", "SELECT user_id || '-' || event_type AS run_id, min(event_id) AS first_event FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Eight files, two per micro-batch, half of the rows delivered again later, and a restart before the last two files."""
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("run_id"), "event_id")
    again = e.filter("event_id % 2 = 0").withColumn("part", (4 + F.col("event_id") % 4).cast("int"))
    last = e.agg(F.max("event_id")).first()[0] or 0
    rows = e.withColumn("part", F.floor(F.col("event_id") * 4 / (last + 1)).cast("int")).unionByName(again)
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    try:
        with J.replayed(rows, 8, F.col("part")) as folder:
            like = spark.read.parquet(folder)
            J.index_once(J.file_stream(spark, folder, "*.parquet", like, 2).filter("part < 6").drop("part"), root)
            # the same checkpoint goes on with what has come since
            rows.filter("part >= 6").coalesce(2).write.mode("append").parquet(folder)
            J.index_once(J.file_stream(spark, folder, "*.parquet", like, 2).drop("part"), root)
        return checkpointed(J.read_index(spark, root, e.schema).select("run_id", F.col("event_id").alias("first_event")))
    finally:
        delete_folder(spark, root)


@query(
    "stream_session_repeats",
    """WITH e AS (SELECT user_id AS session, event_id AS seq, event_type AS a, 'k' || CAST(json_extract(props, '$.k') AS INT) % 5 AS b FROM events),
    p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM e WINDOW w AS (PARTITION BY session ORDER BY seq))
    SELECT session, seq, (a = pa)::BIGINT + (b = pb)::BIGINT AS overlap, a = pa AND b = pb AS repeated FROM p WHERE pa IS NOT NULL""",
)
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    r = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.array("event_type", F.concat(F.lit("k"), k.cast("string"))).alias("ids")
    )
    return rounded(J.drain(J.stream_repeats(r)))


SAMPLE_HOURS = (0, 2, 30)


@query(
    "stream_switch_overlaps",
    """WITH s AS (SELECT event_id AS sample_id, user_id, ts AS a, ts + to_hours(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 30 END) AS b FROM events WHERE event_type = 'purchase')
    SELECT sample_id, s.user_id, count(*) AS n_switches FROM s JOIN events w ON w.user_id = s.user_id AND w.event_type IN ('signup', 'view') AND w.ts BETWEEN a AND b GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Samples of no, two and thirty hours; files arrive out of order, so either half of a pair may be the late one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    try:
        with J.replayed(e, 4, F.pmod("event_id", F.lit(4))) as folder:
            files = J.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder), 1)
            hours = F.element_at(F.array(*[F.lit(h) for h in SAMPLE_HOURS]), (F.col("event_id") % 3 + 1).cast("int"))
            samples = files.filter("event_type = 'purchase'").select(
                F.col("event_id").alias("sample_id"), "user_id", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(hours=hours)).alias("end")
            )
            switches = files.filter("event_type IN ('signup', 'view')").select("user_id", F.col("ts").alias("at"))
            pairs = checkpointed(J.stream_overlaps(samples, switches, "user_id", root))
    finally:
        delete_folder(spark, root)
    return pairs.groupBy("sample_id", "user_id").agg(F.count(F.lit(1)).alias("n_switches"))
