"""Inputs beyond what earlier versions bounded: nothing is dropped, merged or tied together."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.catalog.inputs import conversation_turns
from plumbline.functions.hashing import row_digest
from plumbline.functions.stats import SHORT_BITS, SHORT_DRAWS, poisson_weight, with_draw, with_short_draws
from plumbline.functions.text import content_key
from plumbline.operators import labels as L
from plumbline.operators import matching as M
from plumbline.operators import memory as Y
from plumbline.operators import search as Q
from plumbline.streaming import jobs as J


def test_equal_and_null_samples_stay(spark):
    rows = [("u", 1000, 5000), ("u", 1000, 5000), ("u", None, 5000), (None, 1000, 2000), ("u", 10, 20), ("v", 0, 10_000_000)]
    samples = spark.createDataFrame(rows, "user string, s long, e long")
    switches = spark.createDataFrame([("u", 3000), ("v", 7_200_000)], "user string, t long")
    got = M.flag_overlaps(samples, switches, "s", "e", "t", ["user"]).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.user), str(r.s), r.suspect) for r in got) == sorted(
        [("u", "1000", True), ("u", "1000", True), ("u", "None", False), ("None", "1000", False), ("u", "10", False), ("v", "0", True)]
    )


def test_interleaved_conversations(spark):
    turns = spark.createDataFrame([(1, 1, "a"), (2, 2, "x"), (1, 3, "b"), (2, 4, "y")], "conv_id long, seq long, query string")
    assert {(r.query, r.predecessor) for r in Y.with_predecessor(turns).collect()} == {("b", "a"), ("y", "x")}


def test_long_conversations_do_not_meet(spark, tmp_path):
    rows = [(c, t, "user", f"{c}/{t}") for c in (1, 2) for t in range(1500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    turns = conversation_turns(spark, str(tmp_path))
    assert turns.select("seq").distinct().count() == 3000
    got = Y.with_predecessor(turns, text="text")
    assert got.count() == 2998 and got.filter("split(text, '/')[0] <> split(predecessor, '/')[0]").isEmpty()


def test_draws_of_large_keys_and_replicates_are_independent(spark):
    keys = spark.createDataFrame([(5,), (5 + 2147483647,), (5 + 2**40,)], "k long").crossJoin(spark.range(200).withColumnRenamed("id", "b"))
    rows = with_draw(keys, "k", "b", 3).withColumn("w", poisson_weight(F.col("u"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, {})[r.b] = r.u
    assert len({r.u for r in rows}) == len(rows) and max(r.u for r in rows) > 2**58
    streams = [[v for _, v in sorted(x.items())] for x in by.values()]
    assert not any(set(a[:-1]) & set(b[1:]) for a in streams for b in streams if a is not b)
    assert 0.8 < sum(r.w for r in rows) / len(rows) < 1.2


def test_draws_that_share_a_digest_are_independent(spark):
    names = [f"u{i}" for i in range(SHORT_DRAWS)]
    keys = spark.range(4000).withColumnRenamed("id", "k").withColumn("g", F.lit(2))
    rows = with_short_draws(keys, "k", "g", 3, names).select([poisson_weight(F.col(n), SHORT_BITS).alias(n) for n in names] + [F.col(n).alias(f"d{n}") for n in names])
    sums = rows.agg(*[F.avg(n).alias(n) for n in names], *[F.corr(a, b).alias(f"{a}{b}") for a in names for b in names if a < b], F.max("du5").alias("top")).first()
    assert all(0.93 < sums[n] < 1.07 for n in names)
    assert all(abs(sums[f"{a}{b}"]) < 0.08 for a in names for b in names if a < b)
    assert 0.99 * 2**SHORT_BITS < sums.top < 2**SHORT_BITS


def test_groups_are_keyed_by_the_whole_digest(spark):
    df = spark.createDataFrame([("q", "a")], "q string, a string").select(content_key("q", "a").alias("k"))
    assert len(df.first().k) == 64
    labels = spark.createDataFrame([(1, "1", "s", "o", "q", "a", "L")], "seq long, id string, store string, origem string, query string, resposta string, rotulo string")
    row = L.label_groups(labels).first()
    assert row.content.startswith(row.key) and len(row.key) == 12


def test_a_faulty_rule_is_an_error(spark):
    facts = spark.createDataFrame([("1", True)], "id string, flag boolean")
    assert L.with_rule(facts, "absent_flag", "p").first().p is False
    with pytest.raises(AnalysisException):
        L.with_rule(facts, "no_such_function(flag)", "p").collect()


def test_diversification_takes_the_whole_pool(spark):
    pool = spark.createDataFrame([(1, i, 1.0 - i / 1000, i + 1, [float(i % 7), 1.0, float(i % 3)]) for i in range(150)], "seq long, id long, score double, pos int, vec array<double>")
    assert Q.mmr(pool, 120).count() == 120


def test_long_samples_meet_late_switches(spark, tmp_path):
    stamp = lambda h: f"timestamp'2020-01-01 00:00:00' + INTERVAL {h} HOURS"
    files = [
        f"SELECT 1 AS id, 7 AS u, {stamp(0)} AS a, {stamp(90)} AS b, CAST(NULL AS timestamp) AS t",
        f"SELECT 2 AS id, 7 AS u, CAST(NULL AS timestamp) AS a, CAST(NULL AS timestamp) AS b, {stamp(89)} AS t UNION ALL SELECT 3, 7, {stamp(5)}, {stamp(5)}, NULL",
        f"SELECT 4 AS id, 7 AS u, CAST(NULL AS timestamp) AS a, CAST(NULL AS timestamp) AS b, {stamp(5)} AS t UNION ALL SELECT 5, 8, NULL, NULL, {stamp(5)} UNION ALL SELECT 6, 7, NULL, NULL, {stamp(91)}",
    ]
    for sql in files:
        spark.sql(sql).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = J.file_stream(spark, f"{tmp_path}/in", "*.parquet", spark.sql(files[0]), 1)
    samples = stream.filter("a IS NOT NULL").selectExpr("id AS sample_id", "u", "a AS start", "b AS end")
    pairs = J.stream_overlaps(samples, stream.filter("t IS NOT NULL").selectExpr("u", "t AS at"), "u", f"file://{tmp_path}/root").selectExpr("sample_id", "CAST(unix_seconds(at) - unix_seconds(timestamp'2020-01-01') AS INT) / 3600 AS h")
    assert sorted((r.sample_id, r.h) for r in pairs.collect()) == [(1, 5.0), (1, 89.0), (3, 5.0)]


def test_a_run_is_indexed_once_over_batches_and_restarts(spark, tmp_path):
    def deliver(*rows):
        spark.createDataFrame(rows, "run_id string, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def index():
        stream = J.file_stream(spark, f"{tmp_path}/in", "*.parquet", spark.createDataFrame([], "run_id string, v long"), 1)
        batches = J.index_once(stream, f"file://{tmp_path}/root")
        return batches, sorted((r.run_id, r.v, r.batch) for r in J.read_index(spark, f"file://{tmp_path}/root", stream.schema).collect())

    deliver(("a", 2), ("a", 1))
    deliver(("b", 1), ("a", 1))
    deliver(("a", 0), ("c", 5))
    assert index() == (3, [("a", 1, 0), ("b", 1, 1), ("c", 5, 2)])
    deliver(("c", 5), ("d", 1))
    assert index()[1] == [("a", 1, 0), ("b", 1, 1), ("c", 5, 2), ("d", 1, 3)]


def test_digests_tell_where_a_value_ends(spark):
    df = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), ("a", None), ("a", "-"), ("1:a", ""), ("", "1:a")], "x string, y string")
    assert len({r.d for r in df.select(row_digest(["x", "y"]).alias("d")).collect()}) == 6



def test_strip_takes_all_white_space_and_all_marks(spark):
    from plumbline.functions import text as T

    row = spark.createDataFrame([("\tabc\n ", "Ệ ñ Ž ő é")], "a string, b string").select(T.strip("a").alias("a"), T.truncate("a").alias("t"), T.strip_accents("b").alias("b")).first()
    assert tuple(row) == ("abc", "abc", "e n z o e")


def test_export_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    from plumbline.sources.retrieval import ordered_lines

    for name, rows in (("b.txt", range(500, 900)), ("a.txt", range(0, 500)), ("c.txt", range(900, 901))):
        (tmp_path / name).write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in rows))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted((r.seq, int(r.value.split()[1])) for r in ordered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == [(i, i) for i in range(901)]
