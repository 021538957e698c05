"""Files written and read back."""

import json

from pyspark.sql import functions as F

from plumbline.plans import studies
from plumbline.sources import memory as SM
from plumbline.sources import runs as SR
from plumbline.sources import tables as ST


def test_label_and_feature_csv(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('# guide line\nid,store,query,rotulo\na,s1,"two\nlines",X\nb,s2,q,\n', encoding="utf-8")
    got = {r.id: r for r in ST.read_labels(spark, str(tmp_path / "labels.csv")).collect()}
    assert got["a"]["query"] == "two\nlines" and set(got) == {"a", "b"}
    (tmp_path / "features.csv").write_text("id,flag,n\na,True,3\nb,AUSENTE,1.5\nc,False,x\n", encoding="utf-8")
    feats = {r.id: (r.flag, r.n) for r in ST.read_features(spark, str(tmp_path / "features.csv"), ["flag"], ["n"]).collect()}
    assert feats == {"a": (True, 3.0), "b": (None, 1.5), "c": (False, None)}


def test_sequence_keeps_order_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "y", 2.0), (1, "a", "x", 1.0)], "seq long, query string, id string, timestamp double")
    first = ST.write_sequence(df, str(tmp_path / "one")).first()
    again = ST.write_sequence(df.repartition(3), str(tmp_path / "two")).first()
    assert first == again and first.n_rows == 2
    lines = [json.loads(l) for p in sorted((tmp_path / "one").glob("part-*.json")) for l in p.read_text().splitlines()]
    assert [l["query"] for l in lines] == ["a", "b"]


def test_sample_log_grows(spark, tmp_path):
    one = spark.createDataFrame([(1, 2.0)], "key long, num double")
    ST.append_samples(one, str(tmp_path / "log"))
    ST.append_samples(one.withColumn("key", F.lit(2).cast("long")), str(tmp_path / "log"))
    assert ST.read_samples(spark, str(tmp_path / "log")).count() == 2


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("C1", 1), ("C2", 2)], "k string, v int")
    new = spark.createDataFrame([("C2", 9), ("C3", 3)], "k string, v int")
    assert {r.k: r.v for r in ST.upsert_by_key(base, new, ["k"]).collect()} == {"C1": 1, "C2": 9, "C3": 3}


def test_memory_files(spark, tmp_path):
    for scope, layer, body in (("cognitive", "episodic", [{"id": "a", "text": "t", "answer_class": None}, 5]), ("sprint", "semantic", {"entries": [{"id": "b", "acessos": 4}]})):
        folder = tmp_path / f"default_{scope}"
        folder.mkdir()
        (folder / f"{layer}.json").write_text(json.dumps(body), encoding="utf-8")
    got = {r.id: (r.scope, r.layer, r.acessos, r.has_answer_class) for r in SM.read_memory(spark, str(tmp_path)).collect()}
    assert got == {"a": ("cognitive", "episodic", None, True), "b": ("sprint", "semantic", 4, False)}


def test_faulty_snapshots_leave_rejects(spark, tmp_path):
    bodies = {"cut": '[{"id": "a", "text": "t"}, {"id": "b", "te', "none": '{"items": []}', "text": "hello", "mixed": '{"entries": [{"id": "c"}, 5, null, {"id": "d"}]}', "empty": "[]"}
    for layer, body in bodies.items():
        (tmp_path / "default_x").mkdir(exist_ok=True)
        (tmp_path / "default_x" / f"{layer}.json").write_text(body, encoding="utf-8")
    files = SM.snapshot_files(spark, str(tmp_path))
    assert sorted(r.id for r in SM.parse_snapshots(files).collect()) == ["c", "d"]
    got = {(r.layer, r.position): r.reason for r in SM.snapshot_rejects(files).collect()}
    assert got == {("cut", None): "invalid_json", ("none", None): "no_entries", ("text", None): "invalid_json", ("mixed", 1): "entry_not_object", ("mixed", 2): "entry_not_object"}


def test_legacy_index_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "index.1.jsonl").write_text('{"run_id": "r1", "ts": 1.0}\n{oops\n', encoding="utf-8")
    (tmp_path / "index.jsonl").write_text('{"run_id": "r2", "ts": 2.0}\n', encoding="utf-8")
    rows = SR.read_legacy_index(spark, str(tmp_path), "run_id string, ts double").collect()
    assert sorted(r.run_id for r in rows) == ["r1", "r2"]


def test_ablation_verdict_needs_a_still_control(spark):
    verdict = lambda *row: studies.ablation_verdict(spark.createDataFrame([row], "t_lo double, t_hi double, c_lo double, c_hi double")).first().verdict
    assert verdict(0.1, 0.3, -0.1, 0.1) == "H1"
    assert verdict(0.1, 0.3, 0.05, 0.1).startswith("INVALIDO")
    assert verdict(-0.1, 0.3, -0.1, 0.1).startswith("H0")


def test_lines_of_an_export_stay_where_they_are_read(spark, tmp_path):
    from plumbline.sources.retrieval import ordered_lines

    for name, rows in (("b.txt", range(30, 50)), ("a.txt", range(0, 30)), ("c.txt", ())):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in rows))
    lines = ordered_lines(spark, str(tmp_path))
    # One window, over the splits; the lines themselves were sorted in a second one.
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert sorted((r.seq, int(r.value)) for r in lines.collect()) == [(i, i) for i in range(50)]
