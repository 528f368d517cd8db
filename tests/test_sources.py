"""Scans and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feltmill import schemas as H
from feltmill.operators import normalize as N
from feltmill.operators import runs as R
from feltmill.operators import snapshots as S
from feltmill.sources import files as I
from feltmill.sources import sinks as K


def test_json_lines_keep_good_rows_and_name_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a": 1}\n\n[1]\n{bad\n{"a": 2}\n', encoding="utf-8")
    rows, warnings = I.json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none.jsonl")], "a bigint")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
    texts = sorted(w["warning"].rsplit("/", 1)[-1] for w in warnings.collect())
    assert texts[0] == "a.jsonl:line_2:non_object" and texts[1] == "a.jsonl:line_3:invalid_json" and texts[2].startswith("none.jsonl:")


def test_line_numbers_survive_many_splits(spark, tmp_path):
    (tmp_path / "n.txt").write_text("\n".join(str(i) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = I.numbered_lines(spark, str(tmp_path / "n.txt"))
        assert lines.filter(F.col("value").cast("bigint") != F.col("line")).count() == 0 and lines.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_records_keep_broken_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"solver_job_id": "j_it25", "solver_status": "ok", "quality": {"iterations": 25}}\n\nnope\n"text"\n')
    rows = I.run_records(spark, [str(tmp_path / "r.jsonl")], H.RUN_RESULT)
    states = rows.withColumn("state", R.run_state(F.col("solver_status"), F.col("quality.exclusion_reason"), F.col("error"), F.col("warnings"), F.col("invalid")))
    got = sorted((r["state"], r["error"]) for r in states.collect())
    assert got == [("error", "JSONDecodeError"), ("error", "jsonl_empty_line"), ("error", "jsonl_record_must_be_object"), ("solved", None)]


def test_selected_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("\n".join(["{}", "", "x", '{"a": 1}', "{}"]))
    got = [(r["line"], r["load_error"]) for r in I.selected_lines(spark, str(tmp_path / "j.jsonl"), 1, 3).orderBy("line").collect()]
    assert got == [(1, "jsonl_empty_line"), (2, "JSONDecodeError"), (3, None)]
    with pytest.raises(ValueError, match="max_jobs_exceeds_limit:50"):
        I.selected_lines(spark, "x", 0, 51, largest=50)


def test_scenario_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="missing_scenario_sources"):
        I.scenario_paths(str(tmp_path))
    (tmp_path / "preflop_x_game_scenario_information.csv").write_text(
        "﻿,prev_line,hero_pos,hero_holding,correct_decision,num_players,num_bets,available_moves,pot_size\n0,UTG/2.0bb,BB,AhKd,call,6,1,\"['call', 'fold']\",3.5\n1,,SB,2c2d,8.0bb,,0,\"check, raise\",1\n2,,SB,2c2d,dance,,0,check,1\n", encoding="utf-8"
    )
    paths = I.scenario_paths(str(tmp_path))
    rows, unmapped = N.scenario_rows(I.scenario_csv(spark, paths))
    got = {r["snapshot_id"].rsplit(":", 1)[-1]: r for r in rows.collect()}
    assert got["0"]["bootstrap_label"] == "CALL" and got["0"]["features.to_call_bb"] == 2.0 and got["0"]["metadata.street"] == "PREFLOP"
    assert got["1"]["bootstrap_label"] == "RAISE" and got["1"]["features.num_players"] == 6.0 and got["1"]["features.has_raise"] == 1.0
    assert [(r["output"], r["rows"]) for r in unmapped.collect()] == [("dance", 1)]


def test_scenario_json(spark, tmp_path):
    (tmp_path / "postflop.json").write_text(json.dumps({"data": [], "rows": [{"label": "Fold", "actions": "fold, call", "pot": "4", "street": "turn", "board_flop": "2c3d4h"}]}))
    rows, _ = N.scenario_rows(I.scenario_json(spark, [str(tmp_path / "postflop.json")]))
    r = rows.first()
    assert (r["bootstrap_label"], r["metadata.street"], r["features.pot_bb"], r["features.board_card_count"], r["features.has_fold"]) == ("FOLD", "TURN", 4.0, 3.0, 1.0)


def test_parquet_splits(spark, tmp_path):
    spark.range(5).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train")).write.partitionBy("split").parquet(str(tmp_path / "p"))
    rows = I.parquet_splits(spark, str(tmp_path / "p"), ["train", "test"], "cfg")
    assert rows.filter("_source_split = 'test'").count() == 2 and rows.filter("_source_config = 'cfg'").count() == 5


def test_candidate_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("pot,stack,excluded,bootstrap_label\n12,abc,True, RAISE \nyes,5,0,\n")
    rows = I.candidate_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [(r["features.pot"], r["features.hero_stack"], r["excluded"], r["bootstrap_label"]) for r in rows] == [(12.0, None, True, "RAISE"), (1.0, 5.0, False, None)]
    (tmp_path / "d.csv").write_text("pot,gto_label,bootstrap_label\n1,x,y\n")
    with pytest.raises(ValueError, match="forbidden_column_present:gto_label"):
        I.candidate_csv(spark, str(tmp_path / "d.csv"))


def test_merge_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n3,c\n1,a\n2,b\n")
    frames, warnings = I.merge_sources(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")})
    assert sorted(r["x"] for r in frames["a"].collect()) == ["a", "b", "c"] and warnings[0].startswith("missing_source:b:")
    with pytest.raises(FileNotFoundError, match="no_merge_sources_available"):
        I.merge_sources(spark, {"b": str(tmp_path / "b.csv")})


def test_jsonl_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", [1, 2], {"k": 0.5}, "secret")], "b string, a array<int>, m map<string,double>, gto_label string")
    K.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":[1,2],"b":"x","m":{"k":0.5}}'
    K.write_csv(df, str(tmp_path / "c"), ["b", "a", "m"])
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert (row["a"], row["m"]) == ("[1,2]", '{"k":0.5}')
    with pytest.raises(Exception):
        K.write_csv(df, str(tmp_path / "c"), ["b"])
    K.write_csv(df, str(tmp_path / "c"), ["b"], force=True)


def test_export_bundle(spark, tmp_path):
    records = spark.createDataFrame([(0, "train", "current pot size is 40", "call"), (1, "train", "", "ponder")], "_source_row_idx long, _source_split string, prompt string, response string")
    for name, kind in ((f.name, f.dataType) for f in H.PROMPT_RECORD.fields):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    rows = N.prompt_rows(records, "src", "terms", "url", config="c")
    report = K.write_export(N.normalized_frame(rows), N.audit_rows(rows), str(tmp_path / "out"))
    got = {(r["section"], r["key"]): r["value"] for r in report.collect()}
    assert got[("totals", "rows_loaded")] == 2 and got[("totals", "rows_dropped")] == 1 and got[("label_distribution_3intent", "CALL")] == 1 and got[("missing_field_rates", "hand_id")] == 1.0
    read = spark.read.option("header", True).csv(str(tmp_path / "out" / "model_input"))
    assert read.columns == list(H.NORMALIZED_COLUMNS) and read.count() == 1
    assert not set(spark.read.option("header", True).csv(str(tmp_path / "out" / "model_features_20")).columns) & set(H.AUDIT_RAW_COLUMNS)
    with pytest.raises(Exception):
        K.write_export(N.normalized_frame(rows), N.audit_rows(rows), str(tmp_path / "out"))


def test_run_record_envelope(spark, tmp_path):
    df = spark.createDataFrame([], H.RUN_RESULT)
    row = {"solver_job_id": "a", "error": "boom"}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in H.RUN_RESULT.fields)], H.RUN_RESULT)
    K.write_run_records(df.withColumn("training_label", F.lit("x")), str(tmp_path / "r"))
    out = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert out["solver_status"] == "failed" and out["quality"] == {"iterations": None, "exploitability_last": None, "is_label_candidate": False, "exclusion_reason": "quality_missing"} and "training_label" not in out


def test_strict_sink_and_combine(spark, tmp_path):
    df = spark.createDataFrame([("a", []), ("b", ["bad"]), ("c", []), ("d", [])], "snapshot_id string, reasons array<string>")
    rejected = K.write_strict(df, str(tmp_path / "s"))
    assert [r["snapshot_id"] for r in rejected.collect()] == ["b"]
    (tmp_path / "x.jsonl").write_text('{"z": 1}\n\n')
    assert K.combine_jsonl(spark, [str(tmp_path / "s"), str(tmp_path / "x.jsonl"), str(tmp_path / "gone")], str(tmp_path / "all")) == 2
    assert spark.read.text(str(tmp_path / "all")).count() == 4


def test_snapshot_scan_and_schema(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('﻿{"snapshot_id": "s1", "type": "ml_decision_snapshot", "features": {"pot": 10, "players": [{"name": "Hero", "active": true, "stack_bb": 20}]}}\n[]\n', encoding="utf-8")
    rows = I.snapshots(spark, str(tmp_path / "s.jsonl"), H.SNAPSHOT)
    assert [r["snapshot_id"] for r in rows.collect()] == ["s1"] and rows.first()["features"]["pot"] == 10.0
    flat = N.flatten_one_level(rows)
    assert "features.pot" in flat.columns and "labels.final_action" in flat.columns


def test_matrix_refuses_leakage():
    with pytest.raises(ValueError, match="leakage_column_in_features:labels.final_action"):
        H.check_matrix(["features.pot", "labels.final_action"])
    with pytest.raises(ValueError, match="missing_normalized_column:source_dataset"):
        H.check_normalized([])
    assert not [c for c in H.MODEL_COLUMNS if H.is_leakage(c)]


def test_split_fan_out(spark, tmp_path):
    df = spark.createDataFrame([("s1", "train", 1.0, "CALL", "x"), ("s2", "test", 2.0, "FOLD", "y")], "snapshot_id string, split string, `features.pot_bb` double, bootstrap_label string, `audit.note` string")
    paths = K.write_splits(df, str(tmp_path / "d"), ["features.pot_bb"], audit=["audit.note"])
    x = spark.read.option("header", True).csv(paths["X"])
    assert set(x.columns) == {"features.pot_bb", "split"} and x.filter("split = 'test'").first()["features.pot_bb"] == "2.0"
    assert spark.read.option("header", True).csv(paths["y"]).count() == 2 and spark.read.json(paths["dataset_jsonl"]).count() == 2
    with pytest.raises(ValueError, match="leakage_column_in_features"):
        K.write_splits(df, str(tmp_path / "e"), ["audit.note"])
