"""Splits, ladders, library and clustering: invariants and brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feltmill.operators import clustering as B
from feltmill.operators import jobs as J
from feltmill.operators import library as L
from feltmill.operators import profile as Q
from feltmill.operators import runs as R
from feltmill.operators import splits as S
from feltmill.operators.ranks import exact_rank, running, slots
from feltmill.plans import candidates, merge
from feltmill.sources import generated as G
from feltmill.functions.keys import seeded_digest
from feltmill.schemas import JOB_FIELDS, MODEL_COLUMNS, MODEL_NUMERIC


def units(spark, parts):
    rows = [(i, ("PREFLOP", "POSTFLOP", "UNKNOWN")[i % 3], f"u{i % 97}") for i in range(600)]
    return spark.createDataFrame(rows, "id int, stage_group string, split_unit string").repartition(parts)


def test_stage_split_is_whole_and_does_not_depend_on_partitions(spark):
    a, b = (sorted(map(tuple, S.stage_split(units(spark, p)).collect())) for p in (1, 7))
    assert a == b and len(a) == 600
    by_unit = {}
    for unit, _, _, split in a:
        by_unit.setdefault(unit, set()).add(split)
    assert all(len(s) == 1 for s in by_unit.values()) and {s for v in by_unit.values() for s in v} == {"train", "validation", "test"}


def test_small_stage_all_trains_and_unknown_has_no_split(spark):
    df = spark.createDataFrame([("PREFLOP", "a"), ("PREFLOP", "b"), ("UNKNOWN", "c")], "stage_group string, split_unit string")
    assert {r["split_unit"]: r["split"] for r in S.stage_split(df).collect()} == {"a": "train", "b": "train", "c": ""}


def test_exact_rank_equals_one_window(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("g"), "id", seeded_digest(3, F.col("id")).alias("d"))
    got = {r["id"]: (r["rank"], r["group_size"]) for r in exact_rank(df, ["g"], "d", ["id"]).collect()}
    rows = df.collect()
    for g in {r["g"] for r in rows}:
        ordered = sorted((r["d"], r["id"]) for r in rows if r["g"] == g)
        assert all(got[i] == (n, len(ordered)) for n, (_, i) in enumerate(ordered, 1))


def test_running_matches_plain_scan(spark):
    rows = [(k % 3, i, float((i * 7 + k) % 13), None if i % 4 else f"v{i}") for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, i int, x double, t string")
    out = running(df, ["g"], ["i"], F.floor(F.col("i") / 6), {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("t"))}).collect()
    for r in out:
        before = [q for q in rows if q[0] == r["g"] and q[1] < r["i"]]
        assert r["s"] == sum(q[2] for q in before) and r["m"] == (max(q[2] for q in before) if before else None)
        assert r["l"] == next((q[3] for q in reversed(before) if q[3]), None)


def test_slots_cover_the_need(spark):
    df = spark.createDataFrame([("a", 10001), ("b", 0), ("c", 3)], "k string, need bigint")
    got = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in slots(df, "need", 256).groupBy("k").agg(F.count_distinct("slot").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()}
    assert got == {"a": (10001, 0, 10000), "c": (3, 0, 2)}


def test_resample_refuses_a_missing_class(spark):
    df = spark.createDataFrame([("k1", "A", 1.0), ("k2", "B", 2.0)], "k string, label string, x double")
    with pytest.raises(Exception, match="cannot_augment_missing_class"):
        S.balanced_resample(df, "label", ["A", "B", "C"], "k", 30, ["x"]).collect()
    out = S.balanced_resample(df, "label", ["A", "B"], "k", 11, ["x"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"A": 6, "B": 5}
    assert out.filter((F.col("label") == "A") & ~F.col("x").between(0.92, 1.08)).count() == 0
    assert S.balanced_resample(df, "label", ["A", "B"], "k", 2, ["x"]).filter("generation_method <> 'real_imported'").count() == 0


def test_ratios_follow_the_shaken_amounts(spark):
    df = spark.createDataFrame(
        [("a", "A", 10.0, 5.0, 0.4, 9.0, 9.0, 9.0), ("b", "B", None, 5.0, None, 9.0, 9.0, 9.0), ("c", "C", None, None, 0.4, 9.0, 9.0, 9.0)],
        "k string, label string, pot double, price double, equity double, share double, required double, gap double",
    )
    ratios = S.price_ratios("pot", "price", "equity", "share", "required", "gap")
    out = S.balanced_resample(df, "label", ["A", "B", "C"], "k", 6, ["pot", "price"], derived=ratios).filter("k LIKE '%aug%'")
    got = {r["label"]: (r["share"], r["required"], r["gap"]) for r in out.collect()}
    assert got["A"][0] == 0.5 and got["A"][1:] == (0.333333, 0.066667)  # one factor for both amounts
    assert got["B"] == (9.0, 1.0, -1.0) and got["C"] == (9.0, 9.0, -8.6)


def test_stored_tables_can_be_dropped(spark, tmp_path):
    from feltmill import session

    kept, session._OWN[:] = list(session._OWN), []
    path = session.scratch_path(spark, "numbers")
    spark.range(3).write.parquet(path)
    assert session.drop_stored(spark) == 1 and not os.path.exists(path) and not session._OWN
    session._OWN[:] = kept


GOOD = {
    "solver_job_id": "j", "source_snapshot_id": "s", "created_at": "t", "schema_version": "solver_job_v1", "source_type": "synthetic", "units": "bb", "street": "turn", "hero_hand": ["Ah", "Kd"], "villain_hand": ["Qs", "Qd"],
    "villain_range": None, "board": ["2c", "7d", "10h", "Ks"], "pot": "100", "to_call": "0", "stack": "500", "bet_sizes": ["0.33"], "iterations": "5", "timeout_s": "5", "backend": "rust", "label_intent": "solver_smoke",
}
BROKEN = [
    ({"solver_job_id": " "}, "ValueError:solver_job_id_required"), ({"schema_version": "v0"}, "ValueError:unsupported_schema_version:v0"), ({"units": "eur"}, "ValueError:unsupported_units:eur"), ({"street": "PREFLOP"}, "ValueError:unsupported_street:PREFLOP"),
    ({"hero_hand": None}, "TypeError:hero_hand_must_be_list"), ({"hero_hand": ["Ah"]}, "ValueError:hero_hand_card_count:1_expected:2"), ({"board": ["2c"]}, "ValueError:board_card_count:1_expected:4"), ({"board": ["2c", "7d", "1h", "Ks"]}, "ValueError:invalid_card:board:1h"),
    ({"villain_range": "22+"}, "ValueError:villain_range_not_supported"), ({"villain_hand": None}, "ValueError:villain_hand_required"), ({"villain_hand": ["Ah", "Qd"]}, "ValueError:duplicate_cards:Ah"), ({"pot": "0"}, "ValueError:pot_must_be_positive"),
    ({"to_call": "-1"}, "ValueError:to_call_must_be_nonnegative"), ({"iterations": "101"}, "ValueError:iterations_exceeds_limit:100"), ({"timeout_s": "11"}, "ValueError:timeout_s_exceeds_limit:10"), ({"bet_sizes": []}, "ValueError:bet_sizes_required"),
    ({"bet_sizes": ["1"] * 6}, "ValueError:bet_sizes_exceeds_limit:5"), ({"bet_sizes": ["-1"]}, "ValueError:bet_sizes_must_be_positive"), ({"backend": "go"}, "ValueError:unsupported_backend:go"), ({"label_intent": "x"}, "ValueError:unsupported_label_intent:x"), ({}, None),
]


def test_job_rules_in_order(spark):
    schema = ", ".join(f"{f} {'array<string>' if f in J.LISTS else 'string'}" for f in JOB_FIELDS)
    rows = [tuple({**GOOD, **change}[f] for f in JOB_FIELDS) + (i,) for i, (change, _) in enumerate(BROKEN)]
    out = J.validate_jobs(spark.createDataFrame(rows, schema + ", i int"))
    got = {r["i"]: r["error"] for r in out.collect()}
    assert got == {i: error for i, (_, error) in enumerate(BROKEN)}
    ok = out.filter("error IS NULL").first()
    assert ok["board"] == ["2c", "7d", "Th", "Ks"] and ok["initial_contributions"] == [50.0, 50.0] and ok["hero_solver_player"] == 0


def test_upsert_insert_delete(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], "spot_id string, v int, created_at int")
    new = spark.createDataFrame([("b", 3, 5), ("c", 4, 7), ("c", 5, 8)], "spot_id string, v int, created_at int")
    assert sorted(map(tuple, L.upsert(old, new).collect())) == [("a", 1, 10), ("b", 3, 5), ("c", 5, 8)]
    kept, rejected = L.insert_only(old, new)
    assert sorted(map(tuple, kept.collect())) == [("a", 1, 10), ("b", 2, 10), ("c", 4, 7)]
    assert sorted((r["spot_id"], r["v"]) for r in rejected.collect()) == [("b", 3), ("c", 5)]
    left, absent = L.delete(old, spark.createDataFrame([("a",), ("z",)], "spot_id string"))
    assert [r["spot_id"] for r in left.collect()] == ["b"] and [r["spot_id"] for r in absent.collect()] == ["z"]
    assert L.listing(old.withColumn("label", F.lit("x")), label_pattern="(").count() == 0


def test_glue_refuses_repeated_ids(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "source_row_id int, p string")
    b = spark.createDataFrame([(1, 2.0)], "source_row_id int, q double")
    with pytest.raises(Exception, match="duplicate_row_id:1"):
        L.glue(a, b).collect()


def test_clusters_match_numpy(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.dirichlet(a, 40) for a in ([9, 1, 1, 1, 1], [1, 1, 9, 1, 1], [1, 1, 1, 1, 9])])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, h array<double>").repartition(5)
    found = B.kmeans_emd(df, "id", "h", 3, seed=1, max_rounds=30)
    again = B.kmeans_emd(df.repartition(2), "id", "h", 3, seed=1, max_rounds=30)
    assert np.allclose(found.centroids, again.centroids) and np.allclose(found.centroids.sum(axis=1), 1)
    gaps = np.abs(np.cumsum(points, axis=1)[:, None, :] - np.cumsum(found.centroids, axis=1)[None]).mean(axis=2)
    rows = sorted(B.assign(df, "h", found.centroids).collect(), key=lambda r: r["id"])
    assert [r["cluster"] for r in rows] == gaps.argmin(axis=1).tolist() and np.allclose([r["distance"] for r in rows], gaps.min(axis=1))
    labels = [r["cluster"] for r in rows]
    assert all(max(labels[i * 40:(i + 1) * 40].count(k) for k in range(3)) >= 36 for i in range(3))
    assert found.history[-1] <= found.history[0] + 1e-9


def test_inflation_is_infinite_for_a_copy():
    assert Q.variance_inflation(np.array([[1.0, 1.0], [1.0, 1.0]])) == [float("inf")] * 2
    assert Q.variance_inflation(np.eye(2)) == [1.0, 1.0]


def test_merge_job(spark, tmp_path):
    base = {c: 1.0 for c in MODEL_NUMERIC}

    def row(i, street, board):
        values = {**base, "features.board_card_count": board, "metadata.street": street, "features.hero_position": None}
        return (f"s{i}", f"h{i // 2}", ("call", "RAISE", "no_invest")[i % 3], *[values[c] for c in MODEL_COLUMNS])

    rows = [row(i, "preflop" if i % 2 else "FLOP", 3.0) for i in range(120)] + [row(999, "", float("nan"))]
    schema = "snapshot_id string, hand_id string, bootstrap_label string, " + ", ".join(f"`{c}` {'string' if c in ('metadata.street', 'features.hero_position') else 'double'}" for c in MODEL_COLUMNS)
    merged = merge.merge([merge.scenario_source(spark.createDataFrame(rows, schema))])
    assert {r["value"]: r["n"] for r in merged.reports["stage_group_distribution"].collect()} == {"PREFLOP": 60, "POSTFLOP": 60, "UNKNOWN": 1}
    assert merged.rows.filter(F.col("label_3intent").isin("CALL", "RAISE", "NO_INVEST")).count() == 121
    assert merged.rows.groupBy("split_unit").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    merge.write(merged, str(tmp_path / "m"))
    x = spark.read.option("header", True).csv(str(tmp_path / "m" / "X"))
    assert x.count() == 120 and set(x.columns) - {"stage_group", "split"} == set(MODEL_COLUMNS)


def test_candidate_job(spark):
    runs = spark.createDataFrame(
        [(f"r{i}", f"g{i // 2}", "RIVER", ["Ah", "Kd"], ["2c", "2d"], ["3c", "4c", "5c", "6d", "8h"], 100.0, float(i % 3) * 10, 500.0, 5.0, "OOP", "hero_check_or_bet", {"CHECK": 1.0}, "CHECK" if i < 20 else "FOLD", 0.9, 50, 0.1, "high", True, "hero", "ok", [], None)
         for i in range(40)],
        "source_id string, group_id string, street string, hero_cards array<string>, villain_hand array<string>, board_cards array<string>, pot double, to_call double, stack double, spr double, position_model string, decision_context_type string, "
        "action_frequencies map<string,double>, dominant_action string, dominant_frequency double, iterations int, exploitability_last double, candidate_confidence string, root_matches_hero boolean, root_player_role string, solver_status string, danger_flags array<string>, raw_error string",
    )
    out = candidates.export(runs, top_up=True)
    assert out.rows.filter((F.col("bootstrap_label").isNull()) == (F.col("exclusion_reason").isNull())).count() == 0
    assert {r["bootstrap_label"]: r["count"] for r in out.rows.groupBy("bootstrap_label").count().collect()} == {"CHECK": 34, "FOLD": 34, "RAISE": 34}
    assert out.aligned.filter("`quality_flags.usable_for_training`").count() == 102
    audit = candidates.audit(out.aligned)
    assert "features.has_raise" in {r["feature"] for r in audit["constant"].collect()}
    assert {r["status"] for r in audit["contract"].collect()} >= {"model_used", "leakage_excluded", "target", "constant_excluded"}


def test_generators_repeat_under_any_partitioning(spark):
    for profile in (*G.RANDOM_STREETS, *G.BOARD_PROFILES):
        a, b = (sorted(map(str, G.generated_jobs(G.indexes(spark, 20).repartition(p), profile).collect())) for p in (1, 5))
        assert a == b
    with pytest.raises(ValueError, match="unsupported_generation_profile"):
        G.generated_cards(G.indexes(spark, 1), "nope")
    with pytest.raises(ValueError, match="max_total_solves_exceeds_limit:5"):
        G.experiment_plan(G.indexes(spark, 1), max_solves=5)


def test_strategy_keeps_the_last_of_two_equal_labels(spark):
    df = spark.createDataFrame([(["bet33", "BET_33", "x"], [0.2, 0.4, 0.6], 0, "hero", True)], "l array<string>, f array<double>, hero_solver_player int, root_player_role string, root_matches_hero boolean")
    df = df.select(F.struct(F.col("l").alias("action_labels"), F.col("f").alias("frequencies"), "hero_solver_player", "root_player_role", "root_matches_hero").alias("s"))
    row = R.root_strategy(df, "s").first()
    assert row["action_frequencies"] == {"BET_33": 0.4, "X": 0.6} and row["dominant_action"] == "X" and row["strategy_confidence"] == "medium"


# ---- rows that used to get lost --------------------------------------------------------------


def test_stream_upsert_takes_the_newest_order_over_batches(spark, tmp_path):
    from feltmill.streaming import intake as S

    schema = "id long, seq long, v string"
    for name, rows in (("a", [(1, 20, "new"), (2, 1, "x")]), ("b", [(1, 10, "old"), (2, 2, "y")]), ("c", [(2, 2, "z"), (None, 1, "n")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), "id", "seq")
    assert len(list((tmp_path / "t").glob("batch=*"))) == 3
    found = {tuple(r) for r in S.latest(spark, str(tmp_path / "t"), ["id"], "seq").select("id", "seq", "v").collect()}
    assert found == {(1, 20, "new"), (2, 2, "z"), (None, 1, "n")}


def test_insert_only_loses_no_tied_row(spark):
    from feltmill.operators import library as L

    old = spark.createDataFrame([("k", "there", 1)], "spot_id string, v string, created_at long")
    new = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("a", "x", 5), (None, "n", 1), (None, "n", 1), ("k", "late", 0)], old.schema)
    kept, rejected = L.insert_only(old, new)
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [("k", "there", 1), ("a", "x", 5), (None, "n", 1)]))
    assert sorted(str(tuple(r)[:3]) for r in rejected.collect()) == sorted(map(str, [("a", "x", 5), ("a", "y", 5), (None, "n", 1), ("k", "late", 0)]))
    assert L.upsert(old, new.filter("spot_id = 'a'")).filter("spot_id = 'a'").first().v == "y"


def test_ids_are_never_cut(spark):
    from feltmill.functions.keys import padded

    found = spark.range(1).select(*[padded(F.lit(n), 6).alias(str(n)) for n in (7, 999999, 1234567, 1234568)]).first()
    assert list(found) == ["000007", "999999", "1234567", "1234568"]


def test_rows_without_an_id_keep_their_own_names(spark):
    from feltmill.plans.candidates import _named

    rows = spark.createDataFrame([(None, "CALL", 1), (None, "CALL", 2), ("", "CALL", 2), (None, "CALL", 2), (None, "CALL", 2), ("s1", "CALL", 1)], "source_id string, raw_action string, pot int")
    found = _named(rows).collect()
    assert len({r.row_index for r in found if not r.source_id}) == 5 and len(found) == 6


def test_missing_labels_and_groups_stay(spark):
    from feltmill.operators import splits as M

    rows = [(i, None if i % 4 == 0 else "AB"[i % 2], None if i % 5 == 0 else i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, grp int")
    assert M.stratified_three_way(df, "label", "id").count() == 40
    assert M.stratified_two_way(df, "label", "id").count() == 40
    assert M.grouped_split(df, "label", "grp").count() == 40
    half = {r["label"]: r["count"] for r in M.stratified_fraction(df, "label", "id", 0.5).groupBy("label").count().collect()}
    assert half == {None: 5, "B": 10, "A": 5}
    assert M.fixed_sample(df, "id", 7).count() == 7


def test_sliced_replay_keeps_actions_without_a_player(spark):
    from feltmill.operators import replay as R

    schema = "hand long, at long, kind string, code string, player int, amount double, blind double, max_blind double, start_pot double"
    rows = [(1, 1, "bet", "cbr", 1, 4.0, 1.0, 2.0, 3.0), (1, 2, "bet", "cc", 2, None, 2.0, 2.0, 3.0), (1, 3, "board", None, None, None, None, 2.0, 3.0), (1, 4, "bet", "cc", 1, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, schema)
    whole = R.replay_bets(df, ["hand"], ["at"])
    sliced = R.replay_bets(df, ["hand"], ["at"], slice_of=F.floor(F.col("at") / 2))
    names = ["at", "segment", "current_bet", "to_call", "pot"]
    assert sorted(map(tuple, sliced.select(names).collect())) == sorted(map(tuple, whole.select(names).collect())) and sliced.count() == 4


def test_history_headers_in_any_form(spark, tmp_path):
    from feltmill.sources import files as I

    text = "preamble\n## Game: 1 | Hand: 1 ##\na calls\n##  Game: 1 | Hand: 2 ##\nb folds\n## game: 1 | hand: 3 ##\nc bets\n## Game: broken\nlost line\n"
    (tmp_path / "h.txt").write_text(text)
    found = [r.text for r in I.history_sections(spark, str(tmp_path / "h.txt")).orderBy("section_id").collect()]
    blob = spark.createDataFrame([(1, text)], "k int, text string")
    assert found == [r.text for r in I.split_sections(blob, "k", "text").orderBy("section").collect()] and len(found) == 3
    big = "".join(f"## Game: 1 | Hand: {i} ##\nline of hand {i}\n" for i in range(3000))
    (tmp_path / "big.txt").write_text(big)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = I.history_sections(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.text for r in rows} == {f"## Game: 1 | Hand: {i} ##\nline of hand {i}" for i in range(3000)} and len(rows) == 3000


def test_bad_range_tokens_are_told(spark):
    from feltmill.operators import ranges as R

    bad = {"XX": "invalid_ranks", "AKq": "invalid_suit_mark", "AKs-QTs": "unequal_gaps", "AAs": "pair_with_suit_mark", "AhAh": "duplicate_card", "77-AK": "pair_and_non_pair",
           "AKs-QJo": "unequal_suit_marks", "A": "invalid_hand_token", "AKsss": "invalid_hand_token"}
    good = {"AA": 6, "AK": 16, "AKs": 4, "AKo": 12, "22+": 78, "A2s+": 48, "KQs-JTs": 12, "99-77": 18, "AhKh": 1, "A5s-A2s": 16}
    df = spark.createDataFrame([(t, t) for t in [*bad, *good]], "k string, text string")
    assert {r.k: r.error for r in R.range_errors(df, "k", "text").collect()} == bad
    assert {r["k"]: r["count"] for r in R.range_combos(df, "k", "text").groupBy("k").count().collect()} == good


def test_json_schema_opens_every_level(spark):
    from feltmill.operators import profile as Q

    df = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}',)], "raw string")
    assert {r["path"] for r in Q.json_schema(df, "raw", 30).collect()} == {"a", "a.b", "a.b.c", "a.b.c.d", "a.b.c.d.e", "a.b.c.d.e.f"}
