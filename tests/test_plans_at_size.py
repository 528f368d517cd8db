"""Plans that decide whether a query still runs on large tables."""

import feltmill.plans.catalog  # noqa: F401  (fills the registry)
from feltmill import session
from feltmill.operators import ranges as G
from feltmill.operators import replay as R
from feltmill.operators import training as M
from feltmill.operators.splits import stratified_fraction, stratified_two_way
from feltmill.plans.catalog import training as P
from feltmill.registry import REGISTRY

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_decks_are_shuffled_once_for_the_class_expansion(spark):
    assert "sha2" not in optimized(REGISTRY["hand_class_expansion"].run(spark, SF))


def test_drawn_rows_are_not_broadcast(spark):
    df = REGISTRY["resample_jitter_ratios"].run(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [label" in line and "rank" in line.split("],")[0]]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_cards_of_aligned_rows_are_dealt_once(spark):
    assert "sha2" not in optimized(REGISTRY["aligned_export_equity"].run(spark, SF))


def longest_method(df):
    found = df._jdf.queryExecution().debug().codegenToSeq()
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def test_hands_are_ranked_in_code_that_the_jvm_compiles(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert longest_method(REGISTRY["flop_equity"].run(spark, SF)) < 8000
        assert longest_method(REGISTRY["turn_equity"].run(spark, SF)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boards_are_dealt_once_for_all_relabelings(spark):
    plan = optimized(REGISTRY["canonical_board_set"].run(spark, SF))
    relabelings = [line for line in plan.split("\n") if "array_min" in line]
    assert relabelings and all("instr(" not in line.split("array_min", 1)[1] for line in relabelings), relabelings


def test_snapshot_cards_are_read_once(spark):
    for name in ("snapshot_semantic_errors", "strict_training_rows"):
        assert optimized(REGISTRY[name].run(spark, SF)).count("regexp_replace") <= 2, name


def test_padded_profiles_leave_other_features_out(spark):
    assert "arrays_overlap" not in optimized(REGISTRY["padded_opponent_profiles"].run(spark, SF))


def test_json_is_parsed_once(spark):
    plan = optimized(REGISTRY["json_schema_inference"].run(spark, SF)).lower().replace("_", "")
    assert "parsejson" not in plan


def test_few_bytes_of_heavy_rows_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    for name, branches in (("generated_board_profiles", 5), ("range_token_errors", 1)):
        assert REGISTRY[name].run(spark, SF).rdd.getNumPartitions() >= branches * cores, name


def test_decks_are_dealt_once_for_records_and_ledgers(spark):
    for name in ("portable_record_round_trip", "stage_ledger_counts"):
        assert "17:" not in optimized(REGISTRY[name].run(spark, SF)), name


def test_record_actions_are_read_once(spark):
    plan = optimized(REGISTRY["record_replay_decisions"].run(spark, SF))
    assert plan.count(R.PLAYER_ACTION) <= 2, plan.count(R.PLAYER_ACTION)


def test_record_actions_of_odd_texts(spark):
    texts = ["p1 cc", "p2  cbr  7.5 x", "p1 f", "p3 cbr", "p1 sm", "p1", "p1  ", " p1 cc", "x p1 cc", "d dh p2 AhKd", "d db 2c7dTh", "d dh p2", "d", "", None, "p1\tcc\n", "p2 cbr 1e3", "p2 cbr nan", "p2 cc 4"]
    hands = spark.createDataFrame([("h", texts, [1.0], [0.0], [9.0, 8.0, 7.0], ["a", "b", "c"])], "hand_id string, actions array<string>, blinds array<double>, antes array<double>, stacks array<double>, players array<string>")
    rows = {r["action_index"]: (r["kind"], r["code"], r["player"], r["amount"]) for r in R.record_actions(hands).collect()}
    assert [rows[i] for i in range(len(texts))] == [
        ("bet", "cc", 1, None), ("bet", "cbr", 2, 7.5), ("bet", "f", 1, None), ("bet", "cbr", 3, None), ("other", None, 1, None), ("other", None, None, None), ("other", None, 1, None),
        ("other", None, None, None), ("other", None, None, None), ("hole", None, 2, None), ("board", None, None, None), ("other", None, None, None), ("other", None, None, None),
        ("other", None, None, None), ("other", None, None, None), ("bet", "cc", 1, None), ("bet", "cbr", 2, 1000.0), ("bet", "cbr", 2, None), ("bet", "cc", 2, None),
    ]


def test_rows_are_not_shuffled_by_their_label(spark):
    rows = M.prepared(P.training_rows(spark, SF), P.MATRIX)
    assert optimized(stratified_two_way(rows, "_label", "_key")).count("strategy=broadcast") >= 3


def test_rows_are_not_multiplied_for_class_means(spark):
    plan = optimized(REGISTRY["class_mean_vectors"].run(spark, SF))
    assert 0 <= plan.index("posexplode") < plan.index("Aggregate"), plan


def test_means_of_columns_are_those_of_vectors(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None), ("b", None, 4.0), (None, 5.0, 6.0)], "k string, x double, y double")
    found, want = G.column_means(rows, ["k"], ["x", "y"]), G.class_means(rows.selectExpr("k", "array(x, y) AS v"), ["k"], "v")
    assert found.dtypes == want.dtypes and set(map(tuple, found.collect())) == set(map(tuple, want.collect()))


def test_split_in_place_is_the_split(spark):
    for texts in (["a", "a", "b", None, "b", "a", "", "a"] * 40, ["a"] * 9 + ["b"]):
        rows = spark.createDataFrame([(t, f"k{i // 2}" if i % 7 else None, i) for i, t in enumerate(texts)], "label string, key string, n int")
        found, want = (stratified_two_way(rows, "label", "key", 3, in_place=x) for x in (True, False))
        assert sorted(found.columns) == sorted(want.columns)

        def counted(df):
            return sorted(map(tuple, df.groupBy("label", "key", "split", "split_warning").count().na.fill("?").collect()))

        assert counted(found) == counted(want)


def test_rows_split_in_place_are_not_shuffled(spark):
    rows = M.prepared(P.training_rows(spark, SF), P.MATRIX)
    plan = stratified_two_way(rows, "_label", "_key", in_place=True)
    lines = optimized(plan).split("\n")
    ranked = [i for i, line in enumerate(lines) if "Window [row_number" in line and "_range" in line]
    assert len(ranked) == 1 and any("Filter" in line and "_left" in line for line in lines[ranked[0] :])


def test_share_in_place_is_the_share(spark):
    rows = spark.createDataFrame([("abc"[i % 3] if i % 11 else None, f"k{i // 2}") for i in range(500)], "label string, key string")
    found, want = (sorted(map(tuple, stratified_fraction(rows, "label", "key", 0.3, 5, x).na.fill("?").collect())) for x in (True, False))
    assert found == want and len(found) > 100


def test_variants_share_a_split_and_leave_nothing_behind(spark, monkeypatch):
    calls, split = [], M._by_split
    monkeypatch.setattr(M, "_by_split", lambda rows: calls.append(rows.columns) or split(rows))
    before = len(session._OWN)
    rows = REGISTRY["feature_ablation"].run(spark, SF).collect()
    assert [r["name"] for r in rows] == ["full_current", "without_price", "solver_candidate_only", "nobody_only", "no_columns"]
    assert len(calls) == 2 and all("_key" not in c for c in calls) and len(session._OWN) == before
