"""Decision snapshots: derived features, validation, strict rows, live candidates and the aligned export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cards as C
from ..functions import poker as P
from ..functions.keys import padded
from ..functions.rules import all_reasons, is_false, is_true
from ..functions.text import button_amount, live_label
from ..functions.values import cap, clamp, flag_to_double, half_even, let, ratio, short_number, to_double, to_flag, to_int
from . import equity as E

# Trainable actions and the buttons that allow them.
ACTIONS = ("CHECK", "FOLD", "CALL", "RAISE")
ALLOWED_BUTTONS = {
    "FOLD": ("fold", "couche"),
    "CHECK": ("check",),
    "CALL": ("paie", "call"),
    "RAISE": ("relance", "raise", "mise", "bet", "all-in", "all in"),
}
# Feature keys a snapshot must not carry.
PROHIBITED = (
    "action_history", "debug", "final_result", "hand_result", "hidden_cards", "labels", "opponent_cards",
    "raw_solver", "reads", "solver_action", "solver_ev", "solver_raw", "villain_cards",
)


def rebuilt_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Add a `rebuilt` struct: ratios, button flags, opponent profiles and hand strength from a features struct."""
    f = F.col(features)
    pot, price, equity = f["pot"], f["to_call"], f["equity_table"]
    hole = F.filter(F.transform(F.coalesce(f["hero_cards"], F.array().cast("array<string>")), C.parse_card), lambda c: c.isNotNull())
    strength = let(hole, lambda h: F.when(F.size(h) == 2, C.hand_strength(F.get(h, F.lit(0)), F.get(h, F.lit(1)))))
    return df.withColumn(
        "rebuilt",
        F.struct(
            ratio(price, pot).alias("to_call_pot_ratio"),
            P.equity_required(pot, price, None).alias("equity_required"),
            P.active_buttons(f["buttons"]).alias("buttons_active"),
            P.has_button(f["buttons"], P.CHECK_STATES).alias("has_check"),
            P.has_button(f["buttons"], P.CALL_STATES).alias("has_call"),
            P.has_button(f["buttons"], P.RAISE_STATES).alias("has_raise"),
            P.opponent_profiles(f["players"]).alias("opponent_profiles"),
            strength.alias("starting_hand_strength"),
            equity.alias("equity_table"),
            P.expected_value(equity, pot, price, None).alias("ev"),
            P.call_max(equity, pot, "inf", None).alias("call_max"),
        ),
    )


def trainable(legacy_first: bool = True) -> Column:
    """Rows that may train: right type, valid label, no known bug, usable, and a known action."""
    a, b = F.col("labels.legacy_action"), F.col("labels.final_action")
    action = F.upper(F.coalesce(F.nullif(a, F.lit("")), b) if legacy_first else F.coalesce(F.nullif(b, F.lit("")), a))
    return (
        F.col("type").eqNullSafe(F.lit("ml_decision_snapshot"))
        & F.coalesce(action.isin(*ACTIONS), F.lit(False))
        & is_true(F.col("labels.label_valid"))
        & is_false(F.col("labels.known_bug_risk"))
        & is_true(F.col("quality_flags.usable_for_training"))
    )


def live_trainable() -> Column:
    """The live rule: no action check, but the amount unit must not be missing."""
    return (
        F.col("type").eqNullSafe(F.lit("ml_decision_snapshot"))
        & is_true(F.col("labels.label_valid"))
        & is_false(F.col("labels.known_bug_risk"))
        & is_true(F.col("quality_flags.usable_for_training"))
        & ~is_true(F.col("quality_flags.amount_unit_missing"))
    )


def action_allowed(action: Column, active: Column) -> Column:
    """Whether one of the active button states allows the action; false for unknown actions."""
    lowered = F.transform(F.coalesce(active, F.array().cast("array<string>")), lambda s: F.lower(s))
    allowed = F.lit(False)
    for name, states in ALLOWED_BUTTONS.items():
        allowed = F.when(action == name, F.arrays_overlap(lowered, F.array(*[F.lit(s) for s in states]))).otherwise(allowed)
    return allowed


def _card_checks(df: DataFrame, hero: Column, board: Column) -> tuple[DataFrame, Column, Column, Column]:
    """(rows with the parsed cards as `_cards`, bad hero cards, bad board cards, duplicates). Every card is read once."""
    parsed = F.struct(*[F.transform(cards, C.parse_card).alias(name) for name, cards in (("h", hero), ("b", board))])
    h, b = F.col("_cards.h"), F.col("_cards.b")
    known = F.filter(F.concat(h, b), lambda c: c.isNotNull())
    bad_hero = (F.size(hero) != 2) | F.exists(h, lambda c: c.isNull())
    return df.withColumn("_cards", parsed), bad_hero, F.exists(b, lambda c: c.isNull()), F.size(F.array_distinct(known)) != F.size(known)


def semantic_errors(df: DataFrame, feature_keys: str | None = None) -> DataFrame:
    """Add `errors`: every broken rule of a snapshot row. `feature_keys` names an array of the keys present."""
    f, labels, flags = F.col("features"), F.col("labels"), F.col("quality_flags")
    empty = F.array().cast("array<string>")
    hero, board = F.coalesce(f["hero_cards"], empty), F.coalesce(f["board_cards"], empty)
    df, bad_hero, bad_board, duplicate = _card_checks(df, hero, board)
    street = F.upper(F.coalesce(F.col("metadata.street"), F.lit("")))
    need = F.lit(None).cast("int")
    for name, count in C.STREET_CARDS.items():
        need = F.when(street == name, count).otherwise(need)
    legacy, final = labels["legacy_action"], labels["final_action"]
    rules = [(~F.col("type").eqNullSafe(F.lit("ml_decision_snapshot")), "invalid_type")]
    if feature_keys is not None:
        bad = F.array_sort(F.array_intersect(F.col(feature_keys), F.array(*[F.lit(k) for k in PROHIBITED])))
        rules.append((F.size(bad) > 0, F.concat(F.lit("prohibited_features:"), F.array_join(bad, ","))))
    for action in (legacy, final):
        rules.append((action == "WAIT", "wait_action"))
        rules.append((F.coalesce(~action.isin(*ACTIONS), F.lit(True)), F.concat(F.lit("invalid_action:"), F.coalesce(action, F.lit("None")))))
    rules += [
        (~legacy.eqNullSafe(final), "action_label_mismatch"),
        (
            ~is_true(labels["label_valid"]) | ~is_false(labels["known_bug_risk"]) | ~is_true(flags["usable_for_training"]),
            "not_trainable",
        ),
        (bad_hero, "invalid_hero_cards"),
        (bad_board, "invalid_board_cards"),
        (duplicate, "duplicate_cards"),
        (need.isNull(), F.concat(F.lit("invalid_street:"), street)),
        (F.size(board) != need, F.concat(F.lit("board_street_mismatch:"), street)),
        (legacy.isin(*ACTIONS) & ~action_allowed(legacy, f["buttons_active"]), F.concat(F.lit("action_impossible:"), legacy)),
    ]
    return df.withColumn("errors", all_reasons(rules)).drop("_cards")


def structural_errors(df: DataFrame, raw: str, expected: dict[str, Sequence[str]]) -> DataFrame:
    """Add `structure_errors` for JSON text: missing, unknown and misordered keys per object path.

    `expected` maps a path ('' for the root) to its keys in order.
    """
    reasons: list[Column] = []
    for path, keys in expected.items():
        text = F.col(raw) if not path else F.get_json_object(raw, f"$.{path}")
        have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
        want = F.array(*[F.lit(k) for k in keys])
        missing, unknown = F.array_except(want, have), F.array_except(have, want)
        where = path or "<root>"
        reasons += [
            F.when(F.size(missing) > 0, F.concat(F.lit(f"{where} missing:"), F.array_join(missing, ","))),
            F.when(F.size(unknown) > 0, F.concat(F.lit(f"{where} unknown:"), F.array_join(unknown, ","))),
            F.when((F.size(missing) == 0) & (F.size(unknown) == 0) & (have != want), F.lit(f"{where} key_order_mismatch")),
        ]
    return df.withColumn("structure_errors", F.array_compact(F.array(*reasons)))


def type_errors(df: DataFrame, raw: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Add `type_errors` for JSON text: values whose type the example never shows; whole numbers pass for decimals.

    `allowed` maps a path to VARIANT type names ('BIGINT', 'DOUBLE', 'STRING', 'BOOLEAN', 'VOID', ...).
    """
    doc = F.try_parse_json(raw)
    reasons = []
    for path, names in allowed.items():
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant"))
        base = F.regexp_extract(kind, "^([A-Z]+)", 1)
        named = F.when(base.isin("DECIMAL", "DOUBLE", "FLOAT"), "DOUBLE").when(base.isin("OBJECT", "ARRAY"), base).otherwise(base)
        ok = named.isin(*names) | ((named == "BIGINT") & F.lit("DOUBLE" in names))
        reasons.append(F.when(kind.isNotNull() & ~ok, F.concat(F.lit(f"{path} bad_type:"), named)))
    return df.withColumn("type_errors", F.array_compact(F.array(*reasons)))


def threshold_decision(df: DataFrame) -> DataFrame:
    """Add `decision` (action, raise_amount, confidence, rule): bet, raise, call or fold by equity and price.

    A raise or call needs its button. Without table equity the heads-up one counts, else one half.
    """
    f = F.col("features")
    equity = F.coalesce(f["equity_table"], f["equity_1v1"], F.lit(0.5))
    pot, price = F.coalesce(f["pot"], F.lit(0.0)), F.coalesce(f["to_call"], F.lit(0.0))
    required = ratio(price, pot + price, otherwise=0.0)
    can_raise, can_call = action_allowed(F.lit("RAISE"), f["buttons_active"]), action_allowed(F.lit("CALL"), f["buttons_active"])

    def made(action: str, amount: Column, confidence: float, rule: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"), amount.cast("double").alias("raise_amount"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule")
        )

    none = F.lit(None)
    # The edges, stakes and confidences of the decisions.
    free = F.when((equity >= 0.62) & can_raise, made("BET", F.greatest(F.lit(1.0), half_even(pot * 0.5, 2)), 0.72, "value_bet")).otherwise(
        made("CHECK", none, 0.68, "free_check")
    )
    paid = (
        F.when((equity >= required + 0.24) & can_raise, made("RAISE", F.greatest(price * 2.0, half_even(pot * 0.6, 2)), 0.74, "raise_edge"))
        .when((equity >= required) & can_call, made("CALL", none, 0.67, "call_edge"))
        .otherwise(made("FOLD", none, 0.7, "below_required_equity"))
    )
    return df.withColumn("decision", F.when(price <= 0, free).otherwise(paid))


def strict_rows(df: DataFrame) -> DataFrame:
    """Add `label` and `reasons`: a training label, or every reason a spot with its decision is rejected."""
    f = F.col("features")
    empty = F.array().cast("array<string>")
    hero, board = F.coalesce(f["hero_cards"], empty), F.coalesce(f["board_cards"], empty)
    df, bad_hero, bad_board, duplicate = _card_checks(df, hero, board)
    street = F.upper(F.coalesce(F.col("metadata.street"), F.lit("")))
    need = F.lit(None).cast("int")
    for name, count in C.STREET_CARDS.items():
        need = F.when(street == name, count).otherwise(need)
    raw = F.upper(F.trim(F.coalesce(F.col("decision.action"), F.lit(""))))
    label = F.when(raw == "BET", "RAISE").when(raw.isin(*ACTIONS), raw)
    reasons = all_reasons(
        [
            (bad_hero, "invalid_hero_cards"),
            (need.isNull(), "invalid_street"),
            (F.size(board) != need, "board_street_mismatch"),
            (bad_board, "invalid_board_cards"),
            (duplicate, "duplicate_cards"),
            (F.coalesce((f["pot"] <= 0) | (f["to_call"] < 0), F.lit(True)), "invalid_pot_or_to_call"),
            (F.coalesce((f["player_active"] < 1) | (f["player_start"] < f["player_active"]), F.lit(True)), "invalid_player_counts"),
            (F.coalesce(F.length(f["hero_position"]), F.lit(0)) == 0, "missing_hero_position"),
            (F.coalesce(F.size(f["buttons_active"]), F.lit(0)) <= 0, "missing_buttons"),
            (label.isNull(), F.concat(F.lit("invalid_solver_action:"), F.coalesce(F.col("decision.action"), F.lit("None")))),
            (label.isNotNull() & ~action_allowed(label, f["buttons_active"]), F.concat(F.lit("action_impossible:"), label)),
            (raw == "WAIT", "wait_action_rejected"),
        ]
    )
    out = df.withColumn("reasons", reasons).drop("_cards")
    return out.withColumn("label", F.when(F.size("reasons") == 0, label))


def live_candidates(df: DataFrame, hero_name: str) -> DataFrame:
    """Live snapshots with a `rebuilt` struct to flat candidates in big blinds.

    The hero stack is that of the named player, else of the first active one; the effective stack is
    the smaller of it and the largest positive stack among the other active players.
    """
    f, r = F.col("features"), F.col("rebuilt")
    name = F.lit(hero_name.lower())
    players = f["players"]
    named = F.filter(players, lambda p: F.lower(F.coalesce(p["name"], F.lit(""))) == name)
    active = F.filter(players, lambda p: is_true(p["active"]))
    hero = F.coalesce(
        F.when(F.size(named) > 0, F.coalesce(F.get(named, F.lit(0))["stack_bb"], F.lit(0.0))),
        F.when(F.size(active) > 0, F.coalesce(F.get(active, F.lit(0))["stack_bb"], F.lit(0.0))),
        F.lit(0.0),
    )
    rivals = F.filter(active, lambda p: (F.lower(F.coalesce(p["name"], F.lit(""))) != name) & (p["stack_bb"] > 0))
    deepest = F.array_max(F.transform(rivals, lambda p: p["stack_bb"]))

    def zero(c: Column) -> Column:
        return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))

    merged = {c: F.coalesce(r[c], f[c]) for c in ("equity_table", "equity_required", "to_call_pot_ratio")}
    merged.update({c: F.coalesce(r[c], f[c]) for c in ("has_check", "has_call", "has_raise")})
    staged = df.withColumns({"_hero": hero, "_effective": F.when((hero > 0) & (deepest > 0), F.least(hero, deepest)).otherwise(hero)})
    label = live_label(F.coalesce(F.nullif("labels.final_action", F.lit("")), F.col("labels.legacy_action")))
    status = (
        F.when(f["equity_table"].isNotNull() & f["ev_bb"].isNotNull() & f["call_max_bb"].isNotNull(), "stored_equity_ev_callmax_used")
        .when(r["equity_table"].isNotNull(), "rebuilt_equity_features_used")
        .otherwise("deterministic_features_only")
    )
    columns = {
        "features.pot_bb": zero(f["pot_bb"]),
        "features.to_call_bb": zero(f["to_call_bb"]),
        "features.ev_bb": zero(f["ev_bb"]),
        "features.call_max_bb": cap(zero(f["call_max_bb"])),
        "features.equity_table": zero(merged["equity_table"]),
        "features.equity_1v1": zero(f["equity_1v1"]),
        "features.equity_required": zero(merged["equity_required"]),
        "features.equity_gap": zero(merged["equity_table"]) - zero(merged["equity_required"]),
        "features.hero_stack_bb": F.col("_hero"),
        "features.effective_stack_bb": F.col("_effective"),
        "features.stack_to_pot_ratio": ratio(F.col("_effective"), zero(f["pot_bb"]), otherwise=0.0),
        "features.to_call_pot_ratio": zero(merged["to_call_pot_ratio"]),
        **{f"features.{c}": flag_to_double(merged[c]) for c in ("has_check", "has_call", "has_raise")},
        "features.active_opponents": F.greatest(F.lit(0.0), zero(f["player_active"]) - 1.0),
        "features.hero_position": F.upper(F.coalesce(F.nullif(f["hero_position"], F.lit("")), F.lit("UNKNOWN"))),
    }
    return staged.select(
        "snapshot_id",
        label.alias("bootstrap_label"),
        F.upper(F.coalesce(F.nullif("metadata.street", F.lit("")), F.nullif(f["street"], F.lit("")), F.lit("UNKNOWN"))).alias("metadata.street"),
        F.coalesce(F.nullif("metadata.label_source", F.lit("")), F.lit("legacy")).alias("metadata.label_source"),
        *[c.alias(n) for n, c in columns.items()],
        status.alias("enrichment_status"),
        F.lit("real_imported").alias("generation_method"),
    )


def run_candidates(df: DataFrame) -> DataFrame:
    """Joined run rows (equity, amounts, action frequencies, dominant action) to generated candidates.

    Adds equity arithmetic and legal-action flags; all-in and unmapped actions get a `drop_reason`.
    """
    from ..functions.text import live_solver_action

    equity, pot, price, stack = F.col("equity"), F.col("pot"), F.col("to_call"), F.col("stack")
    required = ratio(price, pot + price, otherwise=0.0)
    legal = F.map_keys("action_frequencies")
    label = live_solver_action(F.col("dominant_action"))

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    return df.select(
        "*",
        label.alias("bootstrap_label"),
        F.when(label == "ALL_IN", "all_in_excluded").when(~label.isin(*ACTIONS), "unmapped_action").alias("drop_reason"),
        half_even(equity, 6).alias("features.equity_table"),
        half_even(required, 6).alias("features.equity_required"),
        half_even(equity - required, 6).alias("features.equity_gap"),
        half_even(P.expected_value(equity, pot, price, None), 6).alias("features.ev_bb"),
        cap(P.call_max(equity, pot, "cap", None)).alias("features.call_max_bb"),
        ratio(stack, pot, 6, 0.0).alias("features.stack_to_pot_ratio"),
        ratio(price, pot, 6, 0.0).alias("features.to_call_pot_ratio"),
        flag(F.array_contains(legal, "CHECK")).alias("features.has_check"),
        flag(F.array_contains(legal, "CALL") | F.array_contains(legal, "CHECK_CALL")).alias("features.has_call"),
        flag(F.exists(legal, lambda a: a.startswith("BET") | a.startswith("RAISE"))).alias("features.has_raise"),
        F.lit("solver_generated").alias("generation_method"),
    )


# Seats that act in and out of position.
IN_POSITION = ("IP", "BTN", "CO", "HJ", "LJ")
OUT_OF_POSITION = ("OOP", "SB", "BB", "UTG", "MP")


def solver_context(position: Column, to_call: Column, has_call: Column, attempt: Column) -> Column:
    """struct(position, context) of a run: facing a bet when there is a price, else check or bet out of position."""
    seat = F.upper(F.coalesce(F.nullif(position, F.lit("")), F.lit("UNKNOWN")))
    facing = F.coalesce((to_call > 0) | (has_call > 0), F.lit(False))
    side = F.when(seat.isin(*IN_POSITION), "IP").when(seat.isin(*OUT_OF_POSITION), "OOP").when(attempt % 2 != 0, "IP").otherwise("OOP")
    return F.struct(
        F.when(facing, side).otherwise("OOP").alias("position"), F.when(facing, "hero_facing_bet").otherwise("hero_check_or_bet").alias("context")
    )


# ---- the aligned export ----------------------------------------------------------------------

# Versions named by every exported row.
EXPORT_VERSIONS = {
    "decision_engine_version": "decision_engine_v2",
    "legacy_rules_version": "legacy_rules_v2",
    "decision_engine_fix_id": "bootstrap_dist_schema_alignment_v5",
    "decision_engine_fix_date": "2026-05-26",
    "git_commit": "",
}
BUTTON_TYPE = "array<struct<index:int,enabled:boolean,state:string,value:double,text:string,confidence:double>>"
PLAYER_TYPE = "array<struct<seat:int,state:string,active:boolean,active_at_start:boolean,stack:double,stack_start:double>>"
PROFILE_TYPE = "array<struct<action:string,looseness:double,aggression:double,confidence:double>>"


def _buttons(price: Column, raw_action: Column) -> Column:
    raised = F.coalesce(F.when(button_amount(raw_action) != 0, button_amount(raw_action)), F.lit(20.0))

    def button(index: int, state: str, value: Column, text: Column) -> Column:
        return F.struct(
            F.lit(index).alias("index"), F.lit(True).alias("enabled"), F.lit(state).alias("state"), value.cast("double").alias("value"), text.alias("text"),
            F.lit(None).cast("double").alias("confidence"),
        )

    fold = button(2, "fold", F.lit(0.0), F.lit("fold"))
    facing = F.array(
        button(0, "relance", raised, F.concat(F.lit("raise "), short_number(raised))), button(1, "paie", price, F.concat(F.lit("call "), short_number(price))), fold
    )
    free = F.array(button(0, "mise", raised, F.concat(F.lit("bet "), short_number(raised))), button(1, "check", F.lit(0.0), F.lit("check")), fold)
    return F.when(price > 0, facing).otherwise(free).cast(BUTTON_TYPE)


def aligned_rows(df: DataFrame) -> DataFrame:
    """Flat candidate rows to the dotted snapshot columns: defaults, buttons, players, profiles and the equity chain.

    Equity comes from `equity_1v1` where present, else from hero, villain and board cards (every different
    spot is computed once, see `with_matchup_equity`), else it is unknown and one half; table equity,
    expected value and largest call follow from it unless the row states them. `row_index` is the number
    of the row in its export.
    """
    have = set(df.columns)

    def c(name: str, kind: str = "string") -> Column:
        return F.col(f"`{name}`").cast(kind) if name in have else F.lit(None).cast(kind)

    def number(*names: str) -> Column:
        return F.coalesce(*[to_double(c(n)) for n in names])

    def cards(name: str) -> Column:
        parsed = F.from_json(c(name), "array<string>")
        return F.coalesce(parsed, F.array().cast("array<string>"))

    excluded = to_flag(c("excluded"))
    label = F.when(~excluded, F.nullif(c("bootstrap_label"), F.lit("")))
    staged = df.withColumns(
        {
            "_excluded": excluded,
            "_label": label,
            "_pot": number("pot"),
            "_call": F.coalesce(number("to_call"), F.lit(0.0)),
            "_stack": number("stack"),
            "_hero": cards("hero_cards"),
            "_villain": cards("villain_hand"),
            "_board": cards("board_cards"),
            "_start": F.coalesce(F.nullif(to_int(c("player_start")), F.lit(0).cast("bigint")), F.lit(2).cast("bigint")),
            "_active": F.coalesce(F.nullif(to_int(c("player_active")), F.lit(0).cast("bigint")), F.lit(2).cast("bigint")),
            "_e1": number("features.equity_1v1", "equity_1v1"),
        }
    )
    staged = E.with_matchup_equity(staged, "_hero", "_villain", "_board", F.col("_e1").isNull(), "_dealt")
    staged = staged.withColumn("_e1", F.coalesce("_e1", half_even(F.col("_dealt"), 10)))
    pot, price, stack, hero, board = F.col("_pot"), F.col("_call"), F.col("_stack"), F.col("_hero"), F.col("_board")
    rivals = F.greatest(F.lit(0), F.col("_active") - 1)
    staged = staged.withColumn("_one", F.coalesce(clamp(half_even(F.col("_e1"), 10), 0.0, 1.0), F.lit(0.5)))
    staged = staged.withColumn("_table", F.coalesce(number("features.equity_table", "equity_table"), P.multiway_equity(F.col("_one"), rivals)))
    one, table = F.col("_one"), F.col("_table")
    known_label = F.coalesce(F.length("_label") > 0, F.lit(False))
    position = F.coalesce(F.nullif(c("hero_position"), F.lit("")), F.nullif(c("position_model"), F.lit("")), F.lit("UNKNOWN"))
    reason = F.coalesce(F.nullif(c("weak_rule_reason"), F.lit("")), F.lit("bootstrap_solver_candidate"))
    source = F.coalesce(F.nullif(c("label_source"), F.lit("")), F.when(F.col("_excluded"), F.lit("bootstrap_excluded")).otherwise("bootstrap_unknown"))
    exclusion = F.coalesce(c("exclusion_reason"), F.lit(""))
    snapshot = F.coalesce(F.nullif(c("source_id"), F.lit("")), F.concat(F.lit("bootstrap_v5_"), padded(c("row_index"), 6)))
    total = F.greatest(F.lit(1), F.col("_start"))
    seats = F.transform(
        F.sequence(F.lit(1).cast("bigint"), total),
        lambda s: F.struct(
            s.cast("int").alias("seat"),
            F.when(s <= F.greatest(F.lit(1), F.least(total, F.col("_active"))), "paid").otherwise("fold").alias("state"),
            (s <= F.greatest(F.lit(1), F.least(total, F.col("_active")))).alias("active"), F.lit(True).alias("active_at_start"),
            F.coalesce(stack, F.lit(0.0)).alias("stack"), F.coalesce(stack, F.lit(0.0)).alias("stack_start"),
        ),
    )
    stored_players = F.from_json(F.coalesce(c("features.players"), c("players")), PLAYER_TYPE)
    stored_profiles = F.from_json(F.coalesce(c("features.opponent_profiles"), c("opponent_profiles")), PROFILE_TYPE)
    neutral = F.struct(F.lit("paid").alias("action"), F.lit(0.5).alias("looseness"), F.lit(0.5).alias("aggression"), F.lit(0.0).alias("confidence"))
    values: dict[str, Column] = {
        "schema_version": F.lit("ml_dataset_v1"), "type": F.lit("ml_decision_snapshot"), "snapshot_id": snapshot, "recorded_at": F.lit(""),
        "metadata.game": F.lit("bootstrap_solver"), "metadata.hand_id": c("row_index", "bigint"), "metadata.scan_count": F.lit(1),
        "metadata.street": F.upper(F.coalesce(F.nullif(c("street"), F.lit("")), F.lit("UNKNOWN"))),
        "metadata.status": F.when(F.col("_excluded"), "excluded").otherwise("ok"), "metadata.decision_mode": F.lit("bootstrap"), "metadata.label_source": source,
        "metadata.new_party_state": F.lit(False), **{f"metadata.{n}": F.lit(v) for n, v in EXPORT_VERSIONS.items()},
        "features.hero_cards": hero, "features.board_cards": board, "features.board_card_count": F.size(F.filter(board, lambda x: F.length(x) > 0)),
        "features.hero_position": position, "features.player_start": F.col("_start"), "features.player_active": F.col("_active"), "features.active_opponents": rivals,
        "features.hero_stack": stack, "features.effective_stack": stack, "features.stack_to_pot_ratio": P.pot_ratio(stack, pot),
        "features.pot": pot, "features.to_call": price, "features.to_call_pot_ratio": P.pot_ratio(price, pot),
        "features.buttons": _buttons(price, c("raw_action")), "features.has_check": price <= 0, "features.has_call": price > 0, "features.has_raise": F.lit(True),
        "features.players": F.when(F.size(stored_players) > 0, stored_players).otherwise(seats.cast(PLAYER_TYPE)),
        "features.opponent_profiles": F.when(F.size(stored_profiles) > 0, stored_profiles).otherwise(F.array_repeat(neutral, rivals.cast("int")).cast(PROFILE_TYPE)),
        "features.equity_table": table, "features.equity_1v1": one, "features.equity_known": F.col("_e1").isNotNull(),
        "features.equity_required": P.equity_required(pot, price),
        "features.ev": F.coalesce(number("features.ev", "ev"), P.expected_value(table, pot, price)),
        "features.call_max": F.coalesce(number("features.call_max", "call_max"), P.call_max(table, pot)),
        "labels.legacy_action": F.col("_label"), "labels.legacy_reason": F.when(known_label, reason).otherwise(""), "labels.final_action": F.col("_label"),
        **{f"labels.{n}": F.lit("") for n in ("legacy_raise_amount", "ml_action", "ml_confidence", "fallback_reason")},
        **{f"confidence.{n}": F.lit("") for n in ("hero_cards_min", "board_cards_min", "pot_ocr", "to_call_ocr", "buttons_min", "hero_position", "player_count")},
        "labels.label_valid": known_label, "labels.label_exclusion_reason": exclusion, "labels.known_bug_risk": F.lit(False),
        "quality_flags.hero_cards_uncertain": F.size(hero) == 0, "quality_flags.board_uncertain": F.size(board) == 0,
        "quality_flags.opponent_count_uncertain": F.lit(True), "quality_flags.pot_to_call_incoherent": F.coalesce((pot < 0) | (price < 0), F.lit(True)),
        "quality_flags.buttons_incoherent": F.lit(False), "quality_flags.street_transient": F.lit(False),
        "quality_flags.hero_position_low_confidence": position == "UNKNOWN", "quality_flags.usable_for_training": known_label & ~F.col("_excluded"),
        "debug.decision_reason": F.when(known_label, reason).otherwise(exclusion), "debug.scan_status": F.when(F.col("_excluded"), "excluded").otherwise("ok"),
        "bootstrap_label": F.col("_label"), "excluded": F.col("_excluded"), "exclusion_reason": exclusion,
        "audit.source_id": snapshot, "audit.label_source": source,
        **{f"audit.{n}": F.coalesce(c(n), F.lit("")) for n in ("label_quality", "weak_rule_reason", "dominant_action", "raw_action", "normalized_action", "candidate_confidence")},
        "audit.dominant_action_frequency": number("dominant_action_frequency"), "audit.iterations": to_int(c("iterations")),
        "audit.exploitability_last": number("exploitability_last"),
        "audit.action_frequencies": F.coalesce(F.from_json(c("action_frequencies"), "map<string,double>"), F.create_map().cast("map<string,double>")),
    }
    return staged.select(*[v.alias(n) for n, v in values.items()]).withColumn(
        "features.buttons_active", F.transform(F.col("`features.buttons`"), lambda b: b["state"])
    )


def feature_views(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Bootstrap features through alias lookup and derived views, as text columns become numbers.

    Derived: opponents from active players, cards-known flag, equity gap, stack-to-pot ratio and the
    averages of the opponent profiles.
    """
    have = set(df.columns)

    def raw(feature: str) -> Column:
        for name in (feature, *aliases.get(feature, ())):
            if name in have:
                return F.col(f"`{name}`")
        return F.lit(None).cast("string")

    def number(feature: str) -> Column:
        return to_double(raw(feature), "blank", bool_words=True)

    hero = raw("features.hero_cards") if "features.hero_cards" in have else raw("hero_cards")
    equity = F.coalesce(number("features.equity_table"), number("features.equity_1v1"))
    stack = F.coalesce(number("features.effective_stack"), number("features.hero_stack"), number("stack"))
    named = [n for n in ("features.opponent_profiles", "opponent_profiles") if n in have]
    typed = [F.col(f"`{n}`") if df.schema[n].dataType.typeName() == "array" else F.from_json(F.col(f"`{n}`"), PROFILE_TYPE) for n in named]
    profiles = F.coalesce(*typed, F.lit(None).cast(PROFILE_TYPE))

    def mean(metric: str) -> Column:
        listed = F.filter(F.transform(profiles, lambda p: p[metric]), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x), F.size(listed))

    null_hero = hero.isNull() | F.lower(F.trim(hero.cast("string"))).isin("", "null", "none", "[]")
    derived = {
        "features.active_opponents": F.when(
            number("features.player_active").isNotNull(), F.greatest(F.lit(0.0), number("features.player_active") - 1.0)
        ),
        "features.hero_cards_known": F.when(null_hero, 0.0).otherwise(1.0),
        "features.equity_gap": P.equity_gap(equity, number("features.equity_required")),
        "features.stack_to_pot_ratio": ratio(stack, number("features.pot")),
        **{f"features.opponent_{m}_avg": mean(m) for m in ("looseness", "aggression", "confidence")},
    }
    from ..schemas import BOOTSTRAP_CATEGORICAL, BOOTSTRAP_NUMERIC

    changes = {n: F.coalesce(derived[n], number(n)) if n in derived else number(n) for n in BOOTSTRAP_NUMERIC}
    changes.update({n: F.coalesce(F.nullif(F.trim(raw(n).cast("string")), F.lit("")), F.lit("UNKNOWN")) for n in BOOTSTRAP_CATEGORICAL})
    return df.withColumns(changes)


def input_check(df: DataFrame, required: Sequence[str], categories: dict[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Add `input_errors` (required fields without a value) and `input_warnings` (unknown categories, absent optional fields)."""
    have = set(df.columns)

    def empty(name: str) -> Column:
        return F.lit(True) if name not in have else F.coalesce(F.trim(F.col(f"`{name}`").cast("string")) == "", F.lit(True))

    errors = [F.when(empty(n), F.lit(f"missing_field:{n}")) for n in required]
    warnings = [
        F.when(~empty(n) & ~F.col(f"`{n}`").cast("string").isin(*values), F.concat(F.lit(f"unknown_category:{n}:"), F.col(f"`{n}`").cast("string")))
        for n, values in categories.items()
        if n in have
    ] + [F.when(empty(n), F.lit(f"optional_numeric_field_missing:{n}")) for n in optional]
    nothing = F.array().cast("array<string>")
    return df.withColumns(
        {
            "input_errors": F.array_compact(F.array(*errors)) if errors else nothing,
            "input_warnings": F.array_compact(F.array(*warnings)) if warnings else nothing,
        }
    )
