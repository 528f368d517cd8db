"""Source rows to the shared schemas: prompts, scenarios, feature frames, keys and stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions import text as X
from ..functions.values import first_text, ratio, strip, to_double, to_double_or_zero
from ..schemas import MODEL_CATEGORICAL, MODEL_COLUMNS, MODEL_NUMERIC, NORMALIZED, NORMALIZED_COLUMNS, check_matrix


def col(name: str) -> Column:
    """A column whose name holds dots."""
    return F.col(f"`{name}`")


def normalized_frame(df: DataFrame) -> DataFrame:
    """Exactly the normalized columns in order; missing ones are null."""
    have = set(df.columns)
    return df.select(
        *[(col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in NORMALIZED.fields]
    )


def empty_normalized(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NORMALIZED)


def usable_rows(df: DataFrame, label: str = "label_3intent") -> DataFrame:
    return df.filter(F.length(F.col(label).cast("string")) > 0)


def prompt_rows(
    df: DataFrame, source_dataset: str, license_text: str, url: str, config: str | None = None, from_metadata: bool = True
) -> DataFrame:
    """Prompt records to normalized columns plus the record they came from.

    With `from_metadata` the metadata map wins over the columns and the prompt gives expected value
    and equity; without it the explicit `pot` and `bet_amount` columns win over the text.
    """
    prompt = first_text(F.col("prompt"), F.col("instruction"))
    answers = ("response", "output", "chosen", "action") if from_metadata else ("response", "output", "action")
    staged = df.withColumns(
        {
            "_prompt": prompt,
            "_raw": first_text(*[F.col(c) for c in answers]),
            "_split": F.coalesce(F.nullif("_source_split", F.lit("")), F.lit("train")),
        }
    )
    staged = staged.withColumn("_clean", X.clean_action(F.col("_raw")))

    def meta(key: str, otherwise: Column) -> Column:
        if not from_metadata:
            return otherwise
        return F.coalesce(F.nullif(F.try_element_at(F.col("metadata"), F.lit(key)), F.lit("")), otherwise)

    p = F.col("_prompt")
    four = X.action_class(F.col("_clean"))
    staged = staged.withColumns(
        {"_four": four, "_position": meta("to_act", F.coalesce(F.nullif("position", F.lit("")), X.prompt_position(p)))}
    )
    row_id = F.concat_ws(":", *([F.lit(config)] if config else []), F.col("_split"), F.col("_source_row_idx").cast("string"))
    pot = X.prompt_number(p, X.POT_FIELD)
    size = X.bet_size(F.col("_clean"))
    columns = {
        "source_dataset": F.lit(source_dataset),
        "source_row_id": row_id,
        "source_split": F.col("_split"),
        "hand_id": F.col("hand_id"),
        "street": F.upper(meta("street", F.coalesce(F.nullif("street", F.lit("")), X.prompt_street(p)))),
        "hero_position": F.col("_position"),
        "villain_position": X.heads_up_villain(F.col("_position")),
        "hero_cards": meta("hero_hand", F.col("hole_cards")),
        "board_cards": meta("board", F.col("board")),
        "pot_size": pot if from_metadata else F.coalesce(F.col("pot"), pot),
        "effective_stack": X.prompt_number(p, X.STACK_FIELD),
        "action_history": X.prompt_history(p),
        "legal_actions": X.prompt_legal(p),
        "raw_action": F.col("_raw"),
        "normalized_action_4class": F.col("_four"),
        "label_3intent": X.intent_of(F.col("_four")),
        "bet_size": size if from_metadata else F.coalesce(F.col("bet_amount"), size),
        "ev": X.prompt_number(p, X.EV_FIELD) if from_metadata else F.lit(None).cast("double"),
        "equity": X.prompt_number(p, X.EQUITY_FIELD) if from_metadata else F.lit(None).cast("double"),
        "source_license": F.lit(license_text),
        "source_url": F.lit(url),
        "leakage_risk_notes": F.lit("prompt and answer texts are audit-only"),
    }
    return staged.select(
        *[columns[c].alias(c) for c in NORMALIZED_COLUMNS], F.struct(*[F.col(c) for c in df.columns]).alias("record")
    )


def audit_rows(df: DataFrame) -> DataFrame:
    """Normalized columns plus the raw texts of the record, for the audit table only."""
    names = df.schema["record"].dataType.names

    def raw(name: str) -> Column:
        return F.col(f"record.{name}") if name in names else F.lit(None).cast("string")

    return df.select(
        *NORMALIZED_COLUMNS,
        *[raw(n).alias(f"raw_{n}") for n in ("prompt", "instruction", "response", "output", "chosen", "rejected")],
        F.to_json(raw("metadata")).alias("raw_metadata_json") if "metadata" in names else F.lit(None).cast("string").alias("raw_metadata_json"),
        F.to_json("record").alias("raw_record_json"),
    )


def feature_frame(df: DataFrame, with_history: bool = True) -> DataFrame:
    """Normalized rows to the 20 model columns and their key columns.

    Amounts are in hundredths. `with_history=False` is the shorter form used when no feature file
    exists: no price, no history counts, and ratios stay null without a pot.
    """
    amount = to_double_or_zero if with_history else to_double
    # What several features share is computed in its own projection first.
    staged = df.withColumns(
        {
            "_pot": amount(F.col("pot_size"), "number"),
            "_stack": amount(F.col("effective_stack"), "number"),
            "_price": X.price_from_legal(F.col("legal_actions")) if with_history else F.lit(0.0),
            "_legal": F.lower(F.coalesce(F.col("legal_actions"), F.lit(""))),
            "_history": F.lower(F.coalesce(F.col("action_history"), F.lit(""))),
        }
    )
    words = X.history_word_counts(F.col("_history")) if with_history else {k: F.lit(0) for k in X.HISTORY_WORDS}
    staged = staged.withColumns({f"_n_{k}": v for k, v in words.items()})
    pot, stack, price, legal = (F.col(c) for c in ("_pot", "_stack", "_price", "_legal"))
    counts = {k: F.col(f"_n_{k}") for k in words}
    total = counts["check"] + counts["call"] + counts["fold"] + counts["bet_raise"]

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    raised = legal.contains("bet") | legal.contains("raise") | legal.contains("all-in") | legal.contains("allin")
    stack_ratio = ratio(stack, pot, otherwise=0.0) if with_history else F.try_divide(stack, pot)
    card_pattern = "(?i)[2-9TJQKA][cdhs]" if with_history else "[2-9TJQKA][cdhs]"
    values = {
        "features.pot_bb": pot / 100.0,
        "features.to_call_bb": price / 100.0,
        "features.hero_stack_bb": stack / 100.0,
        "features.effective_stack_bb": stack / 100.0,
        "features.stack_to_pot_ratio": stack_ratio,
        "features.to_call_pot_ratio": ratio(price, pot, otherwise=0.0) if with_history else F.lit(0.0),
        "features.has_check": flag(legal.contains("check")),
        "features.has_fold": flag(legal.contains("fold")),
        "features.has_call": flag(legal.contains("call")),
        "features.has_raise": flag(raised),
        "features.num_players": F.lit(2.0),
        "features.num_bets": counts["bet_raise"].cast("double"),
        "features.board_card_count": F.regexp_count(F.coalesce(F.col("board_cards"), F.lit("")), F.lit(card_pattern)).cast("double"),
        "features.action_count": total.cast("double"),
        "features.prior_check_count": counts["check"].cast("double"),
        "features.prior_call_count": counts["call"].cast("double"),
        "features.prior_bet_raise_count": counts["bet_raise"].cast("double"),
        "features.prior_fold_count": counts["fold"].cast("double"),
        "metadata.street": F.upper(F.coalesce(F.nullif("street", F.lit("")), F.lit("UNKNOWN"))),
        "features.hero_position": F.upper(F.coalesce(F.nullif("hero_position", F.lit("")), F.lit("UNKNOWN"))),
    }
    return staged.select(*[values[c].alias(c) for c in MODEL_COLUMNS], "label_3intent", "source_dataset", "source_row_id")


def scenario_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled scenario rows to (model candidates with audit columns, unmapped labels with counts)."""
    have = set(df.columns)

    def c(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in have else F.lit(None).cast("string")

    labelled = df.withColumn("_label", X.oracle_label(F.col("correct_decision")))
    mapped = F.col("_label").isin(*X.FOUR_CLASSES)
    unmapped = (
        labelled.filter(~mapped).groupBy(F.coalesce("correct_decision", F.lit("")).alias("output")).agg(F.count(F.lit(1)).alias("rows"))
    )
    staged = labelled.filter(mapped).withColumns(
        {
            "_moves": X.legal_moves(F.col("available_moves")),
            "_history": F.coalesce(c("prev_line"), c("postflop_action"), F.lit("")),
            "_pot": to_double_or_zero(F.col("pot_size")),
            "_preflop": F.coalesce(F.col("source_file").startswith("preflop"), F.lit(False)),
        }
    )
    boards = [F.when(F.lower(c(n)) != "nan", c(n)) for n in ("board_flop", "board_turn", "board_river")]
    counts = X.history_part_counts(F.col("_history"))
    price = X.price_from_history(X.has_move(F.col("_moves"), "CALL"), F.col("_history"))
    staged = staged.withColumns({"_price": price, **{f"_n_{k}": v for k, v in counts.items()}})
    n = {k: F.col(f"_n_{k}") for k in counts}
    pot, players = F.col("_pot"), to_double_or_zero(c("num_players"))

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    values = {
        "features.pot_bb": pot,
        "features.to_call_bb": F.col("_price"),
        "features.hero_stack_bb": F.lit(100.0),
        "features.effective_stack_bb": F.lit(100.0),
        "features.stack_to_pot_ratio": ratio(F.lit(100.0), pot, otherwise=0.0),
        "features.to_call_pot_ratio": ratio(F.col("_price"), pot, otherwise=0.0),
        "features.has_check": flag(X.has_move(F.col("_moves"), "CHECK")),
        "features.has_fold": flag(X.has_move(F.col("_moves"), "FOLD")),
        "features.has_call": flag(X.has_move(F.col("_moves"), "CALL")),
        "features.has_raise": flag(X.has_raise_move(F.col("_moves"))),
        "features.num_players": F.when(players == 0, 6.0).otherwise(players),
        "features.num_bets": to_double_or_zero(c("num_bets")),
        "features.board_card_count": sum((F.size(C.split_cards(b)) for b in boards), F.lit(0)).cast("double"),
        "features.action_count": (n["check"] + n["call"] + n["fold"] + n["bet_raise"]).cast("double"),
        "features.prior_check_count": n["check"].cast("double"),
        "features.prior_call_count": n["call"].cast("double"),
        "features.prior_bet_raise_count": n["bet_raise"].cast("double"),
        "features.prior_fold_count": n["fold"].cast("double"),
        "metadata.street": F.when(F.col("_preflop"), "PREFLOP").otherwise(F.upper(F.coalesce(c("evaluation_at"), F.lit("UNKNOWN")))),
        "features.hero_position": F.upper(F.coalesce(c("hero_pos"), c("hero_position"), F.lit("UNKNOWN"))),
    }
    candidates = staged.select(
        F.concat(F.lit("scenario:"), F.col("source_file"), F.lit(":"), F.col("row_index").cast("string")).alias("snapshot_id"),
        F.col("_label").alias("bootstrap_label"),
        *[values[name].alias(name) for name in MODEL_COLUMNS],
        F.lit("scenario_oracle").alias("metadata.label_source"),
        F.col("source_file").alias("audit.source_file"),
        F.col("row_index").cast("string").alias("audit.row_id"),
        F.col("correct_decision").alias("audit.correct_decision_raw"),
        F.col("available_moves").cast("string").alias("audit.available_moves_raw"),
        F.coalesce(c("prev_line"), c("preflop_action")).alias("audit.preflop_action_raw"),
        c("postflop_action").alias("audit.postflop_action_raw"),
        F.coalesce(c("hero_holding"), c("holding")).alias("audit.hero_holding"),
        *[c(name).alias(f"audit.{name}") for name in ("board_flop", "board_turn", "board_river")],
    )
    return candidates, unmapped


def relabel_intents(df: DataFrame, label: str = "bootstrap_label") -> DataFrame:
    """Four classes to three intents; the old label stays beside it and unmapped rows go."""
    intent = X.intent_of(F.upper(F.col(label)))
    out = df.withColumn("audit.original_label", F.col(label)).withColumn(label, F.coalesce(intent, F.upper(F.col(label))))
    return out.filter(F.col(label).isin(*X.INTENTS))


def coerce_features(df: DataFrame, numeric: Sequence[str] = MODEL_NUMERIC, categorical: Sequence[str] = MODEL_CATEGORICAL, zero: bool = False) -> DataFrame:
    """Numbers by safe cast (null, or 0.0 with `zero`), categories upper-cased with UNKNOWN; absent columns appear."""
    have = set(df.columns)
    number = to_double_or_zero if zero else to_double
    changes = {c: number(col(c)) if c in have else F.lit(0.0 if zero else None).cast("double") for c in numeric}
    changes.update(
        {c: F.upper(F.coalesce(col(c).cast("string"), F.lit("UNKNOWN"))) if c in have else F.lit("UNKNOWN") for c in categorical}
    )
    return df.withColumns(changes)


def stage_group(street: Column, board_count: Column) -> Column:
    """PREFLOP or POSTFLOP by street, else by the number of board cards, else UNKNOWN."""
    up = F.upper(F.coalesce(street, F.lit("")))
    return (
        F.when(up == "PREFLOP", "PREFLOP")
        .when(up.isin("FLOP", "TURN", "RIVER"), "POSTFLOP")
        .when(board_count == 0, "PREFLOP")
        .when(board_count >= 3, "POSTFLOP")
        .otherwise("UNKNOWN")
    )


def split_unit(source: Column, hand_id: Column, row_id: Column) -> Column:
    src = F.coalesce(F.nullif(source, F.lit("")), F.lit("UNKNOWN"))
    hand = F.when(F.length(strip(hand_id.cast("string"))) > 0, hand_id.cast("string"))
    return F.when(hand.isNotNull(), F.concat(src, F.lit(":hand:"), hand)).otherwise(
        F.concat(src, F.lit(":row:"), F.coalesce(row_id.cast("string"), F.lit("None")))
    )


def source_snapshot(generation: Column, job_id: Column, explicit: Column, snapshot: Column) -> Column:
    """Origin of a row: the job of a generated one, the recorded source, else the id before ':aug:'."""
    return F.coalesce(
        F.when((generation == "solver_generated") & (F.length(job_id) > 0), job_id),
        F.nullif(explicit, F.lit("")),
        F.substring_index(F.coalesce(snapshot, F.lit("")), ":aug:", 1),
    )


def aligned_columns(df: DataFrame, reference: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """Reference columns first, then the fixed ones not among them; absent columns are ''."""
    wanted = list(dict.fromkeys([*reference, *fixed]))
    have = set(df.columns)
    return df.select(*[(F.coalesce(col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in wanted])


def flatten_one_level(df: DataFrame) -> DataFrame:
    """Struct columns become 'struct.field' columns."""
    out = []
    for field in df.schema.fields:
        if field.dataType.typeName() == "struct":
            out += [F.col(f"`{field.name}`.`{sub.name}`").alias(f"{field.name}.{sub.name}") for sub in field.dataType.fields]
        else:
            out.append(col(field.name))
    return df.select(*out)


def matrix(df: DataFrame, columns: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """The model matrix; refuses leakage columns by name before anything is read."""
    check_matrix(list(columns))
    return df.select(*[col(c) for c in columns])


def attach_profiles(df: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Attach source attributes and mark what may train a supervised model: behavioral sources may not.

    The profile table has one row per source name; the optimizer broadcasts it by its size.
    """
    behavioral = F.col("source_type").rlike("behavioral|demonstration|case_study|competition|scaffold")
    return df.join(profiles, key, "left").withColumn("supervised", ~F.coalesce(behavioral, F.lit(True)))


# Where a row may state its big blind, and what is noted about it.
BLIND_COLUMNS = ("features.big_blind", "big_blind", "bb", "metadata.big_blind")
BLIND_STATED, BLIND_INFERRED = "explicit_big_blind_available", "big_blind_missing_or_inferred"
AMOUNTS = ("features.pot", "features.to_call", "features.hero_stack", "features.effective_stack", "features.call_max", "features.ev")


def to_big_blinds(df: DataFrame, amounts: Sequence[str] = AMOUNTS, candidates: Sequence[str] = BLIND_COLUMNS) -> DataFrame:
    """Divide the amounts by the first positive big-blind column of the row, else by 1.0 with a warning."""
    have = [c for c in candidates if c in df.columns]
    stated = [F.when(to_double(col(c)) > 0, F.struct(to_double(col(c)).alias("v"), F.lit(c).alias("c"))) for c in have]
    nothing = F.lit(None).cast("struct<v:double,c:string>")
    staged = df.withColumn("_blind", F.coalesce(*stated, nothing))
    staged = staged.withColumns(
        {
            "features.big_blind": F.coalesce(F.col("_blind.v"), F.lit(1.0)),
            "big_blind_missing_or_inferred": F.when(F.col("_blind").isNull(), BLIND_INFERRED).otherwise(BLIND_STATED),
            "audit.big_blind_inference_rule": F.coalesce(F.concat(F.lit("read:"), F.col("_blind.c")), F.lit("inferred:unit_is_big_blind")),
        }
    ).drop("_blind")
    return staged.withColumns({f"{a}_bb": F.try_divide(to_double(col(a)), col("features.big_blind")) for a in amounts if a in df.columns})
