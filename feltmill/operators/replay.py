"""Ordered replay of betting: hand records with windows, text histories inside their own row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions.rules import first_reason
from ..functions.text import hand_record_amount, intent_of
from ..functions.values import let, short_number, strip
from ..session import stored
from .ranks import running

STREETS = ("PREFLOP", "FLOP", "TURN", "RIVER")

# Fixed patterns: actions of a hand record.
HOLE_DEAL = r"^d\s+dh\s+p([0-9]+)\s+(\S+)"
BOARD_DEAL = r"^d\s+db\s+(\S+)"
PLAYER_ACTION = r"^p([0-9]+)\s+(.+)$"


# ---- hand records ---------------------------------------------------------------------------


def record_actions(hands: DataFrame, keys: Sequence[str] = ("hand_id",)) -> DataFrame:
    """Hand-record rows (arrays) to one typed row per action.

    `hands` holds `actions`, `blinds`, `antes`, `stacks` and `players` arrays. Amounts below zero
    count as nothing in the starting pot; missing entries are zero.
    """

    def positive_sum(name: str) -> Column:
        return F.aggregate(
            F.slice(F.coalesce(F.col(name), F.array().cast("array<double>")), 1, F.greatest(F.col("player_count"), F.lit(1))),
            F.lit(0.0),
            lambda acc, x: acc + F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0))),
        )

    def entries(name: str) -> Column:
        return F.coalesce(F.array_size(F.col(name)), F.lit(0))

    # Hands move once, before they are cut into actions; the windows of the replay find them in place.
    parts = int(hands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = hands.repartition(parts, *keys).withColumn("player_count", F.when(entries("stacks") > 0, entries("stacks")).otherwise(entries("players")))
    sized = sized.filter("player_count > 0").withColumns(
        {
            "start_pot": positive_sum("blinds") + positive_sum("antes"),
            "max_blind": F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.slice("blinds", 1, F.col("player_count"))).cast("double"), F.lit(0.0))),
        }
    )
    extra = [c for c in sized.columns if c not in ("actions", "players", "antes", *keys)]
    # Actions are read inside the row of their hand: what the explode gives out is not computed again by later steps.
    rows = sized.select(*keys, *extra, F.posexplode(F.transform("actions", _read_action)).alias("action_index", "_read"))
    rows = rows.select(*keys, *extra, "action_index", "_read.*")
    at = F.col("player")
    return rows.withColumns(
        {
            "amount": F.when(F.col("code") == "cbr", F.col("bet_size")),
            "blind": F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(F.col("blinds"), at).cast("double"), F.lit(0.0))),
            "stack": F.coalesce(F.try_element_at(F.col("stacks"), at).cast("double"), F.lit(0.0)),
        }
    ).drop("blinds", "stacks")


def _read_action(action: Column) -> Column:
    """An action's kind, code, player, words after the player and number among them; every pattern is tried once.

    A pattern needs its first letter; a look at that comes before it.
    """
    deals, plays = action.startswith("d"), action.startswith("p")

    def read(x: Column) -> Column:
        known = x["code"].isin("f", "cc", "cbr")
        return F.struct(
            action.alias("action"),
            F.when(x["hole"] != "", "hole").when(x["board"], "board").when((x["number"] != "") & known, "bet").otherwise("other").alias("kind"),
            F.when(known, x["code"]).alias("code"),
            F.coalesce(F.nullif(x["hole"], F.lit("")), F.nullif(x["number"], F.lit(""))).cast("int").alias("player"),
            x["raw"].alias("raw_action"),
            F.when(known, hand_record_amount(x["raw"])).alias("bet_size"),
        )

    def parts(words: Column) -> Column:
        return let(
            F.struct(
                F.when(deals, F.regexp_extract(action, HOLE_DEAL, 1)).when(action.isNotNull(), "").alias("hole"),
                (deals & action.rlike(BOARD_DEAL)).alias("board"),
                F.when(plays, F.regexp_extract(action, PLAYER_ACTION, 1)).when(action.isNotNull(), "").alias("number"),
                F.regexp_extract(words, r"^(\S*)", 1).alias("code"),
                strip(words).alias("raw"),
            ),
            read,
        )

    return let(F.when(plays, F.regexp_extract(action, PLAYER_ACTION, 2)).when(action.isNotNull(), ""), parts)


def replay_bets(actions: DataFrame, keys: Sequence[str], order: Sequence[str], slice_of: Column | None = None) -> DataFrame:
    """Add `segment`, `current_bet`, `contribution`, `to_call` and `pot`, all as they stand before the action.

    Needs `kind` (board rows start a new betting round), `code`, `player`, `amount`, `blind`,
    `max_blind` and `start_pot`. A raise without an amount means the current bet. Hands of ordinary
    length share one sorted window per key. With `slice_of`, a key of any length is replayed in
    slices (see `running`), so one endless key does not land in one task. Rows that `order` leaves
    equal then get one place that all steps share, or each step could take them in another order.
    """
    if slice_of is not None:
        ties = [c for c in ("kind", "code", "player", "amount") if c not in order]
        place = F.row_number().over(Window.partitionBy(*keys, slice_of).orderBy(*order, *ties))
        actions = stored(actions.withColumn("_place", place), "replay")
        order = [*order, "_place"]
    board = F.when(F.col("kind") == "board", 1).otherwise(0)
    stated = F.when((F.col("code") == "cbr") & (F.col("amount") != 0), F.col("amount"))

    def scan(df: DataFrame, by: Sequence[str], name: str, kind: str, column: Column, inclusive: bool = False) -> DataFrame:
        if slice_of is not None:
            # A sliced scan reads its input twice (slice totals, then rows). The input of every scan
            # after the first is therefore stored, or four scans would read the source sixteen times.
            source = df if df is actions else stored(df, "replay")
            return running(source, by, order, slice_of, {name: (kind, column)}, inclusive)
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        value = F.sum(column).over(frame) if kind == "sum" else F.max(column).over(frame)
        return df.withColumn(name, F.coalesce(value, F.lit(0)) if kind == "sum" else value)

    out = scan(actions, keys, "segment", "sum", board, inclusive=True)
    first = F.col("segment") == 0
    out = scan(out, [*keys, "segment"], "_top", "max", stated)
    out = out.withColumn(
        "current_bet", F.greatest(F.when(first, F.col("max_blind")).otherwise(F.lit(0.0)), F.coalesce("_top", F.lit(0.0)))
    )
    level = F.when(F.col("code") == "cc", F.col("current_bet")).when(F.col("code") == "cbr", F.coalesce(stated, F.col("current_bet")))
    out = out.withColumn("_level", level)
    out = scan(out, [*keys, "segment", "player"], "_mine", "max", F.col("_level"))
    out = out.withColumn(
        "contribution", F.greatest(F.when(first, F.col("blind")).otherwise(F.lit(0.0)), F.coalesce("_mine", F.lit(0.0)))
    )
    out = out.withColumn("to_call", F.greatest(F.lit(0.0), F.col("current_bet") - F.col("contribution")))
    out = out.withColumn("_add", F.coalesce(F.greatest(F.lit(0.0), F.col("_level") - F.col("contribution")), F.lit(0.0)))
    out = scan(out, keys, "_in", "sum", F.col("_add"))
    return out.withColumn("pot", F.col("start_pot") + F.col("_in")).drop("_place", "_top", "_level", "_mine", "_add", "_in")


def betting_class(code: Column, to_call: Column) -> Column:
    return F.when(code == "f", "FOLD").when(code == "cbr", "RAISE").when(code == "cc", F.when(to_call > 0, "CALL").otherwise("CHECK"))


def record_decisions(hands: DataFrame, keys: Sequence[str] = ("hand_id",)) -> DataFrame:
    """Every betting action of a hand record with the state it was taken in."""
    rows = replay_bets(record_actions(hands, keys), keys, ["action_index"])
    before = Window.partitionBy(*keys).orderBy("action_index").rowsBetween(Window.unboundedPreceding, -1)
    seat = Window.partitionBy(*keys, "player").orderBy("action_index").rowsBetween(Window.unboundedPreceding, -1)
    dealt = F.when(F.col("kind") == "board", C.split_cards(F.regexp_extract("action", BOARD_DEAL, 1), keep_tail=True))
    rows = rows.withColumns(
        {
            "_board": F.flatten(F.collect_list(dealt).over(before)),
            "history": F.array_join(F.collect_list("action").over(before), " | "),
            "_hole": F.last(F.when(F.col("kind") == "hole", F.regexp_extract("action", HOLE_DEAL, 2)), ignorenulls=True).over(seat),
        }
    ).filter("kind = 'bet'")
    known = F.size(F.filter("_board", lambda c: ~c.contains("?")))
    label = betting_class(F.col("code"), F.col("to_call"))
    legal = F.when(F.col("to_call") > 0, F.concat(F.lit("fold, call "), short_number(F.col("to_call")), F.lit(", raise")))
    return rows.select(
        *keys,
        "action_index",
        C.street_of_count(known).alias("street"),
        C.seat_name(F.col("player"), F.col("player_count")).alias("hero_position"),
        C.known_cards(F.col("_hole")).alias("hero_cards"),
        F.array_join("_board", " ").alias("board_cards"),
        F.col("pot").alias("pot_size"),
        "to_call",
        F.col("stack").alias("effective_stack"),
        F.col("history").alias("action_history"),
        legal_or(legal).alias("legal_actions"),
        "raw_action",
        label.alias("normalized_action_4class"),
        intent_of(label).alias("label_3intent"),
        "bet_size",
    )


def legal_or(text: Column) -> Column:
    return F.coalesce(text, F.lit("check, bet"))


# ---- text histories -------------------------------------------------------------------------

# Fixed patterns: lines of a text history.
HEADER = r"(?i)##\s*Game:\s*([0-9]+)\s*\|\s*Hand:\s*([0-9]+)\s*##"
ACTION_LINE = (
    r"(?i)^(.+?)\s+(posts small blind|posts big blind|bets|calls|raises|checks|folds|wins|collected)"
    r"(?:\s+\(?\$?([0-9.,]+)\)?)?"
)
SHOW_LINE = r"(?i)^(.+?)\s+shows\s+\[([^\]]+)\]"
WIN_LINE = r"(?i)^(.+?)\s+(?:wins|collected)\s+\$?([0-9.,]+)"
BOARD_LINE = r"(?i)\b(flop|turn|river)\b.*?\[([^\]]+)\]"
WHOLE_BOARD_LINE = r"(?i)\bboard\b.*?\[([^\]]+)\]"
POT_ACTIONS = ("posts small blind", "posts big blind", "bets", "calls", "raises")


def _amount(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"\.+$", "").try_cast("double")


def _cards(text: Column) -> Column:
    parts = F.filter(F.split(strip(text), "[, ]+"), lambda p: F.length(F.trim(p)) > 0)
    return F.transform(parts, C.history_card)


def history_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Text hands to one typed line per row, with the street each line belongs to.

    Hands are distributed by key once, before they are cut into lines; the window here and the
    grouping in `parse_text_hands` both find their rows in place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hands = df.select(*keys, F.col(text).rlike(r"(?i)\bside\s+pot\b").alias("has_side_pot"), F.col(text).alias("_text"))
    lines = hands.repartition(parts, *keys).select(
        *keys, "has_side_pot", F.posexplode(F.split("_text", r"\r\n|\r|\n")).alias("at", "_line")
    )
    lines = lines.select(*keys, "has_side_pot", "at", strip(F.col("_line")).alias("raw"))
    raw = F.col("raw")
    # Every pattern but the action's needs a character that few lines have; a plain search for it comes first.
    listed = raw.contains("[")
    lines = lines.withColumns(
        {
            "_header": raw.contains("##") & raw.rlike(HEADER),
            "_whole": F.when(listed & raw.rlike(WHOLE_BOARD_LINE), _cards(F.regexp_extract(raw, WHOLE_BOARD_LINE, 1))),
            "_board": listed & raw.rlike(BOARD_LINE),
            "_show": listed & raw.rlike(SHOW_LINE),
        }
    )
    whole = F.coalesce(F.size("_whole") >= 3, F.lit(False))
    lines = lines.withColumn(
        "kind",
        F.when(raw == "", "blank")
        .when(F.col("_header"), "header")
        .when(whole, "whole_board")
        .when(F.col("_board"), "board")
        .when(F.col("_show"), "show")
        .when(raw.rlike(ACTION_LINE), "action")
        .otherwise("other"),
    )
    kind = F.col("kind")
    won = (kind == "action") & (F.lower(raw).contains("wins") | F.lower(raw).contains("collected")) & raw.rlike(WIN_LINE)
    whole_street = F.when(F.size("_whole") >= 5, "RIVER").when(F.size("_whole") == 4, "TURN").otherwise("FLOP")
    lines = lines.withColumns(
        {
            "game": F.when(kind == "header", F.regexp_extract(raw, HEADER, 1)).cast("bigint"),
            "hand": F.when(kind == "header", F.regexp_extract(raw, HEADER, 2)).cast("bigint"),
            "opens": F.when(kind == "whole_board", whole_street).when(kind == "board", F.upper(F.regexp_extract(raw, BOARD_LINE, 1))),
            "player": strip(
                F.when(kind == "show", F.regexp_extract(raw, SHOW_LINE, 1)).when(kind == "action", F.regexp_extract(raw, ACTION_LINE, 1))
            ),
            "action": F.when(kind == "show", F.lit("shows")).when(kind == "action", F.lower(F.regexp_extract(raw, ACTION_LINE, 2))),
            "amount": F.when(kind == "action", _amount(F.regexp_extract(raw, ACTION_LINE, 3))),
            "won": F.when(won, _amount(F.regexp_extract(raw, WIN_LINE, 2))),
            "cards": F.when(kind == "whole_board", F.col("_whole"))
            .when(kind == "board", _cards(F.regexp_extract(raw, BOARD_LINE, 2)))
            .when(kind == "show", _cards(F.regexp_extract(raw, SHOW_LINE, 2))),
        }
    ).drop("_header", "_whole", "_board", "_show")
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("street", F.coalesce(F.last("opens", ignorenulls=True).over(before), F.lit("PREFLOP")))


def parse_text_hands(df: DataFrame, keys: Sequence[str], hero: str, text: str = "text") -> DataFrame:
    """One hand section per row to one summary row with `status` and `rejection_reason`."""
    lines = history_lines(df, keys, text)

    def listed(condition: Column, *fields: str) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.struct(*fields))))

    kind = F.col("kind")
    bad = F.coalesce(F.exists("cards", lambda c: c.isNull()), F.lit(False))
    grouped = lines.groupBy(*keys).agg(
        F.max("game").alias("game_id"),
        F.max("hand").alias("hand_id"),
        F.bool_or("has_side_pot").alias("has_side_pot"),
        F.bool_or(bad).alias("_bad_card"),
        F.coalesce(F.sum(F.when(F.col("action").isin(*POT_ACTIONS), F.col("amount"))), F.lit(0.0)).alias("_pot"),
        F.min_by("won", F.when(F.col("won").isNotNull(), F.col("at"))).alias("won"),
        listed(F.col("opens").isNotNull(), "at", "opens", "cards").alias("_boards"),
        listed(kind == "show", "at", "player", "cards").alias("_shows"),
        listed(kind.isin("show", "action"), "at", "street", "player", "action", "amount", "raw").alias("_acts"),
    )
    out = grouped.withColumns(
        {
            "_shown": F.array_distinct(F.transform("_shows", lambda s: s["player"])),
            "players": F.array_sort(F.array_distinct(F.transform("_acts", lambda a: a["player"]))),
        }
    )

    def hand_of(player: Column) -> Column:
        return F.try_element_at(F.filter("_shows", lambda s: s["player"] == player), F.lit(-1))["cards"]

    def last_cards(*cases: tuple[str, int, int, int]) -> Column:
        """Cards set by the last board line that sets a street: (line street, needed cards, from, count)."""
        picked = F.transform(
            "_boards",
            lambda b: F.coalesce(*[F.when((b["opens"] == s) & (F.size(b["cards"]) >= need), F.slice(b["cards"], at, n)) for s, need, at, n in cases]),
        )
        return F.coalesce(F.try_element_at(F.filter(picked, lambda p: p.isNotNull()), F.lit(-1)), F.array().cast("array<string>"))

    out = out.withColumns(
        {
            "_flop": last_cards(("FLOP", 0, 1, 3), ("TURN", 4, 1, 3), ("RIVER", 5, 1, 3)),
            "_turn": last_cards(("TURN", 4, 4, 1), ("TURN", 0, 1, 1), ("RIVER", 5, 4, 1)),
            "_river": last_cards(("RIVER", 5, 5, 1), ("RIVER", 0, 1, 1)),
            "villain_name": F.try_element_at(F.filter("_shown", lambda p: p != hero), F.lit(1)),
        }
    )

    def active_at(limit: Column) -> Column:
        def last_action(player: Column) -> Column:
            return F.try_element_at(F.filter("_acts", lambda a: (a["player"] == player) & (a["at"] < limit)), F.lit(-1))["action"]

        return F.filter("players", lambda p: F.coalesce(last_action(p) != "folds", F.lit(False)))

    def first_board(street: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter("_boards", lambda b: b["opens"] == street), F.lit(1))["at"], F.lit(1 << 30))

    reason = first_reason(
        [
            (F.col("hand_id").isNull(), "invalid_hand_header"),
            (F.col("has_side_pot"), "side_pot_not_supported"),
            (F.col("_bad_card"), "parser_exception"),
            (F.size("_shown") < 2, "showdown_missing"),
            (~F.array_contains("_shown", hero), "hero_hand_missing"),
            (F.size("_shown") != 2, "multiway_not_supported"),
        ]
    )
    kept = [k for k in keys if k not in ("game_id", "hand_id")]
    return out.select(
        *kept,
        "game_id",
        "hand_id",
        F.when(reason.isNull(), "ok").otherwise("failed").alias("status"),
        reason.alias("rejection_reason"),
        F.lit(hero).alias("hero_name"),
        "villain_name",
        "players",
        hand_of(F.lit(hero)).alias("hero_hand"),
        hand_of(F.col("villain_name")).alias("villain_hand"),
        F.struct(F.col("_flop").alias("flop"), F.col("_turn").alias("turn"), F.col("_river").alias("river")).alias("board"),
        F.when(F.col("_pot") > 0, F.col("_pot")).alias("pot_final"),
        "won",
        F.transform("_acts", lambda a: F.struct(*[a[f].alias(f) for f in ("street", "player", "action", "amount", "raw")])).alias("actions"),
        F.create_map(*[x for s in STREETS[1:] for x in (F.lit(s), active_at(first_board(s)))]).alias("active_by_street"),
        "has_side_pot",
    )


def board_for(board: Column, street: Column) -> Column:
    flop, turn = board["flop"], F.concat(board["flop"], board["turn"])
    return (
        F.when(street == "FLOP", flop)
        .when(street == "TURN", turn)
        .when(street == "RIVER", F.concat(turn, board["river"]))
        .otherwise(F.array().cast("array<string>"))
    )


def hand_snapshots(hands: DataFrame, street: str, to_call: Column) -> DataFrame:
    """Snapshot columns of a parsed hand on one street, or the reason there is none."""
    name = street.upper()
    need = C.STREET_CARDS.get(name)
    board = board_for(F.col("board"), F.lit(name))
    active = F.try_element_at(F.col("active_by_street"), F.lit(name))
    pair = F.array_sort(F.array("hero_name", "villain_name"))
    reason = first_reason(
        [
            (F.lit(need in (None, 0)), "unsupported_street"),
            (F.col("has_side_pot"), "side_pot_not_supported"),
            (F.coalesce(F.size("hero_hand"), F.lit(0)) <= 0, "hero_hand_missing"),
            (F.coalesce(F.size("villain_hand"), F.lit(0)) <= 0, "villain_hand_missing"),
            (to_call.isNull(), "to_call_unknown"),
            (F.size(board) != (need or 0), "invalid_board"),
            (F.coalesce(F.size(active), F.lit(0)) <= 0, "street_activity_unknown"),
            ((F.size(active) != 2) | (F.array_sort(active) != pair), "multiway_context_not_supported"),
            (F.coalesce(F.col("pot_final"), F.lit(0.0)) <= 0, "pot_reconstruction_failed"),
        ]
    )
    return hands.select(
        "game_id",
        "hand_id",
        F.when(reason.isNull(), "ok").otherwise("failed").alias("status"),
        reason.alias("rejection_reason"),
        F.when(
            reason.isNull(),
            F.concat(F.lit("game"), F.col("game_id").cast("string"), F.lit("_hand"), F.col("hand_id").cast("string"), F.lit("_" + name.lower())),
        ).alias("snapshot_id"),
        F.lit(name).alias("street"),
        F.col("hero_hand").alias("hero_cards"),
        "villain_hand",
        board.alias("board_cards"),
        F.col("pot_final").alias("pot"),
        to_call.cast("double").alias("to_call"),
    )


DECISIONS = ("calls", "bets", "raises", "checks", "folds")
IGNORED = ("shows", "wins", "collected")
SPOKEN = {"calls": "CALL", "bets": "BET", "raises": "RAISE", "checks": "CHECK", "folds": "FOLD"}


def replay_hero(hands: DataFrame, hero: str) -> DataFrame:
    """Fold the actions of every two-player hand; stop at the first contradiction.

    Adds `replay_status`, `replay_reason`, `contexts` (decisions of the hero up to the stop),
    `snapshots` (those after the flop, none on failure) and `pot_reconstructed`. A hand is one row
    and its actions are one bounded array, so the fold runs inside the row.
    """
    context_type = (
        "array<struct<street:string,hero_action:string,pot_before_action:double,to_call:double,active_opponents:int,raw:string>>"
    )
    zero = F.struct(
        F.lit(0.0).alias("pot"), F.lit(0.0).alias("hero"), F.lit(0.0).alias("other"),
        F.lit(True).alias("other_in"), F.lit(True).alias("hero_in"), F.lit("PREFLOP").alias("street"),
        F.lit(None).cast("string").alias("error"), F.array().cast(context_type).alias("contexts"),
    )
    other_name = F.try_element_at(F.filter("players", lambda p: p != hero), F.lit(1))
    order = F.array(*[F.lit(s) for s in STREETS])
    ordered = F.flatten(F.transform(order, lambda s: F.filter("actions", lambda a: a["street"] == s)))

    def step(acc: Column, act: Column) -> Column:
        fresh = act["street"] != acc["street"]
        mine0 = F.when(fresh, 0.0).otherwise(acc["hero"])
        theirs0 = F.when(fresh, 0.0).otherwise(acc["other"])
        name, amount, player = F.lower(act["action"]), act["amount"], act["player"]
        is_hero = player == hero
        own = F.when(is_hero, mine0).otherwise(theirs0)
        top = F.greatest(mine0, theirs0)
        price = top - own
        posts = name.isin("posts small blind", "posts big blind")
        adds = posts | (name == "calls") | ((name == "bets") & (price == 0))
        sets = (name == "raises") | ((name == "bets") & (price != 0))
        error = first_reason(
            [
                (~name.isin(*POT_ACTIONS, "checks", "folds"), F.concat(F.lit("unknown_action:"), name)),
                (~is_hero & ~player.eqNullSafe(other_name), "multiway_context_not_supported"),
                (name.isin(*POT_ACTIONS) & amount.isNull(), "amount_parse_failed"),
                ((name == "checks") & (price != 0), "pot_reconstruction_failed"),
                ((name == "calls") & (amount < price), "all_in_complex_not_supported"),
                ((name == "calls") & (amount > price), "pot_reconstruction_failed"),
                (sets & (amount <= top), "pot_reconstruction_failed"),
            ]
        )
        level = F.when(adds, own + amount).when(sets, amount).otherwise(own)
        decided = is_hero & name.isin(*DECISIONS) & F.coalesce(~error.startswith("unknown_action"), F.lit(True))
        spoken = F.create_map(*[F.lit(x) for pair in SPOKEN.items() for x in pair])
        context = F.struct(
            act["street"].alias("street"), F.try_element_at(spoken, name).alias("hero_action"), acc["pot"].alias("pot_before_action"),
            price.alias("to_call"),
            (F.when(acc["hero_in"], 1).otherwise(0) + F.when(acc["other_in"], 1).otherwise(0) - 1).alias("active_opponents"),
            act["raw"].alias("raw"),
        )
        contexts = F.when(decided, F.concat(acc["contexts"], F.array(context).cast(context_type))).otherwise(acc["contexts"])
        good = error.isNull()
        moved = F.struct(
            (acc["pot"] + F.when(good, level - own).otherwise(0.0)).alias("pot"),
            F.when(is_hero & good, level).otherwise(mine0).alias("hero"),
            F.when(~is_hero & good, level).otherwise(theirs0).alias("other"),
            (acc["other_in"] & ~(~is_hero & (name == "folds"))).alias("other_in"),
            (acc["hero_in"] & ~(is_hero & (name == "folds"))).alias("hero_in"),
            act["street"].alias("street"),
            error.alias("error"),
            contexts.alias("contexts"),
        )
        stopped = acc["error"].isNotNull() | name.isin(*IGNORED)
        return F.when(stopped, acc).otherwise(moved)

    blocked = first_reason(
        [
            (F.col("has_side_pot"), "side_pot_not_supported"),
            (F.coalesce(F.size("players"), F.lit(0)) != 2, "multiway_context_not_supported"),
            (F.coalesce(F.size("hero_hand"), F.lit(0)) <= 0, "hero_hand_missing"),
            (F.coalesce(F.size("villain_hand"), F.lit(0)) <= 0, "villain_hand_missing"),
            (~F.array_contains("players", hero), "hero_hand_missing"),
        ]
    )
    done = hands.withColumn("_blocked", blocked).withColumn("_end", F.aggregate(ordered, zero, step))
    reason = F.coalesce("_blocked", F.regexp_replace(F.col("_end.error"), "^unknown_action:.*", "unknown_action"))
    contexts = F.when(F.col("_blocked").isNull(), F.col("_end.contexts")).otherwise(F.array().cast(context_type))
    return done.select(
        *hands.columns,
        F.when(reason.isNull(), "ok").otherwise("failed").alias("replay_status"),
        reason.alias("replay_reason"),
        contexts.alias("contexts"),
        F.when(reason.isNull(), F.filter(contexts, lambda c: c["street"] != "PREFLOP")).otherwise(F.array().cast(context_type)).alias("snapshots"),
        F.when(reason.isNull(), F.col("_end.pot")).alias("pot_reconstructed"),
    )


def stage_ledger(parsed: DataFrame, snapshots: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One ledger of parse, snapshot and run rows with stage, status and reason."""
    parts = parsed.filter("status <> 'ok'").select(
        F.lit("parse").alias("stage"), "status", "game_id", "hand_id", F.lit(None).cast("string").alias("source_snapshot_id"), "rejection_reason"
    )
    shots = snapshots.select(
        F.lit("snapshot").alias("stage"), "status", "game_id", "hand_id", F.col("snapshot_id").alias("source_snapshot_id"), "rejection_reason"
    )
    out = parts.unionByName(shots)
    if runs is not None:
        out = out.unionByName(
            runs.select(
                F.lit("solver").alias("stage"), F.col("solver_status").alias("status"), "game_id", "hand_id", "source_snapshot_id", F.col("error").alias("rejection_reason")
            )
        )
    return out


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Counts per stage with the overall status: failed without a success, partial with both, else ok."""
    counts = ledger.groupBy("stage").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("ok_rows"), F.count_if(F.col("status") != "ok").alias("failed_rows")
    )
    status = F.when(F.col("ok_rows") == 0, "failed").when(F.col("failed_rows") > 0, "partial").otherwise("ok")
    return counts.withColumn("status", status)
