"""Cards, boards, hands and ranges as column expressions.

A card is a two-character text such as 'Ah'; beside it a card set is one bigint with 13 bits per
suit (bit 13 * suit + rank - 2), so unions, conflicts and hand ranking are plain integer arithmetic.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import clamp, let, strip

# Rank and suit letters, low to high, and the suit order used for sorting.
RANKS = "23456789TJQKA"
SUITS = "shdc"
DECK = [r + s for r in RANKS for s in SUITS]
# Other spellings of a suit, plain first, then text read with the wrong encoding.
SUIT_SPELLINGS = {
    "s": ("s", "spade", "spades", "\u2660", "\u00e2\u2122\u00a0"),
    "h": ("h", "heart", "hearts", "\u2665", "\u00e2\u2122\u00a5"),
    "d": ("d", "diamond", "diamonds", "\u2666", "\u00e2\u2122\u00a6"),
    "c": ("c", "club", "clubs", "\u2663", "\u00e2\u2122\u00a3"),
}
# Suit symbols of the text histories.
SUIT_SYMBOLS = {"\u2665": "h", "\u2661": "h", "\u2660": "s", "\u2664": "s", "\u2666": "d", "\u2662": "d", "\u2663": "c", "\u2667": "c"}
# Hand categories, weakest first.
CATEGORIES = (
    "HIGH_CARD", "PAIR", "TWO_PAIR", "THREE_OF_A_KIND", "STRAIGHT",
    "FLUSH", "FULL_HOUSE", "FOUR_OF_A_KIND", "STRAIGHT_FLUSH",
)
STREET_CARDS = {"PREFLOP": 0, "FLOP": 3, "TURN": 4, "RIVER": 5}
# Seat names by table size, starting at the small blind.
SEATS = {
    2: ("SB", "BB"),
    3: ("SB", "BB", "BTN"),
    4: ("SB", "BB", "UTG", "BTN"),
    5: ("SB", "BB", "UTG", "CO", "BTN"),
    6: ("SB", "BB", "UTG", "HJ", "CO", "BTN"),
}


def deck() -> Column:
    return F.expr("array(" + ",".join(f"'{c}'" for c in DECK) + ")")


def rank_value(card: Column) -> Column:
    """2 .. 14, null for an unknown rank."""
    at = F.instr(F.lit(RANKS), F.upper(F.substring(card, 1, 1)))
    return F.when((at > 0) & (F.length(card) > 0), at + 1)


def suit_value(card: Column) -> Column:
    """0 .. 3 in the order of SUITS, null for an unknown suit."""
    letter = F.lower(F.substring(card, 2, 1))
    at = F.instr(F.lit(SUITS), letter)
    return F.when((at > 0) & (F.length(letter) > 0), at - 1)


def card_bit(card: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (suit_value(card) * 13 + rank_value(card) - 2).cast("int"))


def cards_mask(cards: Column) -> Column:
    """Card array to one bigint."""
    return F.aggregate(cards, F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(card_bit(c)))


def split_cards(text: Column, keep_tail: bool = False) -> Column:
    """'AhKd7c' to an array of two-character cards; an odd last character is kept or dropped."""
    pattern = "(?s)(.{1,2})" if keep_tail else "(?s)(..)"
    source = F.coalesce(text, F.lit("")) if keep_tail else strip(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(1))


def card_count(text: Column) -> Column:
    """Cards spelled anywhere in a text, in any case."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?i)[2-9TJQKA][cdhs]"))


def parse_card(text: Column) -> Column:
    """Any spelling ('10♥', 'king of spades' style words, broken encodings) to 'Th'; null when unreadable."""

    def read(t: Column) -> Column:
        low = t["low"]
        rank = F.regexp_extract(F.replace(F.upper(t["value"]), F.lit("10"), F.lit("T")), "(A|K|Q|J|T|[2-9])", 1)
        suit = F.lit(None).cast("string")
        for letter, spellings in SUIT_SPELLINGS.items():
            suit = F.coalesce(suit, F.when(low.contains(spellings[-1]), F.lit(letter)))
        for letter, spellings in SUIT_SPELLINGS.items():
            for word in spellings[:-1]:
                suit = F.coalesce(suit, F.when(low.contains(word), F.lit(letter)))
        blank = low.isin("", "none", "null", "unknown", "??")
        return let(F.struct(rank.alias("rank"), suit.alias("suit")), lambda c: F.when(~blank & (c["rank"] != "") & c["suit"].isNotNull(), F.concat(c["rank"], c["suit"])))

    return let(let(strip(text), lambda v: F.struct(v.alias("value"), F.lower(v).alias("low"))), read)


def strict_card(text: Column) -> Column:
    """'10h' or 'th' to 'Th'; null unless it is exactly one rank and one suit."""
    value = F.replace(strip(text), F.lit("10"), F.lit("T"))
    ok = value.rlike("^(?i)[2-9TJQKA][hdcs]$")
    return F.when(ok, F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 1))))


def history_card(text: Column) -> Column:
    """A card of a text history ('[10h', 'K\u2665') to 'Th'; null when it is no card."""
    bare = F.replace(F.translate(strip(text), "[]", ""), F.lit("10"), F.lit("T"))
    bare = F.translate(bare, "".join(SUIT_SYMBOLS), "".join(SUIT_SYMBOLS.values()))
    ok = bare.rlike("^(?i)[2-9TJQKA][hdcs]$")
    return F.when(ok, F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1))))


def known_cards(text: Column) -> Column:
    """Spaced cards; a text with unknown cards passes unchanged."""
    return F.when(text.contains("?"), text).otherwise(F.array_join(split_cards(text, keep_tail=True), " "))


def street_of_count(count: Column) -> Column:
    return F.when(count >= 5, "RIVER").when(count == 4, "TURN").when(count >= 3, "FLOP").otherwise("PREFLOP")


def seat_name(number: Column, size: Column) -> Column:
    """Seat name of a 1-based player number; P7 style outside the known tables."""
    known = F.lit(None).cast("string")
    for players, names in SEATS.items():
        listed = F.try_element_at(F.array(*[F.lit(n) for n in names]), number.cast("int"))
        known = F.coalesce(known, F.when((size == players) & (number >= 1), listed))
    return F.coalesce(known, F.concat(F.lit("P"), number.cast("string")))


def remaining_deck(used: Column) -> Column:
    return F.array_except(deck(), used)


def shuffled(cards: Column, seed: Column) -> Column:
    """Cards ordered by a digest of (seed, card): a reproducible draw without replacement."""
    tagged = F.transform(cards, lambda c: F.struct(F.sha2(F.concat(seed, F.lit(":"), c), 256).alias("k"), c.alias("c")))
    return F.transform(F.sort_array(tagged), lambda t: t["c"])


def shuffled_deck(seed: Column) -> Column:
    """The whole deck in digest order as structs (c: card text, m: card mask)."""
    entries = ",".join(
        f"named_struct('c', '{c}', 'm', {1 << (SUITS.index(c[1]) * 13 + RANKS.index(c[0]))}L)" for c in DECK
    )
    tagged = F.transform(
        F.expr(f"array({entries})"),
        lambda x: F.struct(F.sha2(F.concat(seed, F.lit(":"), x["c"]), 256).alias("k"), x["c"].alias("c"), x["m"].alias("m")),
    )
    return F.sort_array(tagged)


# ---- hand ranking on card masks -------------------------------------------------------------


LANE = 16


def _lanes(values: list[str]) -> str:
    """Up to four rank sets side by side in one long."""
    return " | ".join(f"shiftleft({v}, {LANE * i})" if i else v for i, v in enumerate(values))


def _smeared(packed: str, by: int) -> str:
    """Every bit also on the `by` places below it, inside its lane."""
    inside = sum(((1 << (LANE - by)) - 1) << (LANE * i) for i in range(4)) & ((1 << 63) - 1)
    return f"{packed} | (shiftright({packed}, {by}) & {inside}L)"


def with_hand_score(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Add `out`: the strength of the best five cards of a 5 to 7 card mask as one comparable bigint.

    The category sits above bit 26, the deciding ranks above bit 13, the kickers below. Everything
    is integer arithmetic in one generated stage: no array, no lookup, no UDF. Each step is its own
    projection because later steps use its columns several times.
    """
    kept = [f"`{c}`" for c in df.columns]
    p = f"_{out}_"

    def add(frame: DataFrame, *steps: tuple[str, str]) -> DataFrame:
        return frame.selectExpr("*", *[f"{sql} AS {p}{name}" for name, sql in steps])

    def with_tops(frame: DataFrame, level: str, lanes: str, names: list[str]) -> DataFrame:
        """Add `{name}_top` per lane: the highest rank of its set as one bit, 0 for the empty set. All lanes at once."""
        frame, last = add(frame, (f"{level}0", lanes)), f"{level}0"
        for by in (1, 2, 4, 8):
            frame, last = add(frame, (f"{level}{by}", _smeared(p + last, by))), f"{level}{by}"
        frame = add(frame, (level, f"{p}{last} & ~(shiftright({p}{last}, 1))"))
        # lanes hold at most 14 bits, so the neighbour's lowest bit falls on an unused one
        return add(frame, *[(f"{n}_top", f"shiftright({p}{level}, {LANE * i}) & 16383L") for i, n in enumerate(names)])

    suits = [f"{p}s{i}" for i in range(4)]
    # Without nulls the generated method stays below 8,000 bytes; the JVM never compiles a longer one.
    step = add(df, ("m", f"coalesce(`{mask}`, 0L)"))
    step = add(step, *[(f"s{i}", f"shiftright({p}m, {13 * i}) & 8191L") for i in range(4)])
    flush = " ".join(f"WHEN bit_count({s}) >= 5 THEN {s}" for s in suits)
    pairs = [(f"{n}{i}", f"{p}s{2 * i} {op} {p}s{2 * i + 1}") for n, op in (("both", "&"), ("one", "|")) for i in (0, 1)]
    step = add(step, *pairs, ("flush", f"CASE {flush} ELSE 0L END"))
    step = add(
        step,
        ("any", f"{p}one0 | {p}one1"),
        ("two", f"{p}both0 | {p}both1 | ({p}one0 & {p}one1)"),
        ("three", f"({p}both0 & {p}one1) | ({p}both1 & {p}one0)"),
        ("four", f"{p}both0 & {p}both1"),
    )
    # All ranks and those of the flush, 32 bits apart. The ace counts low as well: one position below the two.
    wide = lambda bits: f"{bits | bits << 32}L"
    step = add(step, ("sets", f"{p}any | shiftleft({p}flush, 32)"))
    step = add(step, ("low", f"shiftleft({p}sets, 1) | (shiftright({p}sets, 12) & {wide(1)})"))
    # Five set bits in a row end a straight.
    step = add(step, ("run2", f"{p}low & shiftleft({p}low, 1)"))
    step = add(step, ("run4", f"{p}run2 & shiftleft({p}run2, 2)"))
    step = add(step, ("runs", f"{p}run4 & shiftleft({p}low, 4) & {wide(16383)}"))
    step = with_tops(step, "high", f"{p}runs | shiftleft({p}three, {LANE}) | shiftleft({p}two, {3 * LANE})", ["any_runs", "three", "flush_runs", "two"])
    step = add(
        step,
        ("full", f"{p}two ^ {p}three_top"),
        ("second", f"{p}two ^ {p}two_top"),
        ("trip_rest", f"{p}any ^ {p}three_top"),
        ("four_rest", f"{p}any ^ {p}four"),
        ("rest", f"CASE WHEN {p}flush > 0 THEN {p}flush WHEN {p}two > 0 THEN {p}any ^ {p}two_top ELSE {p}any END"),
        ("keep", f"IF({p}flush = 0 AND {p}two > 0, 3, 5)"),
    )
    # The highest five of a flush or of single cards, three beside a pair: two cards are dropped at most.
    step = add(step, ("rest1", f"IF(bit_count({p}rest) > {p}keep, {p}rest & ({p}rest - 1), {p}rest)"))
    step = add(step, ("best", f"IF(bit_count({p}rest1) > {p}keep, {p}rest1 & ({p}rest1 - 1), {p}rest1)"))
    rests = ["full", "second", "trip_rest", "four_rest"]
    step = with_tops(step, "next", _lanes([p + n for n in rests]), rests)
    step = add(step, ("pairs", f"{p}two_top | {p}second_top"))
    step = add(step, ("trip_next", f"{p}trip_rest ^ {p}trip_rest_top"), ("pairs_rest", f"{p}any ^ {p}pairs"))
    step = with_tops(step, "last", _lanes([p + "trip_next", p + "pairs_rest"]), ["trip_next", "pairs_rest"])

    def packed(category: int, ranks: str, kickers: str = "0L") -> str:
        return f"{category << 26}L | shiftleft({ranks}, 13) | {kickers}"

    score = f"""IF(`{mask}` IS NULL, NULL, CASE
        WHEN {p}flush_runs_top > 0 THEN {packed(8, f"shiftright({p}flush_runs_top, 1)")}
        WHEN {p}four > 0 THEN {packed(7, p + 'four', p + 'four_rest_top')}
        WHEN {p}three > 0 AND {p}full > 0 THEN {packed(6, p + 'three_top', p + 'full_top')}
        WHEN {p}flush > 0 THEN {packed(5, p + 'best')}
        WHEN {p}any_runs_top > 0 THEN {packed(4, f"shiftright({p}any_runs_top, 1)")}
        WHEN {p}three > 0 THEN {packed(3, p + 'three_top', f"{p}trip_rest_top | {p}trip_next_top")}
        WHEN {p}second > 0 THEN {packed(2, p + 'pairs', p + 'pairs_rest_top')}
        WHEN {p}two > 0 THEN {packed(1, p + 'two_top', p + 'best')}
        ELSE {packed(0, p + 'best')} END)"""
    return step.selectExpr(*kept, f"{score} AS `{out}`")


def category_of(score: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.shiftright(score, 26).cast("int"))


def _mask_array(masks: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{m}L" for m in masks) + ")")


def card_masks() -> Column:
    """The 52 one-card masks as an array."""
    return _mask_array([1 << i for i in range(52)])


def pair_masks() -> Column:
    """The 1326 two-card masks as an array."""
    return _mask_array([(1 << a) | (1 << b) for a, b in combinations(range(52), 2)])


# ---- hole cards and ranges ------------------------------------------------------------------


def _hole(first: Column, second: Column) -> Column:
    a, b = rank_value(first), rank_value(second)
    return F.struct(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), (suit_value(first) == suit_value(second)).alias("suited"))


def hand_class(first: Column, second: Column) -> Column:
    """'AA', 'AKs' or 'AKo' of two cards."""

    def spelled(h: Column) -> Column:
        letters = F.concat(_letter(RANKS, h["high"] - 1), _letter(RANKS, h["low"] - 1))
        mark = F.when(h["high"] == h["low"], "").when(h["suited"], "s").otherwise("o")
        return F.concat(letters, mark)

    return let(_hole(first, second), spelled)


def hand_strength(first: Column, second: Column) -> Column:
    """Two-card strength in 0 .. 1 from ranks, gap, suit, broadway and ace bonuses."""

    def strength(h: Column) -> Column:
        high, low = h["high"], h["low"]
        gap = F.greatest(F.lit(0), high - low - 1)
        # The weight of every part.
        pair = F.lit(0.44) + ((high - 2) / F.lit(12.0)) * 0.52
        other = (
            F.lit(0.05)
            + ((high - 2) / F.lit(12.0)) * 0.34
            + ((low - 2) / F.lit(12.0)) * 0.18
            + F.greatest(F.lit(0.0), F.lit(0.13) - F.lit(0.026) * gap)
            + F.when(h["suited"], 0.08).otherwise(0.0)
            + F.when(low >= 10, 0.12).otherwise(0.0)
            + F.when(high == 14, 0.06).otherwise(0.0)
        )
        return F.when(high == low, pair).otherwise(other)

    return clamp(let(_hole(first, second), strength), 0.0, 1.0)


def combo_weight(klass: Column) -> Column:
    """Number of two-card combos in a hand class: 6, 4 or 12; 16 without a suit mark; 1 for a single combo."""
    return (
        F.when(F.length(klass) == 4, 1)
        .when(klass.endswith("s"), 4)
        .when(klass.endswith("o"), 12)
        .when(F.substring(klass, 1, 1) == F.substring(klass, 2, 1), 6)
        .otherwise(16)
    )


def combo_dimension(spark: SparkSession) -> DataFrame:
    """All 1326 two-card combos: mask, high, low, suited, hand class and card texts."""
    rows = []
    for (i, a), (j, b) in combinations(enumerate(DECK), 2):
        ra, rb = RANKS.index(a[0]) + 2, RANKS.index(b[0]) + 2
        (first, second) = (a, b) if (-ra, SUITS.index(a[1])) <= (-rb, SUITS.index(b[1])) else (b, a)
        suited = a[1] == b[1]
        kind = first[0] + second[0] + ("" if ra == rb else "s" if suited else "o")
        mask = sum(1 << (SUITS.index(c[1]) * 13 + RANKS.index(c[0])) for c in (a, b))
        rows.append((mask, max(ra, rb), min(ra, rb), suited, kind, first, second))
    return spark.createDataFrame(
        rows, "mask bigint, high int, low int, suited boolean, hand_class string, first string, second string"
    )


# ---- board texture and suit isomorphism -----------------------------------------------------


def is_paired(board: Column) -> Column:
    ranks = F.transform(board, rank_value)
    return F.size(F.array_distinct(ranks)) < F.size(ranks)


def is_drawy(board: Column) -> Column:
    """Two cards of one suit, or three different ranks within four."""
    suits = F.transform(board, suit_value)
    two_suited = F.size(F.array_distinct(suits)) < F.size(suits)
    ranks = F.array_sort(F.array_distinct(F.transform(board, rank_value)))
    close = F.exists(ranks, lambda low: F.size(F.filter(ranks, lambda r: (r >= low) & (r <= low + 4))) >= 3)
    return (F.size(board) >= 3) & (two_suited | close)


SUIT_ORDERS = list(permutations(range(4)))


def canonical_board(board: Column) -> Column:
    """struct(key, permutation): the smallest board over the 24 suit relabelings, the first one on ties.

    The key reads r{rank}s{suit} joined by '_' in (rank, suit) order.
    """
    numbered = F.transform(board, lambda c: F.struct(rank_value(c).alias("r"), suit_value(c).alias("s")))
    orders = F.array(*[F.array(*map(F.lit, p)) for p in SUIT_ORDERS])

    def best(cards: Column) -> Column:
        def under(order: Column, index: Column) -> Column:
            relabelled = F.transform(cards, lambda c: F.struct(c["r"].alias("r"), F.get(order, c["s"]).alias("s")))
            return F.struct(F.sort_array(relabelled).alias("cards"), index.alias("permutation"))

        return F.array_min(F.transform(orders, under))

    def spelled(found: Column) -> Column:
        text = F.transform(found["cards"], lambda c: F.concat(F.lit("r"), c["r"].cast("string"), F.lit("s"), c["s"].cast("string")))
        return F.struct(F.array_join(text, "_").alias("key"), found["permutation"].alias("permutation"))

    # Bound before the 24 relabelings: the board may be a whole deal.
    return let(let(numbered, best), spelled)


def canonical_hand(hand: Column, permutation: Column) -> Column:
    """Hole cards under a chosen suit relabeling, in (rank, suit) order, as card text such as '9hKs'."""
    orders = F.from_json(F.lit(str([list(p) for p in SUIT_ORDERS])), "array<array<int>>")
    order = F.get(orders, permutation)
    cards = F.array_sort(F.transform(hand, lambda c: F.struct(rank_value(c).alias("r"), F.get(order, suit_value(c)).alias("s"))))
    return F.array_join(F.transform(cards, lambda c: F.concat(_letter(RANKS, c["r"] - 1), _letter(SUITS, c["s"] + 1))), "")


def _letter(letters: str, position: Column) -> Column:
    return F.substr(F.lit(letters), position, F.lit(1))
