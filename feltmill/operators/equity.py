"""Showdowns, runouts, equities and equity histograms on card masks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions.values import let
from ..session import stored


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribute rows by key before they are multiplied.

    A spot is a few bytes and grows to thousands of evaluations. Moving the spots first costs next
    to nothing, uses every core even when the input is one small file, and leaves the rows where
    the later aggregation by the same keys needs them, so that step does not shuffle again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def dealt(df: DataFrame, seed: Column, board_cards: int = 5) -> DataFrame:
    """Add hero, villain and board cards (arrays) and their masks, drawn from one shuffled deck per row."""
    drawn = df.withColumn("_deck", C.shuffled_deck(seed))
    spans = {"hero": (1, 2), "villain": (3, 2), "board": (5, board_cards)}
    cut = drawn.select(*df.columns, *[F.slice("_deck", at, n).alias(name) for name, (at, n) in spans.items()])

    def joined(name: str, n: int) -> Column:
        mask = F.get(name, F.lit(0))["m"]
        for i in range(1, n):
            mask = mask.bitwiseOR(F.get(name, F.lit(i))["m"])
        # a deck has every card; known as never null, the mask needs no null tests in the code generated for hands
        return F.coalesce(mask, F.lit(0).cast("bigint"))

    return cut.select(
        *df.columns,
        *[F.col(f"{name}.c").alias(name) for name in spans],
        *[joined(name, n).alias(f"{name}_mask") for name, (_, n) in spans.items()],
    )


def with_runouts(df: DataFrame, board: str, used: Sequence[str], missing: int) -> DataFrame:
    """One row per way to complete the board: `full_board`. Zero, one or two cards are enumerated exactly."""
    if missing == 0:
        return df.withColumn("full_board", F.col(board))
    if missing not in (1, 2):
        raise ValueError("exact runouts need at most two missing board cards; sample earlier streets")
    taken = F.col(board)
    for name in used:
        taken = taken.bitwiseOR(F.col(name))
    options = C.card_masks() if missing == 1 else C.pair_masks()
    out = df.withColumn("_taken", taken).withColumn("_run", F.explode(options))
    out = out.filter(F.col("_run").bitwiseAND(F.col("_taken")) == 0)
    return out.withColumn("full_board", F.col(board).bitwiseOR(F.col("_run"))).drop("_taken", "_run")


def with_sampled_boards(df: DataFrame, used: Sequence[str], draws: int, seed: int = 17, key: Sequence[str] = (), board: str | None = None) -> DataFrame:
    """One row per hash-seeded draw of a full board from the cards still in the deck; the cards of `board` lie already."""
    taken = F.lit(0).cast("bigint")
    for name in used:
        taken = taken.bitwiseOR(F.col(name))
    many = df.withColumn("_taken", taken).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    free = F.filter(C.card_masks(), lambda m: m.bitwiseAND(F.col("_taken")) == 0)
    parts = [F.lit(seed), F.col("draw"), *[F.col(k) for k in key]]
    order = F.array_sort(F.transform(free, lambda m: F.struct(F.xxhash64(*parts, m).alias("h"), m.alias("m"))))
    lying = F.col(board) if board else F.lit(0).cast("bigint")
    drawn = F.slice(order, F.lit(1), (F.lit(5) - F.bit_count(lying)).cast("int"))
    full = F.aggregate(drawn, lying, lambda acc, x: acc.bitwiseOR(x["m"]))
    return many.withColumn("full_board", full).drop("_taken", "draw")


def showdown(df: DataFrame, hands: Sequence[str], board: str = "full_board") -> DataFrame:
    """Add per hand `{hand}_share`: 1 / number of winners for a winning hand, else 0."""
    scored = df
    for hand in hands:
        scored = scored.withColumn(f"_m_{hand}", F.col(hand).bitwiseOR(F.col(board)))
        scored = C.with_hand_score(scored, f"_m_{hand}", f"_s_{hand}")
    scores = [F.col(f"_s_{hand}") for hand in hands]
    scored = scored.withColumn("_best", F.greatest(*scores))
    winners = sum((F.when(s == F.col("_best"), 1).otherwise(0) for s in scores), F.lit(0))
    scored = scored.withColumn("_winners", winners)
    shares = {
        f"{hand}_share": F.when(F.col(f"_s_{hand}") == F.col("_best"), F.lit(1.0) / F.col("_winners")).otherwise(0.0)
        for hand in hands
    }
    drop = ["_best", "_winners"] + [f"_m_{h}" for h in hands] + [f"_s_{h}" for h in hands]
    return scored.withColumns(shares).drop(*drop)


def equity(df: DataFrame, keys: Sequence[str], hands: Sequence[str]) -> DataFrame:
    """Per spot and hand: wins, ties, losses, runouts and equity over the showdown rows of `showdown`."""
    parts = []
    for hand in hands:
        share = F.col(f"{hand}_share")
        parts += [
            F.count_if(share == 1.0).alias(f"{hand}_win"),
            F.count_if((share > 0) & (share < 1.0)).alias(f"{hand}_tie"),
            F.count_if(share == 0).alias(f"{hand}_lose"),
            F.avg(share).alias(f"{hand}_equity"),
        ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runouts"), *parts)


SUIT_BITS = 13


def canonical_matchup(hero: Column, villain: Column, board: Column) -> Column:
    """Masks of two hands and a board as four longs, the same for all spots that differ by a renaming of suits.

    A suit's thirteen ranks of the three masks make one number; renaming suits permutes the four numbers.
    """
    def part(mask: Column, suit: int) -> Column:
        return F.shiftright(mask, SUIT_BITS * suit).bitwiseAND(F.lit((1 << SUIT_BITS) - 1))

    return F.sort_array(
        F.array(*[F.shiftleft(part(hero, s), 2 * SUIT_BITS).bitwiseOR(F.shiftleft(part(villain, s), SUIT_BITS)).bitwiseOR(part(board, s)) for s in range(4)])
    )


def matchup_masks(matchup: Column) -> tuple[Column, Column, Column]:
    """Hero, villain and board masks of a canonical matchup."""
    def mask(shift: int) -> Column:
        whole = F.lit(0).cast("bigint")
        for suit in range(4):
            own = F.shiftright(F.get(matchup, F.lit(suit)), shift).bitwiseAND(F.lit((1 << SUIT_BITS) - 1))
            whole = whole.bitwiseOR(F.shiftleft(own, SUIT_BITS * suit))
        return whole

    return mask(2 * SUIT_BITS), mask(SUIT_BITS), mask(0)


def matchup(hero: Column, villain: Column, board: Column) -> Column:
    """The canonical matchup of card arrays; null unless two hands of two and up to five board cards are all readable
    and all different. Blank board entries are left out."""
    shown = F.filter(board, lambda c: F.length(F.trim(c)) > 0)
    every = F.transform(F.concat(hero, villain, shown), C.history_card)
    dealable = (F.size(hero) == 2) & (F.size(villain) == 2) & (F.size(shown) <= 5) & F.forall(every, lambda c: c.isNotNull()) & (F.size(F.array_distinct(every)) == F.size(every))
    masks = F.struct(*[C.cards_mask(F.transform(cards, C.history_card)).alias(name) for name, cards in (("h", hero), ("v", villain), ("b", shown))])
    return F.when(F.coalesce(dealable, F.lit(False)), let(masks, lambda m: canonical_matchup(m["h"], m["v"], m["b"])))


def matchup_equities(matchups: DataFrame, draws: int = 2000, seed: int = 17) -> DataFrame:
    """(matchup, spots, runouts, equity) of every different canonical `matchup`: how many rows share it, and the hero's share.

    Boards that miss at most three cards are completed in every way; earlier ones `draws` times from digests of the
    matchup, so that the result does not depend on rows or partitions.
    """
    hero, villain, board = matchup_masks(F.col("matchup"))
    spots = matchups.filter(F.col("matchup").isNotNull()).groupBy("matchup").agg(F.count(F.lit(1)).alias("spots"))
    spots = spots.select("matchup", "spots", hero.alias("_hero"), villain.alias("_villain"), board.alias("_board"))
    spots = stored(spots.withColumn("_missing", F.lit(5) - F.bit_count("_board")), "matchups")
    hands = ["_hero", "_villain"]

    def of(missing: Column) -> DataFrame:
        return spread(spots.filter(missing).drop("_missing"), ["matchup"])

    runs = [with_runouts(of(F.col("_missing") == n), "_board", hands, n) for n in (0, 1, 2)]
    # a third card above the pair: every three cards once
    pairs = with_runouts(of(F.col("_missing") == 3), "_board", hands, 2)
    third = pairs.withColumn("_last", F.explode(C.card_masks()))
    used = F.col("full_board").bitwiseOR(F.col("_hero")).bitwiseOR(F.col("_villain"))
    third = third.filter((F.col("_last").bitwiseAND(used) == 0) & (F.col("_last") > F.col("full_board").bitwiseXOR(F.col("_board"))))
    runs.append(third.withColumn("full_board", F.col("full_board").bitwiseOR(F.col("_last"))).drop("_last"))
    early = with_sampled_boards(of(F.col("_missing") > 3), [*hands, "_board"], draws, seed, [*hands, "_board"], "_board")
    shown = [showdown(r, hands).select("matchup", "spots", "_hero_share") for r in (*runs, early)]
    # every branch is dealt by matchup, so its aggregation needs no exchange
    sums = [r.groupBy("matchup").agg(F.first("spots").alias("spots"), F.count(F.lit(1)).alias("runouts"), F.avg("_hero_share").alias("equity")) for r in shown]
    return reduce(DataFrame.unionByName, sums)


def with_matchup_equity(df: DataFrame, hero: str, villain: str, board: str, wanted: Column, out: str) -> DataFrame:
    """Add `out`: the hero's equity where `wanted`, null where the cards do not allow one. Equal spots are computed once."""
    # Stored, or the test for a matchup moves below the cards and reads them anew for every use.
    keyed = stored(df.withColumn("matchup", F.when(wanted, matchup(F.col(hero), F.col(villain), F.col(board)))), "keyed")
    found = matchup_equities(keyed.select("matchup")).select(F.col("matchup").alias("_matchup"), F.col("equity").alias(out))
    return keyed.join(found, F.col("matchup") == F.col("_matchup"), "left").drop("matchup", "_matchup")


def equity_vs_uniform(df: DataFrame, keys: Sequence[str], hero: str, board: str, missing: int) -> DataFrame:
    """River equity of a hand against every other holding, one row per spot and runout.

    The opponents of one runout are produced next to each other, so they collapse in the map-side
    part of the aggregation and only one row per runout is shuffled.
    """
    runs = with_runouts(df.select(*keys, hero, board), board, [hero], missing)
    runs = runs.withColumn("_mine", F.col("full_board").bitwiseOR(F.col(hero)))
    runs = C.with_hand_score(runs, "_mine", "_score")
    rivals = runs.select(*keys, "full_board", "_mine", "_score", F.explode(C.pair_masks()).alias("_rival"))
    rivals = rivals.filter(F.col("_rival").bitwiseAND(F.col("_mine")) == 0)
    rivals = rivals.withColumn("_theirs", F.col("_rival").bitwiseOR(F.col("full_board")))
    rivals = C.with_hand_score(rivals, "_theirs", "_other")
    won = F.count_if(F.col("_score") > F.col("_other"))
    tied = F.count_if(F.col("_score") == F.col("_other"))
    return rivals.groupBy(*keys, "full_board").agg(
        ((won + tied * 0.5) / F.count(F.lit(1))).alias("equity"), F.count(F.lit(1)).alias("opponents")
    )


def equity_histogram(df: DataFrame, keys: Sequence[str], value: str = "equity", bins: int = 50) -> DataFrame:
    """Dense, L1-normalized histogram of a value in 0 .. 1 per key; the top edge falls in the last bin."""
    index = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(value) * bins).cast("int")))
    counted = df.groupBy(*keys, index.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    packed = counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"), F.sum("_n").alias("_total")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0)).cast("double") / F.col("_total"),
    )
    return packed.select(*keys, dense.alias("histogram"))


def l1_normalized(values: Column) -> Column:
    """Array scaled to sum 1; an all-zero array becomes uniform."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    size = F.size(values)
    return F.transform(
        values, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(F.lit(1.0) / size)
    )


def emd(left: Column, right: Column) -> Column:
    """Mean absolute difference of the running sums of two equally long histograms."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    gaps = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))

    def step(acc: Column, gap: Column) -> Column:
        run = acc["run"] + gap
        return F.struct(run.alias("run"), (acc["sum"] + F.abs(run)).alias("sum"))

    return F.aggregate(gaps, start, step, lambda acc: acc["sum"]) / F.size(left)
