"""Range text, hand classes and combos against the fixed 1326-row combo table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions.values import let


def _bounds(token: Column) -> tuple[Column, Column, Column]:
    """(high, low, suit mark) of a hand token such as 'AK', 'T9s' or '77'."""
    a, b = C.rank_value(F.substring(token, 1, 1)), C.rank_value(F.substring(token, 2, 1))
    return F.greatest(a, b), F.least(a, b), F.lower(F.substring(token, 3, 1))


EXACT = "^[2-9TJQKAtjqka][shdcSHDC][2-9TJQKAtjqka][shdcSHDC]$"


def token_error(token: Column) -> Column:
    """Why a token of a range text means no hands; null for a good one."""
    ends = F.split(token, r"\s*-\s*", 2)
    dash = F.instr(token, F.lit("-")) > 0
    left = F.when(dash, F.get(ends, 0)).otherwise(F.regexp_replace(token, r"\+$", ""))
    right = F.when(dash, F.get(ends, 1)).otherwise(left)

    def read(t: Column) -> Column:
        high, low, mark = _bounds(t)
        return F.struct(t.alias("t"), high.alias("high"), low.alias("low"), mark.alias("mark"))

    def judged(both: Column) -> Column:
        a, b = both["a"], both["b"]

        def either(test) -> Column:  # noqa: ANN001
            return test(a) | test(b)

        return (
            F.when(either(lambda x: ~F.length(x["t"]).between(2, 3)), "invalid_hand_token")
            .when(either(lambda x: ~F.substring(x["t"], 1, 2).rlike("^[2-9TJQKAtjqka]{2}$")), "invalid_ranks")
            .when(either(lambda x: ~x["mark"].isin("", "s", "o")), "invalid_suit_mark")
            .when(either(lambda x: (x["high"] == x["low"]) & (x["mark"] != "")), "pair_with_suit_mark")
            .when((a["high"] == a["low"]) != (b["high"] == b["low"]), "pair_and_non_pair")
            .when(a["mark"] != b["mark"], "unequal_suit_marks")
            .when((a["high"] != a["low"]) & ~((a["high"] == 14) & (b["high"] == 14)) & (a["high"] - a["low"] != b["high"] - b["low"]), "unequal_gaps")
        )

    twice = F.when(F.lower(F.substring(token, 1, 2)) == F.lower(F.substring(token, 3, 2)), "duplicate_card")
    return F.when(token.rlike(EXACT), twice).otherwise(let(F.struct(read(left).alias("a"), read(right).alias("b")), judged))


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    pieces = df.select(key, F.posexplode(F.split(text, ",")).alias("token_index", "_raw"))
    return pieces.withColumn("token", F.trim("_raw")).filter("token <> ''").withColumn("error", token_error(F.col("token")))


def range_errors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token_index, token, error) of every token that means no hands."""
    return _tokens(df, key, text).filter("error IS NOT NULL").select(key, "token_index", "token", "error")


def range_combos(df: DataFrame, key: str, text: str) -> DataFrame:
    """Range text to combos: (key, mask, first, second, hand_class, position), duplicates collapsed.

    Only good tokens count; `range_errors` tells the others.

    Every token is turned into the ranks and suitedness it covers by arithmetic, so the combo table
    is met by an equi join. The table has 1326 rows by construction and is broadcast.
    """
    tokens = _tokens(df, key, text).filter("error IS NULL")
    exact = F.col("token").rlike(EXACT)
    token = F.col("token")
    dash, plus = F.instr(token, F.lit("-")) > 0, token.endswith("+")
    left = F.trim(F.substring_index(token, "-", 1))
    right = F.trim(F.substring_index(token, "-", -1))
    plain = F.regexp_replace(token, r"\+$", "")
    high, low, mark = _bounds(F.when(dash, left).otherwise(plain))
    high2, low2, _ = _bounds(right)
    pair = high == low
    # A run moves both ranks together, except that ace-x moves the kicker only.
    fixed_ace = ~pair & (high == 14) & (~dash | (high2 == 14))
    first = F.when(dash, F.least(high, high2)).otherwise(high)
    last = F.when(dash, F.greatest(high, high2)).when(plus, F.lit(14)).otherwise(high)
    kick_first = F.when(dash, F.least(low, low2)).otherwise(low)
    kick_last = F.when(dash, F.greatest(low, low2)).when(plus, F.lit(13)).otherwise(low)
    gap = high - low
    steps = F.when(
        fixed_ace, F.transform(F.sequence(kick_first, kick_last), lambda k: F.struct(F.lit(14).alias("high"), k.alias("low")))
    ).otherwise(
        F.filter(
            F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("high"), (t - gap).alias("low"))),
            lambda s: s["low"] >= 2,
        )
    )
    spelled = tokens.filter(~exact).withColumn("_step", F.explode(steps)).select(
        key, "token_index", F.col("_step.high").alias("high"), F.col("_step.low").alias("low"),
        F.when(pair, F.array(F.lit(False))).when(mark == "s", F.array(F.lit(True)))
        .when(mark == "o", F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False))).alias("_suits"),
    ).withColumn("suited", F.explode("_suits")).drop("_suits")
    dimension = F.broadcast(C.combo_dimension(df.sparkSession))
    by_rank = spelled.join(dimension, ["high", "low", "suited"])
    single = tokens.filter(exact).withColumn(
        "mask",
        C.card_bit(F.substring("token", 1, 2)).bitwiseOR(C.card_bit(F.substring("token", 3, 2))),
    ).select(key, "token_index", "mask").join(dimension, "mask")
    columns = [key, "mask", "first", "second", "hand_class", "token_index"]
    both = by_rank.select(*columns).unionByName(single.select(*columns))
    return both.groupBy(key, "mask", "first", "second", "hand_class").agg(F.min("token_index").alias("position"))


def range_difference(left: DataFrame, right: DataFrame, on: Sequence[str] = ("mask",)) -> DataFrame:
    """Combos of `left` that `right` does not hold; the order column of `left` stays."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def class_combos(df: DataFrame, klass: str) -> DataFrame:
    """Expand hand-class rows ('AA', 'AKs', 'AKo', 'AK', 'AhKh') to their combos."""
    label = F.trim(F.col(klass))
    combos = C.combo_dimension(df.sparkSession)
    keyed = combos.withColumn(
        "_labels",
        F.array(
            F.col("hand_class"),
            F.concat("first", "second"),
            F.when(F.col("high") != F.col("low"), F.substring("hand_class", 1, 2)),
        ),
    )
    keyed = keyed.withColumn("_label", F.explode(F.array_distinct(F.array_compact("_labels")))).drop("_labels")
    return df.withColumn("_label", label).join(F.broadcast(keyed), "_label").drop("_label")


def compatible(df: DataFrame, combos: str, excluded: str) -> Column:
    """Masks of `combos` (array) that share no card with the `excluded` mask."""
    return F.filter(F.col(combos), lambda m: m.bitwiseAND(F.col(excluded)) == 0)


def open_pairings(hands: DataFrame, key: str, mine: str, board: str) -> DataFrame:
    """Opponent combos left for every hand: those that meet neither the hand nor the board."""
    spread = hands.select("*", F.explode(C.pair_masks()).alias("rival_mask"))
    return spread.filter(F.col("rival_mask").bitwiseAND(F.col(mine).bitwiseOR(F.col(board))) == 0)


def weighted_strategy(df: DataFrame, keys: Sequence[str], klass: str, freqs: str) -> DataFrame:
    """Combo-weighted mean of action maps. A class without actions does not count; a missing action counts 0."""
    held = df.filter(F.size(freqs) > 0).withColumn("_w", C.combo_weight(F.col(klass)).cast("double"))
    total = held.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    actions = held.select(*keys, "_w", F.explode(freqs).alias("action", "_f"))
    summed = actions.groupBy(*keys, "action").agg(F.sum(F.col("_w") * F.col("_f")).alias("_sum"))
    return summed.join(total, list(keys)).select(*keys, "action", (F.col("_sum") / F.col("_total")).alias("frequency"))


def class_means(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Mean vector per group, position by position."""
    long = df.select(*keys, F.posexplode(values).alias("position", "_v"))
    means = long.groupBy(*keys, "position").agg(F.avg("_v").alias("mean"))
    return means


def column_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """As `class_means` for a vector of the columns `values`: rows are added up as they are, only the means are multiplied."""
    means = df.groupBy(*keys).agg(*[F.avg(v).alias(f"_mean{i}") for i, v in enumerate(values)])
    return means.select(*keys, F.posexplode(F.array(*[f"_mean{i}" for i in range(len(values))])).alias("position", "mean"))


def chart_lookup(requests: DataFrame, chart: DataFrame, cells: Sequence[str], klass: str) -> DataFrame:
    """Frequency of every requested (cell, class): absent class 0.0, absent cell an error text.

    `chart` has one row per cell and class with a `frequency`; it is left to the optimizer to
    broadcast it when it is small.
    """
    known = chart.select(*cells).distinct().withColumn("_cell", F.lit(True))
    out = requests.join(known, list(cells), "left").join(chart.select(*cells, klass, "frequency"), [*cells, klass], "left")
    return out.select(
        *requests.columns,
        F.when(F.col("_cell"), F.coalesce("frequency", F.lit(0.0))).alias("frequency"),
        F.when(F.col("_cell").isNull(), F.lit("chart_cell_missing")).alias("error"),
    )


def chart_grid(chart: DataFrame, cells: Sequence[str], klass: str) -> DataFrame:
    """Every cell with all 169 hand classes, absent ones 0.0."""
    ranks = C.RANKS[::-1]
    classes = []
    for i, a in enumerate(ranks):
        for j, b in enumerate(ranks):
            classes.append(a + a if i == j else a + b + "s" if i < j else b + a + "o")
    full = chart.select(*cells).distinct().withColumn(klass, F.explode(F.split(F.lit(",".join(classes)), ",")))
    return full.join(chart, [*cells, klass], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))
