"""Cards, hand ranking, ranges and texture against plain Python."""

import html
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from feltmill.functions import cards as C
from feltmill.functions import text as X
from feltmill.operators import equity as E
from feltmill.operators import ranges as R


def strength(cards):
    """Best five of the cards as a comparable tuple, by trying every five."""

    def five(hand):
        ranks = sorted((C.RANKS.index(c[0]) + 2 for c in hand), reverse=True)
        groups = sorted(Counter(ranks).items(), key=lambda g: (-g[1], -g[0]))
        shape = [n for _, n in groups]
        order = [r for r, _ in groups]
        flush = len({c[1] for c in hand}) == 1
        high = 5 if ranks == [14, 5, 4, 3, 2] else ranks[0] if ranks[0] - ranks[4] == 4 and len(set(ranks)) == 5 else 0
        if flush and high:
            return (8, high)
        if shape == [4, 1]:
            return (7, *order)
        if shape == [3, 2]:
            return (6, *order)
        if flush:
            return (5, *ranks)
        if high:
            return (4, high)
        return ({(3, 1, 1): 3, (2, 2, 1): 2, (2, 1, 1, 1): 1}.get(tuple(shape), 0), *order)

    return max(five(h) for h in itertools.combinations(cards, 5))


def test_hand_score_orders_like_brute_force(spark):
    rng = random.Random(5)
    hands = [rng.sample(C.DECK, rng.choice([5, 6, 7])) for _ in range(1500)]
    hands += [["Ah", "2h", "3h", "4h", "5h", "Kd", "Kc"], ["Ah", "Kh", "Qh", "Jh", "Th", "9h", "8h"], ["As", "Ad", "Ac", "Ks", "Kd", "Kc", "2h"], ["2s", "2d", "3s", "3d", "4s", "4d", "Ah"], ["As", "2d", "3c", "4h", "5s", "5d", "5c"],
              ["7s", "7d", "7c", "7h", "Ah", "Kd", "Qc"], ["2h", "4h", "6h", "8h", "Th", "Qh", "Ah"]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hands)], "i int, h array<string>").withColumn("m", C.cards_mask(F.col("h")))
    rows = C.with_hand_score(df, "m", "score").withColumn("category", C.category_of(F.col("score"))).collect()
    scored = [(strength(r["h"]), r["score"], r["category"]) for r in rows]
    assert all(C.CATEGORIES[t[0]] == c for t, _, c in scored)
    ordered = sorted(scored)
    for (a, x, _), (b, y, _) in zip(ordered, ordered[1:]):
        assert (x < y) if a < b else (x == y), (a, b, x, y)


def test_multiway_equity_shares(spark):
    df = spark.createDataFrame([(1, ["Ah", "Ad"], ["Kh", "Kd"], ["Ac", "As"], ["2c", "7d", "9s", "Jh"])], "id int, a array<string>, b array<string>, c array<string>, board array<string>")
    for n in ("a", "b", "c", "board"):
        df = df.withColumn(n, C.cards_mask(F.col(n)))
    runs = E.with_runouts(df, "board", ["a", "b", "c"], 1)
    row = E.equity(E.showdown(runs, ["a", "b", "c"]), ["id"], ["a", "b", "c"]).first()
    assert row["runouts"] == 42
    assert row["a_tie"] == row["c_tie"] == 40 and row["b_win"] == 2
    assert abs(row["a_equity"] + row["b_equity"] + row["c_equity"] - 1) < 1e-12


def test_preflop_sampling_is_repeatable_and_sane(spark):
    df = spark.createDataFrame([(1, ["Ah", "Ad"], ["7c", "2d"])], "id int, a array<string>, b array<string>")
    df = df.withColumn("a", C.cards_mask(F.col("a"))).withColumn("b", C.cards_mask(F.col("b")))

    def run(parts):
        boards = E.with_sampled_boards(df.repartition(parts), ["a", "b"], 400, key=["id"])
        assert boards.filter((F.bit_count("full_board") != 5) | (F.col("full_board").bitwiseAND(F.col("a")) != 0)).count() == 0
        return E.equity(E.showdown(boards, ["a", "b"]), ["id"], ["a", "b"]).first()

    assert run(1) == run(7)
    assert 0.8 < run(1)["a_equity"] < 0.97


def test_range_text(spark):
    cases = {"AA": 6, "AKs": 4, "AKo": 12, "AK": 16, "22+": 78, "A5s-A2s": 16, "T9s+": 20, "99-66": 24, "AhKh": 1, "KhAh, AhKh": 1, "ATo+": 48, "QQ+, AK": 34, "J9s-97s": 12, "": 0}
    df = spark.createDataFrame([(k, k) for k in cases], "key string, text string")
    found = {r["key"]: r["count"] for r in R.range_combos(df, "key", "text").groupBy("key").count().collect()}
    assert {k: found.get(k, 0) for k in cases} == cases


def test_canonical_board_is_the_same_for_relabelled_suits(spark):
    rows = [("a", ["Ah", "Kh", "2d"]), ("b", ["As", "Ks", "2c"]), ("c", ["2c", "Ks", "As"]), ("d", ["Ah", "Kd", "2d"])]
    df = spark.createDataFrame(rows, "k string, b array<string>").withColumn("c", C.canonical_board(F.col("b")))
    keys = {r["k"]: r["c"]["key"] for r in df.collect()}
    assert keys["a"] == keys["b"] == keys["c"] != keys["d"]


def test_entities_decode_like_the_standard_library(spark):
    texts = ["a &amp; b", "&lt;action&gt;", "&notit;", "&copy2026", "&#65;&#x42;", "&#x1F600;", "&bogus;", "&amp;lt;", "no reference", "&ampfoo", "&", "&#0;", "x&middot;y&quot", "&NotEqualTilde;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["u"] for r in df.select(X.unescape_entities(F.col("t")).alias("u")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_action_texts(spark):
    cases = {
        "Check": "CHECK", "checks": "CHECK", "x": "CHECK", "k": "CHECK", "Fold": "FOLD", "f": "FOLD", "calls 20": "CALL", "c": "CALL", "Bet 30": "RAISE", "b275": "RAISE", "r 12.5": "RAISE", "all-in": "RAISE",
        "<action>Raise to 12</action>": "RAISE", "24 bb": "RAISE", "17": "RAISE", "shove": "RAISE", "think": None, "": None, "check or call": "CHECK",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", X.action_class(X.clean_action(F.col("t"))).alias("a")).collect()}
    assert got == cases
