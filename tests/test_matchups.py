"""Equity from cards: exact boards against enumeration in Python, sampled boards, suit names, rows without a showdown."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from feltmill.operators import equity as E
from feltmill.operators import snapshots as S

RANKS, SUITS = "23456789TJQKA", "shdc"
DECK = [r + s for r in RANKS for s in SUITS]


def score(cards):
    """The best five of seven as a tuple that compares like the hands."""
    ranks = sorted((RANKS.index(c[0]) for c in cards), reverse=True)
    by_suit = {s: sorted({RANKS.index(c[0]) for c in cards if c[1] == s}, reverse=True) for s in SUITS}

    def straight(values):
        held = {*values} | ({-1} if 12 in values else set())
        return max((top for top in range(3, 13) if all(top - k in held for k in range(5))), default=None)

    flush = next((v for s, v in by_suit.items() if sum(c[1] == s for c in cards) >= 5), None)
    counts = sorted(((ranks.count(r), r) for r in set(ranks)), reverse=True)
    if flush and straight(flush) is not None:
        return 8, straight(flush)
    if counts[0][0] == 4:
        return 7, counts[0][1], max(r for r in ranks if r != counts[0][1])
    if counts[0][0] == 3 and counts[1][0] >= 2:
        return 6, counts[0][1], max(r for n, r in counts[1:] if n >= 2)
    if flush:
        return 5, *flush[:5]
    if straight(ranks) is not None:
        return 4, straight(ranks)
    if counts[0][0] == 3:
        return 3, counts[0][1], *[r for r in ranks if r != counts[0][1]][:2]
    if counts[0][0] == 2 and counts[1][0] == 2:
        pairs = sorted((r for n, r in counts if n == 2), reverse=True)[:2]
        return 2, *pairs, max(r for r in ranks if r not in pairs)
    if counts[0][0] == 2:
        return 1, counts[0][1], *[r for r in ranks if r != counts[0][1]][:3]
    return 0, *ranks[:5]


def enumerated(hero, villain, board):
    left = [c for c in DECK if c not in (*hero, *villain, *board)]
    shares = []
    for run in itertools.combinations(left, 5 - len(board)):
        one, two = score([*hero, *board, *run]), score([*villain, *board, *run])
        shares.append(1.0 if one > two else 0.5 if one == two else 0.0)
    return sum(shares) / len(shares), len(shares)


def computed(spark, rows, **kwargs):
    frame = spark.createDataFrame(rows, "id int, hero array<string>, villain array<string>, board array<string>")
    keyed = frame.withColumn("matchup", E.matchup(F.col("hero"), F.col("villain"), F.col("board")))
    return keyed.join(E.matchup_equities(keyed.select("matchup"), **kwargs), "matchup", "left").orderBy("id").collect()


SPOTS = [
    (["Ah", "As"], ["8c", "3d"], ["Ac", "Kd", "7s", "2h", "2c"]),
    (["Th", "9h"], ["Ad", "Kc"], ["8h", "7d", "2s", "2h"]),
    (["Qs", "Qd"], ["Ah", "5h"], ["9h", "4h", "Qc"]),
    (["2s", "3d"], ["2c", "3h"], ["4s", "5s", "6s"]),
]


def test_exact_boards_are_those_of_enumeration(spark):
    rows = computed(spark, [(i, *spot) for i, spot in enumerate(SPOTS)])
    for row, spot in zip(rows, SPOTS, strict=True):
        want, runouts = enumerated(*spot)
        assert (row.equity, row.runouts, row.spots) == (pytest.approx(want, abs=1e-12), runouts, 1)


def test_spots_that_differ_by_suit_names_are_one(spark):
    hero, villain, board = SPOTS[2]
    rows = []
    for i, order in enumerate(itertools.permutations(SUITS)):
        names = str.maketrans(SUITS, "".join(order))
        rows.append((i, *([c.translate(names) for c in cards] for cards in (hero, villain[::-1], board[::-1]))))
    found = computed(spark, rows)
    assert {r.spots for r in found} == {24} and len({tuple(r.matchup) for r in found}) == 1


def test_early_streets(spark):
    rows = computed(spark, [(0, ["Ah", "As"], ["Kd", "Kc"], []), (1, ["As", "Ah"], ["Kc", "Kd"], []), (2, ["Ah", "Kh"], ["Qs", "Qd"], ["Qh", "Jh"])])
    assert rows[0].equity == rows[1].equity == pytest.approx(0.82, abs=0.04) and rows[0].runouts == 2000
    want, runouts = enumerated(["Ah", "Kh"], ["Qs", "Qd"], ["Qh", "Jh"])
    assert rows[2].equity == pytest.approx(want, abs=1e-12) and rows[2].runouts == runouts == 15180


def test_cards_that_allow_no_showdown(spark):
    ace = ["Ah", "As"]
    bad = [(ace, ["Ah", "2c"], []), (ace, ["??", "2c"], []), (ace, ["2c"], []), (ace, ["2c", "2d"], ["3c"] * 2), (ace, ["2c", "2d"], ["3c", "4c", "5c", "6c", "7c", "8c"]), (ace, ["2c", None], [])]
    rows = computed(spark, [(i, *spot) for i, spot in enumerate(bad)] + [(9, ["10h", "A♠"], ["2C", "2d"], ["", "3c", "4c", "5c"])])
    assert [r.matchup for r in rows[:-1]] == [None] * len(bad) and rows[-1].runouts == 990
    assert computed(spark, []) == []


def test_the_export_takes_equity_from_the_cards(spark):
    cards = {"hero_cards": ["Ah", "As"], "villain_hand": ["8c", "3d"], "board_cards": ["Ac", "Kd", "7s", "2h", "2c"]}
    base = {"row_index": 1, "street": "RIVER", "pot": "300", "to_call": "0", "bootstrap_label": "RAISE", "excluded": "False", "equity_1v1": None, **{k: json.dumps(v) for k, v in cards.items()}}
    rows = [base, {**base, "row_index": 2, "villain_hand": "null"}, {**base, "row_index": 3, "equity_1v1": "0.25"}]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'int' if k == 'row_index' else 'string'}" for k in base))
    found = {r["metadata.hand_id"]: r for r in S.aligned_rows(frame).collect()}
    assert [(found[i]["features.equity_1v1"], found[i]["features.equity_known"]) for i in (1, 2, 3)] == [(1.0, True), (0.5, False), (0.25, True)]
    assert found[1]["features.ev"] == 300.0 and found[1]["features.board_card_count"] == 5
    assert len(found[1].asDict()) == 85
