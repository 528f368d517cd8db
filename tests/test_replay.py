"""Replay: windows, slices and folds agree; text hands and their failures."""

import random

import pytest
from pyspark.sql import functions as F

from feltmill.operators import replay as R
from feltmill.plans import histories
from feltmill.sources import files as I

CLEAN = """## Game: 4 | Hand: 7 ##
wren posts small blind ($50)
Rival posts big blind ($100)
wren calls $50.
Rival checks.
*** FLOP *** [9c, 10h, 8s]
wren bets $120.
Rival raises $360.
wren calls $240.
*** TURN *** [K♦]
wren checks.
Rival checks.
*** RIVER *** [2h]
wren checks.
Rival checks.
wren shows [8h,9s]
Rival shows [8c,Kc]
Rival wins $920.
"""
NO_SHOWDOWN = "## Game: 4 | Hand: 8 ##\nwren posts small blind ($50)\nRival posts big blind ($100)\nwren folds.\n"
THREE = CLEAN.replace("Hand: 7", "Hand: 9").replace("Rival wins", "Third shows [2c,2d]\nRival wins")
SIDE = CLEAN.replace("Hand: 7", "Hand: 10").replace("Rival wins $920.", "side pot $10\nRival wins $920.")
BAD_CARD = CLEAN.replace("Hand: 7", "Hand: 11").replace("[2h]", "[2x]")


def fold(actions, blinds, start):
    """State before every betting action, by walking the hand."""
    seg, bet, pot, levels, out = 0, max([0.0, *blinds]), start, list(blinds), []
    for i, (kind, code, player, amount) in enumerate(actions):
        if kind == "board":
            seg, bet, levels = seg + 1, 0.0, [0.0] * len(levels)
        elif kind == "bet":
            own = levels[player - 1]
            out.append((i, seg, bet, max(0.0, bet - own), pot))
            if code != "f":
                level = bet if code == "cc" or not amount else amount
                pot += max(0.0, level - own)
                levels[player - 1] = max(own, level)
                bet = max(bet, level)
    return out


def test_windows_slices_and_fold_agree(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for hand in range(150):
        actions = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.choices(["bet", "board", "other"], [8, 1, 1])[0]
            code = rng.choice(["f", "cc", "cbr", "cbr"]) if kind == "bet" else None
            amount = rng.choice([None, 0.0, float(rng.randint(1, 60))]) if code == "cbr" else None
            actions.append((kind, code, rng.randint(1, 3), amount))
        want[hand] = fold(actions, [1.0, 2.0, 0.0], 3.0)
        rows += [(hand, i, k, c, p, a, [1.0, 2.0, 0.0][p - 1], 2.0, 3.0) for i, (k, c, p, a) in enumerate(actions)]
    df = spark.createDataFrame(rows, "hand int, i int, kind string, code string, player int, amount double, blind double, max_blind double, start_pot double").repartition(7)
    for slices in (None, F.floor(F.col("i") / 4)):
        out = R.replay_bets(df, ["hand"], ["i"], slices).filter("kind = 'bet'").collect()
        got = {}
        for r in sorted(out, key=lambda r: (r["hand"], r["i"])):
            got.setdefault(r["hand"], []).append((r["i"], r["segment"], r["current_bet"], r["to_call"], r["pot"]))
        assert got == {h: w for h, w in want.items() if w}


@pytest.fixture(scope="module")
def hands(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([CLEAN, NO_SHOWDOWN, THREE, SIDE, BAD_CARD, "no header"])], "id int, text string")
    return R.parse_text_hands(df, ["id"], "wren")


def test_text_hand_outcomes(hands):
    got = {r["id"]: (r["status"], r["rejection_reason"]) for r in hands.collect()}
    assert got == {0: ("ok", None), 1: ("failed", "showdown_missing"), 2: ("failed", "multiway_not_supported"), 3: ("failed", "side_pot_not_supported"), 4: ("failed", "parser_exception"), 5: ("failed", "invalid_hand_header")}
    clean = hands.filter("id = 0").first()
    assert (clean["game_id"], clean["hand_id"], clean["pot_final"], clean["villain_name"]) == (4, 7, 920.0, "Rival")
    assert clean["board"]["flop"] == ["9c", "Th", "8s"] and clean["board"]["turn"] == ["Kd"] and clean["hero_hand"] == ["8h", "9s"]
    assert sorted(clean["active_by_street"]["TURN"]) == ["Rival", "wren"]


def test_hero_replay(hands):
    row = R.replay_hero(hands.filter("id = 0"), "wren").first()
    assert row["replay_status"] == "ok" and row["pot_reconstructed"] == 920.0
    assert [(c["street"], c["hero_action"], c["to_call"], c["pot_before_action"]) for c in row["contexts"]] == [
        ("PREFLOP", "CALL", 50.0, 150.0), ("FLOP", "BET", 0.0, 200.0), ("FLOP", "CALL", 240.0, 680.0), ("TURN", "CHECK", 0.0, 920.0), ("RIVER", "CHECK", 0.0, 920.0)
    ]
    assert len(row["snapshots"]) == 4


@pytest.mark.parametrize("old, new, reason", [("wren calls $50.", "wren calls $40.", "all_in_complex_not_supported"), ("wren calls $50.", "wren calls $60.", "pot_reconstruction_failed"), ("wren calls $50.", "wren checks.", "pot_reconstruction_failed"),
                                              ("Rival raises $360.", "Rival raises $100.", "pot_reconstruction_failed"), ("wren bets $120.", "wren bets", "amount_parse_failed")])
def test_hero_replay_stops(spark, old, new, reason):
    df = spark.createDataFrame([(0, CLEAN.replace(old, new))], "id int, text string")
    row = R.replay_hero(R.parse_text_hands(df, ["id"], "wren"), "wren").first()
    assert (row["replay_status"], row["replay_reason"], row["snapshots"]) == ("failed", reason, [])


def test_history_files(spark, tmp_path):
    (tmp_path / "h.txt").write_text(CLEAN + "\n" + NO_SHOWDOWN + "\n" + THREE, encoding="utf-8")
    out = histories.run_files(spark, str(tmp_path / "h.txt"), "wren")
    assert out.hands.count() == 3
    ledger = sorted((r["stage"], r["status"], r["rejection_reason"]) for r in out.ledger.collect())
    assert ledger == [("parse", "failed", "multiway_not_supported"), ("parse", "failed", "showdown_missing"), ("snapshot", "ok", None)]
    job = out.jobs.first()
    assert job["status"] == "ok" and job["pot"] == 920.0 and job["board"] == ["9c", "Th", "8s", "Kd", "2h"]


HAND = """
variant = "NT"
antes = [0, 0, 0]
blinds_or_straddles = [1, 2, 0]
min_bet = 2
starting_stacks = [200, 180, 150.5]
actions = ["d dh p1 AhKd", "d dh p2 ????", "d dh p3 QsQd", "p3 cbr 6", "p1 f", "p2 cc", "d db 2c7dTh", "p2 cc", "p3 cbr 8.5", "p2 sm", "p2 f"]
players = ["a", "b", "c"]
hand = 12
"""


def test_hand_record_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.phh").write_text(HAND)
    (tmp_path / "many.phhs").write_text("[1]" + HAND.replace("hand = 12", "hand = 13") + "[2]" + HAND.replace("hand = 12", ""))
    (tmp_path / "other.txt").write_text("x")
    records = I.hand_records(spark, str(tmp_path))
    assert sorted(r["hand_id"] for r in records.collect()) == ["12", "13", "2"]
    rows = R.record_decisions(records.filter("hand_id = '12'")).orderBy("action_index").collect()
    assert [(r["normalized_action_4class"], r["to_call"], r["pot_size"], r["street"], r["hero_position"]) for r in rows] == [
        ("RAISE", 2.0, 3.0, "PREFLOP", "BTN"), ("FOLD", 5.0, 9.0, "PREFLOP", "SB"), ("CALL", 4.0, 9.0, "PREFLOP", "BB"), ("CHECK", 0.0, 13.0, "FLOP", "BB"), ("RAISE", 0.0, 13.0, "FLOP", "BTN"), ("FOLD", 8.5, 21.5, "FLOP", "BB")
    ]
    assert rows[1]["hero_cards"] == "Ah Kd" and rows[2]["hero_cards"] == "????" and rows[5]["legal_actions"] == "fold, call 8.5, raise"
    assert rows[3]["action_history"].endswith("p2 cc | d db 2c7dTh") and rows[4]["board_cards"] == "2c 7d Th" and rows[4]["bet_size"] == 8.5
