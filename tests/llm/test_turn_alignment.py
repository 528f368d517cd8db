import hashlib
import itertools
import random
import zlib

import pytest

from feltmill.llm import queries, turn_alignment

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit, repaired lines) by trying all edits; turns are (role, text, gone, cut)."""
    best = {}

    def rest(i, state):
        if (i, state) in best:
            return best[i, state]
        options = []
        if state in "SU" and i == len(turns):
            options.append((0, "", ()))
        inserted = {"S": ("user", "A"), "X": ("user", "A"), "U": ("user", "A"), "A": ("assistant", "U")}[state]
        if room[0] > 0:
            room[0] -= 1
            cost, audit, lines = rest_free(i, inserted[1])
            room[0] += 1
            options.append((cost + 5, "I" + audit, (f"{inserted[0]}:", *lines)))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            cost, audit, lines = rest(i + 1, state)
            options.append((cost + 2, "D" + audit, lines))
            if not gone:
                cost, audit, lines = rest(i + 1, inserted[1])
                same = role[:1] == inserted[0][0]
                options.append((cost + (0 if same else 1) + cut, ("K" if same else "R") + audit, (f"{role if same else inserted[0]}:{text}", *lines)))
                if state == "S" and role[:1] == "s":
                    cost, audit, lines = rest(i + 1, "X")
                    options.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
        out = min(options, default=(10**9, "", ()))
        if room[0] == 2:
            best[i, state] = out
        return out

    def rest_free(i, state):
        return rest(i, state)

    room = [2]  # never more than two insertions in a row, as a pair of them could be left out
    return rest(0, "S")


def code(role, gone, cut):
    letter = role[:1]
    return (turn_alignment.LETTERS.index(letter) if letter and letter in turn_alignment.LETTERS else 0) + (4 if gone else 8 if cut else 0)


def test_every_short_row_of_turns_gets_the_cheapest_first_edits():
    kinds = [(r, g, c) for r in ("system", "user", "assistant", "tool") for g, c in ((False, 0), (True, 0), (False, 5))]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            cost, audit, _ = cheapest([(r, "t", g, c) for r, g, c in turns])
            assert turn_alignment.align(bytes(code(*t) for t in turns)) == (cost, audit), turns


def test_random_longer_rows():
    pick = random.Random(5)
    for _ in range(400):
        turns = [(pick.choice(["system", "user", "user", "assistant", "assistant", "x"]), pick.random() < 0.15, 5 * (pick.random() < 0.2)) for _ in range(pick.randrange(4, 14))]
        cost, audit, _ = cheapest([(r, "t", g, c) for r, g, c in turns])
        assert turn_alignment.align(bytes(code(*t) for t in turns)) == (cost, audit), turns


def test_a_long_conversation_stays_in_its_band():
    pick = random.Random(1)
    turns = bytes(code(("user", "assistant")[i % 2] if pick.random() > 0.1 else "system", pick.random() < 0.05, 5 * (pick.random() < 0.05)) for i in range(20_000))
    most, before = turn_alignment._open_length(turns)
    cells = turn_alignment._table(turns, most, before)
    assert sum(map(len, cells)) < 100 * len(turns)
    cost, audit = turn_alignment.align(turns)
    assert cost == most and len(audit) - audit.count("I") == len(turns)


def brute_force(rows):
    """The query's result for rows (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
            turns += [(turn, "user" if fault == 4 else role, text)] * (fault != 0) * (2 if fault == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).digest()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            bare = text.strip(BLANKS)
            first = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if first:
                counts[first] += 1
            marked.append((role, text, first in ("blank", "duplicate"), 5 * (first == "truncated")))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id long, turn long, role string, text string, __conv int, audit string, copy int, cost string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in queries.repaired_conversations(frame).select(NAMES).collect()), key=str)


@pytest.fixture(scope="module")
def conversations():
    pick = random.Random(9)
    texts = ["Fine.", "Fine.", "No end", "Why? \n", "", " \t\x0b", None, "x" * 50_000 + "!", "a.b", "é!", "! "]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(pick.randrange(1, 9)):
            rows.append((conv, pick.choice([turn, turn, turn, 2 * turn, None]), pick.choice(["user", "assistant", "system", None, "", "Tool"]), pick.choice(texts)))
    return rows + rows[:20]


def test_conversations_with_nulls_ties_and_repeats(spark, conversations):
    assert result(spark, conversations) == brute_force(conversations)


def test_an_empty_table(spark):
    assert result(spark, []) == []


def test_repaired_turns_follow_the_grammar(spark, conversations):
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in conversations], COLUMNS)
    rows = turn_alignment.repaired_turns(frame).orderBy("conv_id", "place").collect()
    for _, turns in itertools.groupby(rows, key=lambda r: r.conv_id):
        turns = list(turns)
        letters = "".join(t.role[0] for t in turns)
        letters = letters.removeprefix("s")
        assert letters == "ua" * (len(letters) // 2) and [t.place for t in turns] == list(range(len(turns)))
        assert all(t.text == "" and t.turn is None for t in turns if t.edit == "I")
