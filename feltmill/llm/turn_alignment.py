"""Repair of conversation structure: turns are aligned to an alternating grammar at the least cost.

A conversation should read (s?(ua)+)? in the first letters of its roles. Edits: K keep (0), R give the role user or
assistant (1), D delete (2), I insert an empty user or assistant turn (5); a truncated turn that is not deleted adds 5.
Blank and repeated turns must go. Of the cheapest edits, those whose letters come first in ASCII are taken.

1. Turns are marked by column expressions: blank, repeated (role and text seen earlier; one window over digests) and
   truncated. Only marks, roles and digests move here, never texts.
2. The marks of a conversation stream through one task in order. Target strings of every length are the tails of one
   alternating string, so one Wagner-Fischer table aligns the turns to all of them: the cell (i, r) is the cost of
   aligning the turns from i on to the last r letters. A first pass that leaves the length open gives an incumbent cost
   and what the turns before i cost at least; cells that exceed the incumbent together with that are outside the
   (Ukkonen) band and never filled, so the table grows with the turns, not with their square.
3. Each feasible length that reaches the incumbent, with and without a leading system turn, is traced back to its
   audit, and the audits are compared.
4. The audit joins its conversation's turns as a row before them; texts stream through in order, and a repaired turn
   only lives until it is written or hashed. A conversation of any length costs its marks, one byte a turn, and no text.

Order of turns: by turn (missing first), role, MD5 of the text. Defined cases: a missing role or text counts as one
space; a role whose first letter is none of s, u, a can only be deleted or renamed; a missing conv_id is a conversation
of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltmill.llm.common import BLANKS
from feltmill.session import stored

INSERT, DELETE, RENAME, TRUNCATED = 5, 2, 1, 5
_NEVER = 1 << 60
#: A turn as one number: the first letter of its role, and what is wrong with it.
LETTERS = ("", "s", "u", "a")
_GONE, _CUT = 4, 8
LEGAL = ("su", "ua", "au")


def repaired_role(letter: str) -> str:
    return "user" if letter == "u" else "assistant"


def _due(left: int) -> str:
    """The letter that stands before the last `left` - 1 letters of an alternating string that ends in a."""
    return "a" if left % 2 else "u"


def _match(turn: int, due: str) -> int:
    """Cost of taking a turn for a letter: kept or renamed."""
    if turn & _GONE:
        return _NEVER
    return (0 if LETTERS[turn & 3] == due else RENAME if due != "s" else _NEVER) + (TRUNCATED if turn & _CUT else 0)


def _open_length(turns: bytes) -> tuple[int, list[int]]:
    """The least cost over all lengths, and for every place the least cost of the turns before it."""
    # by what comes next: anything (at the start), u after s, a, u or the end
    start, after_s, a, u = 0, _NEVER, INSERT, 2 * INSERT
    before = [0]
    for turn in turns:
        drop = DELETE
        as_u, as_a = _match(turn, "u"), _match(turn, "a")
        taken_u, taken_a = min(start, after_s, u) + as_u, a + as_a
        start, after_s, a, u = start + drop, min(after_s + drop, start + _match(turn, "s")), min(a + drop, taken_u), min(u + drop, taken_a)
        a, u = min(a, u + INSERT, start + INSERT, after_s + INSERT), min(u, a + INSERT)
        u = min(u, a + INSERT)
        before.append(min(start, after_s, a, u))
    # the end is legal at the start (nothing was kept) and after a
    return min(start, u), before


def _table(turns: bytes, most: int, before: list[int]) -> list[dict[int, int]]:
    """Cells {r: cost} for every place i, within the band."""
    n = len(turns)
    cells: list[dict[int, int]] = [{} for _ in range(n + 1)]
    cells[n] = {r: r * INSERT for r in range((most - before[n]) // INSERT + 1)}
    for i in range(n - 1, -1, -1):
        bound, below, turn, own = most - before[i], cells[i + 1], turns[i], {}
        takes = _match(turn, "u"), _match(turn, "a")
        for r in range(min(below, default=0), max(below, default=-2) + 2):
            cost = min(below.get(r, _NEVER) + DELETE, below.get(r - 1, _NEVER) + takes[r % 2] if r else _NEVER, own.get(r - 1, _NEVER) + INSERT)
            if cost <= bound:
                own[r] = cost
        r = max(own, default=-2) + 1  # a run of insertions may go on beyond the row below
        while r > 0 and own[r - 1] + INSERT <= bound:
            own[r] = own[r - 1] + INSERT
            r += 1
        cells[i] = own
    return cells


def _trace(turns: bytes, cells: list[dict[int, int]], i: int, r: int) -> str:
    """Letters of the cheapest edits from cell (i, r) on; at every step the first letter in ASCII that stays cheapest."""
    out, n = [], len(turns)
    while i < n or r:
        cost = cells[i][r]
        if i < n and cells[i + 1].get(r, _NEVER) + DELETE == cost:
            out.append("D")
            i += 1
        elif r and cells[i].get(r - 1, _NEVER) + INSERT == cost:
            out.append("I")
            r -= 1
        else:
            out.append("K" if LETTERS[turns[i] & 3] == _due(r) else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def align(turns: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of turns given as numbers: place in LETTERS, + _GONE, + _CUT."""
    most, before = _open_length(turns)
    cells = _table(turns, most, before)
    best = min((_trace(turns, cells, 0, r) for r, cost in cells[0].items() if r % 2 == 0 and cost == most), default=None)
    # a kept system turn in front: the turns before it are deleted, the alternating rest is not empty
    for i, turn in enumerate(turns):
        if DELETE * i > most:
            break
        lead = DELETE * i + _match(turn, "s")
        for r, cost in cells[i + 1].items():
            if r % 2 == 0 and r and lead + cost == most:
                audit = "D" * i + "K" + _trace(turns, cells, i + 1, r)
                best = audit if best is None else min(best, audit)
    return most, best


def edits(audit: str, letters: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(edit, role letter due) for every letter of an audit; `letters` yields the first role letters of the turns."""
    due = ""
    for edit in audit:
        own = "" if edit == "I" else next(letters)
        if edit == "D":
            yield edit, ""
            continue
        due = "s" if edit == "K" and own == "s" else "a" if due == "u" else "u"
        yield edit, due


def with_null(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


MARKS = "__conv string, __known boolean, __turn long, __role string, __md5 binary, __blank boolean, __repeated boolean, __cut boolean"


def marked_turns(df: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, role, text) with their digests and faults; the texts are left out."""
    text = F.rtrim("__text", F.lit(BLANKS))
    marked = turn_rows(df).select(
        "__conv", "__known", "__turn", "__role", "__md5", (text == "").alias("__blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("__cut")
    )
    same = Window.partitionBy("__conv", "__known", "__role", "__md5").orderBy(F.col("__turn").asc_nulls_first())
    return marked.withColumn("__repeated", F.row_number().over(same) > 1).select(*[c.split()[0] for c in MARKS.split(", ")])


def turn_rows(df: DataFrame) -> DataFrame:
    """(__conv, __known, __turn, __role, __text, __md5); __known tells a conversation without id from one named by a space."""
    rows = df.select(
        with_null(F.col("conv_id")).alias("__conv"),
        F.col("conv_id").isNotNull().alias("__known"),
        F.col("turn").cast("long").alias("__turn"),
        with_null(F.col("role")).alias("__role"),
        with_null(F.col("text")).alias("__text"),
    )
    return rows.withColumn("__md5", F.unhex(F.md5(F.encode("__text", "UTF-8"))))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield from zip(*(batch.column(c).slice(low, 256).to_pylist() for c in names), strict=True)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
VERDICT = f"__conv string, __known boolean, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
_FLUSH = 4096


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out = [c.split()[0] for c in VERDICT.split(", ")], []

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * len(COUNTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = _runs(batches, ["__conv", "__known", "__turn", "__role", "__blank", "__repeated", "__cut"])
    for (conv, known), turns in groupby(rows, key=lambda r: r[:2]):
        codes, last, low, high, distinct = bytearray(), None, None, None, 0
        blank = duplicate = truncated = illegal = 0
        for _, _, turn, role, is_blank, repeated, cut in turns:
            letter = role[:1]
            illegal += last is not None and last + letter not in LEGAL
            if turn is not None:
                distinct += turn != high
                low, high = turn if low is None else low, turn
            gone = is_blank or repeated
            blank, duplicate, truncated = blank + is_blank, duplicate + (repeated and not is_blank), truncated + (cut and not gone)
            codes.append((LETTERS.index(letter) if letter in LETTERS else 0) + (_GONE if gone else _CUT if cut else 0))
            last = letter
        cost, audit = align(bytes(codes))
        out.append((conv, known, high - low + 1 - distinct if distinct else 0, blank, duplicate, truncated, illegal, cost, audit))
        if len(out) >= _FLUSH:
            yield batch()
            out = []
    if out:
        yield batch()


def verdicts(df: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation of (conv_id, turn, role, text)."""
    order = ["__conv", "__known", F.col("__turn").asc_nulls_first(), "__role", "__md5"]
    return marked_turns(df).repartition("__conv", "__known").sortWithinPartitions(*order).mapInArrow(_verdicts, VERDICT)


def _with_audits(df: DataFrame, found: DataFrame) -> DataFrame:
    """Turns in order, each conversation's audit in a row before them."""
    turns = turn_rows(df).withColumn("__audit", F.lit(None).cast("string"))
    names = ["__conv", "__known", "__turn", "__role", "__md5", "__text", "__audit"]
    lead = found.select("__conv", "__known", F.col("audit").alias("__audit"))
    both = turns.select(*names).unionByName(lead, allowMissingColumns=True)
    order = ["__conv", "__known", F.col("__audit").isNull(), F.col("__turn").asc_nulls_first(), "__role", "__md5"]
    return both.repartition("__conv", "__known").sortWithinPartitions(*order).select("__conv", "__known", "__turn", "__role", "__text", "__audit")


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(turn or None, role, text, edit) of one conversation's rows, the audit first; deleted turns are left out."""
    audit, held = next(rows)[5], []

    def letters() -> Iterator[str]:
        for row in rows:
            held[:] = [row]
            yield row[3][:1]

    for edit, due in edits(audit, letters()):
        if edit == "I":
            yield None, repaired_role(due), "", edit
        elif edit != "D":
            _, _, turn, role, text, _ = held[0]
            yield turn, role if edit == "K" else repaired_role(due), text, edit


ROWS = "conv string, known boolean, place long, turn long, role string, text string, edit string"


def _streamed(make: Callable, kinds: list[pa.DataType], names: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (conv, known), rows in groupby(_runs(batches, ["__conv", "__known", "__turn", "__role", "__text", "__audit"]), key=lambda r: r[:2]):
            for row in make(conv, known, _repaired(rows)):
                out.append(row)
                size += sum(len(v) for v in row if isinstance(v, str)) + 64
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _digest(conv: str, known: bool, turns: Iterator[tuple]) -> Iterator[tuple]:
    digest, between = hashlib.sha256(), ""
    for _, role, text, _ in turns:
        digest.update(f"{between}{role}:{text}".encode())
        between = "\n"
    yield conv, known, digest.hexdigest()


def repair_digests(df: DataFrame) -> DataFrame:
    """(__conv, __known, counts, audit, repaired_sha256) of every conversation that has a turn."""
    found = stored(verdicts(df), "verdicts")
    hashes = _with_audits(df, found).mapInArrow(_streamed(_digest, [pa.string(), pa.bool_(), pa.string()], ["__conv", "__known", "repaired_sha256"]), "__conv string, __known boolean, repaired_sha256 string")
    return found.join(hashes, ["__conv", "__known"])


def repaired_turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit) of the repaired conversations: inserted turns have no turn and empty text."""

    def numbered(conv: str, known: bool, turns: Iterator[tuple]) -> Iterator[tuple]:
        for place, (turn, role, text, edit) in enumerate(turns):
            yield conv, known, place, turn, role, text, edit

    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    rows = _with_audits(df, verdicts(df)).mapInArrow(_streamed(numbered, kinds, [c.split()[0] for c in ROWS.split(", ")]), ROWS)
    conv = F.when(F.col("known"), F.col("conv"))
    return rows.select(conv.cast(df.schema["conv_id"].dataType).alias("conv_id"), "place", "turn", "role", "text", "edit")
