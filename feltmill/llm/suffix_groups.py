"""Removal of long repeated byte strings, with suffix arrays built by linear grouping.

A byte goes if some string of `span` bytes that covers it also starts elsewhere, in this or another text.

1. Anchors. Of the K-grams inside a string of `span` bytes, the one with the least digest (the leftmost of equals) is
   its anchor. Equal strings have equal anchors at equal places, so strings are only ever compared within the group of
   an anchor's digest. An occurrence of an anchor answers for the strings that begin `lo` to `hi` bytes before it;
   the bytes of all of them are its context. Anchors met once are done with.
2. Contexts. Occurrences with equal contexts are one row with a count, combined before the shuffle, so copies cost
   nothing. A context met twice repeats as a whole. Where an anchor has several contexts, their bytes are fetched once
   and they meet in one task, many anchors at a time.
3. Order. The right sides of all contexts of a task, cut into blocks that stand for themselves by rank, form one text;
   its suffix array comes from linear grouping (`suffix_array`): groups of suffixes with a common Lyndon prefix are
   refined in descending order by previous-smaller pointers, then every group's order is emitted in one pass. The left
   sides, reversed, form another. Neighbours in either order give the lengths up to which contexts agree, so that for
   each distance a from the anchor the strings that agree are those equal in (left class at a, right class at span - a).
4. An anchor with more than `large` different contexts is not brought together: its strings are hashed one by one and
   counted by an aggregation that combines before its shuffle.

Building the suffix array of every byte in Python would take several microseconds a byte; ranks of blocks keep the
method and its result, and leave few symbols to sort.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than `span` lose none; rows that repeat
id and text are places of their own and so remove each other's strings; rows without doc_id take part like any other;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltmill.llm.common import identity, small_side
from feltmill.session import stored

SPAN = 200
GRAM = 32
BLOCK = 50
LARGE = 50_000
_TOGETHER = 4_000
#: Text bytes handled at once, besides the text that goes beyond them.
_SLICE = 1 << 21
_SEGMENT = 1 << 23
_LOW = (1 << 24) - 1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes of a row of non-negative numbers in ascending order; a shorter suffix comes first.

    First part: groups lie in an array in ascending order, each named by its first place. They are taken from the top.
    For a member s, the pointer goes to the nearest earlier place whose group is not higher; places between are higher
    and skipped along their own pointers. Members pointing at each other form a chain that ends outside the group, and
    that outside place is followed by the group's prefix as often as the chain is long. So the outside places move,
    the longest chains first, to the upper end of their own group and become groups of their own. In the end a group
    holds the suffixes with one Lyndon prefix.

    Second part: going up the finished order, the suffix before the current one, then the places its pointers lead to,
    have the current suffix as their next smaller one, which decides among members of a group: each takes the first
    free place of its group.
    """
    n = len(text)
    order = np.argsort(np.asarray(text, np.int64), kind="stable")
    symbols = np.asarray(text, np.int64)[order]
    begins = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(begins, sizes)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    row, group, place = order.tolist(), group_of.tolist(), place_of.tolist()
    size = dict(zip(begins.tolist(), sizes.tolist(), strict=True))
    before = [-1] * n
    end = n
    while end:
        top = group[row[end - 1]]
        members = sorted(row[top:end]) if end - top > 1 else row[top:end]
        chains: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > top:
                p = before[p]
            if p >= 0 and group[p] == top:
                p = before[p]  # members come in order, so the pointer of p already leaves the group
            before[s] = p
            if p >= 0:
                chains[p] = chains.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in chains.items():
            moves.setdefault((k, group[p]), []).append(p)
        for key in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            own, moved = key[1], moves[key]
            if len(moved) == size[own]:
                continue
            at = own + size[own]
            for p in moved:
                at -= 1
                here, other = place[p], row[at]
                row[here], row[at], place[other], place[p] = other, p, here, at
            for p in moved:
                group[p] = at
            size[at] = len(moved)
            size[own] -= len(moved)
        end = top
    out = [-1] * n
    free = {g: g for g in size}

    def emit(s: int) -> None:
        while s >= 0 and group[s] >= 0:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            group[s] = -1
            s = before[s]

    emit(n - 1)
    for i in range(n):
        emit(out[i] - 1)
    return out


def _gram_digests(codes: np.ndarray) -> np.ndarray:
    """Digests of all GRAM-byte windows, by doubling."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[2])
    k = 1
    while k < GRAM:
        left, right = h[:-k], h[k:]
        h = left * np.uint64(_ODD[0] + 2 * k) ^ right * np.uint64(_ODD[1]) ^ right >> np.uint64(29)
        k *= 2
    return h ^ h >> np.uint64(31)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    table = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(place, lo, hi, digest) of the anchors of all strings of `span` bytes, by place."""
    if len(raw) < span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    codes = np.frombuffer(raw, np.uint8)
    width = span - GRAM + 1
    found = []
    for low in range(0, len(raw) - span + 1, _SEGMENT):  # strings that begin in this segment
        h = _gram_digests(codes[low : low + _SEGMENT + span - 1])
        # the upper bits of the digest and the place in one number: the least one is the leftmost of the least
        least = _sliding_min((h & np.uint64(~_LOW & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64), width)
        at = (least & np.uint64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        found.append((at[first] + low, at[first] - last, at[first] - first, h[at[first]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` bytes in a text or binary column, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:], strict=False):
        if high > low:
            yield batch.slice(low, high - low)


OCCURRENCE = "__doc long, __text_key long, __pos long, __lo int, __hi int, __anchor long, __context long"


def _occurrences(span: int):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, names = xxhash.xxh3_64_intdigest, [c.split()[0] for c in OCCURRENCE.split(", ")]
        for batch in batches:
            for part in by_bytes(batch, 2):
                found, sizes, contexts = [], [], []
                for text in part.column(2):
                    raw = (text.as_py() or "").encode()
                    own = anchors(raw, span)
                    found.append(own)
                    sizes.append(len(own[0]))
                    contexts += [digest(raw[p - hi : p - lo + span], hi) for p, lo, hi in zip(*(c.tolist() for c in own[:3]), strict=True)]
                place, lo, hi, gram = (np.concatenate(c) for c in zip(*found, strict=True))
                ids = [np.repeat(part.column(i).to_numpy(), sizes) for i in range(2)]
                columns = [*ids, place, lo.astype(np.int32), hi.astype(np.int32), gram.view(np.int64), np.array(contexts, np.uint64).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows


def _fetch(span: int):  # noqa: ANN202
    """(text, list of contexts to cut from it) to a row with its bytes for each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw, own = text.as_py().encode(), wanted.values
                fields = {name: own.field(name) for name in ("__anchor", "__context", "__n", "__d", "__pos", "__lo", "__hi")}
                names = ["__anchor", "__context", "__n", "__d", "__lo", "__hi"]
                for low in range(0, len(own), _TOGETHER):  # contexts of a long text overlap: together they are many times as long
                    part = {c: v.slice(low, _TOGETHER) for c, v in fields.items()}
                    places = zip(*(part[c].to_pylist() for c in ("__pos", "__lo", "__hi")), strict=True)
                    cut = pa.array([raw[p - hi : p - lo + span] for p, lo, hi in places], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in names), cut], names=[*names, "__bytes"])

    return rows


def _agreement(sides: list[bytes], groups: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): places of the sides by group, then bytes, and how many bytes each shares with the one before;
    -1 for the first of a group."""
    n = len(sides)
    sizes = np.array([len(s) for s in sides], np.int64)
    most = max(1, int(-(-sizes.max() // block))) * block
    # the padding is a byte that UTF-8 does not use; NUL, which numpy would strip, is another such byte
    padded = b"".join(s.ljust(most, b"\xff") for s in sides).replace(b"\x00", b"\xfe")
    table = np.frombuffer(padded, np.uint8).reshape(n, most)
    _, ranks = np.unique(table.reshape(-1, block).copy().view(f"S{block}").ravel(), return_inverse=True)
    text = np.zeros((n, most // block + 1), np.int64)  # 0 ends every side
    text[:, :-1] = ranks.reshape(n, -1) + 1
    width = text.shape[1]
    starts = np.array(suffix_array(text.ravel().tolist()), np.int64)
    order = starts[starts % width == 0] // width
    order = order[np.argsort(groups[order], kind="stable")]
    one, two = table[order[:-1]], table[order[1:]]
    differs = one != two
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    shared = np.full(n, -1, np.int64)
    within = groups[order[1:]] == groups[order[:-1]]
    shared[1:] = np.where(within, np.minimum(same, np.minimum(sizes[order[:-1]], sizes[order[1:]])), -1)
    return order, shared


def repeated_distances(groups: np.ndarray, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], span: int = SPAN, block: int = BLOCK) -> np.ndarray:
    """For every context and distance a from its anchor, whether the string that begins a bytes before the anchor
    occurs more than once (bool table). Contexts of a group are different from each other."""
    n = len(contexts)
    right = _agreement([c[h:] for c, h in zip(contexts, hi.tolist(), strict=True)], groups, block)
    left = _agreement([c[:h][::-1] for c, h in zip(contexts, hi.tolist(), strict=True)], groups, block)
    out = np.zeros((n, int(hi.max()) + 1), bool)
    for a in range(out.shape[1]):
        active = np.flatnonzero((lo <= a) & (a <= hi))
        if not len(active):
            continue
        classes = []
        for (order, shared), length in ((left, a), (right, span - a)):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(shared < length)
            classes.append(own[active])
        _, at, times = np.unique(classes[0] * (n + 1) + classes[1], return_inverse=True, return_counts=True)
        out[active, a] = (times[at] > 1) | (counts[active] > 1)
    return out


RUNS = "array<struct<f: int, t: int>>"


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"f": f, "t": t - 1} for f, t in edges.reshape(-1, 2).tolist()]


def _solve(span: int, block: int):  # noqa: ANN202
    kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; whole groups are solved together until there are enough of them."""
        held: list[pa.RecordBatch] = []

        def solved(table: pa.Table) -> pa.RecordBatch:
            c = {n: table.column(n).to_numpy() for n in ("__anchor", "__n", "__lo", "__hi")}
            found = repeated_distances(c["__anchor"], c["__n"], c["__lo"], c["__hi"], table.column("__bytes").to_pylist(), span, block)
            columns = [table.column(n).combine_chunks() for n in ("__anchor", "__context")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([_runs(f) for f in found], kind)], names=["__anchor", "__context", "__runs"])

        waiting = 0
        for whole in batches:
            for low in range(0, whole.num_rows, _TOGETHER):
                held.append(whole.slice(low, _TOGETHER))
                waiting += held[-1].num_rows
                if waiting < _TOGETHER or held[-1].column("__anchor")[0] == held[0].column("__anchor")[0] == held[-1].column("__anchor")[-1]:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column("__anchor").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next slice
                held, waiting = table.slice(cut).to_batches(), table.num_rows - cut
                for first, last in _spans(keys[:cut]):
                    yield solved(table.slice(first, last - first))
        table = pa.Table.from_batches(held) if held else None
        for first, last in _spans(table.column("__anchor").to_numpy()) if table else ():
            yield solved(table.slice(first, last - first))

    return rows


def _spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups, of about _TOGETHER rows each."""
    low = 0
    while low < len(keys):
        high = int(np.searchsorted(keys, keys[min(low + _TOGETHER, len(keys)) - 1], side="right"))
        yield low, high
        low = high


def _strings(span: int):  # noqa: ANN202
    """A row (anchor, context, count, distance, digest) for every string of a context."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, context, n, lo, hi, raw in zip(*(batch.column(c).to_pylist() for c in ("__anchor", "__context", "__n", "__lo", "__hi", "__bytes")), strict=True):
                far = list(range(lo, hi + 1))
                cut = [hashlib.blake2b(raw[hi - a : hi - a + span], digest_size=16).digest() for a in far]
                columns = [[anchor] * len(far), [context] * len(far), [n] * len(far)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array(far, pa.int32()), pa.array(cut, pa.binary())],
                    names=["__anchor", "__context", "__n", "__a", "__string"],
                )

    return rows


def repeated_strings(docs: DataFrame, span: int = SPAN, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """(__doc, __text_key, __starts): runs of places where a repeated string of `span` bytes begins."""
    if not 2 * GRAM <= span < _SEGMENT:
        raise ValueError(f"span must be at least {2 * GRAM}")
    key = ["__anchor", "__context"]
    texts = docs.select(*identity(), "text")
    occurrences = stored(texts.mapInArrow(_occurrences(span), OCCURRENCE), "anchors")
    again = small_side(occurrences.groupBy("__anchor").agg(F.count("*").alias("__n")).filter("__n > 1").select("__anchor"), "anchors-met-again")
    places = occurrences.join(again, "__anchor", "left_semi")
    one = F.min(F.struct("__doc", "__text_key", "__pos", "__lo", "__hi")).alias("__one")
    contexts = stored(places.groupBy(*key).agg(F.count("*").alias("__n"), one), "contexts")
    several = contexts.groupBy("__anchor").agg(F.count("*").alias("__d"))
    sized = contexts.join(several, "__anchor")
    whole = F.array(F.struct(F.col("__one.__lo").alias("f"), F.col("__one.__hi").alias("t")))
    alone = sized.filter("__d = 1").select(*key, whole.cast(RUNS).alias("__runs"))
    wanted = sized.filter("__d > 1").select(*key, "__n", "__d", "__one.*").groupBy("__doc", "__text_key")
    wanted = wanted.agg(F.collect_list(F.struct(*key, "__n", "__d", "__pos", "__lo", "__hi")).alias("__wanted"))
    # of rows that repeat id and text any one serves
    sources = texts.join(wanted, ["__doc", "__text_key"]).select("text", "__wanted")
    cut = sources.mapInArrow(_fetch(span), "__anchor long, __context long, __n long, __d long, __lo int, __hi int, __bytes binary")
    cut = stored(cut, "context-bytes")
    met = cut.filter(F.col("__d") <= large).dropDuplicates(key)
    solved = met.repartition("__anchor").sortWithinPartitions("__anchor", "__context").mapInArrow(_solve(span, block), f"__anchor long, __context long, __runs {RUNS}")
    strings = cut.filter(F.col("__d") > large).dropDuplicates(key).mapInArrow(_strings(span), "__anchor long, __context long, __n long, __a int, __string binary")
    counted = strings.groupBy("__anchor", "__a", "__string").agg(F.sum("__n").alias("__total")).filter("__total > 1")
    spread = strings.join(counted, ["__anchor", "__a", "__string"], "left_semi").groupBy(*key)
    spread = spread.agg(F.collect_set(F.struct(F.col("__a").alias("f"), F.col("__a").alias("t"))).cast(RUNS).alias("__runs"))
    runs = stored(alone.unionByName(solved).unionByName(spread).filter(F.size("__runs") > 0), "runs")
    begun = places.join(runs, key).select("__doc", "__text_key", "__pos", F.explode("__runs").alias("r"))
    starts = F.struct((F.col("__pos") - F.col("r.t")).alias("f"), (F.col("__pos") - F.col("r.f")).alias("t"))
    return begun.groupBy("__doc", "__text_key").agg(F.collect_list(starts).alias("__starts"))


def covered_spans(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes covered by strings that begin in any of the runs of `starts` (rows from, to)."""
    rows = starts[np.argsort(starts[:, 0], kind="stable")]
    reach = np.maximum.accumulate(rows[:, 1] + span)
    breaks = np.flatnonzero(np.concatenate([[True], rows[1:, 0] > reach[:-1]]))
    return list(zip(rows[breaks, 0].tolist(), reach[np.append(breaks[1:], len(rows)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, span: int = SPAN, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """(doc_id, kept, spans, n_bytes): the bytes left of every text, and the runs [from, to) removed from it."""
    found = repeated_strings(docs, span, block, large)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    joined = own.join(found, ["__doc", "__text_key"], "left").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"), "__starts")

    kind = pa.struct([("kept", pa.binary()), ("spans", pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())])))])

    @F.arrow_udf("kept binary, spans array<struct<f: long, t: long>>")
    def cut(raw: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for text, rows in zip(raw, starts, strict=True):
            text, own = text.as_py(), rows.values
            runs = covered_spans(np.stack([own.field("f").to_numpy(), own.field("t").to_numpy()], axis=1).astype(np.int64), span) if rows.is_valid and len(own) else []
            edges = [0, *(e for run in runs for e in run), len(text)]
            out.append({"kept": b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), "spans": [{"f": f, "t": t} for f, t in runs]})
        return pa.array(out, kind)

    # texts that lose nothing do not travel to Python
    none = F.struct(F.col("raw").alias("kept"), F.array().cast("array<struct<f: bigint, t: bigint>>").alias("spans"))
    some = cut.asNondeterministic()(F.col("raw"), F.col("__starts"))
    done = joined.withColumn("__cut", F.when(F.col("__starts").isNull(), none).otherwise(some))
    return done.select("doc_id", "__cut.kept", "__cut.spans", F.octet_length("raw").cast("long").alias("n_bytes"))
