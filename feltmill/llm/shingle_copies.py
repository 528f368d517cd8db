"""Near copies by the overlap of their word shingles, exactly: no pair at or above the likeness is missed.

Two texts are linked when the Jaccard likeness of their sets of word shingles is at least 4/5; the linked form components.

1. Shingles are counted over all texts in a sketch of fixed size. Every text becomes the set of its shingle digests, with
   a SimHash fingerprint and a bitmap; equal sets become one row.
2. A pair that is alike enough shares one of its first n - ceil(0.8 n) + 1 digests, in any order of digests that holds
   for all texts. The rarest by the sketch come first, so that a passage that many texts share seldom brings them
   together. The counts decide on the order only, not on the result.
3. Fingerprints share the pairs out. Those at most `radius` bits apart are found by the SimHash tiles (op4, five words)
   and by nothing else; those farther apart, by their first digests. SimHash alone cannot serve a likeness of 0.8:
   fingerprints of such pairs differ in about 10 of 64 bits (up to 19 in one of a thousand pairs), where equal bit bands
   no longer keep unlike texts apart.
4. First candidates: the forest of the SimHash tiles, and the pairs of texts under a first digest that sizes, places and
   bitmaps leave possible; where these are more than twice as many as the texts, every text's smallest partner. Both
   are linear, and most copies come together by them once verified.
5. Pairs left out so far are compared one by one where their texts are not yet in one component: those within the radius
   where a link of the forest was not verified, the others in groups that have more possible pairs. In all steps a
   task compares tiles with exclusive-or and bit counts, by size, so that texts of sizes too far apart never meet; only
   pairs that the bitmaps leave possible leave the task.
6. The digest sets themselves settle every candidate before any component is formed.

Defined cases: null and wordless texts have the empty set and are copies of each other; texts shorter than a shingle
are one shingle; rows without a doc_id come after all others; of rows equal in id and text the first by its other
columns stays; an empty table gives an empty result; columns other than doc_id and text pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltmill.llm.common import identity, shared, small_side, wrapped
from feltmill.llm.simhash_tiles import SEED, band_values, components, fingerprint_links
from feltmill.session import settled, stored

WORDS = 5
#: The least likeness, as a fraction.
PART, WHOLE = 4, 5
TILE = 1024
#: Pairs of fingerprints at most so many bits apart are left to the SimHash tiles.
RADIUS = 4
#: Counters of the sketch, and in how many slices they travel.
SLOTS = 1 << 21
SLICES = 64
BITMAP = 1024


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted XXH64 digests of all word shingles, each once, as signed longs."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    count, digest = len(tokens) - width + 1, xxhash.xxh64_intdigest
    pairs = zip(starts[:count].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, count).view(np.int64))


def first_shingles(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As many of the digests, the rarest first, as two texts alike enough cannot avoid to share one of."""
    if not len(shingles):
        return shingles
    return shingles[np.argsort(counts[_slots(shingles, len(counts))], kind="stable")][: len(shingles) - -(-len(shingles) * PART // WHOLE) + 1]


def _slots(shingles: np.ndarray, count: int) -> np.ndarray:
    """The counter of each digest. Its upper bits, as the lower ones make the bitmap."""
    return (shingles.view(np.uint64) >> np.uint64(24) & np.uint64(count - 1)).astype(np.int64)


def alike(both, one, two):  # noqa: ANN001, ANN201
    """Whether sets of sizes `one` and `two` that share `both` digests are linked; of numbers, arrays or columns."""
    return both * (PART + WHOLE) >= (one + two) * PART


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def shingle_counts(docs: DataFrame, words: int = WORDS, slots: int = SLOTS) -> np.ndarray:
    """In how many texts the shingles of every counter lie; all texts count, and the sketch has the same size for any number."""
    size = slots // SLICES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(slots, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(own, _slots(shingles_of(text.as_py(), words), slots), 1)
        parts = [p for p in range(SLICES) if own[p * size : (p + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([own[p * size : (p + 1) * size].astype(np.uint32).tobytes() for p in parts], pa.binary())], names=["__part", "__counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
        for part, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["__part", "__counts"])

    kind = "__part int, __counts binary"
    total = np.zeros(slots, np.uint32)
    for row in docs.select("text").mapInArrow(rows, kind).repartition("__part").mapInArrow(merged, kind).collect():  # SLICES rows of a fixed size
        total[row["__part"] * size : (row["__part"] + 1) * size] = np.frombuffer(row["__counts"], np.uint32)
    return total


def bitmap_of(shingles: np.ndarray) -> bytes:
    """One bit for each remainder of the digests: whether an odd number of them has it."""
    odd = np.bincount((shingles.view(np.uint64) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def shingle_sets(docs: DataFrame, counts: Callable[[], np.ndarray], words: int = WORDS) -> DataFrame:
    """(__set, __size, __fp, __bits, __least, __first) of every different set: its digest, size, fingerprint, bitmap, smallest row and first shingles."""
    names = ["__doc", "__text_key", "__set", "__size", "__fp", "__bits", "__first"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [shingles_of(t.as_py(), words) for t in part.column(2)]
                keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found), np.uint64, len(found)).view(np.int64)
                prints = np.fromiter((majority(s.view(np.uint64)) for s in found), np.uint64, len(found)).view(np.int64)
                sizes, bits = pa.array([len(s) for s in found], pa.int64()), pa.array(map(bitmap_of, found), pa.binary())
                own = [part.column(0), part.column(1), pa.array(keys), sizes, pa.array(prints), bits, _lists([first_shingles(s, held) for s in found])]
                yield pa.RecordBatch.from_arrays(own, names=names)

    kinds = "__doc long, __text_key long, __set long, __size long, __fp long, __bits binary, __first array<long>"
    marked = docs.select(*identity(), "text").mapInArrow(rows, kinds)
    least = F.min(F.struct("__doc", "__text_key")).alias("__least")
    return marked.groupBy("__set").agg(*(F.first(c).alias(c) for c in ("__size", "__fp", "__bits")), least, F.first("__first").alias("__first"))


def majority(digests: np.ndarray) -> int:
    """SimHash of digests: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(digests), 1 << 16):
        ones += np.unpackbits(digests[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(digests), bitorder="little").view(np.uint64)[0])


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Those of the pairs (__a, __b) whose sets are alike enough, by the sets of their texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles_of(t.as_py(), words) for t in part.column(1)])], names=["__set", "__shingles"])

    pairs = stored(pairs, "pairs")
    need = pairs.select(F.explode(F.array("__a", "__b")).alias("__set")).distinct()
    named = small_side(sets.select("__set", "__least.*").join(need, "__set", "left_semi"), "named")
    texts = docs.select(*identity(), "text").join(named, ["__doc", "__text_key"]).dropDuplicates(["__set"]).select("__set", "text")
    held = stored(texts.mapInArrow(rows, "__set long, __shingles array<long>"), "shingles")
    one = held.select(F.col("__set").alias("__a"), F.col("__shingles").alias("__one"))
    two = held.select(F.col("__set").alias("__b"), F.col("__shingles").alias("__two"))
    same = F.size(F.array_intersect("__one", "__two"))
    return pairs.join(one, "__a").join(two, "__b").filter(alike(same, F.size("__one"), F.size("__two"))).select("__a", "__b")


class _Tile:
    """Members of a tile by size: sets, sizes, places, classes, fingerprints and bitmaps."""

    def __init__(self, members: pa.StructScalar) -> None:
        rows = members.values
        size = rows.field("__size").to_numpy()
        order = np.argsort(size, kind="stable")
        self.size = size[order]
        self.set, self.at, self.kind = (rows.field(c).to_numpy()[order] for c in ("__set", "__at", "__class"))
        self.print = rows.field("__fp").to_numpy()[order].view(np.uint64)
        self.bits = np.frombuffer(b"".join(rows.field("__bits").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)[order]
        self.places = self.size, self.at, np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)


def _ruled(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(fit, apart) of members given as (size, place, ones of the bitmap): whether sizes, places and numbers of ones leave
    the likeness possible, and in how many digests alike sets can differ at most."""
    total = one[0] + two[0]
    apart = total - 2 * (-(-total * PART // (PART + WHOLE)))
    left = np.minimum(one[0] - one[1], two[0] - two[1])
    return alike(left, one[0], two[0]) & (np.abs(one[2] - two[2]) <= apart), apart


def possible(one: _Tile, two: _Tile, radius: int, near: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that sizes, places in the order and bitmaps do not rule out, some rows at a time: of those whose
    fingerprints are at most `radius` bits apart if `near`, else of the others.

    Sets alike enough differ in at most a ninth of their sizes' sum, and no fewer digests differ than bits of the bitmaps.
    """
    for low in range(0, len(one.size), 32):
        high = min(low + 32, len(one.size))
        least, most = -(-one.size[low] * PART // WHOLE), one.size[high - 1] * WHOLE // PART
        a, b = np.searchsorted(two.size, [least, most + 1])
        if a == b:
            continue
        fit, apart = _ruled(tuple(c[low:high, None] for c in one.places), tuple(c[None, a:b] for c in two.places))
        fit &= (np.bitwise_count(one.print[low:high, None] ^ two.print[None, a:b]) <= radius) == near
        i, j = np.nonzero(fit)
        if len(i):
            odd = np.concatenate([np.bitwise_count(one.bits[low + i[k : k + 8192]] ^ two.bits[a + j[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 8192)])
            fit = odd <= apart[i, j]
            yield low + i[fit], a + j[fit]


def _linear(one: _Tile, two: _Tile, radius: int, near: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """All possible pairs if they are at most twice as many as the members; else, for every member of either tile, its
    smallest possible partner in the other if that is smaller than itself, and True: there are more."""
    least = [np.full(len(t.set), np.iinfo(np.int64).max) for t in (one, two)]
    held, count, most = [], 0, 2 * (len(one.set) + len(two.set))
    for i, j in possible(one, two, radius, near):
        np.minimum.at(least[0], i, two.set[j])
        np.minimum.at(least[1], j, one.set[i])
        count += len(i)
        if count <= most:
            held.append((one.set[i], two.set[j]))
    if count > most:
        held = [(low[low < t.set], t.set[low < t.set]) for low, t in zip(least, (one, two), strict=True)]
    return *(np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*held, strict=True) if held else ((), ()))), count > most


def _between(one: _Tile, two: _Tile, radius: int, near: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """All possible pairs of different classes."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in possible(one, two, radius, near):
        fit = one.kind[i] != two.kind[j]
        left.append(one.set[i[fit]])
        right.append(two.set[j[fit]])
    return np.concatenate(left), np.concatenate(right), False


def _pairs_of_two(tiles: pa.ListArray, radius: int, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """The possible pairs of tiles that have two members, all at once."""
    rows = tiles.flatten()
    fields = [rows.field(c).to_numpy() for c in ("__set", "__size", "__at")]
    bits = np.frombuffer(b"".join(rows.field("__bits").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    (one, two) = ((fields[1][k::2], fields[2][k::2], ones[k::2]) for k in (0, 1))
    fit, apart = _ruled(one, two)
    prints = rows.field("__fp").to_numpy().view(np.uint64)
    fit &= (np.bitwise_count(prints[::2] ^ prints[1::2]) <= radius) == near
    fit &= np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1, dtype=np.int64) <= apart
    return fields[0][::2][fit], fields[0][1::2][fit]


COMPARED = "__a long, __b long, __more long"


def _compared(choose: Callable, radius: int, near: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, null), a < b, and (null, null, shingle) for a group in which there are more."""
        for batch in batches:
            shingle, own, other = batch.columns
            two = pc.and_(pc.equal(pc.list_value_length(own), 2), pc.is_null(other))
            found, more = [_pairs_of_two(own.filter(two), radius, near)], []
            for at in np.flatnonzero(~two.to_numpy(zero_copy_only=False)).tolist():
                one = _Tile(own[at])
                a, b, rest = choose(one, _Tile(other[at]) if other[at].is_valid else one, radius, near)
                found.append((a, b))
                if rest:
                    more.append(shingle[at].as_py())
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            blank = pa.nulls(len(more), pa.int64())
            columns = [pa.concat_arrays([pa.array(low), blank]), pa.concat_arrays([pa.array(high), blank]), pa.concat_arrays([pa.nulls(len(low), pa.int64()), pa.array(more, pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, names=["__a", "__b", "__more"])

    return rows


def candidates(members: DataFrame, sets: DataFrame, choose: Callable, tile: int = TILE, radius: int = RADIUS, near: bool = False) -> DataFrame:
    """(__a, __b, __more): pairs, a < b, that `choose` takes from the groups of members (__shingle, __n, __set, __at,
    __class), and the shingles of groups from which it left some out. Pairs within the radius only if `near`, else the others only."""
    cut = F.pmod(F.xxhash64("__set"), F.ceil(F.col("__n") / tile))
    full = members.join(sets.select("__set", "__size", "__fp", "__bits"), "__set")
    tiles = full.groupBy("__shingle", (F.col("__n") > tile).alias("__split"), cut.alias("__cut"))
    tiles = stored(tiles.agg(F.collect_list(F.struct("__set", "__size", "__at", "__class", "__fp", "__bits")).alias("__own")), "shingle-tiles")
    alone = tiles.select("__shingle", "__own", F.lit(None).cast(tiles.schema["__own"].dataType).alias("__other"))
    split = tiles.filter("__split").select("__shingle", "__cut", "__own")
    other = split.select("__shingle", F.col("__cut").alias("__cut2"), F.col("__own").alias("__other"))
    dealt = split.join(other, "__shingle").filter("__cut < __cut2").repartition("__shingle", "__cut", "__cut2").select("__shingle", "__own", "__other")
    return alone.unionByName(dealt).mapInArrow(_compared(choose, radius, near), COMPARED).distinct()


def fingerprint_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(__a, __b), a < b: sets linked by SimHash tiles. Equal fingerprints are held against the smallest set that has them."""
    lead = stored(sets.groupBy("__fp").agg(F.min("__set").alias("__lead")), "leads")
    links = fingerprint_links(lead.select("__fp"), radius)
    ends = lead.select(F.col("__fp").alias("__b"), F.col("__lead").alias("__two"))
    linked = links.join(lead, F.col("__a") == F.col("__fp")).select("__b", F.col("__lead").alias("__one")).join(ends, "__b").select("__one", "__two")
    equal = sets.select("__set", "__fp").join(lead, "__fp").select(F.col("__set").alias("__one"), F.col("__lead").alias("__two"))
    return linked.unionByName(equal).select(F.least("__one", "__two").alias("__a"), F.greatest("__one", "__two").alias("__b")).filter("__a < __b").distinct()


def near_members(linked: DataFrame, classes: DataFrame, sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Members of the bit bands in which pairs within the radius may be alike and are of different classes.

    The forest `linked` joins all that the radius joins. Between two classes it then has a link that was not verified at
    either of them, so classes without such a link are whole.
    """
    ends = [classes.select(F.col("__set").alias(c), F.col("__class").alias(k)) for c, k in (("__a", "__one"), ("__b", "__two"))]
    named = linked.join(ends[0], "__a", "left").join(ends[1], "__b", "left")
    named = named.select("__a", "__b", F.coalesce("__one", "__a").alias("__one"), F.coalesce("__two", "__b").alias("__two"))
    named = stored(named, "near-links")
    open_ = named.filter("__one <> __two").select(F.explode(F.array("__one", "__two")).alias("__class")).distinct()
    members = named.select(F.explode(F.array(F.struct(F.col("__a").alias("s"), F.col("__one").alias("c")), F.struct(F.col("__b").alias("s"), F.col("__two").alias("c")))).alias("e"))
    members = members.select(F.col("e.s").alias("__set"), F.col("e.c").alias("__class")).distinct().join(open_, "__class", "left_semi")
    banded = members.join(sets.select("__set", "__fp"), "__set").select("__set", "__class", F.explode(band_values("__fp", radius)).alias("__g"))
    banded = stored(banded.select(F.xxhash64("__g").alias("__shingle"), "__set", "__class"), "near-bands")
    groups = banded.groupBy("__shingle").agg(F.count("*").alias("__n"), F.min("__class").alias("lo"), F.max("__class").alias("hi")).filter("lo <> hi")
    return banded.join(groups, "__shingle").select("__shingle", "__n", "__set", F.lit(0).cast("long").alias("__at"), "__class")


def set_components(docs: DataFrame, words: int = WORDS, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """(__least, __root) of every different shingle set: its smallest row and its component."""
    sets = stored(shingle_sets(docs, shared(docs.sparkSession, shingle_counts(docs, words)), words), "shingle-sets")
    linked = stored(fingerprint_pairs(sets, radius), "fingerprint-pairs")
    entries = sets.select(F.posexplode("__first").alias("__at", "__shingle"), "__set")
    groups = entries.groupBy("__shingle").agg(F.count("*").alias("__n")).filter("__n > 1")
    members = stored(entries.join(groups, "__shingle").select("__shingle", "__n", "__set", F.col("__at").cast("long").alias("__at")), "shingle-members")
    first = stored(candidates(members.withColumn("__class", F.col("__set")), sets, _linear, tile, radius), "first-candidates")
    pairs = first.filter("__more IS NULL").select("__a", "__b").unionByName(linked).distinct()
    links = stored(verified(pairs, sets, docs, words), "first-links")
    left = first.filter("__more IS NOT NULL").select(F.col("__more").alias("__shingle")).distinct()
    classes = components(links).select(F.col("__node").alias("__set"), F.col("__root").alias("__class"))
    placed = members.join(left, "__shingle", "left_semi").join(classes, "__set", "left").withColumn("__class", F.coalesce("__class", "__set"))
    mixed = placed.groupBy("__shingle").agg(F.min("__class").alias("lo"), F.max("__class").alias("hi")).filter("lo <> hi").select("__shingle")
    more = candidates(placed.join(mixed, "__shingle", "left_semi"), sets, _between, tile, radius).select("__a", "__b")
    near = candidates(near_members(linked, classes, sets, radius), sets, _between, tile, radius, near=True).select("__a", "__b")
    more = verified(more.unionByName(near).join(pairs, ["__a", "__b"], "left_anti"), sets, docs, words)
    roots = components(links.unionByName(more)).select(F.col("__node").alias("__set"), "__root")
    return sets.join(roots, "__set", "left").select("__least", F.coalesce("__root", "__set").alias("__root"))


def keep_one(docs: DataFrame, words: int = WORDS, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the smallest doc_id (missing: after all others), then the smallest text digest.

    Of rows that repeat both the id and the text of the one that stays, the first by all other columns. Intermediate
    tables are gone once the kept ids are written.
    """
    spark = docs.sparkSession
    kept = settled(spark, "kept", lambda: set_components(docs, words, tile, radius).groupBy("__root").agg(F.min("__least").alias("k")).select("k.*"))
    rows = wrapped(docs).join(kept, ["__doc", "__text_key"], "left_semi")
    others = [F.col("__row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    return rows.groupBy("__doc", "__text_key").agg(F.min_by("__row", order).alias("__row")).select("__row.*")
