"""Hard negatives from candidate blocks in Hilbert order, read where interval arithmetic says they can matter.

Scores are exact inner products of whole-number vectors; higher come first, ties by the smaller id.

1. Rows are sorted by label, place on a Hilbert curve through the vectors, and id, and cut into blocks of up to `block`
   rows. A block is one Parquet row: its ids, its matrix, and its zone map, the least and largest value in every
   dimension. Anchors are packed the same way, so that the anchors of a pack lie near each other.
2. The zone maps alone, a small part of the blocks' bytes, are held against the anchors, a pack of anchors against a
   page of zone maps at a time. Interval arithmetic bounds the score of any row of a block: an anchor's windows of
   scores need only blocks whose bounds reach into one of them. Blocks wholly inside a window that hold enough rows
   raise its lower end first.
3. (pack, block) pairs that are needed join the packs and the blocks. A task takes its pairs in order of the pack,
   keeps the best rows of every window and gives them out once per pack; a window function settles the best overall.
4. The first search finds every anchor's positives (one open window over the blocks of its label); their scores give
   the windows of the second, over the blocks of all other labels.

The query set is a fixed part of all rows, so the work is anchors times the blocks that cannot be ruled out: every row
for vectors without structure, few for vectors in groups. Nothing is sampled, and no pair of rows leaves a task unless
it is among the best of a window.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no
part, nor do empty vectors; vectors of different length never meet; a row with the anchor's id is not another row;
repeated rows stay repeated; components are taken into +-2**20 first, so that every score fits a long (up to 127
dimensions); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltmill.session import stored

SCALE = 256
REACH = 2**20
BLOCK = 256
PACK = 512
PAGE = 512
#: Levels of the Hilbert curve: so many leading bits of every dimension make the key.
LEVELS = 4
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least SHARE percent of the positive.
SHARE = 80
_OPEN = 2**62


def hilbert_keys(points: np.ndarray, levels: int) -> np.ndarray:
    """Places of whole-number points of [0, 2**levels) on the Hilbert curve, as bytes in order; a row for each point.

    From the top level down, a point's quadrant turns or mirrors what is below it (Skilling's transform, on all points
    at once); the Gray code of the turned bits is the place.
    """
    x = points.T.astype(np.int64).copy()
    for level in range(levels - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[i] ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(levels - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    bits = np.stack([(x >> level & 1).T for level in range(levels - 1, -1, -1)], axis=1)
    return np.packbits(bits.reshape(len(points), -1).astype(bool), axis=1)


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(SCALE * F.greatest(F.least(x.cast("double"), F.lit(float(REACH))), F.lit(-float(REACH)))).cast("int"))


def usable(row_id: Column, vector: Column, label: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return row_id.isNotNull() & label.isNotNull() & F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _with_keys(top: int):  # noqa: ANN202
    shift = max(0, top - LEVELS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__label", "__size", "__id", "__vector", "__key"]
        for batch in batches:
            width, keys = batch.column(1).to_numpy(), [b""] * batch.num_rows
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                points = _matrix(batch.column(3).take(pa.array(at))).astype(np.int64) + (1 << (top - 1))
                for i, key in zip(at.tolist(), hilbert_keys(points >> shift, min(top, LEVELS)), strict=True):
                    keys[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=names)

    return rows


def in_order(rows: DataFrame) -> DataFrame:
    """(__label, __size, __id, __vector) sorted by label and place on the curve, in ranges."""
    most = rows.agg(F.max(F.array_max(F.transform("__vector", lambda x: F.abs(x))))).first()[0] or 0
    top = int(most).bit_length() + 1
    keyed = rows.select("__label", F.size("__vector").alias("__size"), "__id", "__vector")
    keyed = stored(keyed.mapInArrow(_with_keys(top), "__label int, __size int, __id long, __vector array<int>, __key binary"), "hilbert-keys")
    order = ["__label", "__size", "__key", "__id"]
    # the last column only parts rows that repeat all else, so that a range never has to hold them all
    dealt = keyed.withColumn("__deal", F.rand(1)).repartitionByRange(*order, "__deal").sortWithinPartitions(*order)
    return dealt.select("__label", "__size", "__id", "__vector")


BLOCKS = "__block long, __label int, __size int, __ids array<long>, __matrix array<int>, __low array<int>, __high array<int>"


def _packed(rows: int):  # noqa: ANN202
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            matrix = _matrix(table.column("__vector").combine_chunks())
            lists = [table.column("__id").to_numpy(), matrix.ravel(), matrix.min(axis=0), matrix.max(axis=0)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            own = [pa.array([v], k) for v, k in ((number, pa.int64()), (table.column("__label")[0].as_py(), pa.int32()), (matrix.shape[1], pa.int32()))]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([v], pa.list_(k)) for v, k in zip(lists, kinds, strict=True))], names=names)

        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            kinds = held.column("__label").to_numpy().astype(np.int64) << 32 | held.column("__size").to_numpy()
            last = np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, held.num_rows)
            low = 0
            for end in last.tolist():
                while end - low >= rows or end - low > 0 and end < held.num_rows:
                    high = min(end, low + rows)
                    yield block(held.slice(low, high - low))
                    low = high
            held = held.slice(low).combine_chunks()
        if held and held.num_rows:
            yield block(held)

    return pack


def packed(rows: DataFrame, count: int, label: str) -> DataFrame:
    """Blocks of up to `count` consecutive rows of one label, with zone maps."""
    return stored(in_order(rows).mapInArrow(_packed(count), BLOCKS), label)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that a row within [low, high] can have, for every anchor (rows) and zone map (columns)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _products(up, low) + _products(down, high), _products(up, high) + _products(down, low)


def _products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers: in doubles where those hold them."""
    most = one.shape[1] * int(np.abs(one).max(initial=0)) * int(np.abs(two).max(initial=0))
    if most < 2**53:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    return one.astype(np.int64) @ two.astype(np.int64).T


class _Pack:
    """Anchors of a pack and their windows: arrays anchors x windows, empty where low > high."""

    def __init__(self, ids: pa.ListScalar, matrix: pa.ListScalar, windows: pa.ListScalar, width: int) -> None:
        self.ids = ids.values.to_numpy()
        self.matrix = matrix.values.to_numpy().reshape(len(self.ids), -1).astype(np.int64)
        self.low, self.high = np.full((len(self.ids), width), _OPEN, np.int64), np.full((len(self.ids), width), -_OPEN, np.int64)
        place, window, low, high = (windows.values.field(c).to_numpy() for c in ("__place", "__window", "__from", "__to"))
        self.low[place, window], self.high[place, window] = low, high


def _floors(width: int, need: int):  # noqa: ANN202
    names = ["__pack", "__place", "__window", "__floor"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A score that at least `need` rows of the page reach, within a window, by their zone maps alone."""
        for batch in batches:
            for at in range(batch.num_rows):
                own, zones = _cell(batch, at, width)
                low, high = bounds(own.matrix, *zones[1:3])
                for w in range(width):
                    sure = (low >= own.low[:, w, None]) & (high <= own.high[:, w, None])
                    some = np.flatnonzero(sure.any(axis=1))
                    if not len(some):
                        continue
                    floor = np.where(sure[some], low[some], -_OPEN)
                    order = np.argsort(-floor, axis=1, kind="stable")
                    floor, held = np.take_along_axis(floor, order, 1), np.cumsum(zones[3][order], axis=1)
                    enough = (held >= need) & (floor > -_OPEN)
                    found = np.flatnonzero(enough.any(axis=1))
                    value = floor[found, enough[found].argmax(axis=1)]
                    columns = [np.full(len(found), batch.column("__pack")[at].as_py()), some[found], np.full(len(found), w), value]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows


def _cell(batch: pa.RecordBatch, at: int, width: int) -> tuple[_Pack, tuple[np.ndarray, ...]]:
    """A pack and the zone maps it meets: block numbers, least and largest values, rows."""
    column = lambda c: batch.column(c)[at]
    zones = column("__zones").values
    limits = (_matrix(zones.field(c)).astype(np.int64) for c in ("__low", "__high"))
    return _Pack(column("__ids"), column("__matrix"), column("__windows"), width), (zones.field("__block").to_numpy(), *limits, zones.field("__rows").to_numpy().astype(np.int64))


def _needed(width: int):  # noqa: ANN202
    names = ["__pack", "__block", "__anchors"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, zones = _cell(batch, at, width)
                low, high = bounds(own.matrix, *zones[1:3])
                meets = np.zeros(low.shape, bool)
                for w in range(width):
                    meets |= (low <= own.high[:, w, None]) & (high >= own.low[:, w, None]) & (own.low[:, w] <= own.high[:, w])[:, None]
                some = np.flatnonzero(meets.any(axis=0))
                places = [np.flatnonzero(meets[:, b]).astype(np.int32) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("__pack")[at].as_py()] * len(some), pa.int64()), pa.array(zones[0][some]), pa.array(places, pa.list_(pa.int32()))], names=names
                )

    return rows


FOUND = "__pack long, __place int, __window int, __score long, __id long"


class _Best:
    """The best rows so far of every window of a pack: up to `count` by score, then id."""

    def __init__(self, pack: int, own: _Pack, count: int) -> None:
        self.pack, self.own, self.count = pack, own, count
        self.key = self.score = self.id = np.zeros(0, np.int64)
        self.worst = np.full(own.low.shape, -_OPEN, np.int64)  # of a full window

    def add(self, places: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        own, width = self.own, self.own.low.shape[1]
        scores = _products(own.matrix[places], matrix)
        other = own.ids[places][:, None] != ids[None, :]
        key, score, row = [self.key], [self.score], [self.id]
        for w in range(width):
            low = np.maximum(own.low[places, w], self.worst[places, w])
            i, j = np.nonzero(other & (scores >= low[:, None]) & (scores <= own.high[places, w][:, None]))
            key.append(places[i].astype(np.int64) * width + w)
            score.append(scores[i, j])
            row.append(ids[j])
        key, score, row = np.concatenate(key), np.concatenate(score), np.concatenate(row)
        if len(key) == len(self.key):
            return
        order = np.lexsort((row, -score, key))
        key, score, row = key[order], score[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        kept = place < self.count
        self.key, self.score, self.id = key[kept], score[kept], row[kept]
        full = place == self.count - 1
        self.worst.reshape(-1)[key[full]] = score[full]

    def batch(self) -> pa.RecordBatch:
        width = self.own.low.shape[1]
        columns = [np.full(len(self.key), self.pack), (self.key // width).astype(np.int32), (self.key % width).astype(np.int32), self.score, self.id]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _read(width: int, count: int):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for at in range(batch.num_rows):
                column = lambda c: batch.column(c)[at]  # noqa: B023, E731
                pack = column("__pack").as_py()
                if best is None or best.pack != pack:
                    if best is not None:
                        yield best.batch()
                    best = _Best(pack, _Pack(column("__ids"), column("__matrix"), column("__windows"), width), count)
                ids = column("__block_ids").values.to_numpy()
                best.add(column("__anchors").values.to_numpy(), ids, column("__block_matrix").values.to_numpy().reshape(len(ids), -1))
        if best is not None:
            yield best.batch()

    return rows


def zone_pages(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps, about PAGE of a label in a row (__label, __size, __page, __zones), and how many pages there are."""
    pages = max(1, math.ceil(blocks.count() / PAGE))
    zone = F.struct("__block", "__low", "__high", F.size("__ids").alias("__rows"))
    page = F.pmod(F.xxhash64("__block"), F.lit(pages)).alias("__page")
    return stored(blocks.groupBy("__label", "__size", page).agg(F.collect_list(zone).alias("__zones")), "zone-maps"), pages


def search(packs: DataFrame, windows: DataFrame, blocks: DataFrame, zones: DataFrame, pages: int, same: bool, width: int, count: int) -> DataFrame:
    """The first `count` rows of every window: (__pack, __place, __window, __score, __id, __rank).

    `windows`: (__pack, __place, __window below `width`, __from, __to), both ends included. Candidates are the rows of
    the anchor's label (`same`) or of all others.
    """
    def cells(limits: DataFrame) -> DataFrame:
        own = packs.join(_by_pack(limits), "__pack").select("__pack", "__label", "__size", "__ids", "__matrix", "__windows")
        if same:
            met = own.join(zones, ["__label", "__size"])
        else:
            own = own.withColumnRenamed("__label", "__own").withColumn("__page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)).cast("array<long>")))
            met = own.join(zones, ["__size", "__page"]).filter("__own <> __label")
        return met.select("__pack", "__ids", "__matrix", "__windows", "__zones")

    # of an anchor's own label one row is the anchor itself
    floors = cells(windows).mapInArrow(_floors(width, count + same), "__pack long, __place long, __window long, __floor long")
    floors = floors.groupBy(F.col("__pack"), F.col("__place").cast("int").alias("__place"), F.col("__window").cast("int").alias("__window")).agg(F.max("__floor").alias("__floor"))
    raised = F.greatest("__from", F.coalesce("__floor", "__from")).alias("__from")
    narrow = stored(windows.join(floors, ["__pack", "__place", "__window"], "left").select("__pack", "__place", "__window", raised, "__to"), "windows")
    needed = stored(cells(narrow).mapInArrow(_needed(width), "__pack long, __block long, __anchors array<int>"), "needed-blocks")
    own = packs.join(_by_pack(narrow), "__pack").select("__pack", "__ids", "__matrix", "__windows")
    read = needed.join(blocks.select("__block", F.col("__ids").alias("__block_ids"), F.col("__matrix").alias("__block_matrix")), "__block")
    dealt = read.join(own, "__pack").repartition("__pack", "__block").sortWithinPartitions("__pack")
    found = dealt.mapInArrow(_read(width, count), FOUND)
    order = Window.partitionBy("__pack", "__place", "__window").orderBy(F.desc("__score"), "__id")
    return found.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= count)


def _by_pack(windows: DataFrame) -> DataFrame:
    return windows.groupBy("__pack").agg(F.collect_list(F.struct("__place", "__window", "__from", "__to")).alias("__windows"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (__id, __vector, __label).

    `rows` hold usable rows with whole-number vectors; `anchors` tells those to mine for.
    """
    rows = rows.select(F.col("__id").cast("long").alias("__id"), "__vector", F.col("__label").cast("int").alias("__label"))
    blocks = packed(rows, block, "blocks")
    packs = packed(rows.filter(anchors), pack, "anchors").withColumnRenamed("__block", "__pack").drop("__low", "__high")
    places = packs.select("__pack", F.posexplode("__ids").alias("__place", "__anchor"))
    whole = places.select("__pack", "__place", F.lit(0).alias("__window"), F.lit(-_OPEN).alias("__from"), F.lit(_OPEN).alias("__to"))
    zones = zone_pages(blocks)
    liked = stored(search(packs, whole, blocks, *zones, True, 1, positives), "positives")
    liked = liked.select("__pack", "__place", (F.col("__rank") - 1).alias("__window"), F.col("__score").alias("positive_score"), F.col("__id").alias("positive_id"))
    # 80 p <= 100 n <= 100 p in whole numbers
    near = liked.select("__pack", "__place", "__window", F.expr(f"({SHARE} * positive_score + pmod(-{SHARE} * positive_score, 100)) div 100").alias("__from"), F.col("positive_score").alias("__to"))
    near = near.filter("__from <= __to")
    found = search(packs, near, blocks, *zones, False, positives, negatives)
    met = found.join(liked, ["__pack", "__place", "__window"]).join(places, ["__pack", "__place"])
    return met.select(F.col("__anchor").alias("anchor_id"), "positive_id", F.col("__rank").alias("rank"), F.col("__id").alias("negative_id"), "positive_score", F.col("__score").alias("negative_score"))
