"""Links between like vectors of one label: random-hyperplane sign hashing in several tables, verified, in components.

1. Equal vectors of a label are one row with a count, combined before the shuffle: a third of all rows may be one vector.
2. A vector's signature in a table is the row of its signs against the table's hyperplanes. Two vectors at an angle t
   agree in one sign with probability 1 - t / pi. `table_plan` takes as many signs as keep chance meetings rare among
   the vectors of the largest label, and as many tables as the wanted recall at the threshold needs.
3. Vectors meet in the groups of equal label and signature; groups of one are dropped before any vector moves. Large
   groups are cut into tiles by digest, and pairs of tiles are dealt out.
4. A task settles a tile pair by exact cosines. A pair counts only in the first table in which it meets, so sums over
   all tables count every pair once. Links leave as a spanning forest with sums per vector, never as pairs.
5. Components come from the star contraction over tables in the shared folder.

Defined cases: a row whose label is null, or whose vector is null, empty, zero or holds a null or non-finite component,
links with nothing and is its own component; vectors of different length never meet; rows that repeat a vector and
label are linked to each other; a row without vec_id takes part, but names no component (component_id is null when no
member has an id, and kept is false); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltmill.llm.simhash_tiles import _forest, components
from feltmill.session import stored

THRESHOLD = 0.93
#: Chance of finding a pair that lies at the threshold itself; nearer pairs are found more surely.
RECALL = 0.999
#: Signs beyond the logarithm of the largest label's size: 2**-SPARE_SIGNS chance partners are expected in a group.
SPARE_SIGNS = 2
TILE = 512
SEED = 11


def table_plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, signs) for as many vectors under one label."""
    signs = min(62, max(4, math.ceil(math.log2(max(vectors, 1))) + SPARE_SIGNS))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet))), signs


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """The rows at length one, in double precision; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link: a label, and a vector of finite components that are not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return label.isNotNull() & F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _signatures(tables: int, signs: int):  # noqa: ANN202
    names, planes = ["__class", "__signs"], {}

    def of(vectors: np.ndarray) -> np.ndarray:
        width = vectors.shape[1]
        if width not in planes:
            planes[width] = np.random.default_rng([SEED, width]).standard_normal((width, tables * signs))
        bits = (unit_rows(vectors) @ planes[width] >= 0).reshape(len(vectors), tables, signs)
        return bits @ (1 << np.arange(signs, dtype=np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                lists = part.column(1)
                width = lists.value_lengths().to_numpy()
                found = np.empty((part.num_rows, tables), np.int64)
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    found[at] = of(lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), w).astype(np.float64))
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * tables
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, found.ravel())], names=names)

    return rows


class _Tile:
    """The members of one tile: class ids, counts, unit vectors and signatures."""

    def __init__(self, members: pa.StructScalar) -> None:
        rows = members.values
        self.ids = rows.field("__class").to_numpy()
        self.times = rows.field("__n").to_numpy()
        count = len(self.ids)
        self.unit = unit_rows(rows.field("__vector").flatten().to_numpy().reshape(count, -1).astype(np.float64))
        self.signs = rows.field("__signs").flatten().to_numpy().reshape(count, -1)


def _links(one: _Tile, two: _Tile, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked pairs that meet in no table before this one; within one tile only i < j."""
    i, j = np.nonzero(one.unit @ two.unit.T >= threshold)
    if one is two:
        i, j = i[i < j], j[i < j]
    for earlier in range(table):
        fresh = one.signs[i, earlier] != two.signs[j, earlier]
        i, j = i[fresh], j[fresh]
    return i, j


def _verify(threshold: float):  # noqa: ANN202
    names = ["__a", "__b", "__n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, null) for a link of the forest, (a, null, n) for n vectors linked to class a."""
        for batch in batches:
            for table, own, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                one = _Tile(own)
                two = _Tile(other) if other.is_valid else one
                i, j = _links(one, two, table, threshold)
                if not len(i):
                    continue
                edges = _forest(one.ids[i], two.ids[j])
                sums = [np.bincount(at, weights=times, minlength=size).astype(np.int64) for at, times, size in ((i, two.times[j], len(one.ids)), (j, one.times[i], len(two.ids)))]
                ids, total = np.concatenate([one.ids, two.ids]), np.concatenate(sums)
                met = total > 0
                blank, left = [None] * int(met.sum()), [a for a, _ in edges]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(left + ids[met].tolist(), pa.int64()),
                        pa.array([b for _, b in edges] + blank, pa.int64()),
                        pa.array([None] * len(edges) + total[met].tolist(), pa.int64()),
                    ],
                    names=names,
                )

    return rows


def _class(vector: Column, label: Column) -> Column:
    return F.xxhash64(label, F.size(vector), vector)


def linked_classes(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(__class, __n_links, __component) of every different vector of (__id, __vector, __label), all of them usable."""
    key = _class(F.col("__vector"), F.col("__label")).alias("__class")
    kinds = rows.groupBy(key).agg(F.first("__label").alias("__label"), F.first("__vector").alias("__vector"), F.count("*").alias("__n"), F.min("__id").alias("__least"))
    kinds = stored(kinds, "vectors")
    largest = kinds.groupBy("__label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables, signs = table_plan(largest, threshold, recall)
    signed = stored(kinds.select("__class", "__vector").mapInArrow(_signatures(tables, signs), "__class long, __signs array<long>"), "signatures")

    group = ["__label", "__size", "__table", "__sign"]
    placed = kinds.select("__class", "__label", F.size("__vector").alias("__size")).join(signed, "__class")
    entries = placed.select("__class", "__label", "__size", F.posexplode("__signs").alias("__table", "__sign"))
    several = entries.groupBy(*group).agg(F.count("*").alias("__met")).filter("__met > 1")
    members = entries.join(several, group).select("__class", *group, "__met")
    cut = F.pmod(F.xxhash64("__class"), F.ceil(F.col("__met") / tile)).alias("__cut")
    whole = kinds.join(signed, "__class").select("__class", "__n", "__vector", "__signs")
    tiles = members.join(whole, "__class").groupBy(*group, (F.col("__met") > tile).alias("__split"), cut)
    tiles = stored(tiles.agg(F.collect_list(F.struct("__class", "__n", "__vector", "__signs")).alias("__own")), "vector-tiles")
    alone = tiles.select("__table", "__own", F.lit(None).cast(tiles.schema["__own"].dataType).alias("__other"))
    split = tiles.filter("__split").select(*group, "__cut", "__own")
    other = split.select(*group, F.col("__cut").alias("__cut2"), F.col("__own").alias("__other"))
    dealt = split.join(other, group).filter("__cut < __cut2").repartition(*group, "__cut", "__cut2").select("__table", "__own", "__other")
    found = stored(alone.unionByName(dealt).mapInArrow(_verify(threshold), "__a long, __b long, __n long"), "vector-links")

    roots = components(found.filter("__b IS NOT NULL").select("__a", "__b"), "vector-components")
    sums = found.filter("__n IS NOT NULL").groupBy(F.col("__a").alias("__class")).agg(F.sum("__n").alias("__others"))
    own = kinds.select("__class", "__n", "__least").join(roots.withColumnRenamed("__node", "__class"), "__class", "left").join(sums, "__class", "left")
    own = own.select("__class", "__least", F.coalesce("__root", "__class").alias("__root"), (F.coalesce("__others", F.lit(0)) + F.col("__n") - 1).alias("__n_links"))
    own = stored(own, "vector-classes")
    named = own.groupBy("__root").agg(F.min("__least").alias("__component"))
    return own.join(named, "__root").select("__class", "__n_links", "__component")


def link_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(__row, n_links, component_id, kept): every row of `df` in one struct, beside what it is linked with.

    `threshold` must lie above 0 and below 1.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    held = df.select(F.struct("*").alias("__row"))
    of = lambda name: F.col("__row").getField(name)
    held = held.select("__row", of(vec_id).cast("long").alias("__id"), of(vector).alias("__vector"), of(label).alias("__label"))
    held = held.withColumn("__usable", usable(F.col("__vector"), F.col("__label")))
    classes = linked_classes(held.filter("__usable").select("__id", "__vector", "__label"), threshold, recall, tile)
    keyed = held.select("__row", "__id", F.when(F.col("__usable"), _class(F.col("__vector"), F.col("__label"))).alias("__class"))
    joined = keyed.join(classes, "__class", "left")
    # a row with a class has a component, be it without a name; any other is alone
    component = F.when(F.col("__class").isNull(), F.col("__id")).otherwise(F.col("__component"))
    return joined.select("__row", F.coalesce("__n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(False)).alias("kept"))
