"""Near duplicates by SimHash: exact comparison of fingerprint tiles, grouped into components.

1. Every document gets a 64-bit fingerprint of its word shingles; equal fingerprints become one row.
2. Two fingerprints at most r bits apart agree in at least one of r + 1 bit bands, so only fingerprints of the same
   band value need to meet. A group is cut into tiles by population count and a digest, as many as its size asks
   for, and a tile pair is skipped when the population counts differ by more than r.
3. A task compares a pair of tiles with exclusive-or and bit counts in numpy, and reports the links as a spanning
   forest: every group of copies stays whole without its pairs being written.
4. Components come from alternating star contraction over tables in the shared folder.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; rows without a doc_id
keep their fingerprint, link others, and are ignored when the smallest id is taken (component_id is null when a
component has no id at all); repeated rows stay repeated; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltmill.llm.common import identity, wrapped
from feltmill.session import stored

BITS = 64
TILE = 1024
SEED = 42


def fingerprint_of(text: str | None, words: int) -> int:
    """Majority bits of the XXH64 digests of all word shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    count, ones = len(tokens) - width + 1, np.zeros(BITS, np.int64)
    for low in range(0, count, 1 << 16):
        high = min(count, low + (1 << 16))
        pairs = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist(), strict=True)
        digests = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, high - low)
        ones += np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, __doc, __text_key, __fp): the fingerprint as a signed long."""
    names = ["doc_id", "__doc", "__text_key", "__fp"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py(), words) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found.view(np.int64))], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), "text")
    return source.mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands over all bits."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _band_value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def band_values(fp: str, radius: int) -> Column:
    """An array of (band, value) structs of a fingerprint; two at most `radius` bits apart agree in at least one."""
    return F.array(*[F.struct(F.lit(i).alias("band"), _band_value(F.col(fp), *b).alias("value")) for i, b in enumerate(_bands(radius))])


def _forest(one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (one[i], two[i]), as many as join the same values."""
    values, ends = np.unique(np.concatenate([one, two]), return_inverse=True)
    a, b = ends[: len(one)], ends[len(one) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return [(int(values[r]), int(values[i])) for i, r in enumerate(root) if r != i]


def tile_links(one: np.ndarray, two: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of one value of each tile that differs in 1 to `radius` bits."""
    counts = np.bitwise_count(one), np.bitwise_count(two)
    if not len(one) or not len(two) or int(counts[0].min()) - int(counts[1].max()) > radius or int(counts[1].min()) - int(counts[0].max()) > radius:
        return one[:0], two[:0]
    apart = np.bitwise_count(one[:, None] ^ two[None, :])
    i, j = np.nonzero((apart <= radius) & (apart > 0))
    return one[i], two[j]


def _compare(radius: int):
    names = ["__a", "__b"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for own, other in zip(batch.column(0), batch.column(1), strict=True):
                one = own.values.to_numpy().view(np.uint64)
                two = one if not other.is_valid else other.values.to_numpy().view(np.uint64)
                a, b = tile_links(one, two, radius)
                for x, y in _forest(a.view(np.int64), b.view(np.int64)) if len(a) else ():
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=names)

    return rows


def fingerprint_links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(__a, __b) over a table of distinct __fp: links that join exactly what the radius joins."""
    fp = F.col("__fp")
    banded = distinct.select("__fp", F.explode(band_values("__fp", radius)).alias("g")).select("__fp", F.col("g.band").alias("__band"), F.col("g.value").alias("__value"))
    group = ["__band", "__value"]
    large = banded.groupBy(*group).agg(F.count("*").alias("__size")).filter(F.col("__size") > tile)
    # a group within one tile has the tile (-1, 0); a larger one is cut by population count and digest
    cut = F.pmod(F.xxhash64("__fp"), F.ceil(F.col("__size") / tile))
    tiles = (
        banded.join(large, group, "left")
        .select("__fp", *group, F.when(F.col("__size").isNull(), F.lit(-1)).otherwise(F.bit_count(fp)).alias("__ones"), F.coalesce(cut, F.lit(0)).alias("__cut"))
        .groupBy(*group, "__ones", "__cut")
        .agg(F.sort_array(F.collect_list("__fp")).alias("__own"))
        .filter((F.col("__ones") >= 0) | (F.size("__own") > 1))
    )
    tiles = stored(tiles, "tiles")
    alone = tiles.select("__own", F.lit(None).cast("array<long>").alias("__other"))
    split = tiles.filter("__ones >= 0")
    other = split.select(*group, F.col("__ones").alias("__ones2"), F.col("__cut").alias("__cut2"), F.col("__own").alias("__other"))
    after = (F.col("__ones2") > F.col("__ones")) | (F.col("__ones2") == F.col("__ones")) & (F.col("__cut2") > F.col("__cut"))
    near = F.col("__ones2") - F.col("__ones") <= radius
    pairs = split.join(other, group).filter(after & near)
    dealt = pairs.repartition(*group, "__ones", "__cut", "__ones2", "__cut2").select("__own", "__other")
    return alone.unionByName(dealt).mapInArrow(_compare(radius), "__a long, __b long").distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(__node, __root) of every value that has a link: the smallest value its links reach.

    Alternates large and small stars until nothing changes; each round is a table in the shared folder.
    """
    edges = stored(links.select(F.greatest("__a", "__b").alias("u"), F.least("__a", "__b").alias("v")).filter("u <> v").distinct(), label)

    def tally(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = tally(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        edges = stored(small, label)
        now = tally(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("__node"), F.col("v").alias("__root"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, __doc, __text_key, __fp, __root, component_id) of every document."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    held = marked.groupBy("__fp").agg(F.min("doc_id").alias("__least"))
    roots = components(fingerprint_links(held.select("__fp"), radius, tile))
    placed = held.join(roots, F.col("__fp") == F.col("__node"), "left").select("__fp", "__least", F.coalesce("__root", "__fp").alias("__root"))
    placed = stored(placed, "placed")
    named = placed.groupBy("__root").agg(F.min("__least").alias("component_id"))
    return marked.join(placed.join(named, "__root").drop("__least"), "__fp", "left")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component: the smallest doc_id (missing: after all others), then the smallest text digest.

    Of rows that repeat both the id and the text of the one that stays, one is taken.
    """
    found = near_duplicates(docs, words, radius)
    kept = found.groupBy("__root").agg(F.min(F.struct("__doc", "__text_key")).alias("k")).select("k.*")
    return wrapped(docs).join(kept, ["__doc", "__text_key"], "left_semi").dropDuplicates(["__doc", "__text_key"]).select("__row.*")
