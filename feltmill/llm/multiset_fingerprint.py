"""Homomorphic multiset fingerprints of documents, in DataFrame operations only.

A text is cut into pieces: its paragraphs (lines), and these after marks that end a sentence or clause. Every piece is
hashed to a wide vector, and the fingerprint is the sum of the vectors, each lane modulo 2**20. So the order of pieces
does not matter, equal multisets have equal fingerprints, and a piece is inserted or deleted by adding or subtracting
its vector. Three lanes share a long, with a guard bit above each that takes the carry and is masked away.

Lanes: `WIDE` words of three uniform 20-bit lanes tell multisets apart; 21 words of three lanes count pieces by the
bits of one digest; one word counts pieces. From the counts, twice the count of a bit less the number of pieces is a
random-sign sum, whose products estimate how many pieces two texts have in common: `likeness` is that estimate of
the cosine between the multisets.

Defined cases: a null text is empty; empty pieces do not count, so an empty text has the zero fingerprint, which is 1
like itself and 0 like others; for the successor, rows go by doc_id downwards (missing ids last), rows that repeat an
id by a text digest downwards; a single row succeeds itself; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltmill.session import stored

LANE = 20
STEP = LANE + 1
ONES = sum(1 << (STEP * i) for i in range(3))
MASK = ONES * ((1 << LANE) - 1)
GUARD = ONES << LANE
WIDE, SIGNS = 5, STEP
#: Ends of lines, and blanks after a mark.
CUTS = r"\n|(?<=[.!?;:,|*$%&#]) "
FIRST_ID = -(2**63)


def _masked(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def piece_digests(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), CUTS), lambda p: p != ""), lambda p: F.xxhash64(p))


def _sum(digests: Column, word: int) -> Column:
    """One word of the fingerprint: the sum over all pieces, lane by lane."""

    def term(h: Column) -> Column:
        if word < WIDE:
            return _masked(F.xxhash64(h, F.lit(word)))
        if word < WIDE + SIGNS:
            return F.shiftrightunsigned(h, word - WIDE).bitwiseAND(F.lit(ONES))
        return F.lit(1).cast("long")

    return F.aggregate(digests, F.lit(0).cast("long"), lambda acc, h: _masked(acc + term(h)))


def fingerprint(digests: Column) -> Column:
    """array<long> of WIDE + SIGNS + 1 words from an array of piece digests."""
    return F.array(*[_sum(digests, w) for w in range(WIDE + SIGNS + 1)])


def inserted(one: Column, two: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(one, two, lambda a, b: _masked(a + b))


def deleted(one: Column, two: Column) -> Column:
    """The fingerprint of the first multiset without the pieces of the second."""
    return F.zip_with(one, two, lambda a, b: _masked(a.bitwiseOR(F.lit(GUARD)) - b))


def digits(words: Column) -> Column:
    return F.lower(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def _signs(words: Column) -> Column:
    """63 random-sign sums, each read as a number around zero modulo 2**20."""
    count = F.element_at(words, -1)
    half, full = 1 << (LANE - 1), 1 << LANE

    def lane(i: int) -> Column:
        held = F.transform(F.slice(words, WIDE + 1, SIGNS), lambda w: F.shiftrightunsigned(w, STEP * i).bitwiseAND(F.lit(full - 1)))
        return F.transform(held, lambda c: (F.pmod(2 * c - count + F.lit(half), F.lit(full)) - F.lit(half)).cast("double"))

    return F.concat(*[lane(i) for i in range(3)])


def likeness(one: Column, two: Column) -> Column:
    """0 to 1; exactly 1 for equal fingerprints."""

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(_signs(a), _signs(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    size = F.sqrt(product(one, one) * product(two, two))
    return F.when(one == two, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(one, two) / size)))


def _block(order: Column, edges: list[int]) -> Column:
    """How many edges are at most `order`; looked up in two steps."""
    if not edges:
        return F.lit(0)
    side = 64
    groups = [edges[i : i + side] for i in range(0, len(edges), side)]
    below = lambda values: F.size(F.filter(values, lambda e: e <= order))
    literal = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    group = below(literal([g[0] for g in groups])) - 1
    return F.when(group < 0, F.lit(0)).otherwise(group * side + below(F.get(F.array(*[literal(g) for g in groups]), group)))


def with_successor(docs: DataFrame, value: Column, blocks: int | None = None) -> DataFrame:
    """(__row, __next): every row as a struct, and `value` of the row that follows in descending doc_id, of the first
    row after the last.

    Rows are dealt into blocks of neighbouring ids; a window looks only inside a block, and the first row of each block
    also goes, as a guest, to the end of the block before it. Only ids and block borders are gathered beforehand.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    keys = docs.select(order.alias("__order"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text_key"))
    keys = stored(keys, "order")
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(1, blocks)]
    found = keys.agg(F.percentile_approx("__order", shares, 20 * blocks).alias("e")).first()["e"] if shares else None
    edges = sorted(set(found or []))
    heads = keys.groupBy(_block(F.col("__order"), edges).alias("__block")).agg(F.max(F.struct("__order", "__text_key")).alias("h"))
    first = sorted((r["__block"], r["h"][0], r["h"][1]) for r in heads.collect())  # a row for each block
    before = [b for b, _, _ in first[1:]] + [b for b, _, _ in first[:1]]
    guests = spark.createDataFrame([(b, o, k, to) for (b, o, k), to in zip(first, before, strict=True)], "__block int, __order long, __text_key long, __to int")
    whole = docs.select(F.struct("*").alias("__row"), value.alias("__value"), order.alias("__order"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text_key"))
    placed = whole.withColumn("__block", _block(F.col("__order"), edges)).join(F.broadcast(guests), ["__block", "__order", "__text_key"], "left")
    own = F.struct(F.col("__block").alias("block"), F.lit(0).alias("guest"))
    guest = F.when(F.col("__to").isNotNull(), F.struct(F.col("__to").alias("block"), F.lit(1).alias("guest")))
    placed = placed.withColumn("__place", F.explode(F.array_compact(F.array(own, guest))))
    line = Window.partitionBy("__place.block").orderBy("__place.guest", F.desc("__order"), F.desc("__text_key"))
    return placed.withColumn("__next", F.lead("__value").over(line)).filter("__place.guest = 0").select("__row", "__next")
