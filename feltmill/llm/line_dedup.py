"""Removal of lines that an earlier document already holds.

Every long enough line sends one row (128-bit key digest, document, position) through a range partition on all of
these columns with the same order inside a partition. A partition then streams its rows: the first document of a
key holds it, the lines of later documents go. Because document and position belong to the range, a key that a
third of all lines share spreads over as many partitions as its rows need; only the first key of a partition can
have begun earlier, and those few lines are settled afterwards from one row per partition border.

The result is a keep bitmap per document, deflated, bit 1 = keep. Documents that lose nothing have no bitmap, and
bits after the last one kept stand for kept lines.

Defined cases: a null text is one empty line; lines whose key is short always stay; rows without a doc_id count as
one document that comes after all others; rows that repeat a doc_id count as one document, and rows that repeat
id and text get the same bitmap; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feltmill.llm.common import BLANKS, identity, wrapped
from feltmill.session import stored

MIN_KEY = 10
GONE, UNSETTLED, HEAD = 1, 0, 2
KEY = ["__h1", "__h2"]
ROW = "__h1 long, __h2 long, __doc long, __text_key long, __pos int"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("__h1", "__h2", "__doc", "__text_key")] + [("__pos", pa.int32())])
_OUT = _SCHEMA.append(pa.field("__state", pa.int32()))
_PIECE = 1 << 16


def line_rows(min_key: int):
    """Batches of (__doc, __text_key, text) to batches of line rows."""
    strip = BLANKS.encode()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        docs, keys, places, digests = [], [], [], []

        def flush() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            columns = [halves[:, 0].copy(), halves[:, 1].copy(), np.array(docs, np.int64), np.array(keys, np.int64)]
            out = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.array(places, np.int32))], schema=_SCHEMA)
            for x in (docs, keys, places, digests):
                x.clear()
            return out

        for batch in batches:
            for doc, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc, key = doc.as_py(), key.as_py()
                for place, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    line = line.strip(strip)
                    # a code point takes four bytes at most, so only lines of a middling length need decoding
                    if len(line) < min_key or len(line) < 4 * min_key and len(line.decode()) < min_key:
                        continue
                    docs.append(doc)
                    keys.append(key)
                    places.append(place)
                    digests.append(digest(line.lower()))
                if len(digests) >= _PIECE:
                    yield flush()
        if digests:
            yield flush()

    return rows


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the sorted rows of one partition; gives the rows that go, those unsettled, and the last key's head."""
    leading = current = None
    holder = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(5)]
        one, two, doc = columns[:3]
        if leading is None:
            leading = (one[0], two[0])
        starts = np.ones(len(one), bool)
        starts[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts[0] = (one[0], two[0]) != current
        at = np.flatnonzero(starts)
        holders = np.concatenate([[holder], doc[at]])[np.cumsum(starts)]
        state = np.full(len(one), -1, np.int32)
        state[(one == leading[0]) & (two == leading[1])] = UNSETTLED
        state[doc != holders] = GONE
        current, holder = (one[-1], two[-1]), holders[-1]
        told = np.flatnonzero(state >= 0)
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(c[told]) for c in (*columns, state)], schema=_OUT)
    if current is not None and current != leading:
        row = [*current, holder, 0, 0, HEAD]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _OUT, strict=True)], schema=_OUT)


@F.pandas_udf(T.BinaryType())
def _bitmap(gone: pd.Series) -> pd.Series:
    def one(places: np.ndarray) -> bytes:
        bits = np.ones(int(places.max()) // 8 * 8 + 8, np.uint8)  # whole bytes, so that the padding keeps, too
        bits[places] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return gone.map(one)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str, packed: bytes | None) -> str:
        if packed is None:
            return t
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
        keep = np.ones(max(len(lines), len(bits)), bool)
        keep[: len(bits)] = bits
        return "\n".join(line for line, k in zip(lines, keep[: len(lines)].tolist(), strict=True) if k)

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(__doc, __text_key, n_dropped, bitmap) of the documents that lose lines."""
    rows = docs.select(*identity(), "text").mapInArrow(line_rows(min_key), ROW)
    order = [*KEY, "__doc", "__text_key", "__pos"]
    told = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(first_occurrences, f"{ROW}, __state int"),
        "line-marks",
    )
    borders = told.filter(F.col("__state") != GONE).groupBy(*KEY).agg(F.min("__doc").alias("__holder"))
    later = told.filter(F.col("__state") == UNSETTLED).join(borders, KEY).filter("__doc <> __holder").drop("__holder")
    gone = told.filter(F.col("__state") == GONE).unionByName(later)
    places = gone.groupBy("__doc", "__text_key").agg(F.collect_set("__pos").alias("__gone"))
    return places.select("__doc", "__text_key", F.size("__gone").cast("long").alias("n_dropped"), _bitmap("__gone").alias("bitmap"))


def marked(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(__row, n_lines, n_dropped): every row with the kept lines as its text, and its lines before and the loss."""
    whole = wrapped(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    text = F.col("__row.text")
    joined = whole.join(keep_bitmaps(docs, min_key), ["__doc", "__text_key"], "left")
    kept = F.when(F.col("bitmap").isNull(), text).otherwise(_kept(text, F.col("bitmap")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.lit(1).cast("long")
    return joined.select(F.col("__row").withField("text", kept).alias("__row"), lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))


def drop_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """The rows of `docs` with the kept lines as text."""
    return marked(docs, min_key).select("__row.*")
