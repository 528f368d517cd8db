"""Language identification with bit-sliced n-gram filters.

One array of masks stands for one Bloom filter per language: bit l of a slot belongs to language l, so the
conjunction of an n-gram's k slots gives every language that (as far as the filter can tell) holds the n-gram. Beyond
63 languages a slot has several masks, one for every 63 of them. A text is decided by counting, per language, the
n-grams whose mask names it, less the false hits that the fill of that language's filter leads one to expect.

Learning: n-grams are counted over a bounded sample (`sample_docs` documents, drawn per language by a digest of the
text), an n-gram enters the filters of the languages in which it is common enough beside its most frequent one, and
Spark combines the slots; what reaches the driver is the slot array, of fixed size.

Defined cases: a null text or one without any letter is `und` with score 0; a text whose n-grams nobody knows gets
the most frequent language of the sample with score 0; ties go to the language that is more frequent in the sample,
then to the smaller name; with no labelled row at all everything is `und`; an empty table gives an empty result;
columns other than text are not read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feltmill.llm.common import shared

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
GRAM = 5
_PIECE = 1 << 22
#: Languages of one mask: the bits of a long without its sign.
HELD = 63
#: Odd multipliers that spread an n-gram over the slots, one for each probe.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def grams_of(text: str | None) -> np.ndarray:
    """Codes of all 5-byte windows of the lower-cased words, each between single blanks."""
    if not text or not LETTER.search(text):
        return np.zeros(0, np.uint64)
    line = f"  {NOT_LETTERS.sub(' ', text.lower()).strip()}  ".encode()
    codes = np.frombuffer(line, np.uint8).astype(np.uint64)
    out = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        out |= codes[k : len(codes) - GRAM + 1 + k] << np.uint64(8 * (GRAM - 1 - k))
    return out


def slots_of(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(grams * np.uint64(m)) >> np.uint64(64 - bits) for m in SPREAD]


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]  # the most frequent first
    masks: np.ndarray  # a row of slots for every HELD languages
    bits: int

    def false_rates(self) -> np.ndarray:
        """By language: the share of unknown n-grams that its filter lets through."""
        return np.array([((self.masks[l // HELD] >> l % HELD & 1).mean()) ** len(SPREAD) for l in range(len(self.languages))])

    def decide(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        grams = grams_of(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        hits = np.zeros(len(self.languages), np.int64)
        for low in range(0, len(grams), _PIECE):
            one, two, three = slots_of(grams[low : low + _PIECE], self.bits)
            found = [row[one] & row[two] & row[three] for row in self.masks]
            hits += [np.count_nonzero(found[l // HELD] >> l % HELD & 1) for l in range(len(self.languages))]
        real = np.clip((hits - len(grams) * rates) / np.maximum(1 - rates, 1e-9), 0, None)
        best = int(real.argmax())
        return self.languages[best], float(min(1.0, real[best] / len(grams)))


def learn(labelled: DataFrame, sample_docs: int = 8000, bits: int = 20, least_share: float = 0.3, least_docs: int = 3) -> LanguageFilters:
    """Filters from (text, lang) rows; at most about `sample_docs` documents of each language are read closely.

    An n-gram must lie in `least_docs` documents; where a language has fewer than `least_docs` ** 2, in as many of its
    own as a `least_docs`-th part of them, one at least.
    """
    spark = labelled.sparkSession
    rows = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}  # a row for each language
    languages = tuple(sizes)
    if not languages:
        return LanguageFilters((), np.zeros((0, 1 << bits), np.int64), bits)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_docs / sizes[name]))])
    drawn = rows.filter(F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (batch.slice(low, 500) for batch in batches for low in range(0, batch.num_rows, 500))
        for batch in pieces:
            for lang in set(names := batch.column(1).to_pylist()):
                found = [grams_of(t.as_py()) for t, own in zip(batch.column(0), names, strict=True) if own == lang]
                each, docs = np.unique(np.concatenate([np.unique(g) for g in found]), return_counts=True)
                total = np.zeros(len(each), np.int64)
                for g in found:
                    values, n = np.unique(g, return_counts=True)
                    total[np.searchsorted(each, values)] += n
                columns = [pa.array([lang] * len(each)), pa.array(each.view(np.int64)), pa.array(total), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n", "docs"])

    counts = drawn.mapInArrow(count, "lang string, gram long, n long, docs long").groupBy("gram")
    here = [F.when(F.col("lang") == name, F.col("n")) for name in languages]
    floors = {i: max(1, sizes[name] // least_docs) for i, name in enumerate(languages) if sizes[name] // least_docs < least_docs}
    own = [F.sum(F.when(F.col("lang") == languages[i], F.col("docs"))).alias(f"d{i}") for i in floors]
    wide = counts.agg(F.sum("docs").alias("docs"), *own, *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n{i}") for i, c in enumerate(here)])
    wide = wide.filter(reduce(Column.__or__, [F.coalesce(F.col(f"d{i}"), F.lit(0)) >= floor for i, floor in floors.items()], F.col("docs") >= least_docs))
    totals = wide.agg(*[F.sum(f"n{i}") for i in range(len(languages))]).first()
    rate = [F.col(f"n{i}") / F.lit(float(t or 1)) for i, t in enumerate(totals)]
    most = F.greatest(*rate) if len(rate) > 1 else rate[0]
    known = [(r > 0) & (r >= least_share * most) for r in rate]
    bit = [F.when(k, F.lit(1 << i % HELD)).otherwise(F.lit(0)).cast("long") for i, k in enumerate(known)]
    rows_of = [reduce(Column.bitwiseOR, bit[low : low + HELD]) for low in range(0, len(bit), HELD)]
    names = [f"mask{i}" for i in range(len(rows_of))]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            places = np.concatenate(slots_of(grams, bits)).astype(np.int64)
            spread = [pa.array(np.tile(batch.column(1 + i).to_numpy(), len(SPREAD))) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(places), *spread], names=["slot", *names])

    probed = wide.select("gram", *[m.alias(n) for m, n in zip(rows_of, names, strict=True)])
    probed = probed.mapInArrow(probe, ", ".join(f"{n} long" for n in ["slot", *names]))
    slots = probed.groupBy("slot").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()  # at most 2**bits rows
    masks = np.zeros((len(names), 1 << bits), np.int64)
    masks[:, slots.column("slot").to_numpy()] = [slots.column(n).to_numpy() for n in names]
    return LanguageFilters(languages, masks, bits)


def decision(spark: SparkSession, model: LanguageFilters, text: Column) -> Column:
    """struct(lang, score) of a text; the filters (2**bits masks) are broadcast."""
    held = shared(spark, (model, model.false_rates()))

    @F.pandas_udf("lang string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        filters, rates = held()
        return pd.DataFrame([filters.decide(t, rates) for t in texts], columns=["lang", "score"])

    return decide.asNondeterministic()(text)  # so that its fields are not computed apart


def predict(docs: DataFrame, model: LanguageFilters, *keep: str) -> DataFrame:
    """(keep..., lang_pred, score) of every row."""
    found = docs.select(*keep, decision(docs.sparkSession, model, F.col("text")).alias("__found"))
    return found.select(*keep, F.col("__found.lang").alias("lang_pred"), "__found.score")


def keep_known(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """The rows whose language could be told: not `und`, and more n-grams of the language in the text than by chance."""
    rows = docs.select(F.struct("*").alias("__row")).withColumn("__found", decision(docs.sparkSession, model, F.col("__row.text")))
    return rows.filter((F.col("__found.lang") != UNKNOWN) & (F.col("__found.score") > 0)).select("__row.*")
