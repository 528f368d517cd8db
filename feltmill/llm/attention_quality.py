"""Text quality by attention over passages (multiple-instance learning).

A text is a bag of passages of 512 bytes. Each passage is described by byte-class shares, hashed byte-pair shares and
a few measures of repetition, and encoded by one learned layer. Gated attention weighs the encodings,

    weight_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),    score = sigmoid( c . sum_k weight_k h_k + b ),

and all parameters are learned together from document labels alone (Adam, the whole sample in every step).

Fitting uses a bounded sample: at most about `sample_docs` labelled documents, as many of either label as there are,
drawn by a digest of the id before any text is read, and taken whole in the order of that digest while their passages
number no more than `sample_passages` together, half for either label; a document that does not fit in what is left is passed
over. Their passage descriptions, 88 numbers each, reach the driver. Scoring reads every passage of every text.

Defined cases: null and empty texts are one empty passage and get a score like any other; several labels of one
document all count; rows with a null label or id teach nothing; without labels of both kinds every score is the share
of label 1 (0.5 without any label); repeated rows stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feltmill.llm.common import shared

PASSAGE = 512
PAIRS = 64
HIDDEN, GATES = 24, 16
#: Byte classes: control and blank, line end, digit, upper, lower, other ASCII by its three ranges and two marks, rest.
_KIND = np.full(256, 9, np.uint8)
for _low, _high, _kind in ((0, 33, 0), (33, 48, 4), (48, 58, 1), (58, 65, 5), (65, 91, 2), (91, 97, 6), (97, 123, 3), (123, 128, 7)):
    _KIND[_low:_high] = _kind
_KIND[10] = 8
KINDS = 10
WIDTH = 2 * KINDS + PAIRS + 4


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(description of every passage, number of passages of each text)."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    codes = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(first, sizes) + (np.arange(len(codes)) - starts) // PASSAGE
    total = int(counts.sum())

    def shares(values: np.ndarray, own: np.ndarray, bins: int) -> np.ndarray:
        return np.bincount(own * bins + values, minlength=total * bins).reshape(total, bins)

    length = np.maximum(1, np.bincount(owner, minlength=total))[:, None].astype(np.float64)
    kinds = _KIND[codes]
    table = shares(kinds, owner, KINDS) / length
    inside = owner[1:] == owner[:-1]
    left, right, own = codes[:-1][inside].astype(np.int64), codes[1:][inside].astype(np.int64), owner[1:][inside]
    # a mark right after a letter, a capital after a capital and so on: the kind after each lower or upper letter
    after = kinds[:-1][inside]
    letter = (after == 2) | (after == 3)
    follows = shares(kinds[1:][inside][letter], own[letter], KINDS) / length
    mixed = (left * 0x9E37 + right * 0x79B9 >> 5) % PAIRS
    pairs = shares(mixed, own, PAIRS) / length
    long = own[2:][(own[2:] == own[:-2])] if len(own) > 2 else own[:0]
    at = np.flatnonzero(own[2:] == own[:-2]) if len(own) > 2 else own[:0]
    runs = (left[at] * 31 + right[at] * 1009 + left[at + 2] * 8191 + right[at + 2] * 131) % 509
    repeated = (shares(runs, long, 509) / length) ** 2
    blanks = np.maximum(table[:, :1], 1 / length)
    measures = [np.log1p(length), repeated.sum(axis=1, keepdims=True) * 20, (pairs**2).sum(axis=1, keepdims=True) * 5, np.minimum(1 / blanks, 60) / 10]
    return np.hstack([np.sqrt(table), np.sqrt(follows), np.sqrt(pairs), *measures]).astype(np.float32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _slices(batch: pa.RecordBatch, column: int, rows: int = 200, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` texts and `most` bytes, but for single longer texts."""
    low = held = 0
    for at, size in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if at > low and (at - low == rows or held + size > most):
            yield batch.slice(low, at - low)
            low, held = at, 0
        held += size
    if batch.num_rows:
        yield batch.slice(low)


class AttentionModel:
    """Parameters, forward and backward pass over bags that lie one after another."""

    def __init__(self, width: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        size = {"E": (width, HIDDEN), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,)}
        self.p = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) for k, s in size.items()} | {"e": np.zeros(HIDDEN), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, first = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
        a = s / np.repeat(np.add.reduceat(s, first), counts)
        z = np.add.reduceat(h * a[:, None], first)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "first": first, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), self.constant) if self.constant is not None else self.forward(x, counts)["y"]

    def gradients(self, f: dict, counts: np.ndarray, label: np.ndarray, share: np.ndarray) -> dict:
        p, per = self.p, lambda values: np.repeat(values, counts, axis=0)
        d = (f["y"] - label) * share
        g = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = per(d[:, None] * p["c"])
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - per(np.add.reduceat(f["a"] * da, f["first"])))
        g["w"] = (f["v"] * f["u"]).T @ ds
        dv = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (dz * f["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return g | {"E": f["x"].T @ dh, "e": dh.sum(axis=0)}

    def fit(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int, rate: float, shrink: float = 1e-4) -> None:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        share = np.full(len(label), 1 / len(label))
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            for k, g in self.gradients(self.forward(x, counts), counts, label, share).items():
                g = g + shrink * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = 4000, sample_passages: int = 100_000, steps: int = 150, rate: float = 0.02
) -> AttentionModel:
    """A model from the labels (doc_id, `label` 0 or 1) of the given documents; learns from at most about `sample_docs`
    of them, whole, with at most `sample_passages` passages in all, so that the sample fits the driver whatever the texts' length."""
    own = labels.select(F.col("doc_id").cast("long").alias("__doc"), F.col(label).cast("int").alias("__label"))
    own = own.filter("__doc IS NOT NULL AND __label IN (0, 1)")
    sizes = {r["__label"]: r["n"] for r in own.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    model = AttentionModel(WIDTH)
    if len(sizes) < 2:
        model.constant = float(next(iter(sizes), 0.5))
        return model
    # of the rarer label all that half the sample can hold, of the other one the rest
    rare = min(sizes, key=sizes.get)
    most = {rare: min(sizes[rare], sample_docs // 2)}
    most[1 - rare] = min(sizes[1 - rare], sample_docs - most[rare])
    share = F.when(F.col("__label") == rare, most[rare] / sizes[rare]).otherwise(most[1 - rare] / sizes[1 - rare])
    own = own.withColumn("__draw", F.pmod(F.xxhash64("__doc", F.lit("draw")), F.lit(1 << 30)))
    drawn = own.filter(F.col("__draw") < share * float(1 << 30)).groupBy("__doc", "__label", "__draw").agg(F.count("*").alias("__times"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    length = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)) * F.col("__times")
    found = F.broadcast(drawn).join(texts, "__doc").groupBy("__label", "__draw", "__doc", "__times").agg(F.sum(length).alias("n"))
    room, fitting = dict.fromkeys(sizes, sample_passages // 2), []
    for r in found.orderBy("__label", "__draw", "__doc").collect():  # as many as were drawn, at the most
        if r["n"] <= room[r["__label"]]:
            room[r["__label"]] -= r["n"]
            fitting.append((r["__doc"], r["__label"], r["__times"]))
    chosen = docs.sparkSession.createDataFrame(fitting, "__doc long, __label int, __times long")
    bags = F.broadcast(chosen).join(texts, "__doc").select("__label", "text", F.explode(F.sequence(F.lit(1), "__times"))).select("__label", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                x, counts = passages(part.column(1).to_pylist())
                rows = [x[e - n : e].tobytes() for e, n in zip(np.cumsum(counts), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["label", "x"])

    found = bags.mapInArrow(describe, "label int, x binary").toArrow()
    own_bags = sorted(zip(found.column("x").to_pylist(), found.column("label").to_pylist(), strict=True))  # the same order in every run
    if len({y for _, y in own_bags}) < 2:
        model.constant = float(own_bags[0][1]) if own_bags else 0.5
        return model
    x = np.frombuffer(b"".join(b for b, _ in own_bags), np.float32).reshape(-1, WIDTH)
    counts = np.array([len(b) // (4 * WIDTH) for b, _ in own_bags])
    model.fit(x, counts, np.array([y for _, y in own_bags], np.float64), steps, rate)
    return model


def scores(docs: DataFrame, model: AttentionModel, *keep: str) -> DataFrame:
    """(keep..., score, n_passages) of every row; the model's few thousand parameters are broadcast."""
    held = shared(docs.sparkSession, model)
    source = docs.select(*keep, "text")
    added = T.StructType().add("score", T.DoubleType()).add("n_passages", T.LongType())
    schema = T.StructType(source.schema.fields[:-1] + added.fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, len(keep)):
                x, counts = passages(part.column(len(keep)).to_pylist())
                found = [pa.array(held().score(x, counts)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *found], names=[*keep, "score", "n_passages"])

    return source.mapInArrow(rows, schema)
