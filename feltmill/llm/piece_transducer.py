"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Compiled from a model file: the normaliser (blanks, dummy prefix), one arc for each piece, and for a character that
no piece covers the chain of its byte pieces. A text is composed with it lazily: the states are its positions, each
with the last piece, and the path of least weight in the tropical semiring (weights add along a path, the least
wins) is the encoding.

Weights. Unigram models: the negated piece score. BPE models: the merge order decides, and it is compiled into the
arcs as weight 0 or infinity: a piece may follow another iff merging their characters in rank order gives just these
two, which can be read off the merge trees of both pieces. A prefix has one encoding, so one state per position is
of finite weight. The path falls apart where no piece reaches across (blanks, line ends), so short stretches are
solved once per worker and looked up afterwards.

Defined cases: null and empty texts have no ids; U+2581 in a text is read as a blank, as the format has it; control
pieces are never matched in text; a model with a character map, or of a type other than unigram or BPE, is refused;
rows that repeat stay; other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feltmill.llm.common import shared, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
UNKNOWN_PENALTY = 10.0
SHORT, HELD, PAIRS, MARKS = 48, 150_000, 300_000, 1 << 22
#: Rows encoded at a time.
SLICE = 200


class PieceTransducer:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a character map can be compiled")
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        pieces = list(proto.pieces)
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
        self.score = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.unknown_weight = UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        surface = {CONTROL: b"", UNUSED: b"", UNKNOWN: " ⁇ ".encode()}
        self.surfaces = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else surface[p.type] if p.type in surface else p.piece.replace(MARK, " ").encode() for p in pieces
        ]
        self._compile()

    def _compile(self) -> None:
        order = sorted({-s for s in self.score.values()})
        place = {s: i for i, s in enumerate(order)}
        #: Rank of the merge that makes a piece, and its two parts; single characters are made by no merge.
        self.rank = {p: place[-s] for p, s in self.score.items() if len(p) > 1}
        self.parts: dict[str, tuple[str, str]] = {}
        self.trie: dict = {}
        for piece in sorted(self.ids, key=len):
            if self.kind == BPE and len(piece) > 1:
                made = self._merged(list(piece))
                if made is None:
                    continue  # merging never arrives at it
                self.parts[piece] = made
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.stretch = None if crossing else re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._forget()

    def _forget(self) -> None:
        #: Ids of short stretches met more than once: the newest, and those before them.
        self.solved: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Marks, by hash, of stretches met: most are met once only and would fill the tables for nothing.
        self.met = bytearray(MARKS)
        self.pairs: dict[tuple[str, str], bool] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("solved", "older", "met", "pairs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _merged(self, symbols: list[str]) -> tuple[str, str] | None:
        """The last two symbols when merging by rank (the leftmost of equals first) ends in one; else None."""
        while len(symbols) > 2:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))))
            if best[0] == 1 << 60:
                return None
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols[0], symbols[1]

    def may_follow(self, one: str, two: str) -> bool:
        """Whether merging the characters of both leaves the border between them: no merge across it comes first."""
        found = self.pairs.get((one, two))
        if found is None:
            rank, a, b, limit = self.rank, one, two, 1 << 60
            while True:
                if rank.get(a + b, 1 << 61) < limit:
                    found = False
                    break
                made = rank.get(a, -1) if len(a) > 1 else -1, rank.get(b, -1) if len(b) > 1 else -1
                if made[0] > made[1]:  # undo the later merge; of equals the right one is later
                    limit, a = made[0], self.parts[a][1]
                elif made[1] >= 0:
                    limit, b = made[1] + 1, self.parts[b][0]
                else:
                    found = True
                    break
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[one, two] = found
        return found

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = f" {text}" if self.prefix else text
        return text.replace(" ", MARK) if self.escape else text

    def _arcs(self, line: str, at: int) -> list[str]:
        """Pieces that begin at `at`, the longest last; a character that no piece covers stands for itself."""
        found, node = [], self.trie
        for j in range(at, len(line)):
            node = node.get(line[j])
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        if at < len(line) and (not found or len(found[0]) > 1):
            found.insert(0, line[at])
        return found

    def _merge_path(self, line: str) -> list[str]:
        """The path of weight zero. Weights are 0 or infinite, so states are visited depth first, the longest arc
        first, and a state that leads nowhere is never entered again."""
        n, pairs, last, at, dead = len(line), self.pairs, "", 0, set()
        arcs, trail = self._arcs(line, 0), []
        while at < n:
            while arcs:
                piece = arcs.pop()
                if last:
                    fits = pairs.get((last, piece))
                    if fits is None:
                        fits = self.may_follow(last, piece)
                    if not fits:
                        continue
                if dead and (at + len(piece), piece) in dead:
                    continue
                trail.append((at, last, arcs))
                at += len(piece)
                last = piece
                arcs = self._arcs(line, at)
                break
            else:
                dead.add((at, last))
                at, last, arcs = trail.pop()
        return [x[1] for x in trail[1:]] + [last] if n else []

    def _score_path(self, line: str) -> list[str]:
        """The path of least total weight, by one forward pass over the positions."""
        weight, back = [0.0] + [float("inf")] * len(line), [""] * (len(line) + 1)
        for i in range(len(line)):
            for piece in self._arcs(line, i):
                total = weight[i] + (-self.score[piece] if piece in self.score else self.unknown_weight)
                if total < weight[i + len(piece)]:
                    weight[i + len(piece)], back[i + len(piece)] = total, piece
        out, at = [], len(line)
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def path(self, line: str) -> list[int]:
        """Ids along the lightest path over the whole of `line`."""
        out: list[int] = []
        for piece in self._merge_path(line) if self.kind == BPE else self._score_path(line):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def _solve(self, line: str) -> bytes:
        found = self.older.get(line)
        if found is None:
            found = array("i", self.path(line)).tobytes()
            mark = hash(line) % MARKS
            if len(line) > SHORT or not self.met[mark]:
                self.met[mark] = 1
                return found
        if len(self.solved) >= HELD:
            self.older, self.solved, self.met = self.solved, {}, bytearray(MARKS)
        self.solved[line] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        line = self.normalise(text or "")
        stretches = self.stretch.findall(line) if self.stretch else [line] if line else []
        solve = self._solve
        return np.frombuffer(b"".join([self.solved.get(s) or solve(s) for s in stretches]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        surfaces = self.surfaces
        text = b"".join([surfaces[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def compile_model(path: str) -> PieceTransducer:
    with open(path, "rb") as file:
        return PieceTransducer(file.read())


def encode_texts(docs: DataFrame, model: PieceTransducer, *keep: str) -> DataFrame:
    """(keep..., ids, n_bytes, round_trip): ids of the text, how many of them are byte pieces, and whether decoding
    them gives the text again. The compiled model is broadcast; it is as large as its vocabulary.

    A worker holds the model, its tables of bounded size and one small batch: what a slice took is given back after it.
    """
    small_batches(docs.sparkSession)
    held = shared(docs.sparkSession, model)
    source = docs.select(*keep, "text")
    added = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("n_bytes", T.LongType()).add("round_trip", T.BooleanType())
    schema = T.StructType(source.schema.fields[:-1] + added.fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held()
        raw = np.zeros(len(own.surfaces), np.int64)
        raw[list(own.bytes.values())] = 1

        def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(len(keep)).to_pylist()
            found = [own.encode(t) for t in texts]
            same = [own.decode(x) == (t or "") for x, t in zip(found, texts, strict=True)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            last = [ids, pa.array([int(raw[x].sum()) for x in found], pa.int64()), pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *last], names=[*keep, "ids", "n_bytes", "round_trip"])

        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                yield encoded(batch.slice(low, SLICE))
                pa.default_memory_pool().release_unused()

    return source.mapInArrow(rows, schema)


def decode_ids(encoded: DataFrame, model: PieceTransducer, ids: str = "ids", into: str = "text") -> DataFrame:
    """The rows with the text of their ids in column `into`; null ids give null."""
    held = shared(encoded.sparkSession, model)

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else held().decode(x))

    return encoded.withColumn(into, decode(F.col(ids)))
