"""What a Python worker holds while it reads texts."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from feltmill.llm import piece_transducer

SF = "/root/testdata/sf0.001"
BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND)


def batch_sizes(docs):
    def sizes(batches):
        for x in batches:
            yield pa.RecordBatch.from_pydict({"rows": [x.num_rows], "size": [x.nbytes]})

    return docs.mapInArrow(sizes, "rows long, size long").collect()


def test_texts_of_the_pieces_stage_come_in_small_batches(unbounded):
    docs = unbounded.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd efg ', 1000) AS text")
    found = corpus_pipeline.pieces(unbounded, docs, SF)
    sizes = batch_sizes(docs)
    assert sum(r["rows"] for r in sizes) == 3000 and max(r["size"] for r in sizes) < 5_000_000
    batches = batch_sizes(found)
    assert sum(r["rows"] for r in batches) == 3000
    assert [r.n_ids for r in found.select("n_ids").distinct().collect()] == [len(piece_transducer.compile_model(corpus_pipeline.PIECE_MODEL).encode("ab cd efg " * 1000))]


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(BOUND, "1m")
    corpus_pipeline.pieces(unbounded, unbounded.read.parquet(f"{SF}/documents.parquet"), SF)
    assert unbounded.conf.get(BOUND) == "1m"


def test_stretches_met_once_are_not_held():
    model = piece_transducer.compile_model(corpus_pipeline.PIECE_MODEL)
    model.encode(" ".join(f"word{i}" for i in range(500)))
    assert len(model.solved) + len(model.older) < 50
    before = [model.encode("again and again").tolist() for _ in range(3)]
    assert before[0] == before[1] == before[2] and "▁again" in model.solved


def test_small_tables_give_the_same_ids(monkeypatch):
    plain, small = (piece_transducer.compile_model(corpus_pipeline.PIECE_MODEL) for _ in range(2))
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choice("abcdeé.1") for _ in range(draw.randint(1, 4))) for _ in range(60)) for _ in range(60)]
    want = [plain.encode(t).tolist() for t in texts]
    for name, value in (("HELD", 7), ("PAIRS", 5), ("MARKS", 64)):
        monkeypatch.setattr(piece_transducer, name, value)
    small._forget()
    assert [small.encode(t).tolist() for t in texts] == want
    assert len(small.solved) <= 7 and len(small.older) <= 7 and len(small.pairs) <= 5
