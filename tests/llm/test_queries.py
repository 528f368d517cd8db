"""Registered queries against their SQL twins, and those without one against brute force, on the smallest tables."""

import hashlib

import check
import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash

from feltmill.llm import queries, simhash_tiles
from feltmill.session import stored

from .test_shingle_copies import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id DESC").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    ok, _, message = check.compare(spark, con, SF, name)
    assert ok, message


def test_quality_on_held_out_labels(spark):
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/../sf0.01/labels.parquet'").fetchall())
    found = [r for r in queries.QUERIES["op1_attention_quality"](spark, f"{SF}/../sf0.01").collect() if r.held_out and r.doc_id in label]
    assert len(found) > 50 and sum(r.predicted == label[r.doc_id] for r in found) / len(found) > 0.95


def test_language_on_held_out_documents(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    found = [r for r in queries.QUERIES["op5_language_filters"](spark, SF).collect() if r.held_out]
    assert len(found) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in found) / len(found) > 0.95


def brute_fingerprint(text):
    words = text.encode().lower().split()
    n = min(4, len(words))
    digests = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests)) if digests else 0


def test_simhash_components(spark, documents):
    prints = {i: brute_fingerprint(t) for i, t in documents}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = queries.QUERIES["op4_simhash_tiles"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{p:016x}", top(i)) for i, p in prints.items()}


def test_fingerprints_follow_texts(spark, documents):
    found = {r.doc_id: r for r in queries.QUERIES["op7_multiset_fingerprint"](spark, SF).collect()}
    by_text = {}
    for k, (i, text) in enumerate(documents):
        after, half, r = documents[(k + 1) % len(documents)][1], len(text) // 2, found[i]
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(text, set()).add(r.fingerprint)
        by_text.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.9


def test_repeated_strings(spark, documents):
    seen = {}
    for _, text in documents:
        raw = text.encode()
        for p in range(len(raw) - 199):
            key = hash(raw[p : p + 200])
            seen[key] = seen.get(key, 0) + 1
    want = set()
    for i, text in documents:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 199):
            if seen[hash(raw[p : p + 200])] > 1:
                gone[p : p + 200] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        want.add((i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    found = queries.QUERIES["op9_suffix_groups"](spark, SF).collect()
    assert {tuple(r) for r in found} == want


def test_pieces_match_the_library(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    found = {r.doc_id: r for r in queries.QUERIES["op10_piece_transducer"](spark, SF).collect()}
    assert all(list(found[i].ids) == library.encode(t) and found[i].round_trip and found[i].n_ids == len(found[i].ids) for i, t in documents)


def test_pipeline_stages(spark):
    """Each stage against a plain rerun of its rule on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in after.values())
            assert all(not any(c.isalpha() for c in before[i].text) for i in set(before) - set(after))
        elif name == "line_dedup":
            held = set()
            for i in sorted(before):
                lines = before[i].text.split("\n")
                keys = [x.strip(" \t\n\x0b\x0c\r").encode().lower() for x in lines]
                kept = [x for x, k in zip(lines, keys, strict=True) if len(k.decode()) < 10 or k not in held]
                held |= set(keys)
                assert after[i].text == "\n".join(kept) and after[i].n_chars == len(after[i].text)
        elif name == "simhash_near_dedup":
            assert set(after) == brute_kept({i: r.text for i, r in before.items()})
        elif name == "benchmark_decontamination":
            items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
            gone = set(before) - set(after)
            assert gone and all(any(t in before[i].text for t in items) for i in gone)
            assert not any(t in r.text for t in items for r in after.values())
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
