"""Operators on nulls, empty and long texts, ties, repeats, empty tables and clashing names; parts against brute force."""

import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from feltmill.llm import (
    attention_quality,
    language_filters,
    line_dedup,
    mincut_extraction,
    multiset_fingerprint,
    piece_transducer,
    simhash_tiles,
    spaced_seeds,
    suffix_groups,
    warc,
)
from feltmill.llm.queries import PIECE_MODEL
from pyspark.sql import functions as F

from .conftest import LONG


@pytest.fixture(scope="module")
def pieces():
    return piece_transducer.compile_model(PIECE_MODEL)


@pytest.fixture(scope="module")
def benchmark(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(1, item), (2, item), (None, item), (3, None), (4, ""), (5, "too few words"), (6, "five words make an item")]
    return spark.createDataFrame(rows, "item_id long, text string")


# line dedup


def test_line_dedup_edges(edge, empty):
    found = line_dedup.drop_lines(edge)
    assert found.columns == edge.columns and line_dedup.drop_lines(empty).count() == 0
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[1] == [""] and by_id[2] == [""]
    assert len(by_id[3][0]) > 100_000 and sorted(by_id[4]) == ["", "", "another text under a repeated id"]
    assert by_id[5] == ["same line of text here\nshort\nsame line of text here"]  # the holder keeps all its lines
    assert by_id[6] == ["another line of words"]
    assert sorted(by_id[None]) == ["", "only a null id"]  # without an id a row comes last
    assert by_id[8] == ["é" * 9 + "\n" + "é" * 9] and by_id[9] == ["é" * 10] and by_id[10] == [""]


def test_line_dedup_hot_line(spark):
    """One line in every document, over many range partitions: only the smallest id keeps it."""
    docs = spark.range(3000, numPartitions=7).selectExpr("id AS doc_id", "concat('the very common line\n', 'own line number ', id) AS text")
    found = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert found == {i: ("the very common line\n" if i == 0 else "") + f"own line number {i}" for i in range(3000)}


def test_keep_bitmap_is_compressed(edge):
    row = line_dedup.keep_bitmaps(edge).filter("__doc = 6").first()
    assert row.n_dropped == 1 and np.unpackbits(np.frombuffer(zlib.decompress(row.bitmap), np.uint8)).tolist() == [0] + [1] * 7


# SimHash


def test_simhash_edges(edge, empty):
    found = simhash_tiles.near_duplicates(edge).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r["__fp"], r.component_id))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 1)] and (0, 1) in by_id[None]
    assert {c for _, c in by_id[3] + by_id[4]} == {3, 4}
    assert simhash_tiles.near_duplicates(empty).count() == 0 and simhash_tiles.keep_one(empty).count() == 0
    kept = simhash_tiles.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id if r.doc_id is not None else 99 for r in kept.collect()).count(4) == 1


def test_tiles_of_large_groups_lose_no_link(spark):
    """Small tiles force groups to be cut; a chain of close values must stay one component."""
    draw = random.Random(5)
    values = [draw.getrandbits(64)]
    for _ in range(400):
        value = values[draw.randrange(len(values))]
        for bit in draw.sample(range(64), draw.choice([1, 2, 4, 9])):
            value ^= 1 << bit
        values.append(value)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                root[max(top(i), top(j))] = min(top(i), top(j))
    links = simhash_tiles.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "__fp long"), 4, tile=8)
    label = {r["__node"]: r["__root"] for r in simhash_tiles.components(links).collect()}
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(top(i), set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# language ID


def test_language_edges(spark, edge, empty):
    rows = [("the house and the garden of the man with the dog", "en"), ("la maison et le jardin de la femme avec le chien", "fr")] * 5
    model = language_filters.learn(spark.createDataFrame([*rows, (None, "en"), ("no language", None)], "text string, lang string"))
    found = language_filters.predict(edge, model, "doc_id", "text").collect()
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert language_filters.predict(empty, model).count() == 0
    kept = language_filters.keep_known(edge, model)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 7})
    none = language_filters.learn(empty)
    assert {r.lang_pred for r in language_filters.predict(edge, none).collect()} == {"und"}


# decontamination


def test_more_languages_than_a_mask_has_bits(spark):
    """Every language has words of its own, the last ones bits of a second mask."""
    words = {f"l{i:02}": " ".join(chr(97 + i % 26) * 3 + chr(97 + i // 26) * 2 + chr(97 + k) * 4 for k in range(8)) for i in range(70)}
    docs = spark.createDataFrame([(n, text, lang) for lang, text in words.items() for n in range(3)], "doc_id long, text string, lang string")
    model = language_filters.learn(docs)
    assert len(model.languages) == 70 and model.masks.shape[0] == 2
    assert all(r.lang_pred == r.lang for r in language_filters.predict(docs, model, "lang").collect())


def test_decontamination_edges(spark, edge, empty, benchmark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    swapped = item.replace("gamma", "other").replace("kappa", "words")
    texts = [(1, f"before {item} after"), (2, f"It says: {swapped}!"), (3, "alpha beta and gamma delta are letters"), (3, "alpha beta and gamma delta are letters"),
             (4, None), (5, ""), (6, "Five words, make an ITEM."), (7, "x " * 50_000 + item), (8, item.replace(" ", " so ")), (None, item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("__row", F.lit(0))
    found = {(r["__doc"], r.item_id): r for r in spaced_seeds.overlaps(docs, benchmark).collect()}
    last = 2**63 - 1
    assert set(found) == {(1, 1), (2, 1), (6, 6), (7, 1), (last, 1)}
    assert found[1, 1].doc_start == 1 and found[2, 1].n_matched == 13 and found[7, 1].doc_start == 50_000
    kept = spaced_seeds.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 3, 4, 5, 8]
    assert spaced_seeds.overlaps(empty, benchmark).count() == 0
    assert spaced_seeds.drop_contaminated(edge, benchmark.limit(0)).count() == edge.count()


def test_decontamination_beyond_the_broadcast_bound(spark, benchmark, monkeypatch):
    import feltmill.llm.common as common

    monkeypatch.setattr(spaced_seeds, "small_side", lambda df, label: common.small_side(df, label, rows=0))
    docs = spark.createDataFrame([(1, "five words make an item"), (2, "nothing of it here at all")], "doc_id long, text string")
    assert [r["__doc"] for r in spaced_seeds.overlaps(docs, benchmark).collect()] == [1]


# quality


def test_quality_gradients():
    draw = np.random.default_rng(0)
    model = attention_quality.AttentionModel(5)
    counts, label = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x, share = draw.normal(size=(6, 5)), np.full(3, 1 / 3)

    def loss():
        y = model.forward(x, counts)["y"]
        return -(share * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum()

    found = model.gradients(model.forward(x, counts), counts, label, share)
    for name, values in model.p.items():
        at = tuple(draw.integers(0, s) for s in values.shape)
        values[at] += 1e-6
        up = loss()
        values[at] -= 2e-6
        down = loss()
        values[at] += 1e-6
        assert abs((up - down) / 2e-6 - found[name][at]) < 1e-6, name


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = attention_quality.learn(edge, labels, steps=5)
    found = attention_quality.scores(edge, model, "doc_id").collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 for r in found)
    assert attention_quality.scores(empty, model, "doc_id").count() == 0
    assert {r.score for r in attention_quality.scores(edge, attention_quality.learn(edge, labels.limit(0)), "doc_id").collect()} == {0.5}
    assert next(r.n_passages for r in found if r.doc_id == 3) > 500


# WARC


def test_quality_of_long_samples(spark, monkeypatch):
    """Long texts teach whole, as many as the sample's passages allow, and are scored by all of their passages."""
    docs = spark.createDataFrame([(i, ("Good words in a row. " if i % 2 else "x9 ## 00 !! ") * (3000 if i > 1 else 90_000)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen, fit = [], attention_quality.AttentionModel.fit
    monkeypatch.setattr(attention_quality.AttentionModel, "fit", lambda self, x, counts, *rest: (seen.extend(counts), fit(self, x, counts, *rest)))
    model = attention_quality.learn(docs, labels, sample_passages=1000)
    assert set(seen) == {-(-21 * 3000 // 512), -(-12 * 3000 // 512)} and sum(seen) <= 1000 and len(seen) == 500 // 124 + 500 // 71
    found = attention_quality.scores(docs, model, "doc_id").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) and r.n_passages > 50 for r in found)


def test_quality_scores_by_brute_force(spark):
    """Scores of whole texts against descriptions, attention and score written out passage by passage."""
    texts = ["", "A", "One plain line.\nAnd TWO more, 3 of them!", "é" * 700 + "~x~ \t" * 90, "The same words. " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = attention_quality.AttentionModel(attention_quality.WIDTH, seed=3)
    found = {r.doc_id: r.score for r in attention_quality.scores(docs, model, "doc_id").collect()}
    ranges = [(0, 33, 0), (33, 48, 4), (48, 58, 1), (58, 65, 5), (65, 91, 2), (91, 97, 6), (97, 123, 3), (123, 128, 7)]
    kind = lambda c: 8 if c == 10 else next((k for low, high, k in ranges if low <= c < high), 9)
    p = model.p
    for i, text in enumerate(texts):
        raw, encoded, weights = text.encode(), [], []
        for low in range(0, max(1, len(raw)), 512):
            part = raw[low : low + 512]
            n = max(1, len(part))
            own, after, pairs, runs = np.zeros(10), np.zeros(10), np.zeros(64), np.zeros(509)
            for k, c in enumerate(part):
                own[kind(c)] += 1 / n
                if k and kind(part[k - 1]) in (2, 3):
                    after[kind(c)] += 1 / n
                if k:
                    pairs[(part[k - 1] * 0x9E37 + c * 0x79B9 >> 5) % 64] += 1 / n
                if k > 2:
                    runs[(part[k - 3] * 31 + part[k - 2] * 1009 + part[k - 1] * 8191 + c * 131) % 509] += 1 / n
            measures = [np.log1p(n), (runs**2).sum() * 20, (pairs**2).sum() * 5, min(1 / max(own[0], 1 / n), 60) / 10]
            x = np.concatenate([np.sqrt(own), np.sqrt(after), np.sqrt(pairs), measures])
            h = np.tanh(x @ p["E"] + p["e"])
            encoded.append(h)
            weights.append(np.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
        assert abs(found[i] - 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))) < 1e-5


def test_warc_edges(spark):
    big = "<p>" + "é" * 2000 + "</p>"
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://c", big), (4, "u\r\nx: y", big), (5, "e", big), (5, "e", big), (6, "f", "x" * 999), (7, "g", "x" * 999),
            (None, "n", big), (8, "h", "y" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    for packed in (True, False):
        manifest = warc.write_archives(pages, archive_bytes=1000, compressed=packed)
        assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
        found = warc.read_archives(spark, manifest).collect()
        kinds = sorted((warc.page_of(r.record_id) or 0, r.record_type, warc.page_of(r.refers_to), r.payload_bytes) for r in found)
        n = len(big.encode())
        assert kinds == sorted([(0, "revisit", 5, n), (1, "response", None, 0), (2, "response", None, 0), (3, "revisit", 5, n), (4, "revisit", 5, n), (5, "response", None, n),
                                (5, "response", None, n), (6, "response", None, 999), (7, "response", None, 999), (8, "response", None, 500_000)])
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    """Damage any byte: every record it does not touch is read, and the rest is covered by gaps."""
    records = [warc.record(i, f"http://x/{i}", f"<p>page {i}</p>".encode() * (i * 7), None, False) for i in range(12)]
    parts = [warc.member(r) if packed else r for r in records]
    whole, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
    assert [r.trouble for r in warc.salvage(pa.BufferReader(whole))] == [""] * 12
    draw = random.Random(1)
    for _ in range(40):
        at = draw.randrange(len(whole))
        damaged = bytearray(whole)
        damaged[at] ^= 1 << draw.randrange(8)
        damaged = bytes(damaged) if draw.random() < 0.7 else whole[:at] + whole[at + draw.randrange(1, 90) :]
        found = list(warc.salvage(pa.BufferReader(damaged)))
        assert found[0].at == 0 and found[-1].end == len(damaged) and all(a.end == b.at for a, b in zip(found, found[1:], strict=False))
        ids = [r.heads["warc-record-id"] for r in found if not r.trouble]
        hit = int(np.searchsorted(ends, at, side="right"))
        assert len(ids) >= 12 - (1 if len(damaged) == len(whole) else 3) and set(ids) >= {warc.record_id(i) for i in range(hit)}


def test_warc_foreign_bytes():
    good = warc.member(warc.record(1, "u", b"hello", None, False))
    found = list(warc.salvage(pa.BufferReader(b"noise" + good + warc.MEMBER + b"WARC/1.0 no" + good[:-9])))
    assert [(bool(r.trouble), r.at) for r in found] == [(True, 0), (False, 5), (True, 5 + len(good))]
    assert list(warc.salvage(pa.BufferReader(b""))) == [] and gzip.decompress(good).startswith(b"WARC/1.1")


# fingerprints


def test_fingerprint_is_homomorphic(spark):
    m = multiset_fingerprint
    rows = [("one line\ntwo lines\nthree lines", "three lines\none line\ntwo lines", "one line\ntwo lines", "three lines", "one line\none line\ntwo lines")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    f = {x: m.fingerprint(m.piece_digests(F.col(x))) for x in "abcde"}
    r = df.select(
        (f["a"] == f["b"]).alias("order"), (m.inserted(f["c"], f["d"]) == f["a"]).alias("plus"), (m.deleted(f["a"], f["d"]) == f["c"]).alias("minus"),
        (f["c"] != f["e"]).alias("counts"), m.likeness(f["a"], f["b"]).alias("same"), m.likeness(f["a"], f["c"]).alias("near"),
    ).first()
    assert r.order and r.plus and r.minus and r.counts and r.same == 1.0 and 0.3 < r.near < 1


def test_successors(spark, edge, empty):
    m = multiset_fingerprint
    ids = random.Random(2).sample(range(10_000), 700)
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    for blocks in (1, 3, 50):
        found = {r["__row"].doc_id: r["__next"] for r in m.with_successor(docs, F.col("doc_id"), blocks).collect()}
        down = sorted(ids, reverse=True)
        assert found == dict(zip(down, down[1:] + down[:1], strict=True))
    assert m.with_successor(empty, F.col("text")).count() == 0
    found = m.with_successor(edge, F.col("doc_id")).collect()
    assert len(found) == edge.count() and sorted(str(r["__next"]) for r in found) == sorted(str(r.doc_id) for r in edge.collect())
    assert [r["__next"] for r in m.with_successor(docs.limit(1), F.lit(5)).collect()] == [5]


# extraction


def test_extraction_edges(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>First  para\n graph, long enough to be content.<p>Second <b>bold <i>text</b> goes on here."
        "<ul><li>item one<li>item two</ul><div class=ad>Buy now!</div><aside>Related things</aside><script>var x = '</p>';</script><br>Tail &lt;b&gt; text.</article>"
        "<section id=comments><p>I think that this long comment is really quite wrong about it.</p></section><form><p>Subscribe</p></form><footer>&copy; 2020</footer>"
    )
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p"), (5, "just words, no markup at all, but enough of them to be a text."), (5, page)], "text long, html string")
    found = [r.out for r in mincut_extraction.extract(pages, into="out").collect()]
    want = "A & B\n\nFirst para graph, long enough to be content.\n\nSecond bold text goes on here.\n\nitem one\n\nitem two\n\nTail <b> text."
    assert found == [want, "", "", "", "just words, no markup at all, but enough of them to be a text.", want]
    assert mincut_extraction.extract(pages.limit(0)).count() == 0
    assert mincut_extraction.main_blocks("<article>" + "<p>A fine sentence of some length stands here.</p>" * 3000)[2999]


def test_minimum_cut_is_minimal():
    draw = random.Random(3)
    for _ in range(200):
        n = draw.randint(1, 7)
        good, bad = ([draw.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(i, j, draw.randint(0, 6)) for i in range(n) for j in range(i) if draw.random() < 0.6]

        def cost(keep):
            return sum(b if k else g for k, g, b in zip(keep, good, bad, strict=True)) + sum(w for i, j, w in edges if keep[i] != keep[j])  # noqa: B023

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(mincut_extraction.source_side([*map(float, good)], [*map(float, bad)], edges)) == best


# repeated strings


def test_suffix_array():
    draw = random.Random(4)
    for _ in range(1500):
        text = [draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randint(0, 40))]
        assert suffix_groups.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_kept(texts, span):
    seen = {}
    for t in texts:
        for p in range(len(t) - span + 1):
            seen[t[p : p + span]] = seen.get(t[p : p + span], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = [True] * span
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("large", [suffix_groups.LARGE, 1])
def test_repeated_strings_against_brute_force(spark, large):
    """Texts of shared pieces, periods, zero bytes and repeats; large=1 sends every group along the hashed way."""
    draw = random.Random(6)
    pool = ["".join(draw.choice("ab é\x00") for _ in range(draw.randint(20, 150))) for _ in range(12)]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 9))) for _ in range(50)] + ["x" * 300, "xyz" * 100, "x" * 300, "", "xy" * 100]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").withColumn("__starts", F.lit(1))
    found = suffix_groups.remove_repeats(docs, span=64, block=9, large=large).collect()
    want = brute_kept([t.encode() for t in texts], 64)
    assert sorted((r.n_bytes, bytes(r.kept)) for r in found) == sorted([(len(t.encode()), k) for t, k in zip(texts, want, strict=True)] + [(0, b"")])


def test_repeated_strings_edges(edge, empty):
    found = suffix_groups.remove_repeats(edge).collect()
    assert len(found) == edge.count() and suffix_groups.remove_repeats(empty).count() == 0
    assert all(len(r.kept) == 0 for r in found if r.doc_id in (1, 2, 3) or r.doc_id == 4 and r.n_bytes > 1000) and len(LONG) > 200_000


# pieces


def test_pieces_against_the_library(pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    draw = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz     éüñç\n.,!$%&*#ABCTHE01239\U0001f999 \t中文"
    for k in range(600):
        text = "".join(draw.choice("  ab" if k % 5 == 0 else alphabet) for _ in range(draw.randint(0, 90)))
        ids = pieces.encode(text)
        assert ids.tolist() == library.encode(text) and pieces.decode(ids) == text


def test_shortest_path_of_scores(pieces):
    """The unigram weights: least total over all ways to cut, by enumeration."""
    other = piece_transducer.PieceTransducer.__new__(piece_transducer.PieceTransducer)
    other.__dict__.update(pieces.__dict__, kind=piece_transducer.UNIGRAM, solved={}, older={}, pairs={})
    score = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.0, "aba": -5.4, "▁a": -1.5}
    other.score, other.ids, other.trie, other.unknown_weight = score, {p: i for i, p in enumerate(score)}, {}, 20.0
    for piece in score:
        node = other.trie
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = piece

    def least(line):
        return 0.0 if not line else min(-score.get(line[:k], -20.0 if k == 1 else -1e9) + least(line[k:]) for k in range(1, len(line) + 1))

    draw = random.Random(8)
    for _ in range(60):
        line = "▁" + "".join(draw.choice("abz▁") for _ in range(draw.randint(0, 8)))
        assert abs(sum(-score.get(p, -20.0) for p in other._score_path(line)) - least(line)) < 1e-9


def test_pieces_edges(edge, empty, pieces):
    found = piece_transducer.encode_texts(edge, pieces, "doc_id", "__row").collect()
    assert len(found) == edge.count() and all(r.round_trip for r in found) and all(r.ids == [] for r in found if r.doc_id in (1, 2))
    encoded = piece_transducer.encode_texts(edge, pieces, "doc_id")
    back = piece_transducer.decode_ids(encoded, pieces).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in edge.collect())
    assert piece_transducer.encode_texts(empty, pieces).count() == 0
