"""Near copies of the pipeline against brute-force Jaccard likeness."""

import random

import corpus_pipeline
import pytest
from feltmill.llm import shingle_copies, simhash_tiles


def brute_kept(texts):
    """Smallest id of each component of texts whose five-word shingles are alike to 0.8 or more."""

    def shingles(text):
        tokens = (text or "").lower().split()
        return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            one, two = sets[i], sets[j]
            if one == two or one and 10 * len(one & two) >= 8 * len(one | two):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Edited copies on both sides of the bound, a chain of them, a passage that many texts share, short texts."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage = draw.choices(words, k=30)
    out = []
    for _ in range(40):
        base = draw.choices(words, k=draw.randint(20, 160))
        for edits in (0, 1, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in draw.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = draw.choice(words)
            out.append(copy)
    link = draw.choices(words, k=120)
    for _ in range(60):
        link = link[2:] + draw.choices(words, k=2)
        out.append(link)
    out += [passage + draw.choices(words, k=60) for _ in range(60)]
    out += [["one"], ["ONE"], ["one", "two"], [], []]
    draw.shuffle(out)
    return {i: " ".join(t) for i, t in enumerate(out)} | {len(out): None}


def test_near_copies_are_those_of_brute_force(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_kept(texts)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == want
    assert {r.doc_id for r in shingle_copies.keep_one(docs, tile=4).collect()} == want


def test_a_pair_that_fingerprints_miss(spark):
    base = [f"word{i}" for i in range(100)]
    texts = {1: " ".join(base), 2: " ".join([*base[:45], "other", *base[46:]])}
    one, two = (simhash_tiles.fingerprint_of(t, 4) for t in texts.values())
    assert (one ^ two).bit_count() > 4
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [1]


@pytest.mark.parametrize("size", [1, 2, 4, 5, 6, 9, 10, 57])
def test_first_shingles_meet(size):
    """Two sets just alike enough share a first digest in any order."""
    draw = random.Random(size)
    np = shingle_copies.np
    for _ in range(200):
        pool = np.unique(np.array([draw.getrandbits(62) for _ in range(2 * size)], np.int64))
        one = np.sort(pool[draw.sample(range(len(pool)), size)])
        two = np.array(sorted(draw.sample(one.tolist(), -(-size * 4 // 5)) + [draw.getrandbits(62)] * draw.randint(0, 1)), np.int64)
        counts = np.array([draw.randrange(4) for _ in range(64)], np.uint32)
        if shingle_copies.alike(len(set(one.tolist()) & set(two.tolist())), len(one), len(two)):
            assert set(shingle_copies.first_shingles(one, counts).tolist()) & set(shingle_copies.first_shingles(two, counts).tolist())


def test_near_copies_edges(edge, empty):
    assert shingle_copies.keep_one(empty).count() == 0
    kept = shingle_copies.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id if r.doc_id is not None else 99 for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 99]


def test_counts_cover_all_texts(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    counts = shingle_copies.shingle_counts(docs, slots=1 << 12)
    want = shingle_copies.np.zeros(1 << 12, int)
    for text in texts.values():
        shingle_copies.np.add.at(want, shingle_copies._slots(shingle_copies.shingles_of(text), 1 << 12), 1)
    assert counts.tolist() == want.tolist()


def test_rows_equal_in_id_and_text_leave_the_first(spark):
    text = "one two three four five six"
    rows = [(1, text, "b", 2), (1, text, "a", 3), (1, text, "c", 1), (2, text, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    assert [tuple(r) for r in shingle_copies.keep_one(docs).collect()] == [(1, text, "a", 3)]


def test_a_stage_leaves_only_its_kept_ids(spark, texts):
    from feltmill import session

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    before = len(session._OWN)
    shingle_copies.keep_one(docs).count()
    assert len(session._OWN) == before + 1


@pytest.mark.parametrize("radius", [1, 28])
def test_fingerprints_share_the_pairs_out(spark, texts, radius):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in shingle_copies.keep_one(docs, tile=16, radius=radius).collect()} == brute_kept(texts)


def test_near_pairs_come_by_the_fingerprints_alone(spark, monkeypatch):
    base = [f"word{i}" for i in range(400)]
    texts = {1: " ".join(base), 2: " ".join([*base[:-1], "other"])}
    one, two = (simhash_tiles.fingerprint_of(t, 5) for t in texts.values())
    assert 0 < (one ^ two).bit_count() <= shingle_copies.RADIUS
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.doc_id for r in shingle_copies.keep_one(docs).collect()] == [1]
    monkeypatch.setattr(shingle_copies, "fingerprint_links", lambda prints, radius=4: spark.createDataFrame([], "__a long, __b long"))
    assert {r.doc_id for r in shingle_copies.keep_one(docs).collect()} == {1, 2}
