"""Languages of a few documents beside a large one."""

import random

import pytest
from feltmill.llm import language_filters

WORDS = {
    "en": "the river bank today over lazy dog quick brown fox jumps near stone house under morning light with many people".split(),
    "pl": "rzeka brzeg dzisiaj leniwy pies szybki brązowy lis skacze blisko kamień dom pod poranne światło wielu ludzi się łąka".split(),
}


def frame(spark, few):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(WORDS[lang], k=40)), lang) for i, lang in enumerate(["en"] * 40 + ["pl"] * few)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("few", [1, 2, 5, 12])
def test_a_small_language_is_known_and_kept(spark, few):
    docs = frame(spark, few)
    model = language_filters.learn(docs)
    found = {r.doc_id: r.lang_pred for r in language_filters.predict(docs, model, "doc_id").collect()}
    assert found == {r.doc_id: r.lang for r in docs.collect()}
    assert language_filters.keep_known(docs, model).count() == 40 + few
