"""Comments, sidebars and notices inside main texts, broken markup, and long pages."""

import itertools
import random
import time

import pytest
from feltmill.llm import mincut_extraction

TEXT = "\n\n".join(f"Sentence number {i} of the story, which is long enough to be content of the page." for i in range(6))
BODY = "".join(f"<p>{t}</p>" for t in TEXT.split("\n\n"))
SAID = "".join(f"<p>I have read this and think number {i} is not at all what happened there.</p>" for i in range(4))
LONG = "<p>We and our partners store data on your device, and we tell you here at great length about it.</p>" * 9
HEAD, FOOT = "<nav><a href=/>Home</a></nav>", "<footer>All about us.</footer>"


def text_of(page):
    return "\n\n".join(mincut_extraction.main_blocks(page))


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{BODY}<div class='comments'>{SAID}</div></article>",
        f"<article>{BODY}<div id='commentSection'>{SAID}</div></article>",
        f"<article>{BODY}<div class='post-comments'>{SAID}</div></article>",
        f"<article>{BODY}</article><section id='comments'><article class='comment'>{SAID}</article><article>{SAID}</article></section>",
        f"<article>{BODY}<ul class='comments'><li>I have read this and think it is not at all so.<li>Nor do I think that it is.</ul></article>",
        f"<article>{BODY}<article>{SAID}</article></article>",
        f"<main>{BODY}<div class='sidebar'>{SAID}</div></main>",
        f"<main>{BODY}<div class='widget-area sidebar-left'>{SAID}</div></main>",
        f"<div class='cookie-notice'>{LONG}</div><div>{BODY}</div>",
        f"<div class='cookie-notice'>{LONG}</div><article>{BODY}</article>",
        f"<div class='content sidebar-right'>{BODY}</div>",
        f"<div class='sidebar-right'><article>{BODY}</article></div>",
        f"<div class='sidebar-right'>{BODY}</div>",
        f"<title>About the story<body><article>{BODY}</article>",
        f"<article><p data-x=it's>{BODY[3:]}</article>",
        f"<article data-id=comments title='class=\"sidebar\"' aria-hidden=false>{BODY}</article>",
        f"<svg><article>{BODY}</article>",
    ],
)
def test_parts_stay_out_and_texts_stay(page):
    assert text_of(f"<body>{HEAD}{page}{FOOT}</body>") == TEXT


def test_formulas_and_bare_signs_are_text():
    assert text_of("<article><p>It holds that <math><mi>a</mi></math> &lt; b, and 1 < 2, as <object>everyone</object> knows.</p></article>") == "It holds that a < b, and 1 < 2, as everyone knows."
    assert text_of("<article><p>One sentence of the story before a script that never ends.</p><script>if (a < b) {") == "One sentence of the story before a script that never ends."


def test_cut_is_the_cheapest_and_the_smallest():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 9)
        good, bad = ([draw.randint(0, 6) / 2 for _ in range(n)] for _ in range(2))
        edges = [(*sorted(draw.sample(range(n), 2)), draw.randint(1, 4) / 2) for _ in range(draw.randint(0, 2 * n))] if n > 1 else []
        cost = lambda keep: sum(b if k else g for k, g, b in zip(keep, good, bad, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731, B023
        cheapest = min((cost(keep), sum(keep), keep) for keep in itertools.product((False, True), repeat=n))
        found = mincut_extraction.source_side(good, bad, edges)
        assert (cost(found), sum(found), tuple(found)) == cheapest


@pytest.mark.parametrize(
    "unit", ["<p>A block of text with some words in it, as long as any.</p><p><a href=/x>A link to some other place</a></p>", "<div>Seen here <a>and there</a></div>", "<svg><title>x<b y='", "<div><p>Deep in it</x>"]
)
def test_long_pages_take_time_in_proportion(unit):
    page = "<body>" + unit * (1_000_000 // len(unit))
    start = time.monotonic()
    mincut_extraction.main_blocks(page)
    assert time.monotonic() - start < 8


def test_neutral_blocks_do_not_slow_the_flow():
    n = 20_000
    draw = random.Random(1)
    weights = [draw.choice((-1.0, 1.0)) * draw.random() for _ in range(n)]
    start = time.monotonic()
    mincut_extraction.source_side([max(0.0, w) for w in weights], [max(0.0, -w) for w in weights], [(i, i + 1, 0.6) for i in range(n - 1)] + [(i, i + 3, 0.4) for i in range(n - 3)])
    assert time.monotonic() - start < 8
