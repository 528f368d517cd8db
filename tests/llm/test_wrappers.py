"""Pages whose wrappers carry telling words."""

import pytest
from feltmill.llm import mincut_extraction

TEXT = "\n\n".join(f"Sentence number {i} of the story, which is long enough to be content of the page." for i in range(6))
BODY = "".join(f"<p>{t}</p>" for t in TEXT.split("\n\n"))
EXTRA = "<div class='sidebar'><p>Other stories that are listed here.</p></div><footer>All about us.</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content has-sidebar'><main><article>{BODY}</article></main></div>",
        f"<div class='content has-sidebar'><article>{BODY}</article><div class=related><p>Read more.</p></div></div>",
        f"<div class='no-sidebar'>{BODY}</div>",
        f"<section class='post-social'>{BODY}</section>",
        f"<form action='/go'>{BODY}</form>",
        f"<form><div class='page with-menu'><div class='tags-on'><div>{BODY}</div></div></div></form>",
        f"<article class='no-sidebar'>{BODY}<div class='ad'>Buy this thing now, it is a very good thing to buy, and cheap.</div></article>",
    ],
)
def test_wrappers_keep_their_text(page):
    assert "\n\n".join(mincut_extraction.main_blocks(f"<body>{page}{EXTRA}</body>")) == TEXT


def test_comments_in_articles_of_their_own_stay_out():
    page = f"<article>{BODY}</article><section id=comments><article class=comment><p>I think that this is really quite wrong about it.</p></article></section>"
    assert "\n\n".join(mincut_extraction.main_blocks(page)) == TEXT
    assert mincut_extraction.main_blocks("<nav><article><p>A text in a landmark element is never taken.</p></article></nav>") == []
