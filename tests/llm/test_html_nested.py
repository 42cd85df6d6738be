"""Away marks nested in content marks: the innermost away mark counts."""

import pytest

from savora.llm import html_extract

SHORT = "<p>Ten plain words are here in this very short line.</p>"
LONG = "<p>" + "This one goes on and on with many more words " * 5 + "indeed.</p>"
TEXT = "The text of the article, with a good many words in it, is here to be read."
AWAY = ['<div class="comments">%s</div>', '<div class="ad">%s</div>', '<div class="notice">%s</div>', "<form>%s</form>", "<aside>%s</aside>", "<footer>%s</footer>", '<div class="comments"><article><div class="content">%s</div></article></div>']
AROUND = ["<main><article><p>%s</p>%s</article></main>", '<article class="post"><p>%s</p>%s</article>']


@pytest.mark.parametrize("away", AWAY)
def test_away_inside_content(away):
    for around in AROUND:
        for piece in (SHORT, LONG):
            assert html_extract.main_text(around % (TEXT, away % piece)) == TEXT


def test_surroundings_named_by_the_content_element():
    for page in ('<main class="has-sidebar"><article class="post"><p>%s</p></article></main>', '<main><article class="post share"><p>%s</p></article></main>', "<form><main><article><p>%s</p></article></main></form>"):
        assert html_extract.main_text(page % (TEXT * 3)) == TEXT * 3
