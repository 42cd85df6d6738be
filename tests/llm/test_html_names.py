"""Names of classes are evidence: wrappers' names don't empty a page, parts named like surroundings go, deep markup takes linear time."""

import time

import pytest

from savora.llm.html_extract import main_text

PROSE = "This is a long sentence of prose that tells what happened in the town that day."
BODY = f"<p>{PROSE}</p><p>Another sentence of prose follows it, and it ends the story of the town.</p>"


@pytest.mark.parametrize("inner", [BODY, f"<article>{BODY}</article>"])
@pytest.mark.parametrize("name", ["content-area has-sidebar", "site-content no-sidebar", "post no-comments", "layout menu-open", "page ad-free", "entry legal", "share-post", "newsletter", "widget alert"])
def test_wrappers(name, inner):
    page = f'<html><body><nav>Home | About</nav><div class="{name}">{inner}<div class="comments"><p>{PROSE.replace("town", "city")}</p></div></div><footer>Copyright</footer></body></html>'
    assert main_text(page) == f"{PROSE}\n\nAnother sentence of prose follows it, and it ends the story of the town."


@pytest.mark.parametrize("name", ["ad", "sidebar", "comments", "cookie-notice", "comment-list open", "widget-area", "newsletter signup"])
def test_parts(name):
    page = f'<html><body><div class="{name}"><p>{PROSE.replace("town", "city")}</p></div><article>{BODY}</article></body></html>'
    assert "city" not in main_text(page) and PROSE in main_text(page)


def test_deep_inline_markup():
    start = time.perf_counter()
    main_text("<i>" * 50_000 + "a<hr>" * 50_000)
    main_text("<i>" * 50_000 + "</b>" * 50_000)
    assert time.perf_counter() - start < 10
