"""Whole pages against cuts found by trying all labellings, and blocks that the cut takes from the classifier."""

from itertools import product

from savora.llm import html_extract as h

LONG = "This one goes on and on with many more words in it, as the sentences of articles do."
PAGES = [
    f"<nav><a href=x>Home</a></nav><article><h2>Title</h2><p>{LONG}</p><p>x</p><p>{LONG}</p></article><footer>c x</footer>",
    f"<div><p>{LONG}</p><p><a href=x>One link only</a></p><p>{LONG}</p></div><div class=sidebar><ul><li><a>a</a></li><li>{LONG}</li><li><a>b</a></li></ul></div>",
    f"<main><p>{LONG}</p><aside><p>{LONG}</p></aside><p>Short</p></main><div id=comments><p>{LONG}</p><p>ok</p></div>",
    f"<header><h1>S</h1></header><section><p>a b</p><p>{LONG}</p><blockquote>q</blockquote></section><form><p>{LONG}</p></form>",
]


def test_pages_against_all_labellings():
    for page in PAGES:
        blocks = h.blocks_of(page)
        costs, edges = [h.unary(b) for b in blocks], h.edges(blocks)

        def energy(keep):
            return sum(abs(c) for c, k in zip(costs, keep) if (c > 0) != k) + sum(w for i, j, w in edges if keep[i] != keep[j])

        best = min(product((False, True), repeat=len(blocks)), key=energy)
        assert h.main_text(page) == "\n\n".join(b.text for b, k in zip(blocks, best) if k)


def test_the_cut_overturns_single_blocks():
    for page, text in ((PAGES[1], "One link only"),):
        block = next(b for b in h.blocks_of(page) if b.text == text)
        assert h.unary(block) < 0 and text in h.main_text(page)
    changed = wrong = wrong_alone = 0
    for page in h.examples():
        blocks = h.blocks_of(page)
        costs = [h.unary(b) for b in blocks]
        keep = h.minimum_cut(costs, h.edges(blocks))
        changed += sum((c > 0) != k for c, k in zip(costs, keep))
        wrong += sum((b.text[0] == "K") != k for b, k in zip(blocks, keep))
        wrong_alone += sum((b.text[0] == "K") != (c > 0) for b, c in zip(blocks, costs))
    assert changed > 0 and wrong < wrong_alone


def test_weak_marks_do_not_empty_a_page():
    assert h.main_text(f'<article><div class="related-work"><p>{LONG}</p><p>{LONG}</p></div></article>') == f"{LONG}\n\n{LONG}"
    assert h.main_text(f'<div class="related-work"><p>{LONG}</p><p>{LONG}</p></div>') == f"{LONG}\n\n{LONG}"
    assert h.main_text('<article><p>' + LONG + '</p></article><div class="related"><ul><li><a href=x>More of this</a></li><li><a href=x>And this</a></li></ul></div>') == LONG


def test_tables(spark):
    big = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGES[0], "x"), (1, "u", PAGES[0], "x"), (2, None, big, None), (3, "v", None, "y"), (4, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, cost string")
    got = sorted(((r.page_id, r.text) for r in h.extract(df).collect()), key=str)
    assert got == sorted([(1, h.main_text(PAGES[0]))] * 2 + [(2, "\n\n".join([LONG] * 3000)), (3, ""), (4, "")], key=str)
    assert h.extract(df.limit(0)).count() == 0
