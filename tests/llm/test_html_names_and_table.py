"""Names that an article's own parts carry, and the table function on odd rows."""

import pytest

from shotloom.llm import html_extraction as h


@pytest.fixture(scope="module")
def model():
    return h.train(h.labelled_pages())


PROSE = "the town council met again and spoke about the new bridge over the river "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><h1>Old news</h1><section class="related-work"><h2>Related work</h2><p>{}</p></section></article>', ["Old news", "Related work", "{}"]),
        ('<body><div class="tabs"><p>{}</p></div></body>', ["{}"]),
        ('<article><h1>Prices</h1><div class="share-price"><p>{}</p></div></article>', ["Prices", "{}"]),
        ('<article><h1>Alarm</h1><section id="alert-system"><p>{}</p></section></article>', ["Alarm", "{}"]),
        ('<article><h1 class="comment-title">No comment</h1><p>{}</p></article>', ["No comment", "{}"]),
        ('<main><div class="story-tabs"><p>{}</p></div></main>', ["{}"]),
        ('<nav class="site-nav"><a href="/">Home</a></nav><article><p>{}</p><div class="promo-box">Buy two for one now</div></article><div class="comment-list"><div class="comment"><p>Nice one, thank you</p></div></div><div class="page-footer"><p>All rights reserved</p></div>', ["{}"]),
    ],
)
def test_names_are_evidence_and_no_verdict(model, page, want):
    prose = (PROSE * 3).strip()
    assert h.main_text(page.replace("{}", prose), model) == "\n\n".join(w.replace("{}", prose) for w in want)


def test_what_names_say():
    said = {"related-work": ("side", False), "related": ("side", True), "promo-box": ("advert", True), "comment-list": ("comment", True), "post-comments": ("comment", True), "ad-slot-3": ("advert", True), "site-footer": ("edge", True), "story-tabs": ("menu", False), "hero": ("none", False), "article-body": ("content", True)}
    assert {name: h._named(name) for name in said} == said


def test_the_table_function_on_odd_rows(spark, model):
    page = f"<article><h1>Town &amp; river</h1><p>{PROSE * 2}</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "y"), (None, "v", page, None), (4, "u", "<p>" + PROSE * 5000, "z"), (5, "u", "<<<>>><div", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = h.extract_pages(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = sorted((str(i), str(u), h.main_text(page, model)) for i, u, page, _ in rows)
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got.collect()) == want and all(r.n_chars == len(r.text) for r in got.collect())
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[2] == texts[3] == "" and texts[1].startswith("Town & river\n\n") and len(texts[4]) > 300_000
    assert h.extract_pages(spark.createDataFrame([], df.schema), model).collect() == []
