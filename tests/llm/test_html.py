"""Pages with odd markup, names of elements, and odd tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from specloom.llm import html_text

LONG = " ".join(f"word{k}" for k in range(40))


@pytest.mark.parametrize("name", ["entry-header", "share-price", "search-results-study", "article-footer", "related-work", "notice-of-intent"])
def test_names_with_a_word_of_their_own_are_content(name):
    page = f'<html><body><nav><a>Home</a></nav><article><div class="{name}"><h1>Title words</h1></div><p>{LONG}</p></article></body></html>'
    assert html_text.extract(page) == f"Title words {LONG}"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "site-header", "cookie-notice", "comment-list", "user-comments", "related-posts", "social-links", "newsletter-signup", "x sidebar-left"])
def test_names_of_boilerplate(name):
    page = f'<html><body><article><p>{LONG}</p><div class="{name}"><p>not this</p></div><p>{LONG}</p></article></body></html>'
    assert html_text.extract(page) == f"{LONG} {LONG}"


def test_articles_beside_cards():
    card = "<article class=card><p>See this too</p></article>"
    assert html_text.extract(f"<main><h1>T</h1><p>{LONG}</p><p>{LONG}</p></main><aside>{card}</aside>") == f"T {LONG} {LONG}"
    two = html_text.extract(f"<article><p>first {LONG}</p></article><article><p>second {LONG}</p></article>")
    assert two == f"first {LONG} second {LONG}"


def test_unclosed_elements_take_linear_time():
    t = time.perf_counter()
    assert html_text.extract("<div><span>" * 40_000 + LONG + "</b></i>" * 40_000) == LONG
    assert time.perf_counter() - t < 10


def test_odd_tables(spark):
    row = (1, "u", f"<p>{LONG}</p>", "x", 5)
    d = spark.createDataFrame([row, row, (None, None, "", "y", 6), (2, "v", "<p>" + "a é " * 300_000 + "</p>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    out = html_text.extract_pages(d.withColumn("tag", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 4 * 300_000 - 1)]
    assert html_text.extract_pages(d.where("false")).count() == 0


NAMES = "reader-comments article-comments related-articles related-stories cookie-policy privacy-notice gdpr-banner google-ad ad-leaderboard ad-300x250 newsletter-form sign-up breadcrumb-trail share-buttons social-media responses discussion comments comment-body user-comments top-ad site-navigation subscribe-box"


@pytest.mark.parametrize("name", NAMES.split())
def test_boilerplate_inside_and_after_an_article(name):
    part = f'<div class="{name}"><p>not this {LONG}</p></div>'
    assert html_text.extract(f"<body><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body>") == f"{LONG} {LONG}"
    assert html_text.extract(f"<body><article><p>{LONG}</p></article>{part}</body>") == LONG


def test_text_after_a_long_advert_stays():
    assert html_text.extract(f"<article><p>one</p><div class=ad>{LONG} {LONG}</div><p>two</p></article>") == "one two"


def test_lists_of_links_go_and_lists_with_links_stay():
    links = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(30))
    assert html_text.extract(f"<body><p>Word</p><ul>{links}</ul></body>") == "Word"
    assert html_text.extract(f"<p>Word</p><ul><li>Part<ul>{links}</ul></li><li>more text here</li></ul>") == "Word Part more text here"
    kept = "".join(f"<li>Step {k} is told <a href=x>here</a></li>" for k in range(5))
    assert html_text.extract(f"<p>Word</p><ul>{kept}</ul>").count("Step") == 5


def test_region_equals_a_quadratic_search():
    r = random.Random(9)
    for _ in range(300):
        x = [r.choice([-3, -2, -1, -0.5, 0, 1, 2, 4]) for _ in range(r.randint(0, 30))]
        every = [(sum(x[i:j]), -i, -j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        most = max((s for s, *_ in every), default=0)
        start, end = html_text.best_region(x)
        assert sum(x[start:end]) == max(most, 0) and (end > start) == (most > 0)
