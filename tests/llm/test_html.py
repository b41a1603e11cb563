"""Operator 6 on hand-marked pages: hostile class names, no names, notices, comments; and on odd rows."""

import pytest
from pyspark.sql import functions as F

from riskbook.llm import html_text

TITLE = "<h1>A fine title of things</h1>"
ART = TITLE + "".join(f"<p>The anchor of thing {k} was that other matter, and so it went on for a while, with many words to say.</p>" for k in range(5))
NAV = "<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul>"
FOOT, COOKIE = "<p>Copyright 2024 The Site. All rights reserved.</p>", "<div><p>We use cookies to make this better. Accept all.</p></div>"
COMMENTS = '<section id="comments"><article class="comment"><p>I like this text very much, and so I say it here.</p></article><article class="comment"><p>Me too, my friend, and it is so good.</p></article></section>'
PAGES = {
    "no-sidebar": f'<div class="wrap no-sidebar"><article>{ART}</article></div>',
    "with-header": f'<div class="with-header"><main>{ART}</main></div>',
    "comments-open": f'<article class="post comments-open">{ART}</article>',
    "category-legal": f'<article class="post category-legal">{ART}</article>',
    "plain wrapper": f'<div class="site"><article>{ART}</article></div>',
    "wrapper named sidebar": f'<div class="sidebar-left"><div class="content">{ART}</div><div class="sidebar"><p>Side text that is here for all.</p></div></div>',
    "whole page in a form": f'<form id="f">{NAV}<div id="main">{ART}</div><footer>us</footer></form>',
    "nothing named": f"{COOKIE}{NAV}<div><div>{ART}</div></div><div>{FOOT}</div>",
    "loose footer": f"<div>{NAV}</div><div>{ART}</div>{FOOT}",
    "reader comments": f"<article>{ART}</article>{COMMENTS}",
    "related story": f'<div id="main">{ART}<aside class="related"><article><p>Another story you may like to read.</p></article></aside></div>',
    "cookie notice": f'<div class="cookie-notice"><p>We use cookies here.</p></div><main>{ART}</main><div class="newsletter"><p>Give us your mail address now.</p></div>',
    "widget layout": f'<div class="widget-area-wrap header-layout"><section>{ART}</section></div>',
    "share in article": f'<article>{ART}<div class="share-buttons">Tweet this</div></article>',
    "table layout": f"<table><tr><td>{NAV}</td><td>{ART}</td></tr></table>{FOOT}",
    "header in article": f"<article><header>{TITLE}</header>{ART[len(TITLE):]}</article>",
    "form and script in article": f"<article>{ART}<form><label>Mail</label><button>Go</button></form><script>x('<p>no</p>')</script></article>",
}


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def test_hand_marked_pages(spark, pages):
    rows = [(10**6 + k, name, f"<html><head><title>T</title></head><body>{x}</body></html>") for k, (name, x) in enumerate(PAGES.items())]
    got = {r["url"]: r for r in html_text.extract(pages.unionByName(spark.createDataFrame(rows, pages.schema))).where("page_id >= 1000000").collect()}
    want = "\n".join(x.split(">", 1)[1] for x in ART.replace("</h1>", "</p>").split("</p>")[:-1])
    assert {name: r["text"] for name, r in got.items()} == dict.fromkeys(PAGES, want)
    assert all(r["n_chars"] == len(want) for r in got.values())


def test_names_that_name_nothing():
    for word in ("no-sidebar", "with-header", "comments-open", "category-legal", "tag-promo", "has-sidebar"):
        assert html_text.naming(f' class="{word}"')[1:] == (False, frozenset())
    assert html_text.naming(' class="site-footer"')[2] and html_text.naming(" id=comments")[2] and html_text.naming(" class=entry-content")[1]


def test_clashing_columns_repeated_rows_and_nulls_together(pages):
    some = pages.limit(12).withColumns({"text": F.lit("clash"), "n_chars": F.lit(1), "x": F.lit(2), "h": F.lit(None).cast("string")})
    odd = some.limit(2).withColumns({"html": F.lit(None).cast("string"), "page_id": F.lit(None).cast("long")})
    got = html_text.extract(some.unionByName(some).unionByName(odd)).collect()
    assert len(got) == 26 and sum(r["text"] == "" for r in got) == 2
