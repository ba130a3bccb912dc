"""Browser histories and articles of pages."""

from __future__ import annotations

import sqlite3

import pytest
from palimpsest.operators import article, parse
from palimpsest.sources.browser import BrowserHistorySource
from palimpsest.sources.capture import browser_documents
from pyspark.sql import functions as F


@pytest.fixture
def histories(tmp_path):
    """A history file of each kind: (paths, add(browser, ids))."""
    paths = {"chrome": f"{tmp_path}/History", "firefox": f"{tmp_path}/places.sqlite"}
    chrome, firefox = (sqlite3.connect(p) for p in paths.values())
    chrome.executescript("create table urls (id integer primary key, url text, title text); create table visits (id integer primary key, url integer, visit_time integer)")
    firefox.execute("create table moz_places (id integer primary key, url text, title text, last_visit_date integer)")

    def add(browser, ids):
        for i in ids:
            url = "about:blank" if i % 10 == 9 else f"https://{browser}.example.org/{i}"
            if browser == "chrome":
                chrome.execute("insert into urls values (?, ?, ?)", (1000 + i, url, f"Page {i}"))
                chrome.execute("insert into visits values (?, ?, ?)", (i, 1000 + i, (11_644_473_600 + 1_700_000_000 + i) * 1_000_000))
            else:
                firefox.execute("insert into moz_places values (?, ?, ?, ?)", (i, url, None if i == 3 else f"Page {i}", None if i == 4 else (1_700_000_000 + i) * 1_000_000))
        chrome.commit()
        firefox.commit()

    yield paths, add
    chrome.close()
    firefox.close()


def test_histories_in_batch(spark, histories):
    paths, add = histories
    add("chrome", range(1, 31))
    add("firefox", range(1, 6))
    spark.dataSource.register(BrowserHistorySource)
    rows = spark.read.format("browser_history").options(**paths, chrome_after=20).load()
    assert sorted((r.browser, r.visit_id) for r in rows.collect()) == [*(("chrome", i) for i in range(21, 31) if i % 10 != 9), *(("firefox", i) for i in range(1, 6))]
    times = {(r.browser, r.visit_id): r.at for r in rows.withColumn("at", F.unix_seconds("visited_at")).collect()}
    assert times["chrome", 21] == 1_700_000_021 and times["firefox", 2] == 1_700_000_002 and times["firefox", 4] is None
    found = browser_documents(rows).collect()
    assert len(found) == rows.count() and {r.content for r in found if r.source_path.endswith("firefox.example.org/3")} == {"\nhttps://firefox.example.org/3"}


def test_histories_as_a_stream_have_a_cursor_each(spark, histories, tmp_path):
    paths, add = histories
    spark.dataSource.register(BrowserHistorySource)

    def run():
        stream = spark.readStream.format("browser_history").options(**paths).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.browser, r.visit_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    add("chrome", range(100, 108))
    add("firefox", range(1, 4))
    first = [*(("chrome", i) for i in range(100, 108)), *(("firefox", i) for i in range(1, 4))]
    assert run() == first
    assert run() == first  # a restart reads nothing twice
    add("firefox", range(4, 7))  # with ids below the other browser's
    add("chrome", (108, 111))
    assert run() == sorted([*first, *(("firefox", i) for i in range(4, 7)), ("chrome", 108), ("chrome", 111)])


TEXT = "The river rises in the hills above the town and runs for many miles through meadows before it meets the sea."
LINKS = "".join(f'<li><a href="/{i}">Section number {i} of the site</a></li>' for i in range(12))
PAGES = {
    "navigation and footer": f"<html><head><title>The river</title><style>p {{}}</style></head><body><nav><ul>{LINKS}</ul></nav><div id=main><h1>The river</h1><p>{TEXT}</p><p>Short.</p><p>{TEXT} <a href=x>more</a></p></div><footer>All rights reserved by the makers of this page and others</footer></body></html>",
    "two columns": f"<title>The river</title><body><table><tr><td><ul>{LINKS}</ul></td><td><h2>The river</h2>{TEXT}<br>{TEXT}<p>{TEXT}</td></tr></table><div><a href=/>Home</a> | <a href=/a>About us and the way that we work</a></div>",
    "divisions only": f"<title>The river</title><div class=menu>{LINKS}</div><div><div><div>{TEXT}</div><div>{TEXT}</div></div></div><div class=foot><a href=/>Imprint of this site and its owners</a></div><script>var x = '{TEXT * 9}';</script>",
    "open elements": f"<title>The river</title><ul>{LINKS.replace('</li>', '')}</ul><article><h1>The river<h2>Course</h2><p>{TEXT}<p>{TEXT}<p>{TEXT}</article><aside>{TEXT * 4}</aside>",
}


@pytest.mark.parametrize("name", PAGES)
def test_the_article_of_a_page(name):
    title, text = article.article(PAGES[name])
    assert title == "The river" and text.count(TEXT) == PAGES[name].split("<script>")[0].split("<aside>")[0].count(TEXT)
    assert not any(x in text for x in ("Section number", "rights reserved", "Imprint", "About us", "var x", "Home"))


def test_headings_and_short_paragraphs_of_an_article_stay():
    assert article.article(PAGES["navigation and footer"])[1].split("\n") == ["The river", TEXT, "Short.", f"{TEXT} more"]


def test_pages_without_an_article(spark):
    pages = ["", "no tags", f"<ul>{LINKS}</ul>", "<p>Hi", "<div>" * 3000 + TEXT, "<<<>>>", "<p>a &amp; b</p>", f"<a href=x>{TEXT}", f"<nav>{TEXT}", "</p></div></body>" + TEXT]
    assert [bool(article.article(p)[1]) for p in pages] == [False, False, False, False, True, False, False, False, False, True]
    table = spark.createDataFrame([("p.html", p) for p in [*pages, None]], "source_path string, text string")
    got = [r.clean_content for r in parse.parsed(table).collect()]
    assert got[4] == TEXT and got[6] == "a &amp; b" and got[2].startswith("Section number 0") and got[0] is None and got[-1] is None  # the rest falls back on all text
