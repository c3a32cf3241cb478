"""Operator 3."""

import html
import re
import time

import pytest

from lodestream.llm import html_text
from tests.llm import helpers

PROSE = "The quick brown fox is in the house and it was on the way to the sea, which is not what they had in mind when they came to the town of all towns and so it was that the day came to an end for them and for all of us that were there."


def page(body, head="<title>T of the page</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "": "",
    "plain text": "plain text",
    "<p>just <i>a</i>text &amp; more&nbsp;&#x41;&lt;b&gt;</p>": "just atext & more A<b>",
    page(f"<nav><a href=x>Home of the site</a></nav><article><h1>Title</h1><p>{PROSE}<p>Qzx vrt.</p></article><footer>{PROSE}</footer>"): f"Title {PROSE} Qzx vrt.",
    page(f"<header><h1>Site</h1></header><main><h2>A</h2><p>{PROSE}</p></main><aside>{PROSE}</aside>"): f"A {PROSE}",
    page(f"<article><header><h1>Own</h1></header><p>{PROSE}</p><form><p>{PROSE}</p></form></article>"): f"Own {PROSE}",
    page(f"<div class='cookie-notice'><p>{PROSE}</p></div><div><h2>B</h2><p>{PROSE}</p></div><div id=comments><p>{PROSE}</p></div>"): f"B {PROSE}",
    page(f"<div class='page has-sidebar'><p>{PROSE}</p></div><div class=sidebar>{PROSE}</div>"): PROSE,
    page(f"<article><p>{PROSE}</p><script>var t='</p><p>{PROSE}';</script><style>p{{}}</style><!-- {PROSE} --></article><article class=comment>{PROSE}</article>"): PROSE,
    page(f"<article><p><b>{PROSE}<br>after<p>{PROSE}</article>"): f"{PROSE} after {PROSE}",
    page("<ul><li><a href=a>one of the links</a></li><li><a href=b>two</a></li></ul>"): "",
    page(f"<p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p style='display: none'>{PROSE}</p><p hidden>{PROSE}</p>"): f"{PROSE} Short. {PROSE}",
    page(f"<article><p title='a > b'>{PROSE}</p><p title=it's>1 < 2 & 3</p></article>"): f"{PROSE} 1 < 2 & 3",
    page(f"<article><p>{PROSE}</p><script>never closed <p>{PROSE}"): PROSE,
    page(f"<article><div></div></div></p><p>{PROSE}</p></article></div><div role=contentinfo>{PROSE}</div>"): PROSE,
}


@pytest.mark.parametrize("source", CASES, ids=range(len(CASES)))
def test_cases(source):
    assert html_text.extract(source) == CASES[source]


def test_short_blocks_follow_their_nearest_neighbours():
    bad = "<p>" + "<a href=x>link to another page</a> " * 3 + "</p>"
    got = html_text.extract(page(f"<p>{PROSE}</p><p>near good</p><p>x y</p><p>near bad</p>{bad}"))
    assert got == f"{PROSE} near good x y"


def test_long_and_hostile_pages_end_soon():
    for source in ("<p title='" * 3000, "<" * 100_000, "<!--" * 20_000, "<div>" * 20_000 + "x", "&" * 100_000, "<a href=\"" + "x" * 200_000, "<script>" * 3000):
        html_text.extract(source)


def test_op3_on_all_pages(spark, data):
    """On the test pages the main text is the article element without its markup."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = html_text.op3_html_extraction(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r["text"] == " ".join(html.unescape(plain).split())
        assert r["n_chars"] == len(r["text"])


def test_pages_without_article_elements(data):
    """The rules find the same text where nothing says which part is the article."""
    import duckdb

    for (source,) in duckdb.sql(f"SELECT html FROM '{data}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert html_text.extract(source.replace("<article>", "<div>").replace("</article>", "</div>")) == plain


LINKS = "".join(f"<li><a href=/{k}>section number {k} of this site</a></li>" for k in range(8))
CHINESE = ["本市昨天公布了新的公共交通计划，居民们对此表示欢迎，认为新的线路会让出行更加方便。" * 3, "专家指出，计划的实施还需要几年时间，期间会有一些道路施工，请大家注意安全。" * 3]
POLISH = ["Wczoraj władze miasta ogłosiły nowy plan komunikacji miejskiej, który mieszkańcy przyjęli z zadowoleniem, ponieważ nowe linie ułatwią im codzienne dojazdy do pracy oraz szkoły w całym regionie.", "Eksperci podkreślają, że wdrożenie planu potrwa kilka lat, a roboty drogowe spowodują utrudnienia, dlatego kierowcy powinni zachować szczególną ostrożność podczas jazdy."]
OTHERS = ["Ranking: Kowalski 12, Nowak 9, Wisniewski 7, Zielinski 5, Kaminski 3, Wozniak 2, Mazur 1", "12.05 14.20 16.35 18.50 20.05 22.20 — 12.05 14.20 16.35 18.50 20.05 22.20 — 23.40"]


@pytest.mark.parametrize("texts", [CHINESE, POLISH, [PROSE, *OTHERS, PROSE]], ids=["chinese", "polish", "within"])
def test_languages_without_stop_words_and_blocks_without_any(texts):
    body = "".join(f"<p>{t}</p>" for t in texts)
    assert html_text.extract(page(f"<ul>{LINKS}</ul><div>{body}</div><div>© 2024 The Site. {PROSE[:60]}</div>")) == " ".join(texts)


def test_rules_decide():
    """Blocks that differ in links, length and stop words alone."""
    links = "<p>" + " and ".join(f"<a href=x>{PROSE[:40]}</a>" for _ in range(3)) + "</p>"
    listed = f"<p>{OTHERS[0]}</p>"
    assert html_text.extract(page(f"{links}{listed}{links}<p>{PROSE}</p><p>{PROSE[:99]}</p>{links}<p>{PROSE[:99]}</p>{links}")) == f"{PROSE} {PROSE[:99]}"
    known = [html_text.Block(t, 0, False) for t in (PROSE, PROSE[:99], OTHERS[0], PROSE[:60], "Copyright 2024 of all that")]
    assert [html_text.first_pass(b, True) for b in known] == ["good", "near", "short", "short", "bad"]
    assert [html_text.first_pass(b, False) for b in known] == ["good", "good", "good", "short", "bad"]


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<div>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000 + "</div>" * 50_000, "<p><article>" + "<div>" * 50_000 + "</p>" * 50_000, "<span hidden>" * 50_000 + "</i></span>" * 50_000], ids=range(5))
def test_deep_nesting_takes_linear_time(source):
    begin = time.process_time()
    html_text.extract(source)
    assert time.process_time() - begin < 2


def test_columns_of_other_names(spark):
    rows = [(1, "u", "<p>a</p>", "mine", 5, ("s",), "z")]
    got = html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, `we.ird` struct<`a b`:string>, `b``t` string")).first()
    assert (got["text"], got["n_chars"], got["we.ird"]["a b"], got["b`t"]) == ("a", 1, "s", "z")


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "", "<article><p>" + "word " * 300_000 + "</article>")]
    got = html_text.html_text(spark.createDataFrame(rows, helpers.PAGES)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 1, 5 * 300_000 - 1]
    assert html_text.html_text(helpers.empty(spark, helpers.PAGES)).count() == 0


@pytest.mark.parametrize("size", [3000, 5000, 300_000])
def test_quoted_values_of_any_length(size):
    value = f"<p>{PROSE}</p>" * (size // 200)
    for quote in "\"'":
        source = page(f"<article><p>{PROSE}</p><div data-x={quote}{value}{quote} srcdoc = {quote}{value}{quote}>after</div><p>{PROSE}</p></article>")
        assert html_text.extract(source) == f"{PROSE} after {PROSE}"
    # quotes that don't open a value, or aren't closed
    assert html_text.extract(page(f"<article><p title=it's>{PROSE}</p>{'<br>' * size}<p>it's {PROSE}</p></article>")) == f"{PROSE} it's {PROSE}"
    assert html_text.extract(page(f"<article><p title=\">{PROSE}</p></article>")) == PROSE


def test_hostile_quotes_end_soon():
    for source in ("<p a='>' " * 30_000, "<p a='>\" " * 30_000, "<a" * 100_000, "<a <!--" * 30_000, "<p title='" * 30_000 + ">", "<p a=\"'>" * 30_000):
        begin = time.monotonic()
        html_text.extract(source)
        assert time.monotonic() - begin < 20


@pytest.mark.parametrize("wrapper", ['<div class="elementor-widget elementor-widget-text-editor">', '<div class="widget-content">', '<div class="header-layout">', '<div class="sidebar-right-layout">', '<div class="promo-free-story">', '<form id="aspnetForm">'])
def test_names_around_the_whole_text_say_nothing(wrapper):
    """And names within them still count."""
    end = f"</{wrapper[1:5].split(' ')[0]}>"
    assert html_text.extract(page(f"{wrapper}<p>{PROSE}</p>{end}")) == PROSE
    rest = f"<h1>Title</h1><p>{PROSE}</p><div class=ad>{PROSE}</div><p>{PROSE}</p><div id=comments><p>{PROSE}</p><p>{PROSE}</p></div>"
    assert html_text.extract(page(f"<nav><a href=x>home</a></nav>{wrapper}{rest}{end}<footer>{PROSE}</footer>")) == f"Title {PROSE} {PROSE}"


def test_each_of_several_widgets_holds_text():
    widget = f"<div class='elementor-widget'><p>{PROSE}</p></div>"
    assert html_text.extract(page(f"{widget}{widget}<div class='elementor-widget sidebar'><p>{PROSE}</p></div>")) == f"{PROSE} {PROSE}"


def test_forms_lose_their_controls_only():
    form = f"<form><p>{PROSE}</p><label>Your name</label><select><option>one</option></select><button>Send</button></form>"
    assert html_text.extract(page(form)) == PROSE


def test_what_follows_an_article_is_no_part_of_it():
    assert html_text.extract(page(f"<article><p>{PROSE}</p></article><section class='reader-feedback'><p>{PROSE}</p></section>")) == PROSE
    assert html_text.extract(page(f"<p>{PROSE} {PROSE}</p><article><a href=x>A teaser of the next</a></article>")) == f"{PROSE} {PROSE}"


def test_pages_without_class_names(data):
    """No class or id says what is what; the rules change each page, and leave its article."""
    import duckdb

    for (source,) in duckdb.sql(f"SELECT html FROM '{data}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        bare = re.sub(r"\s(?:class|id)=(\"[^\"]*\"|[^\s>]+)", "", source)
        assert "class=" not in bare
        assert html_text.extract(bare) == plain != " ".join(b.text for b in html_text.cut(bare))
