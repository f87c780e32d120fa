import html
import re

import pytest

from panelrd.llm import html_extract as H

LONG = "This is the first of the paragraphs that a reader of the page will see, and it has as many of the small words as any text that was written for people to read on a screen, with no links in it at all and with more than two hundred characters."
LONG2 = "It was a long day for all of the people who had been at the place, and they were not sure that it would be of any use to go on with the work that they had begun so early in the morning of that day, as one of them said."


@pytest.mark.parametrize(
    "page,expected",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (f"<body><nav><a href=1>Home</a></nav><div class='ad'>{LONG}</div><article><h1>Title</h1><p>{LONG}<p>Short.</p><form>Name: <input></form><aside>{LONG2}</aside></article><footer>&copy; x</footer>", f"Title\n{LONG}\nShort."),
        (f"<div id=menu-main><p>{LONG}</p></div><div class=content><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG2}</p></div><div class='post-comments'><p>{LONG2}</p></div><p>&copy; 2020 somebody</p>", f"Head\n{LONG}\nYes.\n{LONG2}"),
        (f"<form id=f><header><p>{LONG}</p></header><main><p>{LONG}</p></main></form>", LONG),
        ("<article><p>a  &amp;&nbsp;b\n\t c<br>d</p><p>&lt;p&gt; x<span>y</span></p><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><style>p{}</style></article>", "a & b c d\n<p> xy"),
        ("<article><p>one</p><ul><li><a href=1>link one</a></li><li><a href=2>link two</a></li></ul><p>two</article>", "one\ntwo"),
        (f"<article class='comments-open'><div class=has-sidebar>{LONG}</div></article><article class=comment>{LONG2}</article>", LONG),
        (f"<article><div class=cookie-notice>{LONG}</div><p>{LONG}<div style='display: none'>{LONG2}</div><div hidden>{LONG2}</div><div role=navigation>{LONG2}</div></article>", LONG),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>{LONG2}</footer></article>", f"T\n{LONG}"),
        ("<article><p>a < b and c > d <unclosed", "a < b and c > d <unclosed"),
        ('<article><p title="a > b">x</p><p title="never closed>y</p></article>', "x\ny"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>1<li>2</ul></article>", "a\nb\nc\n1\n2"),
        (f"<div><p>{LONG}</p><p><a href=1>Read more of this</a></p><p>{LONG2}</p></div>", f"{LONG}\n{LONG2}"),
        ("<title>t</title><article>" + "<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ],
)
def test_pages(page, expected):
    assert H.main_text(page) == expected


def test_short_blocks_take_the_label_of_the_nearest_decided_one():
    blocks = [H.Block(text=t, label=x) for t, x in (("m", False), ("a", None), ("b", None), ("t", True), ("c", None), ("n", False))]
    H.second_pass(blocks)
    assert [b.label for b in blocks] == [False, False, True, True, True, False]  # as near to both: text


def _article(page):
    found = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)>", found))
    return "\n".join(p for p in parts if p)


def test_whole_table_against_its_articles(spark, sf_small):
    from panelrd.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_extraction"](spark, sf_small).collect()
    assert len(got) == len(pages) and all(r.text == _article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_odd_tables(spark):
    page = f"<p>{LONG}</p>"
    long = "<article>" + "<p>word " * 100_000
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (None, None, None, "x"), (2, "v", "", "y"), (3, "w", long, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in H.extract_text(df).collect())
    assert got == [(0, None, 0, 0), (1, "u", len(LONG), len(LONG)), (1, "u", len(LONG), len(LONG)), (2, "v", 0, 0), (3, "w", 499_999, 499_999)]
    assert H.extract_text(df.limit(0)).count() == 0
