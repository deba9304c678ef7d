import html
import re

import duckdb
import pytest

from loanlens.llm import html_extraction as X, html_tokens as H


def page(article, host_extra="", k=0):
    return (f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>"
            f"<header>Site {k}</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About {k}</a></ul></nav><!-- ad -->"
            f"<div class='ad box'>Buy {k}</div><div id=cookie-notice>We use cookies</div>{host_extra}"
            f"{article}<aside>side {k}</aside><section class='comments'><p>reader {k}</p></section>"
            f"<form><input name=q>search</form><footer>&copy; host</footer></body></html>")


def text_of(h):
    return X.main_text(h, [], set(), None)


@pytest.mark.parametrize("source,want", [
    (page("<article><h1>Head</h1><p>One &amp; two<br>three</p></article>"), "Head One & two three"),
    (page("<article><p><b>un<i>closed</i> <p>next\n\n line &eacute;&#233;&nbsp;x</article>"), "unclosed next line éé x"),
    (page("<main><div><p>a</p><div class=share>Share!</div><p>b <a href=x>link</a> c</div></main>"), "a b link c"),
    (page("<article><p>if a < b and c > d</p></article>"), "if a < b and c > d"),
    (page("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>"), "x y 1 2"),
    (page("<ARTICLE CLASS=post><P>Upper</P></ARTICLE>"), "Upper"),
    (page("<article><p>Kept</p><div class='comment-list'><p>not kept</p></div><script>x</script></article>"), "Kept"),
    ("<p>no container at all", "no container at all"),
    ("plain text", "plain text"),
    ("", ""), ("   \n ", ""), ("<!-- only a comment", ""), ("<script>never closed", ""), ("<", "<"),
])
def test_one_page(source, want):
    assert text_of(source) == want


def test_page_without_article_takes_the_fullest_container():
    assert text_of("<body><div class=menu>a b c d e f g h i j k l m n o p</div><div id=x><p>the running text of it</p><p>more</p></div>"
                   "<div><a href=1>link one two three four five six seven eight nine</a></div></body>") == "the running text of it more"


def test_page_without_article_keeps_every_running_slot():
    body = "<p>the running text of the page</p><p>see<br><a href=1>this long long long link</a></p>"
    assert text_of(page(f"<div class=top><h1><a href=/x>Head line</a></h1><p>a lead</p><div class=body>{body}</div></div>"
                        "<blockquote>a quote</blockquote><ul><li>one <a href=2>x</a><li>two</ul><div class=rest>the end</div>"
                        "<div><a href=3>elsewhere</a> | <a href=4>more of it</a></div><h3><a href=5>Next story</a></h3>")) == (
        "Head line a lead the running text of the page see this long long long link a quote one x two the end")


def test_template_tokens_in_order_and_nested():
    found = H.tokens("<body><div>A</div><ul><li>x</li><li>y</li></ul><div>B</div></body>")
    at = {t.text or t.key: t.key for t in found}
    key = [t.key for t in found]
    ul, li, end_li, end_ul = key[4], key[5], key[7], key[11]
    assert X.template_tokens(found, [[ul, end_ul], [li, end_li]]) == {4, 11, 5, 7, 8, 10}
    assert X.template_tokens(found, [[end_ul, ul]]) == set()  # out of order
    assert X.template_tokens(found, [[ul, key[6]], [li, end_ul]]) == {4, 6}  # the second class crosses the first
    assert at["A"] == key[2]


def run(spark, rows, schema="page_id long, url string, html string, host string, text string"):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in X.extract(df).collect()), key=repr)


def test_boilerplate_of_a_host_is_learnt(spark):
    rows = [(i, "http://A.example/x%d" % i, page(f"<article><p>Subscribe today</p><p>own text {i}</p></article>")) for i in range(20)]
    rows += [(100 + i, "http://b.example/", page("<article><p>Subscribe today</p><p>copy</p></article>")) for i in range(3)]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert all(got[i] == f"own text {i}" for i in range(20))
    assert all(got[100 + i] == "Subscribe today copy" for i in range(3))  # too few pages to tell


def test_copies_do_not_make_their_article_the_template(spark):
    story = "<p>A long story</p><p>that many pages carry</p>"
    rows = [(i, "http://c.example/%d" % i, page(f"<article><p>Subscribe today</p>{story}</article>", k=i)) for i in range(30)]
    rows += [(100 + i, "http://c.example/o%d" % i, page(f"<article><p>Subscribe today</p><p>own text {i}</p></article>")) for i in range(9)]
    long = "".join(f"<p>{x} {'word ' * 40}</p>" for x in "abcdef")  # near copies: one more paragraph that differs
    rows += [(200 + i, "http://d.example/%d" % i, page(f"<article>{long}<p>changed {i}</p></article>")) for i in range(20)]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert all(got[i] == "A long story that many pages carry" for i in range(30))
    assert all(got[100 + i] == f"own text {i}" for i in range(9))
    assert all(got[200 + i].startswith("a word") and got[200 + i].endswith(f"word changed {i}") for i in range(20))


def test_layouts_of_a_third_small_hosts_and_doubled_rows(spark):
    def laid(x, i):
        body = f"<div class=wrap-{x}><div>Terms of {x}</div><div class=text><p>own {x} story {i}</p></div><div>Terms of {x}</div></div>"
        return page(f"<article>{body}</article>" if i % 2 else body)
    rows = [(i, "http://l.example/%d" % i, laid("abc"[i % 3], i)) for i in range(60)]
    rows += [(100 + i, "http://s.example/%d" % i, page(f"<article><p>Subscribe today</p><p>own text {i}</p></article>")) for i in range(4)]
    # a line that a third of the articles share, without tags of its own, is theirs
    rows += [(200 + i, "http://q.example/%d" % i, page(f"<article><p>text {i}</p>{'<p>a passage</p>' * (i % 3 == 0)}</article>")) for i in range(30)]
    got = run(spark, rows + rows)
    assert len(got) == 2 * len(rows)
    want = {i: f"own {'abc'[i % 3]} story {i}" for i in range(60)} | {100 + i: f"own text {i}" for i in range(4)}
    want |= {200 + i: f"text {i}" + " a passage" * (i % 3 == 0) for i in range(30)}
    assert {r[0]: r[2] for r in got} == want and {r[0]: r[2] for r in run(spark, rows)} == want


def test_a_passage_that_articles_of_a_host_share_stays(spark):
    lead = "<p>The opening that several articles of this host have</p>"
    rows = [(i, "http://p.example/%d" % i, page(f"<article><h1>Head {i}</h1>{lead * (i < 3)}<p>own text {i}</p></article>")) for i in range(5)]
    # without an article element, telling names or tags of its own the passage stays too, and the notice in its box goes
    rows += [(10 + i, "http://n.example/%d" % i, "<html><body><div class=x1><div class=q>Free shipping all week</div></div>"
              f"<div class=x2><h2>Head {i}</h2>{lead * (i % 2)}<p>own text {i}</p></div></body></html>") for i in range(8)]
    got = {r[0]: r[2] for r in run(spark, rows)}
    opening = "The opening that several articles of this host have "
    assert [got[i] for i in range(5)] == [f"Head {i} {opening * (i < 3)}own text {i}" for i in range(5)]
    assert [got[10 + i] for i in range(8)] == [f"Head {i} {opening * (i % 2)}own text {i}" for i in range(8)]


def test_the_template_decides_where_names_do_not(spark, monkeypatch):
    """With no template learnt the unnamed notice would stay."""
    rows = [(i, "http://n.example/%d" % i, "<html><body><div class=x1><div class=q>Free shipping all week</div></div>"
             f"<div class=x2><p>own text {i}</p></div></body></html>") for i in range(8)]
    assert [r[2] for r in run(spark, rows)] == [f"own text {i}" for i in range(8)]
    monkeypatch.setattr(X, "LEAST_PAGES", 10 ** 6)
    assert any("Free shipping" in r[2] for r in run(spark, rows))


def test_awkward_rows(spark):
    rows = [(1, None, page("<article>x</article>")), (2, "not a url", None), (3, "http://h/", ""), (None, "http://h/", "<p>y"),
            (4, "http://[bad", "<p>z"), (5, "http://u:p@H.example:80/q", "<article><p>" + "long " * 50_000), (5, "http://h/", "<p>y")]
    got = run(spark, rows)
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    by = {(r[0], r[1]): r[2] for r in got}
    assert by[1, None] == "x" and by[2, "not a url"] == "" and by[None, "http://h/"] == "y" and by[4, "http://[bad"] == "z"
    assert by[5, "http://u:p@H.example:80/q"] == " ".join(["long"] * 50_000)
    assert run(spark, []) == []


def test_query_equals_articles(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in X.op3(spark, d).collect()}
    for i, u, x in duckdb.sql(f"select page_id, url, html from '{d}/pages.parquet'").fetchall():
        inner = re.search("<article>(.*?)</article>", x, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        assert (got[i].url, got[i].text, got[i].n_chars) == (u, want, len(want))
