"""Text of pages: a plain version of the host's repeats, whole tables, and pages that are hard to read."""

import html as entities
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import html


def covered_plainly(streams, run):
    """Tokens in a string of `run` tokens that another stream of different tokens has."""
    out = []
    for s in streams:
        gone = [False] * len(s)
        for i in range(len(s) - run + 1):
            w = s[i : i + run]
            if any(t != s and any(t[j : j + run] == w for j in range(len(t) - run + 1)) for t in streams):
                gone[i : i + run] = [True] * run
        out.append(gone)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=6), st.integers(2, 8))
def test_repeats_of_a_host(streams, run):
    assert [x.tolist() for x in html.repeated(streams, run)] == covered_plainly(streams, run)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=4))
def test_hosts_of_few_tokens(sizes):
    pages = [html.blocks("<p>" + " ".join(f"w{k}" for k in range(n))) for n in sizes]
    assert html.main_texts(pages) == [" ".join(f"w{k}" for k in range(n)) for n in sizes]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a</p><script>if (a<b) x = '<!--'</script><p>rest</p></article>", "a\nrest"),
        ("<article><script>var t = '</p><article>'</script><style>p > a {}</style>b</article>", "b"),
        ("<article><div class=market-share>one two</div><p id=related-work>three</p><ul class='search-results'><li>x</ul></article>", "one two\nthree\nx"),
        ("<article><h2 id=search>Search algorithms</h2><p id=login>How to log in</p><h3 id='reply'>Reply</h3><h2 class=ad id=x>Buy</h2></article>", "Search algorithms\nHow to log in\nReply"),
        ("<article>text<div class=commentbox>no</div><section class=reader-reviews><p>no</p></section><ul class=pagination><li>2</ul><section id=discussion>What it means</section></article>", "text\nWhat it means"),
        ("<article>text<div class='ad-slot'>Buy</div><section id=comments><p>no</p></section><div class=adBanner>no</div></article>", "text"),
        ("<body><form id=f><nav>menu</nav><p>All the text of the page is in a form</p><label>Name</label><button>go</button></form></body>", "All the text of the page is in a form"),
        ("<article><p>Text body here</p><form><label>Name</label> say hi</form></article>", "Text body here"),
        ("<form><article><p>Text body here</p></article></form>", "Text body here"),
        ("<article class=comment>no</article><article>yes</article>", "yes"),
        ("<aside><article>teaser</article></aside><article>yes</article>", "yes"),
        ("<section class=comments><article>mine</article></section><main>yes</main>", "yes"),
        ("<nav><ul><li>x<article>yes</article>", "yes"),
        ("<div role=main><p>yes</div><div role=navigation>no</div>", "yes"),
        ("<p data=don't>text here</p><p>it's</p>", "text here\nit's"),
        ("<article><p class=ad>Buy<p>Real</article>", "Real"),
        ("<article><div><p class=ad>Buy</div>Real</article>", "Real"),
        ("a<!-->b<!-- c -- > d --!>e", "abe"),
        ("<article>x <b>y</b z> w</ >v</article>", "x y wv"),
        ("<main><svg><title>t</title><text>q</text></svg>w<object><object></object>no</object></main>", "w"),
        ("<title>open <p>body", "open\nbody"),
        ("<script src='x'/>not</script>yes", "yes"),
        ("<article><p>foo <span class=ad>AD</span>bar <a class=market-share>baz</a> qux</p></article>", "foo bar baz qux"),
        ("<article><p>one<br>two\n three&nbsp;four &lt;b&gt; &amp;amp;<td>five</article>", "one two three four <b> &amp;\nfive"),
        ("<article><header><h1>Title</h1></header>x<footer>f</footer></article><header>no</header>", "Title\nx"),
        ("<article>x<div hidden>no</div><div style='display: none'>no</div><div aria-hidden=true>no</div></article>", "x"),
        ("<article>a < b and 1<2 x<3</article>", "a < b and 1<2 x<3"),
        ("<noscript><p>no</noscript><template>no</template><article>y</article>", "y"),
        ("<ARTICLE>Upper</ARTICLE><FOOTER>no</FOOTER>", "Upper"),
        ("", ""),
        ("<", "<"),
        ("<p", ""),
    ],
)
def test_hard_pages(page, text):
    assert html.main_texts([html.blocks(page)]) == [text]


def test_doubtful_blocks_go_where_the_host_repeats_them_whole():
    share = "<div class=market-share>this very long box tells the same on each page</div>"
    pages = [f"<article><p>page {k} tells its own</p>{share}<div class=market-share>share of page {k}</div></article>" for k in range(3)]
    assert html.main_texts([html.blocks(p) for p in pages]) == [f"page {k} tells its own\nshare of page {k}" for k in range(3)]


@pytest.mark.parametrize("page", ["<nav><article>" * 5000, "<div class='x-ad'>a" * 5000, "<span class=ad>" * 5000 + "x", "<!--" * 9000, "<a href='" * 9000, "<a b = " * 9000, "<" * 50_000, "&amp;" * 50_000])
def test_long_pages_take_linear_time(page):
    assert isinstance(html.blocks(page), list)


def test_whole_tables_by_structure(spark, sf_dir):
    """The made pages hold one article each: its blocks, read plainly."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    for r in d.collect():
        body = re.search("(?s)<article>(.*)</article>", r["html"])[1]
        lines = [" ".join(entities.unescape(re.sub("(?s)<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", body))]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)
