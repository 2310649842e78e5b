"""Main text of pages: whole tables against the article element, and pages made to mislead."""

import html
import re

import pytest

from auditloom.llm import html_text as H

PROSE = "Some prose that goes on for a while, with a comma and an end."


def text(source, paths=()):
    page = H.Page(source)
    return page.text(page.chosen(list(paths)))


def article_of(source):
    """Blocks of the only article element, for pages that nest nothing inside it but inline tags."""
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks) if t)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    found = {r["page_id"]: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]]["text"] == article_of(r["html"]) and found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


@pytest.mark.parametrize(("source", "want"), [
    ("", ""),
    ("   ", ""),
    ("plain words &amp; no tags", "plain words & no tags"),
    (f"<p>{PROSE}<p>two <b>bold<br>words</b> here &lt;tag&gt;&nbsp;x &#8211; &#x41;", f"{PROSE}\ntwo bold words here <tag> x – A"),
    (f"<div class=menu><a href=/a>Home</a></div><div id=main><p>{PROSE}</p><p>End.</p></div><div class='sidebar'><p>{PROSE * 3}</p></div>", f"{PROSE}\nEnd."),
    (f"<article><header><h1>Title</h1><p>By someone</p></header><p>{PROSE}</p><aside>{PROSE}</aside></article><header><h1>Site</h1></header>", f"Title\n{PROSE}"),
    (f"<article><p>{PROSE}</p><div class='ad-box'>{PROSE}</div><form><p>{PROSE}</p><button>Go</button></form><p>Last.</p></article>", f"{PROSE}\nLast."),
    (f"<main><article><h2>T</h2><p>{PROSE}</p></article><section class='comments'><article class='comment'><p>{PROSE * 9}</p></article></section></main>", f"T\n{PROSE}"),
    (f"<article><script>if (a < b) {{ t = '</p><p>no</p>' }}</script><!-- <p>no</p> --><style>p{{}}</style><p title=\"a > b\">{PROSE}</p></article>", PROSE),
    (f"<article><p>{PROSE}</p><!-- open <p>no", PROSE),
    (f"<article><p>{PROSE}<p cla", PROSE),
    (f"<form><main><p>{PROSE}</p></main></form>", PROSE),
    (f"<div class='has-sidebar'><article><p>{PROSE}</p></article></div>", PROSE),
    (f"<article><ul><li>one<li>two <ul><li>three</ul></ul><p>{PROSE}</p></article>", f"one\ntwo\nthree\n{PROSE}"),
    (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{PROSE}</article>", f"a\nb\nc\n{PROSE}"),
    (f"<article><p hidden>no</p><p style='display: none'>no</p><div role=dialog>no</div><div class='cookie-notice'>no</div><p>{PROSE}</p></article>", PROSE),
    (f"<article><p>{PROSE}</b></i></div> more</p></article></article>", f"{PROSE} more"),
    ("<nav><a href=x>only</a> <a href=y>links</a></nav>", ""),
    (f"a < b <article><p>1 < 2 &lt 3 <3 {PROSE}</article>", f"1 < 2 < 3 <3 {PROSE}"),
])
def test_single_pages(source, want):
    assert text(source) == want


def test_hosts_agree_where_one_page_misleads(spark):
    """A page whose teasers outweigh its story is read at the path that its host's other pages chose."""
    story = "<html><body><div class='wrap'><div class='lead-{0}'>{1}</div><div class='more'>{2}</div></div></body></html>"
    teaser = "<p>A short teaser.</p>"
    rows = [(i, f"https://Host.example:80/p{i}", story.format(i, f"<p>{PROSE}</p>" * 9, teaser), "x") for i in range(9)]
    rows.append((9, "http://u@host.example/p9", story.format(9, f"<p>{PROSE}</p>" * 3, f"<p>{PROSE}</p>" * 4), "x"))
    rows.append((10, "http://other.example/", story.format(1, f"<p>{PROSE}</p>" * 3, f"<p>{PROSE}</p>" * 40), "x"))
    rows += [(None, None, None, "x"), (12, "", "", None), (0, rows[0][1], rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, paths string").repartition(4)
    votes = H.host_votes(pages).where("host = 'host.example'").orderBy("votes", ascending=False).collect()
    assert votes[0]["path"] == ">div.wrap>div.lead-#" and votes[0]["votes"] == 10
    found = {(r["page_id"], r["url"]): r["text"] for r in H.extract(pages).collect()}
    assert H.extract(pages).count() == len(rows)
    assert found[9, "http://u@host.example/p9"] == "\n".join([PROSE] * 3)
    assert found[0, "https://Host.example:80/p0"] == "\n".join([PROSE] * 9)
    assert found[None, None] == "" and found[12, ""] == ""
    assert PROSE in found[10, "http://other.example/"]


def test_a_host_of_many_layouts_keeps_ten_paths_at_most(spark):
    """Votes scattered over many paths name none; every page is then read at its own best container."""
    rows = [(i, "http://many.example/", f"<div class='{'abcdefghij'[i % 10] * (i // 10 + 1)}'><p>{PROSE}</p></div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert H.winning_paths(H.host_votes(pages)).count() == 0
    assert {r["text"] for r in H.extract(pages).collect()} == {PROSE}
    votes = spark.createDataFrame([("h", f"p{i}", 100 + i) for i in range(9)] + [("h", "rare", 20)], "host string, path string, votes long")
    assert H.winning_paths(votes).first()["paths"] == [f"p{i}" for i in range(8, -1, -1)]


def test_empty_table_and_long_pages(spark):
    schema = "page_id long, url string, html string"
    assert H.extract(spark.createDataFrame([], schema)).collect() == []
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>"
    wide = "<article>" + f"<p>{PROSE} &amp; <i>more</i></p>" * 20_000 + "</article>"
    found = H.extract(spark.createDataFrame([(1, "http://a/", deep), (2, "http://b/", wide), (3, "http://c/", "<a b='" * 5000)], schema)).orderBy("page_id").collect()
    assert found[0]["text"] == PROSE
    assert found[1]["n_chars"] == 20_000 * (len(PROSE) + 8) - 1
    assert found[2]["text"] == ""
