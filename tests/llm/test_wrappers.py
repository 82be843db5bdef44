from __future__ import annotations

import pytest

from cutline.llm.wrappers import aligned, blocks, extract, infer, expression, learn, learn_wrappers, main_text
from tests.llm.conftest import LONG


def page(i, body="article", n=3):
    paragraphs = "".join(f"<p>Part {k} of page {i} has <b>bold</b>ness &amp; more &amp;lt;" for k in range(n))
    return f"""<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="comments-open">
<header><a href=/>Site</a></header><nav><ul>{"".join(f"<li><a href=/{k}>Item {i}{k}</a></li>" for k in range(n))}</ul></nav><!-- ad {i} --><div class="ad">Buy {i}</div>
<div class="cookie-notice">We use cookies</div><{body}><h1>Head\n {i}</h1>{paragraphs}<form><input><button>Go</button></form>
<div id="comments"><p>I disagree {i}</p></div></{body}><aside>Side {i}</aside><footer>&copy; host {i}</footer></body></html>"""


def text(i, n=3):
    return " ".join([f"Head {i}"] + [f"Part {k} of page {i} has boldness & more &lt;" for k in range(n)])


def test_wrapper_is_a_union_free_expression():
    w = expression(infer([page(i, n=2 + i) for i in range(4)] + [page(9).replace("<aside>Side 9</aside>", "")]))
    assert "(<li><a>#TEXT</a></li>)+" in w and "|" not in w.replace("\\|", "")
    assert "We\\ use\\ cookies" in w and "<h1>#TEXT</h1>" in w and ")?" in w


@pytest.mark.parametrize("body", ["article", "main", "div"])
def test_main_text(body):
    rules = learn([page(i, body) for i in range(5)])
    assert main_text(page(77, body, 6), rules) == text(77, 6)
    assert main_text(page(77, body, 6), None) == text(77, 6)


def test_shared_text_of_a_host_is_boilerplate_outside_articles_only():
    div = lambda i: f"<body><div><p>About page {i}, at some length.</p><p>All rights reserved by the host</p></div></body>"
    art = lambda i: div(i).replace("div", "article")
    assert main_text(div(9), learn([div(i) for i in range(4)])) == "About page 9, at some length."
    assert main_text(art(9), learn([art(i) for i in range(4)])).endswith("All rights reserved by the host")


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<br>b  c</p>", "a b c"), ("<p>unclosed <i>x", "unclosed x"), ("<", "<"), ("a < b <p>c", "a < b c"),
    ("<script>no", ""), ("<!-- only", ""), ("<p>a</p></div></p>tail", "a tail"), ("<nav>menu</nav>", ""), ("<p hidden>no</p><p>yes</p>", "yes"), ("<div title='a>b'>in</div>", "in"),
    ("<b>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
])
def test_odd_pages(html, want):
    assert main_text(html, None) == want
    assert main_text(html, learn([html or ""])) == want


def test_blocks_close_paragraphs_and_skip_links():
    got = blocks("<p>one<p>two <a href=x>link</a><ul><li>a<li>b</ul>")
    assert [(t, k) for *_, k, t in got] == [("one", 0), ("two link", 4), ("a", 0), ("b", 0)]


def test_extract(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i)) for i in range(20)] + [(50, None, page(50)), (51, "no url", None), (52, "http://h1.example/x", ""), (None, "http://h0.example/y", page(53)), (3, "http://h1.example/3", page(3)), (54, "http://h0.example/l", f"<article><p>{LONG}</p></article>")]
    table = lambda r: spark.createDataFrame([(*x, "a", "b", "c") for x in r], "page_id long, url string, html string, host string, _host string, rules string")
    got = {}
    for r in extract(table(rows)).collect():
        got.setdefault(r["page_id"], []).append((r["url"], r["text"], r["n_chars"]))
    assert sum(map(len, got.values())) == len(rows) and len(got[3]) == 2
    for i, u, h in rows:
        want = "" if not h else LONG.strip() if i == 54 else text(53 if i is None else i)
        assert (u, want, len(want)) in got[i]
    assert extract(table([])).count() == 0


def test_every_page_of_a_host_is_learnt_from(spark):
    """A text on two thirds of a host's pages, but on none of the forty with the least hashes, which samples were taken from."""
    import json

    line = "Ask our team at the desk for help"
    least = {r[0] for r in spark.sql("select id from range(120) order by xxhash64(id) limit 40").collect()}
    story = lambda i: f"Story {i} has its own words, {i} of them in all."
    rows = [(i, "http://one.example/a", f"<body><div><p>{story(i)}</p>{'' if i in least else f'<h3>{line}</h3>'}</div></body>") for i in range(120)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [json.loads(r["rules"]) for r in learn_wrappers(table.repartition(5)).collect()]
    want = learn([h for *_, h in rows])
    assert len(got) == 1 and got[0]["fixed"] == want["fixed"] and len(want["fixed"]) == 1 and got[0]["main"] == want["main"]
    assert {r["page_id"]: r["text"] for r in extract(table).collect()} == {i: story(i) for i in range(120)}


def test_wrappers_are_aligned_like_pages():
    pages = [page(i, n=2 + i % 3) for i in range(6)] + [page(9).replace("<aside>Side 9</aside>", "")]
    both = expression(aligned(infer(pages[:3]), infer(pages[3:])))
    assert "(<li><a>#TEXT</a></li>)+" in both and "We\\ use\\ cookies" in both and "<h1>#TEXT</h1>" in both and ")?" in both
