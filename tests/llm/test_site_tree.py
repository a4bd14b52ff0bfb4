import math
import random
from collections import Counter, defaultdict

import pytest

from quadframe.llm import site_tree
from quadframe.llm.site_tree import ABOVE, LEAST, PAGE, PRIOR, STYLE, STYLES, TEXTS, Page, features
from quadframe.llm.work import Work


def text_of(html):
    page = Page(html)
    return " ".join(t for _, t in page.blocks(page.kept()))


PAGES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b<br>c</p>d<b>e</b>f": "a b c def",
    "a < b <3 &lt;i&gt; &#65;&eacute;&am": "a < b <3 <i> Aé&am",
    "<article>x<script>if (a</b>) '<p>'</script>y<!-- <p>no</p> -->z<style>p{}</style></article>": "xyz",
    "<article>one<script>never closed <p>two": "one",
    "<article>one<!-- never closed <p>two": "one",
    "<article>one<p class='never closed": "one",
    "<article><p>one</p><!--> <p>two</p><!bogus><?pi?></3></article>": "one two",
    "<title>t</title><body><header><h1>Site</h1></header><main><h1>T</h1><p>x</p></main><footer>f</footer>": "T x",
    "<body><nav><ul><li>m<li>n</ul></nav><article><header><h1>T</h1></header><p>x<aside>s</aside><form><p>f<button>b</button></form><footer>by</footer></article>": "T x",
    "<div class=page><div id='main-nav'>n</div><div class='content no-sidebar'><p>x</p><p>y</p></div><div class='sideBar'>z</div><div class=sidebar>s</div></div>": "x y z",
    "<div class='cookie-notice'>c</div><p>x</p><div role=dialog>d</div><div hidden>h</div><p style='display: none'>n</p><span class='ad'>a</span>": "x",
    "<article><p>x</p></article><section id=comments><article>c1</article><article class=comment>c2</article></section>": "x",
    "<div class=sidebar><article><p>x</p></article></div>": "x",
    "<article><p>x</p><div class=comments><p>c</p></div><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>": "x a b 1 2 3",
    "<head><title>t</title><article>x</article>": "x",
    "<article><p>x <b>y</p><p>z</b> w</p>\n\n v</article></article></div>": "x y z w v",
    "<ARTICLE CLASS=Post><P>X</P></ARTICLE>": "X",
    "<p a=\"<p>\" b='>' c=>x</p><p title=a\"b>y": "x y",
    "<pre>a\n  b\tc</pre>&nbsp;d": "a b c d",
}


@pytest.mark.parametrize("html", PAGES)
def test_text_of_pages(html):
    assert text_of(html) == PAGES[html]


def test_long_and_broken_pages_take_linear_time():
    for html in ("<!--" * 200_000, "<script>" * 100_000, "<p " * 200_000, "<a b=\"" * 100_000, "<" * 300_000, "&" * 300_000, "<article>" + "<p>x</p>" * 50_000):
        text_of(html)


def site(host, n, rng, share="Read our other stories today", start=0):
    """A host whose layout has no telling names: a repeated block inside and outside the article's text, different elsewhere."""
    words = [f"w{k}" for k in range(400)]
    for k in range(n):
        paragraphs = [" ".join(rng.choices(words, k=12)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        yield start + k, f"http://{host}/{k}", f"<html><body><div class=a><div class=b>{share}</div><div class=c>{body}<div class=d>Ask <i>us</i></div></div></div></body></html>", " ".join(paragraphs), f"{share} {' '.join(paragraphs)} Ask us"


def plain(pages):
    """{(host, node): (importance, noisy)} by loops over pages."""
    hosts = defaultdict(dict)
    for host, html in pages:
        text, found = features(Page(html or ""))
        hosts[host][text] = min(hosts[host].get(text, found), found)
    out = {}
    for host, texts in hosts.items():
        n = Counter(x for found in texts.values() for x in found)
        of = lambda node, kind: {v: c for (m, k, v), c in n.items() if m == node and k == kind}  # noqa: E731, B023
        nodes, content, imp = {m for m, k, _ in n if k == PAGE}, {}, {}
        log = lambda c, m: math.log(c) / math.log(m) if m > 1 else 0
        for node in nodes:
            m, said = n[node, PAGE, 0], of(node, TEXTS)
            if said:
                content[node] = 1 - sum(log(c, m) for c in said.values()) / len(said)
        for node in nodes:
            m, styles = n[node, PAGE, 0], of(node, STYLES)
            below = [(x, c) for (x, k, v), c in n.items() if k == ABOVE and v == node and x in content]
            inner = [sum(c * content[x] for x, c in below) / sum(c for _, c in below)] if below else []
            mixed = [*([content[node]] if node in content else []), *inner] or [1.0]
            value = sum(mixed) / len(mixed)
            if styles:
                total = sum(styles.values())
                shown = min(1, -sum(c / total * log(c / total, m) for c in styles.values())) if m > 1 else 1
                value = (1 - STYLE ** len(styles)) * shown + STYLE ** len(styles) * value
            imp[node] = (m * value + PRIOR) / (m + PRIOR)
        for node in nodes:
            below = [imp[x] for (x, k, v) in n if k == ABOVE and v == node and x in imp]
            out[host, node] = imp[node], max([imp[node], *below]) < LEAST
    return out


def test_trees_and_text_against_loops(spark):
    rng = random.Random(2)
    rows = [*site("big.org", 120, rng), *site("small.org", 3, rng, start=1000)]
    copies = [(2000 + k, f"http://copied.org/{k}", rows[0][2], "", "") for k in range(80)]
    odd = [(3000, None, None, "", ""), (3001, "nowhere", "<p>x", "", "x"), (None, "http://big.org/x", "", "", ""), (1, "http://big.org/1", rows[1][2], "", "")]
    pages = spark.createDataFrame([(i, u, h, "n", "d") for i, u, h, *_ in [*rows, *copies, *odd]], "page_id long, url string, html string, host string, drop string").repartition(5)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in site_tree.extract(pages).collect()}
    for i, u, _, without, whole in rows:
        assert got[i, u][0] == (without if "big" in u else whole) and got[i, u][1] == len(got[i, u][0])
    assert all(got[i, u][0] == rows[0][4] for i, u, *_ in copies)
    assert got[3000, None] == ("", 0) and got[3001, "nowhere"] == ("x", 1) and got[None, "http://big.org/x"] == ("", 0)
    assert site_tree.extract(pages).count() == pages.count()
    hosted = [(u.split("/")[2] if u and "//" in u else "", h) for _, u, h, *_ in [*rows, *copies, *odd]]
    frame = spark.createDataFrame(hosted, "host string, html string")
    tree = {(r["host"], r["node"]): (r["importance"], r["noisy"]) for r in site_tree.trees(frame, Work(spark, "tree")).collect()}
    want = plain(hosted)
    assert tree.keys() == want.keys() and all(abs(tree[k][0] - want[k][0]) < 1e-9 and tree[k][1] == want[k][1] for k in want)
    assert sum(noisy for _, noisy in want.values()) == 2


def test_empty_table(spark):
    got = site_tree.extract(spark.createDataFrame([], "page_id int, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.collect() == []
