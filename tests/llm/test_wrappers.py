"""Wrappers as regular expressions, what they decide, and layouts of several kinds."""

import json
import random
import re

import pandas as pd
import pytest

from banditframe.llm import wrappers as W

LETTERS: dict[str, str] = {}


def letter(signature):
    return LETTERS.setdefault(signature, chr(0xE000 + len(LETTERS)))


def pattern(items):
    """The wrapper as a regular expression over one character a tag."""
    out = ""
    for x in items:
        inner = "T" if x[0] == "#" else pattern(x[3]) if x[0] == "+" else letter(x[0]) + pattern(x[3]) + "/"
        out += f"(?:{inner})" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[x[1], x[2]]
    return out


def tokens(page, monkeypatch):
    """The page as a string over the same characters, with nothing folded."""
    with monkeypatch.context() as m:
        m.setattr(W, "fold", lambda items: items)
        return re.sub(r"[?+*]|\(\?:|\)", "", pattern(W.read(page)[0]))


def merged(pages):
    return json.loads(W.merged([json.dumps(W.read(p)[0]) for p in pages]))


def made(rng, depth=0):
    """A random page of lists, sections and paragraphs."""
    out = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice("pphds" if depth < 2 else "pph")
        if kind == "p":
            out += "".join(f"<p>{rng.randint(0, 9)}</p>" for _ in range(rng.randint(1, 3)))
        elif kind == "h":
            out += "".join(f"<h2>{k}</h2><p>x</p>" for k in range(rng.randint(1, 3)))
        elif kind == "d":
            out += f"<div class=c{rng.choice('ab')}>{made(rng, depth + 1)}</div>"
        else:
            out += "<dl>" + "".join("<dt>a</dt><dd>b</dd><dd>c</dd>" for _ in range(rng.randint(1, 3))) + "</dl>"
    return out


@pytest.mark.parametrize("seed", range(30))
def test_a_wrapper_matches_its_pages(seed, monkeypatch):
    rng = random.Random(seed)
    pages = [f"<body>{made(rng)}</body>" for _ in range(6)]
    whole = re.compile(pattern(merged(pages)))
    assert all(whole.fullmatch(tokens(p, monkeypatch)) for p in pages)


@pytest.mark.parametrize("seed", range(10))
def test_a_coarse_wrapper_has_all_texts(seed):
    rng = random.Random(seed)
    wrapper = merged([f"<body>{made(rng)}{made(rng)}</body>" for _ in range(8)])
    small = W.bounded(wrapper, 12)
    chars = lambda items: sum(x[5] if x[0] == "#" else chars(x[3]) for x in items)
    assert W.count(small) <= 12 < W.count(wrapper) and chars(small) == chars(wrapper)


def test_optional_and_repeated_groups():
    one, two = W.read("<ul><li>a</li><li>b</li></ul><p>x</p>")[0], W.read("<ul><li>a</li></ul><p>x</p><div>more</div>")[0]
    assert [(x[0], x[1], x[2]) for x in W.merge(one, two)] == [("ul", 0, 0), ("p", 0, 0), ("div", 1, 0)]
    assert W.merge(one, two)[0][3][0][:3] == ["li", 0, 1]
    wide = "".join(f"<h{k}>t</h{k}>" for k in range(1, 7)) + "<p>x</p><ul><li>y</li></ul><pre>c</pre><table><tr><td>d</table>"
    group = W.read(wide * 3)[0]
    assert len(group) == 1 and group[0][:3] == ["+", 0, 1] and len(group[0][3]) == 10
    once = W.merge(group, W.read(wide)[0])
    assert len(once) == 1 and once[0][0] == "+" and len(once[0][3]) == 10


def texts(spark, pages, off=None):
    df = spark.createDataFrame([(k, f"http://a.b/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in W.main_text(df).orderBy("page_id").collect()]


def test_the_alignment_decides(spark):
    """Elements without telling names: what the host's pages share is template, what varies is text."""
    pages = [f"<div class=x1><p>My site</p></div><div class=x2><h1>T{k}</h1><p>Body {k}</p></div><div class=x1><p>Imprint of all</p></div>" for k in range(4)]
    assert texts(spark, pages) == [f"T{k} Body {k}" for k in range(4)]
    assert [W.extract(p, []) for p in pages] == [f"My site T{k} Body {k} Imprint of all" for k in range(4)]


def test_positions_of_equal_elements_are_told_apart(spark):
    pages = [f"<div><p>Same on all</p><h2>H{k}</h2><p>Own {k}</p></div>" for k in range(3)]
    assert texts(spark, pages) == [f"H{k} Own {k}" for k in range(3)]


@pytest.mark.parametrize("n", [3, 5, 25])
def test_notices_inside_articles(spark, n):
    pages = [f"<article><h1>About</h1><p>What number {k} has to say is longer than that.</p><div><p>Write to our editors.</p></div></article>" for k in range(n)]
    assert texts(spark, pages) == [f"About What number {k} has to say is longer than that." for k in range(n)]


@pytest.mark.parametrize("n", [2, 10, 19, 20, 50])
def test_near_copies_keep_what_they_share(spark, n):
    """Also where the shared text stands alone in its place, however many copies there are."""
    shared = "The shared long body that all copies of this page have in common."
    pages = [f"<article><h1>Same</h1><section><p>{shared}</p></section><p>Variant {k}</p></article>" for k in range(n)]
    assert texts(spark, pages) == [f"Same {shared} Variant {k}" for k in range(n)]


def test_copies_keep_their_text(spark):
    pages = ["<div><h1>T</h1><p>Body</p></div>"] * 40
    assert texts(spark, pages) == ["T Body"] * 40
    near = [f"<article><h1>Same</h1><p>Same</p><p>Same {k // 20}</p></article>" for k in range(40)]
    assert texts(spark, near) == [f"Same Same Same {k // 20}" for k in range(40)]


def test_what_not_every_article_has_is_no_notice(spark):
    """The same sentence in some of a host's articles may be theirs."""
    pages = [f"<article><h1>About</h1><p>Words of number {k} and some more of them</p>{'<div><p>As we said.</p></div>' if k % 3 else ''}</article>" for k in range(30)]
    assert all(("As we said." in t) == (k % 3 > 0) for k, t in enumerate(texts(spark, pages)))


LAYOUTS = {
    "comment list": ("<article><h1>T</h1><p>x</p><ol class=commentlist><li>wow 3</li></ol><div class=author-box>A.</div></article>", "T x"),
    "names inside": ("<article><p>x</p><ins class=adsbygoogle>a</ins><div class=popup-overlay>p</div><div class='notification'>n</div><div class=alert>al</div><div class=entry-meta>m</div><div class=mainmenu>mm</div><div class=topnav>t</div></article>", "x"),
    "inline": ("<article><p>x <span hidden>h</span><span class=note>y</span> <span>z <span style='display:none'>q</span></span> e</p><span class=ads>b<span>c</span>b</span> d</article>", "x y z e d"),
    "no display": ("<article><p>x</p><p style='display:none'>y</p><p style=\"color:red; DISPLAY : none !important\">z</p></article>", "x"),
    "article": ("<header>Site</header><nav><a href=/>Home</a></nav><article class='post has-sidebar'><header><h1>T</h1></header><p>A&amp;B<br>c</p><footer>tags</footer></article><footer>F</footer>", "T A&B c"),
    "body classes": ("<body class='single no-sidebar comments-open'><article id=post-1><h1>T</h1><p>x</p></article></body>", "T x"),
    "main": ("<div class='site-header'>Site</div><main><h1>T</h1><p>One <b>two</b><p>three</main><aside>s</aside>", "T One two three"),
    "title above": ("<main><h1>Title</h1><article><p>body</p></article><div class=related-posts><p>more</p></div></main>", "Title body"),
    "related work": ("<article><h1>T</h1><section class=related-work><p>prior art</p></section><div class='comments-area'><p>c</p></div></article>", "T prior art"),
    "svg": ("<article><svg/><h1>T</h1><svg><text>no</text></svg><p>x</p></article>", "T x"),
    "divs": ("<div id=content><p>only\n text</p><script>var a='<p>no</p>'</script><!-- no --></div><div class='sidebar-left'>no</div><div class=cookie-notice>ok?</div>", "only text"),
    "comments": ("<article><p>x</p></article><article class=comment><p>nice</p></article><div id=disqus_thread>d</div><form>f</form>", "x"),
    "wrapped": ("<div class='sidebar-right'><div class=menu>m</div><main><h1>T</h1><p>x</p></main></div>", "T x"),
    "empty": ("<nav>n</nav><div class=ad>buy</div><article></article><footer>f</footer>", ""),
    "hidden": ("<article><p>x</p><p hidden>y</p></article>", "x"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl></article>", "a b c d e"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, text = LAYOUTS[name]
    own = json.loads(W.merged([json.dumps(W.read(page)[0])]))
    assert W.extract(page, W.judge(own)) == W.extract(page, []) == text


PAGES = [f"<article><h1>T</h1><div {m}><p>X{k}</p></div></article>" for k, m in enumerate(["class=a", "class=b", "id=post-1", "id=post-2"])]


def test_bodies_of_differing_elements_are_kept(spark):
    assert texts(spark, PAGES) == [f"T X{k}" for k in range(len(PAGES))]


def test_numbers_in_attributes_do_not_part_pages():
    pages = [f"<article id=post-{k}><h1>T{k}</h1><p>x</p></article>" for k in range(60)]
    assert W.count(merged(pages)) == 5


def test_made_up_and_deep_elements_are_bounded(spark):
    wide = ["<article>" + "".join(f"<x{j}y{'abcdefgh'[k]}>w{j}</x{j}y{'abcdefgh'[k]}>" for j in range(900)) + "</article>" for k in range(3)]
    deep = ["<article>" + "<div>" * 3000 + f"<p>{x}</p>" + y for x, y in (("a", ""), ("b", "<div class=c>d</div>"))]
    assert W.count(merged(wide)) <= W.MOST and W.count(merged(deep)) <= W.MOST
    assert texts(spark, wide + deep) == [" ".join(f"w{j}" for j in range(900))] * 3 + ["a", "b d"]


def test_long_and_repeated_pages(spark):
    page = "<article>" + "".join(f"<p>w{k}</p>" for k in range(20_000)) + "</article>"
    got = texts(spark, [page, page, None, ""])
    assert got == [" ".join(f"w{k}" for k in range(20_000))] * 2 + ["", ""]


def test_spark_merges_as_one_process_does(spark):
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    df = spark.createDataFrame(pages).repartition(7)
    got = {r["host"]: json.loads(r["wrapper"]) for r in W.wrappers(df, group=2).collect()}
    hosts = pages.url.str.extract(r"//([^/?#:]*)")[0].str.lower()
    assert set(got) == set(hosts)
    for h, group in pages.groupby(hosts):
        one = W.judge(merged(sorted(group.html)))
        assert [W.extract(p, one) for p in group.html] == [W.extract(p, W.judge(got[h])) for p in group.html]
