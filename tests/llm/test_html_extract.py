import random
import re
import time
from html import unescape

import pytest
from hypothesis import given
from hypothesis import strategies as st

from forkscope.llm import common, html_extract
from forkscope.llm.html_extract import main_text

P = "Some words of the article, with commas, and enough of them to count as a paragraph of text."


def plain_text(html):
    """The whole extraction again as plain recursions over the pruned tree, each quantity computed where it is asked for."""
    h = html_extract
    root = h.parse(html or "")
    h._pruned(root)
    block = lambda e: not isinstance(e, str) and e.name not in h.INLINE
    flows = lambda e: not block(e) and (isinstance(e, str) or not e.out)
    size = lambda e: len(e.strip()) if isinstance(e, str) else sum(map(size, e.children))
    linked = lambda e: 0 if isinstance(e, str) else sum(size(c) if not isinstance(c, str) and c.name == "a" else linked(c) for c in e.children)
    every = lambda e: [e, *(x for c in e.children if not isinstance(c, str) for x in every(c))]
    loose = lambda e: [x for c in e.children if not block(c) for x in ([c] if isinstance(c, str) else loose(c))]
    own = lambda e: sum(len(x.strip()) for x in loose(e))
    paragraph = lambda e: block(e) and own(e) > 0 and (e.name in h.PARAGRAPHS or own(e) >= 25)
    worth = lambda e: (1 + sum(len(re.findall("[,،、，]", x)) for x in loose(e)) + min(own(e) / 100, 3)) * (1 - linked(e) / size(e))
    above = lambda e: [] if e.parent is None else [e.parent, *above(e.parent)]

    def points(e):
        if not size(e):
            return 0.0
        got = [worth(e)] if paragraph(e) and not e.apart and e.name not in h.PARAGRAPHS else []
        for p in every(root):
            if paragraph(p) and not p.apart and e in above(p)[:6]:
                level = above(p).index(e) + 1
                got.append(worth(p) * {1: 1, 2: 1 / 2, 3: 1 / 9, 4: 1 / 12, 5: 1 / 15, 6: 1 / 18}[level])
        return sum(got) * (1 - linked(e) / size(e)) * (3 if e.name in ("article", "main") else 1)

    def container(e):
        return block(e) and size(e) > 0 and (e.name not in h.PARAGRAPHS or e.name == "td" and any(block(c) and c.name == "p" for c in e.children))

    def stays(part, node, near):
        total, links = sum(map(size, part)), sum(size(x) if not isinstance(x, str) and x.name == "a" else linked(x) for x in part)
        if not isinstance(part[0], str) and part[0].out:
            return False
        if not block(part[0]):
            return near and node.name not in ("article", "main") and total > 0 and links <= total / 4
        e = part[0]
        if container(e) and points(node) > 0 and points(e) >= 0.2 * points(node) - 1e-9:
            return True
        if node.name in ("article", "main"):
            return False
        if e.name in h.PARAGRAPHS and e.name not in ("li", "td") and links <= (total / 4 if total >= 80 else 0):
            return True
        return near and container(e) and any(map(paragraph, every(e))) and links <= total / 4

    def around(kept, node, near):
        if node.parent is None or node.name == "body":
            return kept
        parts, out = [], []
        for c in node.parent.children:
            if parts and flows(c) and flows(parts[-1][-1]):
                parts[-1].append(c)
            else:
                parts.append([c])
        for part in parts:
            out += kept if part[0] is node else part if stays(part, node, near) else []
        return out if node.name in ("article", "main") else around(out, node.parent, False)

    places = [e for e in every(root) if container(e)]
    score = [points(e) for e in places]
    best = next((e for e, x in zip(places, score) if x >= max(score) - 1e-9), root)
    return h._text(around([best], best, True))


def test_query_against_the_plain_scorer(spark):
    pages = {r.page_id: r.html for r in common.table(spark, "/root/testdata/sf0.001", "pages").collect()}
    for r in html_extract.op7_html_extract(spark, "/root/testdata/sf0.001").collect():
        assert r.text == plain_text(pages[r.page_id])


WORDS = "one, two three; four, five six seven, eight nine ten".split()


def generated(rng, marked):
    """A page of nested boxes with paragraphs, lists, bare text, links and furniture."""

    def words(n):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, n)))

    def box(depth):
        names = ["p"] * 4 + ["text", "links", "ul", "h2", "table", "b"] + (["div"] * 4 + ["section", "nav"] + ["article", "main"] * marked if depth < 5 else [])
        out = []
        for _ in range(rng.randint(1, 5)):
            name = rng.choice(names)
            if name in ("p", "h2", "b", "nav"):
                out.append(f"<{name}>{words(40)}{'<a href=x>' + words(10) + '</a>' if rng.random() < 0.2 else ''}</{name}>")
            elif name == "text":
                out.append(words(30))
            elif name == "links":
                out.append("<div>" + " | ".join(f"<a href=x>{words(4)}</a>" for _ in range(4)) + "</div>")
            elif name == "ul":
                out.append("<ul>" + "".join(f"<li>{words(12)}</li>" for _ in range(3)) + "</ul>")
            elif name == "table":
                out.append(f"<table><tr><td>{words(9)}</td><td><p>{words(30)}</p></td></tr></table>")
            else:
                out.append(f"<{name}>{box(depth + 1)}</{name}>")
        return "".join(out)

    return f"<html><body>{box(0)}</body></html>"


def test_generated_pages_against_the_plain_scorer():
    rng = random.Random(7)
    for n in range(400):
        html = generated(rng, n % 2)
        assert main_text(html) == plain_text(html), html


def test_the_scores_decide(spark, monkeypatch):
    rng = random.Random(3)
    pages = [r.html for r in common.table(spark, "/root/testdata/sf0.001", "pages").limit(200).collect()]
    made = [generated(rng, 0) for _ in range(200)]
    right = [[main_text(h) for h in each] for each in (pages, made)]
    score = html_extract._score

    def shuffled(elements):
        score(elements)
        points = [e.points for e in elements]
        rng.shuffle(points)
        for e, x in zip(elements, points):
            e.points = x

    monkeypatch.setattr(html_extract, "_score", shuffled)
    for each, want in zip((pages, made), right):
        assert sum(main_text(h) != w for h, w in zip(each, want)) > 0.25 * len(want)


def test_the_scores_alone_find_the_article(spark, monkeypatch):
    """Without any list of furniture, and without the mark of the article, the rest of a page has too few points."""
    pages = [r.html for r in common.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    want = [brute(h) for h in pages]
    monkeypatch.setattr(html_extract, "FURNITURE", frozenset())
    monkeypatch.setattr(html_extract, "APART", frozenset())
    assert sum(main_text(h) == w for h, w in zip(pages, want)) > 0.97 * len(pages)
    plain = [main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")) for h in pages]
    assert all(w in got for got, w in zip(plain, want))


def test_containers_that_the_best_one_stands_beside():
    Q = P.replace("Some", "Other")
    # A second container beside the best one's wrapper, and a closing section, bare text and a list beside the best one.
    assert main_text(f"<body><div><div id=a><p>{P}</p><p>{P}</p><p>{P}</p></div></div><div><div id=b><p>{Q}</p><p>{Q}</p></div></div></body>") == " ".join([P] * 3 + [Q] * 2)
    assert main_text(f"<div><div><p>{P}</p><p>{P}</p><p>{P}</p></div>and <b>so</b> on<div><p>The end.</p></div><ul><li>x</li></ul><div><a href=1>more</a></div></div>") == " ".join([P] * 3) + " and so on The end. x"


def test_long_pages_take_time_in_proportion():
    def seconds(n):
        html = "<body>" + f"<div class='comment-free'><article><p>{P}</p></article></div>" * n + "</body>"
        began = time.perf_counter()
        assert main_text(html) == " ".join([P] * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8000) < 16 * seconds(1000)


def brute(html):
    """The tables' pages are of one make: everything in their article element."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    inner = re.sub(r"</?(?:p|h1|br)>", " ", inner)
    return " ".join(unescape(re.sub(r"</?b>", "", inner)).split())


def test_query(spark):
    pages = {r.page_id: r for r in common.table(spark, "/root/testdata/sf0.001", "pages").collect()}
    got = html_extract.op7_html_extract(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute(pages[r.page_id].html), len(r.text))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain text", "plain text"),
        (f"<body><div class='content'><h1>T</h1><p>{P}<p>Short.</div><div class=sidebar><p>{P}</div></body>", f"T {P} Short."),
        (f"<body><header><a href=/>Site</a></header><main><h1>T</h1><div><p>{P}</p><p>{P}</p></div></main><footer>c</footer></body>", f"T {P} {P}"),
        (f"<div id=wrap class='has-sidebar'><article><header><h1>T</h1><p>by me</p></header><p>{P}</p></article></div>", f"T {P}"),
        (f"<article><p>{P}</p><section id='comments'><article><p>{P} {P}</p></article></section></article>", P),
        (f"<div><div class='cookie-notice'>{P}</div><div><p>{P}</p><ul><li>one</li><li>two</li></ul></div></div>", f"{P} one two"),
        (f"<article><p>a&lt;b &amp c&nbsp;&eacute;&#x41;{P}</p><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- x --><form><input> Name</form></article>", f"a<b & c éA{P}"),
        (f"<article><p>f<b>o</b>o<br>bar <i>x</i>\n\t y {P}</p></article><p hidden>{P}</p>", f"foo bar x y {P}"),
        (f"<article><p>{P}<a title=\"a>b\" href=x>link</a></p></article><div class", f"{P}link"),
        (f"<article><p>{P}</p><div style='display: none'>{P}</div><div role=complementary>{P}</div></article><script>never ended", P),
        (f"<form id=all><div id=top class=menu><a href=/>x</a></div><div><p>{P}</p><p>{P}</p></div></form>", f"{P} {P}"),
        (f"<table><tr><td><a href=/>Home</a> <a href=/b>Other</a></td><td><p>{P}</p><p>{P}</p></td></tr></table>", f"{P} {P}"),
        (f"<div class='layout no-sidebar'><div role=main><h1>T</h1><p>{P}</p></div><div class='comment body'><p>{P}</p></div></div>", f"T {P}"),
        (f"<div id=page-header-wrapper><div><h2>T</h2><p>{P}</p><p>{P}</p></div></div><div id=user-comments><p>{P}</p></div>", f"T {P} {P}"),
        (f"<main><p>{P}</p><div class='alert alert-info'>Cookies!</div><div class=share><button>Like</button></div><ol class=commentlist><li>{P}</li></ol></main>", P),
        (f"<div><div><a href=1>One</a> | <a href=2>Two</a></div><div><h1>T</h1><p>{P}</p><p>Yes.</p><blockquote>{P}</blockquote></div><div>(c) 2020</div></div>", f"T {P} Yes. {P}"),
        (f"<body><p>{P}</p><p>{P}</p><nav>{P}</nav></body>", f"{P} {P}"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + P + "</div>" * 5000) == P
    assert main_text("<article>" + f"<p>{P}</p>" * 5000 + "</article>") == " ".join([P] * 5000)
    assert main_text("<" * 20000) is not None
    assert main_text("<a href='" * 3000) is not None


@given(st.lists(st.sampled_from([*"<>/!-= \"'&;ab", "<p>", "</p>", "<div>", "<b>", "<script>", "<!--", "<li>", "</div>", "<td>", "<article>", "</article>"]), max_size=60).map("".join))
def test_any_markup(html):
    assert isinstance(main_text(html), str)


def test_nulls_and_names(spark):
    df = spark.createDataFrame([(None, None, None, "x", 1), (2, "u", "<p>hi</p>", "x", 1), (2, "u", "<p>hi</p>", "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html_extract.extracted(df).collect()), key=repr) == [(2, "u", "hi", 2), (2, "u", "hi", 2), (None, None, "", 0)]
    assert html_extract.extracted(df.limit(0)).collect() == []
