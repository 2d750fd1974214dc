"""Main text extraction: planted articles in templates, odd markup, and defined results."""

from __future__ import annotations

import random

import pytest

from recscope.llm import html_template as ht
from recscope.llm.queries import QUERIES

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'


def page(title: str, paragraphs: list[str], k: int = 0) -> str:
    body = "".join(f"<p>{p}</p>\n" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='</p><p>no</p>';</script></head><body>"
        f'<div class="top-banner">Buy now {k}</div>{MENU}<main><article><h1>{title}</h1>{body}<p>Published by the Daily Example team.</p></article></main>'
        f'<div id="comments"><p>First comment on {title}!</p></div><aside>Related things</aside><form><label>Mail</label><input></form><footer>All rights reserved 2024</footer></body></html>'
    )


def words(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(n))


SHARED = "Published by the Daily Example team."


def articles_of(draw: random.Random, n: int) -> list[tuple[str, list[str]]]:
    return [(words(draw, 4), [words(draw, draw.randrange(5, 40)) for _ in range(draw.randrange(1, 6))]) for _ in range(n)]


def plain(title: str, paragraphs: list[str], draw: random.Random) -> str:
    """A page of plain divs: nothing but the template tells the article from the teaser and the note."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><body><div>{words(draw, 5)}</div><div><h1>{title}</h1>{body}</div><div>Note: {words(draw, 6)}</div><div><p>All of it is ours.</p></div></body></html>"


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 20])
def test_articles_of_one_host(n):
    """A line that all articles share is theirs, however many pages the host has."""
    articles = articles_of(random.Random(1), n)
    got = ht.extract([page(t, ps, k) for k, (t, ps) in enumerate(articles)])
    assert got == ["\n\n".join([t, *ps, SHARED]) for t, ps in articles]


def test_template_decides_without_markup():
    draw = random.Random(4)
    articles = articles_of(draw, 30)
    htmls = [plain(t, ps, draw) for t, ps in articles]
    expected = ["\n\n".join([t, *ps]) for t, ps in articles]
    assert ht.extract(htmls, markup=False) == expected
    assert ht.extract(htmls) == expected
    # Without the template (and the rules for pages that have none) the teaser and the note stay.
    assert not any(ht.main_text(ht.read(h, False), None, False) == e for h, e in zip(htmls, expected, strict=True))


def test_layouts_and_boilerplate_of_one_host():
    """Two layouts on one host; a share box on all of a layout's articles is boilerplate."""
    draw = random.Random(5)
    one, two = articles_of(draw, 12), articles_of(draw, 7)
    box = "<div><p>Tell your friends</p></div>"
    body = lambda ps: "".join(f"<p>{p}</p>" for p in ps)
    htmls = [f"<body><div><h1>{t}</h1>{body(ps)}{box}</div><div>{words(draw, 3)}</div></body>" for t, ps in one]
    htmls += [f"<body><table><tr><td>{words(draw, 4)}</td><td><h1>{t}</h1>{body(ps)}</td></tr></table></body>" for t, ps in two]
    assert ht.extract(htmls, markup=False) == ["\n\n".join([t, *ps]) for t, ps in one + two]


def test_heading_before_the_text_is_kept():
    draw = random.Random(6)
    articles = articles_of(draw, 8)
    htmls = [f"<body><h1>{t}</h1><div>by {words(draw, 1)}</div><div>{''.join(f'<p>{p}</p>' for p in ps)}</div></body>" for t, ps in articles]
    assert ht.extract(htmls, markup=False) == ["\n\n".join([t, *ps]) for t, ps in articles]


def test_copies_do_not_become_a_template():
    draw = random.Random(2)
    one = (words(draw, 4), [words(draw, 30)])
    expected = "\n\n".join([one[0], *one[1], SHARED])
    assert ht.extract([page(*one)] * 30) == [expected] * 30
    # 97 copies and 3 other articles, all with one site-wide title.
    others = articles_of(draw, 3)
    htmls = [plain(*one, draw) for _ in range(97)] + [plain(t, ps, draw) for t, ps in others]
    assert ht.extract(htmls)[97:] == ["\n\n".join([t, *ps]) for t, ps in others]


def test_inline_parts_set_aside_leave_the_paragraph():
    assert ht.extract(['<p>before <span class="ad">buy</span>after</p>']) == ["before after"]


def test_deep_nesting():
    assert ht.extract(["<div>" * 20_000 + "x" + "</div>" * 20_000]) == ["x"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>a<br>b   c</p><p>d&nbsp;e &lt;f&gt; &#233;</p>", "a b c\n\nd e <f> é"),
        ("<article><p>x<b>y</b>z <i>w</i></p></article><p>outside</p>", "xyz w"),
        ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\n\nfour"),
        ("<script>if (a < b) {}</script><p>kept</p><!-- <p>gone</p> --><style>x</style>", "kept"),
        ("<p>unclosed <b>tag", "unclosed tag"),
        ('<div hidden><p>gone</p></div><div style="display: none">gone</div><p>kept</p>', "kept"),
    ],
)
def test_markup(html, text):
    assert ht.extract([html]) == [text]


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(1, "http://a.example/1", None), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (None, "http://A.example/2", "<p>null id</p>"), (3, "not a url", ""), (4, "http://a.example/4", "<p>" + "long " * 50_000 + "</p>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r)[:4] for r in QUERIES["op4_html_extraction"](spark, str(tmp_path)).collect()), key=str)
    texts = {1: "", 2: "x", None: "null id", 3: "", 4: ("long " * 50_000).strip()}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, text string, host string")
    assert ht.main_texts(empty).count() == 0


@pytest.mark.parametrize("most", [400_000, 0])
def test_spark_agrees_with_one_machine(spark, monkeypatch, most):
    """Broadcast and joined decisions are those of ``extract`` over each host's pages."""
    monkeypatch.setattr(ht, "DECISIONS", most)
    draw = random.Random(3)
    hosts = {"hot.example": [plain(t, ps, draw) for t, ps in articles_of(draw, 60)], "b.example": [page(t, ps, k) for k, (t, ps) in enumerate(articles_of(draw, 9))], "one.example": [plain(*articles_of(draw, 1)[0], draw)], "two.example": [plain("t", ["same"], random.Random(1))] * 2}
    hosts["hot.example"] += [page(t, ps, k) for k, (t, ps) in enumerate(articles_of(draw, 5))]
    rows, expected = [], {}
    for host, htmls in hosts.items():
        for h, text in zip(htmls, ht.extract(htmls), strict=True):
            expected[len(rows)] = text
            rows.append((len(rows), f"http://{host}/x", h))
    got = ht.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == expected
    assert {r["by_template"] for r in got if r["page_id"] < 60} == {True}


@pytest.mark.parametrize("counts", [[1, 2, 3, 4], [2], [3, 3, 2]])
@pytest.mark.parametrize("label", ['div class="s"', "section", "div"])
def test_equal_sections_are_one_slot(counts, label):
    draw = random.Random(8)
    htmls, expected = [], []
    for k in range(32):
        title, parts = words(draw, 4), [[words(draw, draw.randrange(15, 40)) for _ in range(2)] for _ in range(counts[k % len(counts)])]
        inner = "".join(f"<{label}>{''.join(f'<p>{p}</p>' for p in ps)}</{label.split()[0]}>" for ps in parts)
        htmls.append(f'<body><div class="menu2">Home News</div><div class="outer"><h1>{title}</h1>{inner}</div><div class="end">All of it is ours</div></body>')
        expected.append("\n\n".join([title, *(p for ps in parts for p in ps)]))
    assert ht.extract(htmls, markup=False) == expected
    assert ht.extract(htmls) == expected


INNER = [
    *(f'<div class="{c}"><p>Words of the article about {c}.</p></div>' for c in ("market-share", "social-history", "search-results", "hidden-gems", "copyright-law", "note-ad-3")),
    "<figure><figcaption>What the picture shows</figcaption></figure>",
    "<label>A label in the text</label>",
    '<ul><li><a href="/x">A reference of the article</a></li><li><a href="/y">Another one</a></li></ul>',
]


@pytest.mark.parametrize("inner", INNER)
@pytest.mark.parametrize("n", [1, 12])
def test_what_an_article_has_stays(inner, n):
    draw = random.Random(9)
    texts = [words(draw, 30) for _ in range(n)]
    pages = [f"<body>{MENU}<main><article><h1>Title {k}</h1><p>{t}</p>{inner}</article></main><footer>ours</footer></body>" for k, t in enumerate(texts)]
    said = ["\n\n".join([f"Title {k}", t, *[b.text() for b in ht.read(inner, False).blocks]]) for k, t in enumerate(texts)]
    assert ht.extract(pages) == said


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "share-buttons", "cookie-notice", "newsletter-form", "related-posts", "social-share", "advert banner", "commentList", "sidebar-right", "ad3"])
def test_what_is_set_aside_within_an_article(name):
    assert ht.extract([f'<article><p>the text</p><div class="{name}"><p>not of it</p></div></article>']) == ["the text"]


def test_constant_cells_beside_ones_that_vary():
    draw = random.Random(10)
    rows = [[words(draw, 12) for _ in range(3)] for _ in range(10)]
    pages = [f"<body><div>Menu</div><div class='c'><h1>t {k}</h1><p>{words(random.Random(k), 30)}</p><table>{''.join(f'<tr><td>Row {i}</td><td>{c}</td></tr>' for i, c in enumerate(r))}</table></div></body>" for k, r in enumerate(rows)]
    for k, (got, r) in enumerate(zip(ht.extract(pages, markup=False), rows, strict=True)):
        assert got == "\n\n".join([f"t {k}", words(random.Random(k), 30), *(x for i, c in enumerate(r) for x in (f"Row {i}", c))])


@pytest.mark.parametrize("heading", ["<h1>t</h1>", ""])
def test_short_article_beside_longer_teasers(heading):
    draw = random.Random(11)
    texts = [words(draw, 20) for _ in range(30)]
    teasers = lambda: "".join(f'<div><a href="/x">{words(draw, 10)}</a></div>' if draw.random() < 0.5 else f"<div>{words(draw, 10)}</div>" for _ in range(4))
    pages = [f"<body><div class='a'>{heading}<p>{t}</p></div><div class='b'>{teasers()}</div></body>" for t in texts]
    assert ht.extract(pages) == ["\n\n".join([*(["t"] if heading else []), t]) for t in texts]


def test_page_alone_on_its_host():
    draw = random.Random(12)
    text = [words(draw, 30) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in text)
    html = f'<body><div><a href="/">Home</a> <a href="/n">News</a></div><div><div><h1>A title</h1>{body}</div></div><div><div><a href="/1">{words(draw, 6)}</a></div><div><a href="/2">{words(draw, 6)}</a></div></div><div>Imprint</div></body>'
    assert ht.extract([html]) == ["\n\n".join(["A title", *text])]
    # Sentences elsewhere: nothing is left out.
    two = f"<body><div><p>{text[0]}</p></div><div><p>{text[1]}</p></div></body>"
    assert ht.extract([two]) == ["\n\n".join(text[:2])]


@pytest.mark.parametrize("html", ["<span>" * 50_000 + "</x>" * 50_000, "<p><div>" + "<span><p></p>" * 30_000, "<div>" * 30_000 + "<li>" * 30_000])
def test_tags_out_of_order_take_linear_time(html):
    import time

    began = time.perf_counter()
    ht.read(html)
    assert time.perf_counter() - began < 2
