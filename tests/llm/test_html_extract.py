import re
from html import unescape

import pytest

from corpuslens.llm import html_extract as he

DATA = "/root/testdata/sf0.01"


def article_by_regex(html):
    """For the plain pages of the given data: the article element, cut at its block tags."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", inner)
    return " ".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks) if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: article_by_regex(r.html) for r in pages.collect()}
    out = he.main_text(pages).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


LONG = "This is a sentence of the article, with some more words in it. " * 4
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><a href="/">Home</a></header><div id="cookie-notice">We use cookies.</div>
<div class="layout sidebar-right"><nav><a href="/a">A</a></nav>
<main><div class="breadcrumbs"><a>x</a> / <a>y</a></div><article class="post post-77"><h2>Head&amp;line &lt;1&gt;</h2>
<p>{long}<p>Second   &nbsp; <b>bo</b>ld <a href="#">link</a> text.<script>var a = "</p><p>no";</script>
<ul><li>One thing<li>Two things</ul><form><p>Name <input></form><div class="share-buttons">Share</div>
<aside>Aside text</aside></article><section id="comments"><article class="comment"><p>{long}{long} I liked it.</p></article></section></main>
<div class="sidebar"><p>{long}</p></div></div><div class="ad">{long}</div><footer>&copy; 2020</footer></body></html>""".replace("{long}", LONG)
WANT = f"Head&line <1> {' '.join(LONG.split())} Second bold link text. One thing Two things"


def test_page_with_everything():
    assert he.extracted(PAGE, None) == (WANT, False)
    path = he.votes(PAGE)
    best = max(path, key=lambda x: x[1])[0]
    assert best.endswith("article.post")
    assert he.extracted(PAGE, best) == (WANT, True)
    assert he.extracted(PAGE, "body>div.other") == (WANT, False)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>a<br>b</p> c", "a b c"),
        ("<p>unclosed <b>bold", "unclosed bold"),
        ("<!-- x --><p>a<!-- <p>no</p> -->b</p>", "ab"),
        ("<script>x", ""),
        ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"),
        ("<div><p>x</div></p>y", "x y"),
        ("<p>tail <", "tail <"),
        ("<a href='x>y'>link only</a>", "link only"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<p>&#128512;&eacute;&nbsp;x</p>", "😀é x"),
        ("<P CLASS=x>Upper</P><STYLE>a{}</STYLE>", "Upper"),
    ],
)
def test_small_pages(html, want):
    assert he.extracted(html, None)[0] == want


def test_deep_and_long_pages():
    assert he.extracted("<div>" * 30_000 + "deep" + "</div>" * 30_000, None)[0] == "deep"
    assert he.extracted("<article>" + "<p>word</p>" * 50_000 + "</article>", None)[0] == " ".join(["word"] * 50_000)
    assert he.extracted("<" * 20_000, None)[0] == "<" * 20_000
    assert he.extracted("<a " * 5_000, None)[0] is not None


def test_hosts_vote_and_odd_rows(spark):
    other = '<div class="box1"><p>' + LONG + "</p></div><div class='box2'><p>tiny</p></div>"
    usual = '<div class="text-col"><p>' + LONG + "</p></div><div class='box2'><p>tiny</p></div>"
    rows = [(i, f"http://Example.org:80/{i}", usual, 1) for i in range(5)] + [(9, "http://example.org/x", other, 1), (10, None, usual, 1), (None, "nonsense", None, 1), (11, "https://u@b.org?q", "", None), (0, "http://Example.org:80/0", usual, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    out = he.main_text(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[3].text == " ".join(LONG.split()) and by[3].by_host_path
    assert by[9].text == " ".join(LONG.split()) and not by[9].by_host_path
    assert by[10].text and by[11].text == "" and by[None].n_chars == 0
    assert {r.host for r in df.select(he.host_of(df.url).alias("host")).collect()} == {"example.org", "", "b.org"}
    assert he.main_text(df.limit(0)).collect() == []


def sentences(word, n):
    return " ".join(f"The {word} sentence number {i} is here." for i in range(n))


@pytest.mark.parametrize(
    "parts",
    [
        ["<section>{}</section>", "<section>{}</section>"],
        ["<div class=content>{}</div>"] * 4,
        ["<div class=part1>{}</div>", "<div class=part2>{}</div>", "<div class=other>{}</div>"],
        ["<section>{}</section>", "<p>{}</p>"],
        ["<h1>{}</h1>", "<section><p>{}</p></section>", "<div><section>{}</section></div>"],
    ],
)
def test_no_part_of_an_article_is_lost(parts):
    texts = [sentences(f"w{i}", n) for i, n in enumerate([50, 30, 12, 8][: len(parts)])]
    page = "<body><div>" + "".join(p.format(t) for p, t in zip(parts, texts, strict=True)) + "</div><div class=sidebar>" + sentences("side", 9) + "</div></body>"
    assert he.extracted(page, None) == (" ".join(texts), False)
    for path, _ in he.votes(page):
        assert he.extracted(page, path)[0] == " ".join(texts)


def test_host_path_with_half_of_the_page_is_not_enough():
    page = f"<body><div><div class=lead>{sentences('a', 60)}</div><p>{sentences('b', 40)}</p></div></body>"
    assert he.extracted(page, "body>div>div.lead") == (f"{sentences('a', 60)} {sentences('b', 40)}", False)


@pytest.mark.parametrize(
    "html",
    ["<aaaa", "<aaaa ", "<a b=", "<a '", "<a \"x='", "<!", "<!--", "</", "<div>", "<p><b>", "<li>", "<div class='x1'>", "<form><p>a.", "<ul><li><a>x</a>", "<div class=share>a b c. ", "<table><td><p>", "&", "</p>", "<section class=alert><div>"],
)
def test_any_markup_takes_linear_time(html):
    import time

    took = []
    for size in (50_000, 200_000):
        page, t = html * (size // len(html)), time.time()
        he.votes(page)
        he.extracted(page, "body>div")
        took.append(time.time() - t)
    assert took[1] < max(2.0, 9 * took[0])


def test_a_megabyte_of_tags_without_an_end():
    import time

    for html in ("<aaaa", "<a <", "<a b='", "<!"):
        t = time.time()
        he.extracted(html * (1_000_000 // len(html)), None)
        assert time.time() - t < 4


S = "A sentence of the story, which is long enough to be one of its own parts, ends here."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><form id=f><div><p>{S}</p><p>{S}</p><input></div></form></body>", f"{S} {S}"),
        (f"<body><div><p>{S}</p><form><p>Your name, please. <input></p></form></div></body>", S),
        (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{S}</p></article></body>", f"Title {S}"),
        (f"<body><article><div class='entry-header'>Title</div><p>{S}</p><div class='entry-footer'>tags</div></article></body>", f"Title {S}"),
        *((f"<body><article><p>{S}</p><section class='{c}'><p>{S}</p></section></article></body>", f"{S} {S}") for c in ("social-science-article", "search-engine-history", "copyright-law", "alert", "share", "no-sidebar", "part notice-of-dawn")),
        *((f"<body><article><p>{S}</p><section class='{c}'><p>{S}</p></section></article></body>", S) for c in ("ad", "ads", "sidebar", "side-bar right", "cookie-notice", "notice", "comments-area", "newsletter-box", "widget", "related-posts", "main-menu", "AD-SLOT", "ad-content")),
        (f"<body><article><p>{S}</p><div class=share>Share</div><div class='social-links'>Like us</div></article></body>", S),
        (f"<body><div class=x>{S} {S}</div><div class=x><p>The end.</p></div></body>", f"{S} {S} The end."),
    ],
)
def test_names_headers_and_forms(html, want):
    assert he.extracted(html, None)[0] == want
    for path, _ in he.votes(html):
        assert he.extracted(html, path)[0] == want


def test_paths_of_any_depth():
    inner = f"<p>{S}</p><p>{S}</p>"
    one, two = ("<div>" * 40 + f"<div class={c}9>" + "<div>" * 20 + f"<div class=x>{inner}</div>" for c in ("a", "b"))
    paths = [{p for p, _ in he.votes(h)} for h in (one, two, one.replace("9", "7"))]
    assert paths[0] == paths[2] and len(paths[0]) == len(paths[1]) == 63 and len(paths[0] & paths[1]) == 41
    assert max(map(len, paths[0])) < 120


def labelled_page(rng, layout):
    """A page of one of six layouts, and its main text by construction."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(8, 20))).capitalize() + "."
    blocks = [sentence() if rng.random() < 0.7 else f"{sentence()} {sentence()}" for _ in range(rng.randint(4, 12))]
    marked = [rng.choice(["<p>{}</p>", "<p>{}", "<P class=c{}>".replace("{}", str(rng.randint(0, 9))) + "{}</P>", "<p><em>{}</em></p>"]).format(b) for b in blocks]
    title = sentence()
    links = "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(3, 8))) + "</ul>"
    junk = [f"<nav>{links}</nav>", f"<div class='ad ad-{rng.randint(1, 9)}'>{sentence()}</div>", f"<aside><p>{sentence()}</p></aside>", f"<div class=cookie-notice>{sentence()}</div>", f"<form><label>{word()}</label><input></form>", f"<section id=comments><p>{sentence()}</p><p>{sentence()}</p></section>"]
    rng.shuffle(junk)
    body = f"<h1>{title}</h1>" + "".join(marked)
    half = len(marked) // 2
    frames = [
        f"<article>{body}</article>",
        f"<article><header><h1>{title}</h1></header>{''.join(marked)}{junk[5]}</article>",
        f"<div id=main-content><h1>{title}</h1>{''.join(marked[:half])}{junk[4]}{''.join(marked[half:])}</div>",
        f"<main><h1>{title}</h1><section>{''.join(marked[:half])}</section><section>{''.join(marked[half:])}</section></main>",
        f"<form action=/><div class=wrap{rng.randint(1, 99)}>{body}</div></form>",
        f"<div class=story-{rng.randint(1, 99)}>{body}</div>",
    ]
    html = f"<html><head><title>{title}</title><script>var a='<p>{sentence()}</p>'</script></head><body><header>{word()}</header>{junk[0]}{junk[1]}{frames[layout]}{junk[2]}{junk[3]}<footer>{sentence()}</footer></body></html>"
    return html, " ".join([title, *blocks])


def test_labelled_pages(spark):
    import random

    rng = random.Random(8)
    made = [(i, f"https://h{i % 6}.org/{i}", *labelled_page(rng, i % 6)) for i in range(240)]
    df = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string").repartition(5)
    out = {r.page_id: r for r in he.main_text(df).collect()}
    assert [i for i, _, _, want in made if out[i].text != want] == []
    assert sum(r.by_host_path for r in out.values()) > 200


FOUR = f"{S} {S} {S} {S}"


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ('<h2 id="navigation">Navigation of ships</h2>', "Navigation of ships"),
        ('<h3 id="advertisement">Advertisement</h3>', "Advertisement"),
        *((f'<section id="{i}"><h2>Part</h2><p>{FOUR}</p></section>', f"Part {FOUR}") for i in ("related", "cookies", "promotion", "navigation", "sidebar")),
        (f'<p class="banner">{FOUR}</p>', FOUR),
        (f'<table class="navigation"><tr><td>{FOUR}</td></tr></table>', FOUR),
        (f'<blockquote class="promo"><p>{FOUR}</p></blockquote>', FOUR),
        ("<ol><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ol>", "First source Second source Third source"),
        ("<p>See <a href=1>the first source</a>, <a href=2>the second one</a> and <a href=3>the third one</a>.</p>", "See the first source, the second one and the third one."),
        (f"<blockquote><p>{S}</p><footer>Somebody</footer></blockquote>", f"{S} Somebody"),
        # and what goes all the same
        ('<p class="ad">Buy.</p>', ""),
        ('<section id="comments"><p>I liked it, and I have a lot more to say about it than this.</p></section>', ""),
        ('<li class="menu-item"><a href=1>Home</a></li>', ""),
        ("<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>", ""),
        (f'<div id="cookies"><p>{S}</p></div>', ""),
        ("<footer>Filed under: things</footer>", ""),
    ],
)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><article class=post>{}</article></main>"])
def test_an_article_keeps_its_text(part, want, frame):
    html = f"<body><nav><a href=/>x</a></nav>{frame.format(f'<h1>Title</h1><p>{S}</p>{part}<p>{S}</p>')}<div class=ad>{S}</div></body>"
    text = " ".join(x for x in ("Title", S, want, S) if x)
    assert he.extracted(html, None)[0] == text
    for path, _ in he.votes(html):
        assert he.extracted(html, path)[0] == text


def test_votes_and_winners_by_plain_loops(spark):
    import random
    from collections import defaultdict

    rng = random.Random(8)
    rows = [(i, f"http://host{i % 7}.org/{i}", labelled_page(rng, rng.randint(0, 5))[0]) for i in range(120)] + [(900, None, "<p>x.</p>"), (901, "http://host1.org/z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sums = defaultdict(float)
    for _, url, html in rows:
        if url:
            for path, score in he.votes(html or ""):
                sums[url.split("/")[2], path] += score
    named = pages.select(he.host_of("url").alias("host"), "html").fillna({"html": ""})
    got = {(r.host, r.path): r.score for r in he.host_votes(named).collect()}
    assert got.keys() == sums.keys() and all(abs(got[k] - 1e6 * sums[k]) <= 200 for k in got)
    best = {}
    for (host, path), score in sorted(got.items()):
        if host not in best or score > best[host][0]:
            best[host] = (score, path)
    assert {r.host: r.path for r in he.winning_paths(he.host_votes(named)).collect()} == {h: p for h, (_, p) in best.items()}
