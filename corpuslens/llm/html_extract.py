"""HTML main-text extraction by consensus host paths.

Each page is parsed into a tree that forgives missing end tags. Its containers are scored by the text of their blocks
(by distance, less the share of text in links), and the best are votes for their generalised path: tag and class names from
the body down, digits left out. Spark sums the votes for each host and path, with a map-side combine, so a host of any
size is one row for each path and task. Each host's winning path goes back to its pages, which are extracted again from the elements at
that path; a page with article text of its own choice outside them (or without the path) keeps its own: the elements at its
best container's path, or the outermost container around them with more article text (its own text, blocks, or containers
with a sentence; a container without one, of another class, is taken for a label).

What isn't article text is left out of both passes: menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments, by element, role, and the names of class and id (see `named_out`); and lists that are nearly all
links. An article's own header stays, and so does a form that holds the article or half of the page's text (a page wrapped in one).
A section with a name that an article's own part may have as well (alert, share, copyright) stays if it holds a sentence.

A path is exact at any depth: beyond PATH_DEPTH elements the upper ones are written as a digest. Reading, scoring and choosing
take linear time in the page.

Defined results: a null or empty html has an empty text; a page without a host (or with a null url) votes for nothing and
is extracted by its own best container; repeated rows give a row each; an empty table gives an empty result; extra
columns aren't looked at; html is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_arrow_batches, stored, table

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html article body blockquote center div main section table tbody td".split())
LEFT_OUT = frozenset("aside audio button canvas datalist dialog embed footer form head header iframe input label menu nav noembed noframes noscript object script select style svg template textarea title video".split())
ENDS_P = BLOCK - {"br", "option"}
#: A start tag closes an open element of these, up to the nearest of the bounds.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
#: Words of class and id names of what isn't the article; those that an article's own part may have too; words that only say what kind of box a name is of; words that say that something else has the thing named.
STRONG = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside header masthead footer cookie cookies "
    "notice notices consent gdpr popup modal overlay newsletter subscribe subscription comment comments commentlist disqus respond replies related recommended widget widgets pagination pager".split()
)
WEAK = frozenset("share sharing social search skip login signup toolbar disclaimer copyright alert".split())
BOXES = frozenset("area articles bar bars block blocks body bottom box boxes button buttons col column container content contents footer form group header holder icons inner item items left link links list main nav notice outer panel posts primary right row secondary section sections slot stories text title top unit widget widgets wrap wrapper".split())
HAVING = frozenset("has have with without no not hide show is".split())
#: Of the strong words, those of readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Elements that hold text rather than parts of a page: within an article a name doesn't take one out that holds prose. The ids of these
#: and of sections are often made from their titles.
TEXT_PARTS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre table dl dt dd figure".split())
#: Headers with these words are an article's own.
OWN_HEADER = frozenset("article entry post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
SENTENCE, WORD = re.compile(r"\w\W*?[.!?…。！？।؟]"), re.compile(r"\w")
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body|text)(?:$|[\s_-])", re.I)

#: A tag from its first letter to its end; quoted values may hold ">" if the quote is closed. Possessive, so that nothing is tried twice.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|$))""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: Elements of a path that are written out.
PATH_DEPTH = 12
#: Text, without links, that a weakly named section must have to stay.
SECTION_CHARS = 60


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "out", "weak", "in_article", "in_main", "in_quote", "depth", "steps", "upper", "text_n", "link_n", "links", "sentence", "raw_n", "score", "holds_article")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article" and not parent.out)
        self.in_main = parent is not None and (parent.in_main or parent.tag in ("article", "main") and not parent.out)
        self.in_quote = parent is not None and (parent.in_quote or parent.tag == "blockquote")
        self.weak = False
        own = tag == "header" and self.in_article or tag == "footer" and self.in_quote  # an article's header, a quotation's footer
        self.out = tag in LEFT_OUT and not own or left_out(self)
        self.depth, self.steps, self.upper = (0, (), b"") if parent is None else (parent.depth + 1, None, b"")
        self.text_n = self.link_n = self.links = self.raw_n = 0
        self.sentence = self.holds_article = False
        self.score = 0.0


def named_out(name: str, own: bool) -> str | None:
    """Whether a class or id name is of what isn't the article: "comments", "strong", "weak" or None.

    The name's last word decides, or its first word if the others are only words for boxes, so that a section about a
    thing ("social-science-article", "copyright-law") isn't taken for the thing. own: within an article, whose header stays.
    """
    words = re.findall(r"[a-z]+", name.lower().replace("side-bar", "sidebar"))
    if not words or not HAVING.isdisjoint(words):
        return None
    for word, others in ((words[-1], ()), (words[0], words[1:])):
        if all(w in BOXES for w in others):
            if word == "header" and (own or not OWN_HEADER.isdisjoint(words)):
                continue
            if word in STRONG:
                return "comments" if word in COMMENTS else "strong"
            if word in WEAK:
                return "weak"
    return None


def left_out(node: Node) -> bool:
    """Whether an element's attributes say that it isn't article text; `weak` is set where its text must decide."""
    a, tag = node.attributes, node.tag
    if not a or tag in ("html", "body", "main"):
        return a.get("role", "").lower() in ROLES and tag != "html"
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    kinds = {named_out(name, node.in_article) for name in a.get("class", "").split()}
    by_id = {named_out(name, node.in_article) for name in a.get("id", "").split()}
    if tag in TEXT_PARTS or tag == "section" and node.in_main:  # an id made from a title: only that of comments says something
        by_id &= {"comments"}
    if tag in TEXT_PARTS and node.in_main and "strong" in kinds:
        kinds = kinds - {"strong"} | {"weak"}
    kinds |= by_id
    node.weak = "weak" in kinds and tag != "article"
    return not kinds.isdisjoint(("strong", "comments"))


class Builder:
    """The open elements of a page while it is parsed, with the depths of those of each tag, so that none is searched for."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None, {})
        self.open: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(node.depth)
        self.node = node

    def end(self, tags: tuple[str, ...], bounds: tuple[str, ...] = ()) -> bool:
        """End the nearest open element of `tags` that has no open element of `bounds` inside it."""
        deepest = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if not deepest or any(self.open[t][-1] > deepest for t in bounds if self.open.get(t)):
            return False
        while self.node.depth >= deepest:
            self.open[self.node.tag].pop()
            self.node = self.node.parent
        return True


def parsed(html: str) -> Node:
    """The tree of a page, under an element 'html'. Strings are text as written, with references still in."""
    b = Builder()
    at, n = 0, len(html)
    last_end = html.rfind(">")
    while at < n:
        start = html.find("<", at)
        if start < 0:
            b.node.children.append(html[at:])
            break
        if start > at:
            b.node.children.append(html[at:start])
        m = TAG.match(html, start)
        if m is None:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), start) and start < last_end:
                at = html.find(">", start) + 1
            else:  # a "<" that begins nothing is text
                b.node.children.append("<")
                at = start + 1
            continue
        at = m.end()
        tag = m[1].lower()
        if html.startswith("</", start):
            if not b.end((tag,)) and tag in ("p", "br"):
                b.node.children.append(Node("br", b.node, {}))
            continue
        if tag == "html" or tag == "form" and b.open.get("form"):  # a form within a form isn't one
            continue
        if tag in ENDS_P:
            b.end(("p",), ("td", "th", "table", "button", "object", "caption"))
        if tag in CLOSES:
            b.end(*CLOSES[tag])
        rest = html[m.end(1) : at - 1]
        attributes = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(rest)} if rest else {}
        new = Node(tag, b.node, attributes)
        b.node.children.append(new)
        if tag in VOID or rest.endswith("/") and tag in ("path", "circle", "rect", "use", "g"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else n
        b.push(new)
    return b.root


def reached(root: Node) -> list[Node]:
    """Every element that isn't left out, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.out]
    return order


def measured(root: Node) -> list[Node]:
    """Score the containers that aren't left out; they are returned in page order.

    Text counts for the container it is in, by 0.6 for the next one out, and so on; an article, main or well-named container
    counts all text within it. Everything is summed from the leaves up, so a page of any depth takes linear time.
    """
    for node in reached_all(root):  # a frame named like a sidebar that holds the article isn't one
        if node.out and node.tag == "form":
            node.out = not (node.holds_article or 2 * node.raw_n >= root.raw_n and prose(node, True)) or left_out(node)
        else:
            node.out = node.out and not (node.holds_article and node.tag not in LEFT_OUT)
    sums: dict[int, tuple[float, float]] = {}
    for node in reversed(reached(root)):  # children before parents
        own = near = whole = 0.0
        for c in node.children:
            if isinstance(c, str):
                k = len(" ".join(c.split()))
                node.text_n += k
                node.link_n += k if node.tag == "a" else 0
                node.sentence = node.sentence or node.tag != "a" and bool(SENTENCE.search(c))
                own += k
            elif not c.out:
                if is_link_list(c) or c.weak and not (c.sentence and c.text_n - c.link_n >= SECTION_CHARS or c.holds_article):
                    c.out = True
                    continue
                node.sentence = node.sentence or c.sentence
                node.links += c.links
                node.text_n += c.text_n
                node.link_n += c.text_n if node.tag == "a" else c.link_n
                n, w = sums.pop(id(c), (0.0, 0.0))
                if c.tag in BLOCK:
                    near += n * (0.6 if c.tag in CONTAINERS else 1.0)
                    whole += w
                else:
                    own += n
        if node.tag == "a":
            own = near = whole = 0.0
            node.links += 1
        named = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"
        good = bool(POSITIVE.search(named))
        sums[id(node)] = (own + near, own + whole)
        if node.tag in CONTAINERS:
            all_ = node.tag in ("article", "main") or good
            node.score = (own + whole if all_ else own + near) * (2.0 if node.tag == "article" else 1.5 if node.tag == "main" or good else 1.0)
    return [x for x in reached(root) if x.tag in CONTAINERS]


def reached_all(root: Node) -> list[Node]:
    """Every element, children before parents, with holds_article and raw_n (characters within, left out by no name) set."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        node.holds_article = any(isinstance(c, Node) and (c.tag in ("article", "main") and not c.out or c.holds_article and c.tag not in LEFT_OUT - {"form"}) for c in node.children)
        node.raw_n = sum(len(c.strip()) if isinstance(c, str) else c.raw_n if not c.out or c.tag == "form" else 0 for c in node.children)
    return order


def is_link_list(node: Node) -> bool:
    """A list or division with several links that are nearly all of its text; an article's own paragraphs, lists and tables are none."""
    if node.in_article and node.tag in ("p", "ul", "ol", "dl", "table"):
        return False
    return node.tag in ("ul", "ol", "dl", "div", "table", "section", "p") and node.text_n > 0 and node.link_n >= 0.8 * node.text_n and node.links >= 3


def step_of(node: Node) -> str:
    """The element's tag and class names, digits left out."""
    names = sorted({re.sub(r"\d+", "", c).strip("-_") for c in node.attributes.get("class", "").lower().split()} - {""})
    return ".".join([node.tag, *names])


def path_of(node: Node) -> str:
    """Tags and class names from the body down to the node, digits left out; of those above the last PATH_DEPTH a digest."""
    todo = []
    up: Node | None = node
    while up.steps is None:
        todo.append(up)
        up = up.parent
    for x in reversed(todo):
        steps, x.upper = (*x.parent.steps, step_of(x)), x.parent.upper
        if len(steps) > PATH_DEPTH:
            x.upper = sha256(x.upper + steps[0].encode("utf-8", "surrogatepass")).digest()
            steps = steps[1:]
        x.steps = steps
    return ">".join([*([node.upper.hex()[:16]] if node.upper else []), *node.steps])


def text_of(nodes: list[Node]) -> str:
    """The blocks of the nodes in page order: references decoded, white space as one space, joined by one space."""
    blocks, run = [], []

    def end() -> None:
        if run:
            block = " ".join(unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            elif not x.out:
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return " ".join(blocks)


def best_of(containers: list[Node]) -> Node | None:
    scored = [x for x in containers if x.score > 0]
    return max(scored, key=lambda x: x.score) if scored else None  # the first in page order of equals


def votes(html: str) -> list[tuple[str, float]]:
    """(generalised path, share of the best score) of all the page's scored containers."""
    containers = [x for x in measured(parsed(html)) if x.score > 0]
    best = max((x.score for x in containers), default=0.0)
    out: dict[str, float] = {}
    for x in containers:
        p = path_of(x)
        out[p] = max(out.get(p, 0.0), x.score / best)
    return sorted(out.items())


def prose(node: Node, as_form: bool = False) -> bool:
    """Whether an element holds a sentence that isn't all links."""
    if as_form:  # before anything is measured, and read as if it weren't left out
        node.out = False
        found = bool(SENTENCE.search(text_of([node])))
        node.out = True
        return found
    return node.text_n > node.link_n and bool(SENTENCE.search(text_of([node])))


def holds_more(node: Node, skip: set[int]) -> bool:
    """Whether a node has article text of its own or in children that aren't in skip: a container's counts if it is prose."""
    for c in node.children:
        if isinstance(c, str):
            if WORD.search(c):
                return True
        elif not c.out and id(c) not in skip and (prose(c) if c.tag in CONTAINERS else c.text_n > c.link_n):
            return True
    return False


def uncovered(node: Node, inside: list[Node]) -> bool:
    """Whether a node holds article text outside the given elements."""
    skip = set(map(id, inside))
    if id(node) in skip or any(id(y) in skip for y in above(node)):
        return False
    between: set[int] = set()
    for x in inside:
        for y in above(x):
            if id(y) in between:
                break
            between.add(id(y))
    if id(node) not in between:
        return True
    covered, stack = skip | between, [node]
    while stack:
        x = stack.pop()
        if holds_more(x, covered):
            return True
        stack += [c for c in x.children if isinstance(c, Node) and id(c) in between and id(c) not in skip]
    return False


def chosen(containers: list[Node], path: str) -> list[Node]:
    """The elements to extract at a path: all of them if articles or well named, otherwise the best one, those of its class, and prose."""
    at = [x for x in containers if x.score > 0 and path_of(x) == path]
    if not at:
        return []
    best = best_of(at)
    named = best.attributes.get("class", "")
    several = best.tag == "article" or POSITIVE.search(f"{named} {best.attributes.get('id', '')}")
    return [x for x in at if x is best or several or x.attributes.get("class", "") == named or prose(x)]


def completed(at: list[Node]) -> list[Node]:
    """The elements, or the outermost container around them that holds more article text. An article or main element is whole."""
    if any(x.tag in ("article", "main") for x in at):
        return at
    top = at[0]
    if len(at) > 1:
        common = {id(y) for y in above(at[0])}
        for x in at[1:]:
            common &= {id(y) for y in above(x)}
        top = next(y for y in above(at[0]) if id(y) in common)
        if uncovered(top, at):
            at = [top]
    below = top
    for y in () if top.tag in ("article", "main") else above(top):
        if holds_more(y, {id(below)}):
            at = [y]
        if y.tag in ("article", "main"):
            break
        below = y
    return at


def extracted(html: str, path: str | None) -> tuple[str, bool]:
    """The page's main text, by the host's path if that holds all article text of the page's own choice; and whether it did."""
    root = parsed(html)
    containers = measured(root)
    own = best_of(containers)
    if own is None:
        return text_of([root]), False
    mine = completed(chosen(containers, path_of(own)) or [own])
    if path and (at := chosen(containers, path)) and not any(uncovered(x, at) for x in mine):
        return text_of(at), True
    return text_of(mine), False


def above(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def host_of(url):
    """The host of a url, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_votes(pages: DataFrame) -> DataFrame:
    """host, path, score: the summed votes of all pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, score in votes(html):
                    sums[host, path] = sums.get((host, path), 0.0) + score
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([round(1e6 * sums[k]) for k in keys], pa.int64())], ["host", "path", "score"])

    return pages.filter("host != ''").select("host", "html").mapInArrow(run, "host string, path string, score long").groupBy("host", "path").agg(F.sum("score").alias("score"))


def winning_paths(voted: DataFrame) -> DataFrame:
    """host, path: the path with the most votes, the first by name of equals. Integer sums, so the order of pages doesn't matter."""
    return voted.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("less"), "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_host_path for each row of pages (page_id, url, html)."""
    small_arrow_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    paths = stored(winning_paths(host_votes(rows)), "paths")
    paths = F.broadcast(paths) if paths.count() <= BROADCAST_ROWS else paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [extracted(html, path) for html, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            texts = [t for t, _ in done]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([h for _, h in done], pa.bool_())], ["page_id", "url", "text", "n_chars", "by_host_path"])

    joined = rows.join(paths, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, by_host_path boolean")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
