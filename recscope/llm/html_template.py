"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from few templates. A page is read as tokens: container elements, each told apart by the path of
containers around it (with the first class word or the id, and the place among its like), and blocks of text, by their container.
Over all pages of a host, however many, containers with equal occurrence vectors (the pages that have them) under one parent form
an equivalence class. A class is valid if it is on two pages at least, keeps one order wherever it occurs, and nests: the
element around it is of a valid class too. The valid classes are the template; what lies in their elements is in slots.

A slot's weight is its text on a page, on average, that is not the same wherever the slot is, times the logarithm of the
number of different texts: text that all pages share counts nothing, a long notice in two versions little. A block counts by its words outside of
links, short blocks and list items less than sentences (``worth``). The main text is reached from the root of a page: as
long as one child of a valid class has more than half of the weight, it is entered, unless it is one of several of its kind: siblings
of one class word, or plain ones on different pages or of comparable weight, are one repeated slot, and their parent is the element reached. Within that, containers on
just its pages whose texts never vary are boilerplate, table cells beside ones that vary and parts of an article element excepted; all other blocks are the text, after the nearest heading of first level
before it if it has none itself.

Markup only helps. What an element's name, a hidden attribute or a whole class word says (``nav``, ``ad``, ``ad-box``) is set aside and no token.
A word within a longer class word (``site-menu``, but ``market-share`` too) sets aside only what is neither in an article or main element nor in the
element that the template reached. Lists of links outside of articles are left out. Where the template does not decide (no slot of
the host varies, as with one page or copies of one, or the element reached has an article or main element within) the largest
article or main element is the text, or else the body, or a container in it beside which no sentence stands. ``by_template`` says whether the template decided. ``markup=False``
switches all of that off.

How it is spread: pages become distinct skeletons (lists of containers) and distinct blocks with counts, within tasks first; vectors,
order and weights are aggregates over these; a decision belongs to a (host, skeleton). Decisions are broadcast while
there are at most ``DECISIONS`` container numbers in them, and joined beyond that. No group holds a host's pages.

Defined results: null and empty html give an empty text, a null url counts as the empty host. Rows are kept one by one, repeated ones
too. Ties in weight mean that no child has more than half. The result has the id, the url, ``text`` and ``by_template``; other
columns are not read. Memory is bounded by one page: a few times its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.llm.common import remembered, stored

#: Numbers in the decisions that are broadcast, at most (some 40 MB in a worker).
DECISIONS = 400_000
#: Distinct blocks that a task counts before it sends them on.
COUNTED = 100_000
#: Containers nested more deeply count as part of the one around them.
DEPTH = 64
#: Words from which on a block counts in full.
SENTENCE = 20

# Fixed names of HTML.
CONTAINERS = frozenset("article aside body center details dialog div fieldset figure footer form header html main menu nav section table tbody td tfoot th thead tr".split())
BLOCKS = CONTAINERS | frozenset("address blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 hr legend li ol p pre summary ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button menu dialog".split())
CELLS = frozenset("tr td th thead tbody tfoot".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table div section article main body dl".split())
#: Words of class, id and role that name what is not the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "comment comments commentlist respond reply replies disqus sidebar aside menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations footer toolbar pagination pager widget widgets "
    "copyright login search skip contentinfo complementary hidden".split()
)
HEADERS = frozenset("header masthead topbar".split())
#: Words that, after one of these, leave its meaning.
PLACES = frozenset("area bar block box button buttons container content form group inner item items links list left right top bottom main section slot unit widget wrap wrapper post posts banner notice message overlay policy consent thread links icons".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[/!?]?[a-zA-Z!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Block:
    """A run of text between block elements: its container, the main elements that it is in, whether it is a heading of first
    level or in a list item, and whether a part of a class word would set it aside."""

    home: int
    inside: tuple[int, ...]
    heading: bool
    item: bool
    doubtful: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def worth(self, text: str) -> int:
        """How much the block speaks for its container: its words outside of links, in hundredths; short blocks by the square of their length."""
        if self.doubtful:
            return 0
        n = max(text.count(" ") + 1 - self.linked, 0)
        own = 100 * n * min(n, SENTENCE) ** 2 // SENTENCE**2
        return own // 3 if self.item else own + 100 * SENTENCE if self.heading else own


@dataclass(slots=True)
class Page:
    """Paths of containers in page order (0: the root), their parents' numbers and depths, blocks, and names of main elements."""

    paths: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])
    blocks: list[Block] = field(default_factory=list)
    mains: list[str] = field(default_factory=list)

    def skeleton(self) -> str:
        return "\n".join(self.paths)


def number(text: str) -> int:
    """A text's 64-bit number, as Spark's own xxhash64 has it."""
    k = xxhash.xxh64_intdigest(text, 42)
    return k - (1 << 64) if k >> 63 else k


def _set_aside(name: str, attributes: str, in_article: bool) -> int:
    """2: what the element has is no part of an article; 1: so it seems from a part of a class word; 0: neither."""
    if name in DROPPED or (name == "header" and not in_article):
        return 2
    out = 0
    for kind, *values in NAMED.findall(attributes) if attributes else ():
        value, kind = "".join(values), kind.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return 2
        if kind not in ("class", "id", "role"):
            continue
        for whole in value.split():
            words = [w.lower() for w in PARTS.split(whole) if w]
            if name == "article":
                if {"comment", "comments", "reply", "related", "sidebar"}.intersection(words):
                    return 2
            elif name not in ("html", "body", "main"):
                if words and words[0] in ASIDE and all(w in ASIDE or w in PLACES for w in words[1:]):
                    return 2
                if not in_article and words and words[0] in HEADERS:
                    return 2
                if not in_article and (ASIDE.intersection(words) or HEADERS.intersection(words)):
                    out = 1
    return out


def _label(name: str, attributes: str) -> str:
    """An element's name with the first word of its class, or else its id, digits left out."""
    if attributes and attributes.strip(" /"):
        found = {kind.lower(): "".join(values) for kind, *values in NAMED.findall(attributes)}
        for kind in ("class", "id"):
            if words := found.get(kind, "").split():
                return f"{name}.{DIGITS.sub('', words[0])}".replace("/", "")
    return name


def read(html: str, markup: bool = True) -> Page:
    """A page's containers and blocks; what ``markup`` sets aside is in neither."""
    page = Page()
    likes: Counter = Counter()
    # Open elements: name, container, set aside, main elements, in a link, in a list item, in a heading, the number of its scope.
    stack: list[tuple] = [("", 0, 0, (), False, False, False, 0)]
    scopes = 0
    opened: Counter = Counter()  # open elements by name, and by scope and name

    def closed_from(k: int) -> None:
        for e in stack[k:]:
            opened[e[0]] -= 1
            opened[e[7], e[0]] -= 1
        del stack[k:]

    block: Block | None = None
    at = 0
    for m in TOKEN.finditer(html):
        begin = m.start()
        if begin > at:
            block = _text(html[at:begin], block, page.blocks, stack[-1])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block = None
        elif name == "br" and block is not None:
            block.parts.append(" ")
        if m[2]:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                closed_from(k)
            continue
        if name in VOID:
            continue
        if name in CLOSES and any(opened[stack[-1][7], c] for c in CLOSES[name]):
            k = len(stack) - 1
            while stack[k][0] not in CLOSES[name]:
                k -= 1
            closed_from(k)
        _, home, dropped, inside, linked, item, heading, scope = stack[-1]
        attributes = m[4]
        if markup and dropped < 2:
            dropped = max(dropped, _set_aside(name, attributes, bool(inside)))
            if dropped < 2 and (name in ("article", "main") or (attributes and re.search(r"""role\s*=\s*["']?main""", attributes, re.I))):
                page.mains.append(name)
                inside = (*inside, len(page.mains) - 1)
                dropped = 0
        if name in CONTAINERS and dropped < 2 and page.depths[home] < DEPTH:
            page.depths.append(page.depths[home] + 1)
            path = f"{page.paths[home]}/{_label(name, attributes)}"
            likes[path] += 1
            page.parents.append(home)
            page.paths.append(f"{path}:{likes[path]}")
            home = len(page.paths) - 1
        if name in SCOPES:
            scopes += 1
            scope = scopes
        opened[name] += 1
        opened[scope, name] += 1
        stack.append((name, home, dropped, inside, linked or name == "a", item or name == "li", heading or name == "h1", scope))
    if at < len(html):
        _text(html[at:], block, page.blocks, stack[-1])
    return page


def _text(raw: str, block: Block | None, blocks: list[Block], top: tuple) -> Block | None:
    """Add a run of text to the open block, which begins with the first character that isn't white space."""
    _, home, dropped, inside, linked, item, heading, _ = top
    if dropped > 1 or raw.isspace():
        if block is not None:
            block.parts.append(" ")
        return block
    text = unescape(raw) if "&" in raw else raw
    if text.isspace():
        if block is not None:
            block.parts.append(text)
        return block
    if block is None:
        blocks.append(block := Block(home, inside, heading, item, dropped > 0))
    if linked:
        block.linked += len(text.split())
    block.parts.append(text)
    return block


def observed(page: Page) -> dict[tuple[int, int], int]:
    """(container's number, block's number) -> worth, for each different block of a page."""
    numbers = [number(p) for p in page.paths]
    out = {}
    for b in page.blocks:
        text = b.text()
        out[numbers[b.home], number(text)] = b.worth(text)
    return out


def decide(containers: list[dict]) -> tuple[int, list[int]] | None:
    """The number of the element that has the main text, and of boilerplate containers within it, for one skeleton.

    ``containers``: path, support, class, ordered (whether its class keeps one order), words (on all pages, in texts that vary) and
    texts (different ones), of every container but the root, in any order. None: the template does not decide.
    """
    by_path = {c["path"]: c for c in containers}
    children: dict[str, list[str]] = {}
    for path in sorted(by_path):
        children.setdefault(path.rpartition("/")[0], []).append(path)
    weight: dict[str, float] = {p: c["words"] / c["support"] * math.log2(1 + c["texts"]) for p, c in by_path.items()}
    for path in sorted(by_path, key=lambda p: -p.count("/")):
        above = path.rpartition("/")[0]
        if above in weight:
            weight[above] += weight[path]
    now, whole = "", sum(weight[p] for p in children.get("", []))
    while whole > 0:
        best = max(children.get(now, []), key=lambda p: weight[p], default=None)
        if best is None or 2 * weight[best] <= whole or by_path[best]["support"] < 2 or not by_path[best]["ordered"] or _repeated(best, children[now], weight, by_path):
            break
        now, whole = best, weight[best]
    if not now:
        return None
    own = by_path[now]["class"]
    beside = lambda p: _label_of(p).partition(".")[0] in CELLS and weight.get(p.rpartition("/")[0], 0) > 0
    dull = [p for p in by_path if p.startswith(now + "/") and by_path[p]["class"] == own and by_path[p]["ordered"] and not weight[p] and not beside(p)]
    return number(now), [number(p) for p in sorted(dull)]


def _label_of(path: str) -> str:
    return path.rpartition("/")[2].rpartition(":")[0]


def _repeated(best: str, siblings: list[str], weight: dict[str, float], facts: dict[str, dict] | None = None) -> bool:
    """Whether another sibling is of the same kind: of one class word, or plain and on other pages or of comparable weight."""
    label = _label_of(best)
    like = [p for p in siblings if p != best and weight[p] > 0 and _label_of(p) == label]
    return any("." in label or (facts is not None and facts[p]["support"] != facts[best]["support"]) or 4 * weight[p] >= weight[best] for p in like)


def _alone(page: Page) -> list[Block]:
    """Of a page that neither a template nor markup decides: the blocks of the innermost container beside which there is no sentence."""
    weight: Counter = Counter()
    children: dict[str, list[str]] = {}
    for path in page.paths[1:]:
        children.setdefault(path.rpartition("/")[0], []).append(path)
    worth = [(page.paths[b.home], b, b.worth(b.text())) for b in page.blocks]
    for path, _, n in worth:
        while path:
            weight[path] += n
            path = path.rpartition("/")[0]
    sentence = lambda b: not b.heading and not b.item and b.text().count(" ") + 1 - b.linked >= SENTENCE
    now, kept = "", page.blocks
    while True:
        best = max(children.get(now, []), key=lambda p: weight[p], default=None)
        if best is None or not weight[best] or _repeated(best, children[now], weight):
            break
        inner = [b for path, b, _ in worth if path == best or path.startswith(best + "/")]
        held = set(map(id, inner))
        if not any(map(sentence, inner)) or any(sentence(b) for b in kept if id(b) not in held):
            break
        now, kept = best, inner
    head = next((k for k, b in enumerate(page.blocks) if kept and b is kept[0]), 0)
    if now and not any(b.heading for b in kept):
        kept = [b for b in page.blocks[:head] if b.heading][-1:] + kept
    return kept


def main_text(page: Page, decision: tuple[int, list[int]] | None, markup: bool = True) -> str:
    """The article's blocks, joined by empty lines."""
    blocks = page.blocks
    if decision is not None:
        region, dull = decision
        numbers = [number(p) for p in page.paths]
        within, bare = [False] * len(numbers), [False] * len(numbers)
        for k, n in enumerate(numbers):
            up = page.parents[k]
            within[k] = n == region or (k > 0 and within[up])
            bare[k] = n in dull or (k > 0 and bare[up])
        first = next((k for k, b in enumerate(blocks) if within[b.home]), 0)
        blocks = [b for b in blocks if within[b.home] and (not bare[b.home] or (markup and b.inside))]
        if blocks and not any(b.heading for b in blocks):
            blocks = [b for b in page.blocks[:first] if b.heading][-1:] + blocks
    if markup:
        if decision is None:
            blocks = [b for b in blocks if b.inside or not b.doubtful]
            if not page.mains:
                blocks = [b for b in _alone(page) if not b.doubtful]
        blocks = _best_main(page, blocks)
    out = []
    for b in blocks:
        text = b.text()
        if markup and not b.inside and 2 * b.linked > text.count(" ") + 1 and (b.item or decision is None):
            continue
        out.append(text)
    return "\n\n".join(t for t in out if t)


def _best_main(page: Page, blocks: list[Block]) -> list[Block]:
    """Blocks in the largest article (or main) element that doesn't hold all of them."""
    shared = set(blocks[0].inside).intersection(*(b.inside for b in blocks)) if blocks else set()
    size: Counter = Counter()
    for b in blocks:
        for k in b.inside:
            if k not in shared:
                size[k] += b.text().count(" ") + 1
    articles = [k for k in size if page.mains[k] == "article"] or list(size)
    best = max(articles, key=lambda k: (size[k], -k), default=None)
    if best is None:
        return blocks
    head = next((k for k, b in enumerate(blocks) if best in b.inside), 0)
    inner = [b for b in blocks if best in b.inside]
    if shared and not any(b.heading for b in inner):
        inner = [b for b in blocks[:head] if b.heading][-1:] + inner
    return inner


def extract(htmls: list[str], markup: bool = True) -> list[str]:
    """Main texts of pages of one host: the deduction of ``main_texts`` on one machine."""
    pages = [read(h, markup) for h in htmls]
    skeletons, blocks = Counter(p.skeleton() for p in pages), Counter()
    words: dict[tuple[int, int], int] = {}
    for p in pages:
        words |= (own := observed(p))
        blocks.update(own.keys())
    on: dict[str, set[str]] = {}
    for s in skeletons:
        for path in s.split("\n")[1:]:
            on.setdefault(path, set()).add(s)
    support = {p: sum(skeletons[s] for s in found) for p, found in on.items()}
    varied, texts = Counter(), Counter()
    by_number = {number(p): p for p in on}
    for (home, text), n in blocks.items():
        if home in by_number and n < support[by_number[home]]:
            varied[by_number[home]] += n * words[home, text]
            texts[by_number[home]] += 1
    ranks: dict[str, set[int]] = {p: set() for p in on}
    for s in skeletons:
        seen: Counter = Counter()
        for path in s.split("\n")[1:]:
            group = frozenset(on[path]), path.rpartition("/")[0]
            ranks[path].add(seen[group])
            seen[group] += 1
    made = {s: decide([{"path": p, "support": support[p], "class": hash(frozenset(on[p])), "ordered": len(ranks[p]) == 1, "words": varied[p], "texts": texts[p]} for p in s.split("\n")[1:]]) for s in skeletons}
    return [main_text(p, made[p.skeleton()], markup) for p in pages]


def _counted(markup: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeletons (with ``paths``) and blocks of pages, counted within the task first."""
    remembered("html")  # nothing is kept
    skeletons: dict[tuple[int, int], list] = {}
    blocks: dict[tuple[int, int, int], list] = {}

    def sent() -> pa.RecordBatch:
        rows = [(site, None, skeleton, n, 0, paths) for (site, skeleton), (n, paths) in skeletons.items()]
        rows += [(*key, n, words, None) for key, (n, words) in blocks.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["site", "home", "what", "n", "words", "paths"])

    for batch in batches:
        for site, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = read(html.as_py(), markup)
            paths = page.skeleton()
            skeletons.setdefault((site, number(paths)), [0, paths])[0] += 1
            for (home, text), words in observed(page).items():
                blocks.setdefault((site, home, text), [0, words])[0] += 1
            if len(blocks) > COUNTED:
                yield sent()
                skeletons.clear()
                blocks.clear()
    yield sent()


def _decided(found: pa.Array) -> pa.Array:
    kind = pa.struct([("region", pa.int64()), ("dull", pa.list_(pa.int64()))])
    made = (decide(x.as_py()) for x in found)
    return pa.array([{"region": d[0], "dull": d[1]} if d else None for d in made], kind)


def decisions(pages: DataFrame, markup: bool = True) -> DataFrame:
    """(site, skeleton, region, dull) of ``pages`` (site, html): what ``decide`` says of each skeleton of a site, where it decides."""
    counted = stored(pages.select("site", "html").mapInArrow(partial(_counted, markup), "site long, home long, what long, n long, words long, paths string"), "pages")
    skeletons = counted.where("paths IS NOT NULL").groupBy("site", F.col("what").alias("skeleton"), "paths").agg(F.sum("n").alias("n"))
    skeletons = stored(skeletons, "skeletons")
    paths = F.split("paths", "\n")
    each = skeletons.select("site", "skeleton", "n", F.posexplode(paths).alias("at", "path")).where("at > 0")
    hashed = F.xxhash64("skeleton")
    vector = F.struct(F.sum(F.shiftrightunsigned(hashed, 32)).alias("a"), F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"))
    containers = each.groupBy("site", "path").agg(F.sum("n").alias("support"), F.xxhash64(vector).alias("class"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    ranked = Window.partitionBy("site", "skeleton", "class", parent).orderBy("at")
    classed = each.join(containers, ["site", "path"]).withColumn("rank", F.row_number().over(ranked))
    ordered = classed.groupBy("site", "path").agg((F.min("rank") == F.max("rank")).alias("ordered"))
    # Words of blocks that are on fewer pages than their container.
    blocks = counted.where("home IS NOT NULL").groupBy("site", "home", "what").agg(F.sum("n").alias("n"), F.max("words").alias("words")).groupBy("site", "home", "n").agg(F.sum(F.col("n") * F.col("words")).alias("words"), F.count("*").alias("texts"))
    known = containers.withColumn("home", F.xxhash64("path"))
    varied = known.join(blocks, ["site", "home"]).where("n < support").groupBy("site", "path").agg(F.sum("words").alias("words"), F.sum("texts").alias("texts"))
    facts = containers.join(ordered, ["site", "path"]).join(varied, ["site", "path"], "left").select("site", "path", "support", "class", "ordered", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("texts", F.lit(0)).alias("texts"))
    # A group is one page's containers.
    gathered = each.join(facts, ["site", "path"]).groupBy("site", "skeleton").agg(F.collect_list(F.struct("path", "support", "class", "ordered", "words", "texts")).alias("found"))
    decided = F.arrow_udf(_decided, "struct<region:bigint,dull:array<bigint>>")("found")
    return stored(gathered.select("site", "skeleton", decided.alias("d")).where("d IS NOT NULL").select("site", "skeleton", "d.region", "d.dull"), "decisions")


def main_texts(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", markup: bool = True) -> DataFrame:
    """(id_col, url, text, by_template) for each row of ``df``: the main text of ``html``."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    sited = rows.withColumn("site", F.xxhash64(host))
    made = decisions(sited, markup)
    result = "struct<text:string,by_template:boolean>"
    kind = pa.struct([("text", pa.string()), ("by_template", pa.bool_())])
    size = made.agg(F.coalesce(F.sum(F.size("dull") + 3), F.lit(0))).first()[0]
    if size <= DECISIONS:
        shared = df.sparkSession.sparkContext.broadcast({(r["site"], r["skeleton"]): (r["region"], r["dull"]) for r in made.toArrow().to_pylist()})

        @F.arrow_udf(result)
        def extracted(sites: pa.Array, htmls: pa.Array) -> pa.Array:
            out = []
            for site, html in zip(sites.to_pylist(), htmls, strict=True):
                page = read(html.as_py(), markup)
                decision = shared.value.get((site, number(page.skeleton())))
                out.append({"text": main_text(page, decision, markup), "by_template": decision is not None})
            return pa.array(out, kind)

        found = sited.select("id", "url", extracted("site", "html").alias("x"))
    else:

        @F.arrow_udf("bigint")
        def skeleton(htmls: pa.Array) -> pa.Array:
            return pa.array([number(read(h.as_py(), markup).skeleton()) for h in htmls], pa.int64())

        @F.arrow_udf(result)
        def extracted_by(htmls: pa.Array, regions: pa.Array, dulls: pa.Array) -> pa.Array:
            out = []
            for html, region, dull in zip(htmls, regions.to_pylist(), dulls.to_pylist(), strict=True):
                decision = None if region is None else (region, dull)
                out.append({"text": main_text(read(html.as_py(), markup), decision, markup), "by_template": decision is not None})
            return pa.array(out, kind)

        joined = sited.withColumn("skeleton", skeleton("html")).join(made, ["site", "skeleton"], "left")
        found = joined.select("id", "url", extracted_by("html", "region", "dull").alias("x"))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url), "x.text", "x.by_template")
