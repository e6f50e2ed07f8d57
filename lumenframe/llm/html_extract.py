"""Main text of web pages by wrapper induction.

Pages of one host are mostly filled-in templates. Their DOM trees are aligned by simple tree matching and merged
into the host's wrapper, sibling by sibling; only items of a real list (neighbouring blocks of plain text, list
items, table cells) share a slot. A slot whose words are the same in different articles is template; one whose words
vary is content. The article of a page is the element that most of the varying text leads to: from the root, the
child that holds more than half of it is entered until a level has paragraphs of its own; on the way, headings and
blocks that the page's title repeats are kept. Names are features
only: an ``article`` or ``main`` element is where the varying text is looked for, and menus, headers, footers,
sidebars, notices, adverts, forms and reader comments that say so carry none.

Rules worth stating. One article can't tell template from content, so words count as constant when two articles
that share no passage have them; copies and near copies are one article. Within a list that varies, an item that
articles share is a passage and stays. Inside an ``article`` an element goes only if its kind, its role or one whole
class or id says that it isn't text; a part of a name (``share-price``) says so only outside, and never of a
paragraph or heading. Outside of ``article`` elements a block of nothing but links is a menu, one that begins with ©
a footer.

Every page of a host takes part. Each task merges its pages into a wrapper a host, these are merged by host and a
salt, then by host. A wrapper's siblings are bounded: beyond MOST_SIBLINGS, those of one kind share a slot.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import BROADCAST_BYTES
from .shared import materialise, mix, normal_words, windows, word_hashes

SALTS = 64
#: Rows of one host that share a copy of its wrapper where wrappers are too large to send everywhere.
ROWS_A_SALT = 5_000
#: Elements nested deeper than this stand beside each other instead, so that trees can be walked; none is dropped.
DEEPEST = 150
#: More children than this of one element are aligned by kind; lists whose product is larger than CELLS in one pass.
MOST_SIBLINGS, CELLS = 128, 40_000
#: Hash orders by which articles are told apart.
SKETCH = 12

#: Kinds of elements, and names that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NOISE = frozenset("nav footer aside form script style noscript iframe object template button select option textarea input svg canvas dialog menu head title".split())
NAMES = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion menu navbar navigation nav breadcrumb breadcrumbs sidebar footer masthead header cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social related recommended comment comments respond disqus widget toolbar pagination pager skip login signup".split())
HEADER = frozenset("header masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = frozenset("li dt dd option".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt figure figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(?P<raw>script|style|template|textarea|title|noscript|iframe|svg)(?=[\s/>])"
    r"(?:(?<=svg)(?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+(?<=/)>"  # only svg may close itself
    r"|[^<>]*>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|</?[A-Za-z][^<>]*\Z"  # a tag that the end of the page cuts off
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_ELEMENT = re.compile(r"<[^<>]*>")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


PERHAPS, SURE = 1, 2


class Node:
    """An element, or a stretch of running text (tag ``#text``) with inline markup taken out.

    noise says whether the element isn't text: SURE by its kind or a whole name, PERHAPS by a part of a name.
    plain counts the letters and digits of a text that are in no link; the root's text is the page's title. groups
    is filled in by ``parts``.
    """

    __slots__ = ("children", "groups", "label", "noise", "plain", "tag", "text")

    def __init__(self, tag: str, noise: int = 0):
        self.tag, self.noise = tag, noise
        self.label = tag if len(tag) <= 10 and "-" not in tag else "other"
        self.children: list[Node] = []
        self.text, self.plain = "", 0
        self.groups: list[tuple[list[Node], list]] | None = None


def _named(tag: str, attrs: str) -> int:
    """Whether element and names say that it isn't the article."""
    noise = SURE if tag in NOISE else 0
    if not attrs.strip():
        return noise
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            for name in value.split():
                if name.lower() in NAMES:
                    noise = max(noise, PERHAPS if name.lower() in HEADER else SURE)
                elif tag not in PROSE and not NAMES.isdisjoint(_PART.findall(_CAMEL.sub("-", name).lower())):
                    noise = max(noise, PERHAPS)
        elif key == "role":
            noise = SURE if value.lower() in ROLES else noise
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            noise = SURE
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            noise = SURE
    return noise


def parse(page: str) -> Node:
    """A tree of block elements over text nodes. Unclosed and misnested elements are mended as browsers roughly do."""
    root = Node("#root")
    stack, links = [root], 0
    held: list[tuple[str, bool]] = []
    left_out = 0  # spans open within one that isn't text

    def flush() -> None:
        if held:
            whole = " ".join("".join(t for t, _ in held).split())
            if whole:
                node = Node("#text")
                node.text = whole
                node.plain = sum(sum(map(str.isalnum, t)) for t, linked in held if not linked)
                stack[-1].children.append(node)
            held.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not left_out:
            held.append((html.unescape(page[at : m.start()]), links > 0))
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() == "title" and not root.text:
                root.text = " ".join(html.unescape(_ELEMENT.sub("", m[0])).split())
            if m["raw"].lower() == "textarea":
                held.append((" ", False))
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m["end"] else 1))
            if tag == "br":
                held.append((" ", False))
            if tag == "span":
                if left_out:
                    left_out = max(0, left_out + (-1 if m["end"] else 1))
                elif not m["end"] and m["attrs"].strip() and _named(tag, m["attrs"]) == SURE:
                    left_out = 1
            continue
        flush()
        links = left_out = 0
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "article", "body") and tag in ("p", "li"):
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in CLOSES_P:
                    break
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            mates, fence = {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}.get(tag, (("td", "th"), ("tr", "table")))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in mates:
                    del stack[i:]
                    break
                if stack[i].tag in fence:
                    break
        node = Node(tag, _named(tag, m["attrs"]))
        stack[-1].children.append(node)
        if tag not in VOID and not m["attrs"].rstrip().endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    if at < len(page) and not left_out:
        held.append((html.unescape(page[at:]), links > 0))
    flush()
    _pruned(root)
    return root


def _pruned(node: Node) -> bool:
    """Take out elements without text; whether any is left."""
    node.children = [c for c in node.children if c.tag == "#text" or _pruned(c)]
    return bool(node.children)


# --- wrappers -----------------------------------------------------------------------------------------------
#
# A slot is [label, whether some page has several, pages, articles, words, plain characters, children]. words is the
# digest of the slot's text, "" once it varies, None for elements that hold others. articles are sketches of at most
# two articles that the slot stands in and that share no passage.


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=9).hexdigest()


def is_leaf(node: Node) -> bool:
    return node.tag == "#text" or all(c.tag == "#text" for c in node.children)


def text_of(node: Node) -> str:
    return node.text if node.tag == "#text" else "\n".join(c.text for c in node.children)


def plain_of(node: Node) -> int:
    return node.plain if node.tag == "#text" else sum(map(plain_of, node.children))


def listed(node: Node) -> bool:
    """Whether neighbours of this kind are a list: plain blocks, list items, table rows of plain cells."""
    return is_leaf(node) or node.tag in ITEMS or node.tag == "tr" and all(map(is_leaf, node.children))


def grouped(nodes: list[Node]) -> list[list[Node]]:
    """Siblings, with neighbours together that are items of one list; beyond MOST_SIBLINGS, all of one kind."""
    out: list[list[Node]] = []
    for n in nodes:
        if out and (p := out[-1][-1]).label == n.label != "#text" and listed(n) and listed(p) and bool(n.noise) == bool(p.noise):
            out[-1].append(n)
        else:
            out.append([n])
    if len(out) > MOST_SIBLINGS:
        kinds: dict = {}
        for g in out:
            kinds.setdefault(g[0].label, []).extend(g)
        out = list(kinds.values())
    return out


def parts(node: Node, article: list) -> list[tuple[list[Node], list]]:
    """The groups of a node's children with their slots, made once."""
    if node.groups is None:
        node.groups = [(g, slot_of(g, article)) for g in grouped(node.children)]
    return node.groups


def slot_of(group: list[Node], article: list) -> list:
    """The slot that a group of one page's siblings makes."""
    label, many, plain = group[0].label, len(group) > 1, sum(map(plain_of, group))
    if all(map(is_leaf, group)):
        return [label, many, 1, [article], _digest("\n".join(map(text_of, group))), plain, []]
    children: list = []
    for n in group:
        own = [s for _, s in parts(n, article)]
        children = merged_children(children, own, same_page=True) if children else own
    return [label, many, 1, [article], None, plain, children]


def page_sketch(text: str) -> list[int]:
    """The least hash of the text's five-word runs in each of SKETCH orders; texts that share no passage share none."""
    x = windows(word_hashes(normal_words(text)), 5)
    if not len(x):
        return []
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    together = max(1, 40_000 // len(x))  # orders at once, so few that they stay in the processor's cache
    return [int(least) for i in range(0, SKETCH, together) for least in mix(x[None, :] ^ seeds[i : i + together, None]).min(axis=1) >> np.uint64(32)]


def differ(a: list[int], b: list[int]) -> bool:
    return len(a) != len(b) or bool(a) and not any(x == y for x, y in zip(a, b))


def count(a: list) -> int:
    """What a slot and its children add to a matching with themselves."""
    return 1 + bool(a[4]) + sum(map(count, a[6]))


def ends(xs: list, ys: list) -> tuple[int, int]:
    """How many siblings at the start and at the end of both lists are the same; a best alignment pairs these."""
    most = min(len(xs), len(ys))
    lead = 0
    while lead < most and same(xs[lead], ys[lead]):
        lead += 1
    tail = 0
    while tail < most - lead and same(xs[-1 - tail], ys[-1 - tail]):
        tail += 1
    return lead, tail


def same(a: list, b: list) -> bool:
    return a[0] == b[0] and a[4] == b[4] and len(a[6]) == len(b[6]) and all(map(same, a[6], b[6]))


def matching(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the nodes that the best order-keeping alignment pairs, and one more for each pair of equal words."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        own = 1 + (a[4] == b[4] and bool(a[4]))
        xs, ys = a[6], b[6]
        lead, tail = ends(xs, ys)
        own += sum(map(count, xs[:lead])) + sum(map(count, xs[len(xs) - tail :]))
        xs, ys = xs[lead : len(xs) - tail], ys[lead : len(ys) - tail]
        if len(xs) * len(ys) > CELLS:
            own += sum(matching(xs[i], ys[j], memo) for i, j in in_one_pass(xs, ys) if i is not None and j is not None)
        elif xs and ys:
            own += _table(xs, ys, memo)[-1][-1]
        memo[key] = own
    return memo[key]


def _table(xs: list, ys: list, memo: dict) -> list[list[int]]:
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = table[-1], [0]
        for j, y in enumerate(ys):
            w = matching(x, y, memo)
            row.append(max(row[-1], above[j + 1], above[j] + w if w else 0))
        table.append(row)
    return table


def in_one_pass(xs: list, ys: list) -> list[tuple[int | None, int | None]]:
    """An alignment that pairs each sibling with the next of its kind, for lists too long for a table."""
    at: dict = {}
    for j, y in enumerate(ys):
        at.setdefault(y[0], []).append(j)
    out, done = [], 0
    for i, x in enumerate(xs):
        own = at.get(x[0], [])
        k = bisect_left(own, done)
        if k < len(own):
            out += [(None, j) for j in range(done, own[k])] + [(i, own[k])]
            done = own[k] + 1
        else:
            out.append((i, None))
    return out + [(None, j) for j in range(done, len(ys))]


def aligned(xs: list, ys: list, memo: dict) -> list[tuple[int | None, int | None]]:
    """The pairs of a best alignment of two lists of siblings, unpaired ones with None, in order."""
    if [x[0] for x in xs] == [y[0] for y in ys] and len(set(x[0] for x in xs)) == len(xs):
        return [(i, i) for i in range(len(xs))]
    lead, tail = ends(xs, ys)
    core, other = xs[lead : len(xs) - tail], ys[lead : len(ys) - tail]
    if len(core) * len(other) > CELLS:
        out = in_one_pass(core, other)
    else:
        out, i, j = [], len(core), len(other)
        table = _table(core, other, memo) if i and j else None
        while i or j:
            if table is None:
                i, j = max(0, i - 1), max(0, j - 1)
                out.append((i, None) if core else (None, j))
            elif i and j and (w := matching(core[i - 1], other[j - 1], memo)) and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif j and table[i][j] == table[i][j - 1]:
                j -= 1
                out.append((None, j))
            else:
                i -= 1
                out.append((i, None))
        out.reverse()
    middle = [(None if p is None else p + lead, None if q is None else q + lead) for p, q in out]
    return [(i, i) for i in range(lead)] + middle + [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """Two slots of one kind as one; those of one page become a list."""
    if a[4] is None and b[4] is None:
        words = None
    elif same_page and a[4] is not None and b[4] is not None:
        words = _digest(f"{a[4]}{b[4]}")
    else:
        words = a[4] if a[4] == b[4] else ""
    articles = list(a[3])
    for s in b[3]:
        if len(articles) < 2 and all(differ(s, t) for t in articles):
            articles.append(s)
    return [a[0], a[1] or b[1] or same_page, a[2] + (0 if same_page else b[2]), articles, words, a[5] + b[5], merged_children(a[6], b[6], same_page)]


def merged_children(xs: list, ys: list, same_page: bool = False) -> list:
    out = [merged(xs[i], ys[j], same_page) if i is not None and j is not None else xs[i] if j is None else ys[j] for i, j in aligned(xs, ys, {})]
    if len(out) > MOST_SIBLINGS:
        kinds: dict = {}
        for s in out:
            kinds[s[0]] = merged(kinds[s[0]], s, same_page=True) if s[0] in kinds else s
        out = list(kinds.values())
    return out


def page_wrapper(page: str | None) -> list:
    """The wrapper of one page."""
    root = parse(page or "")
    article: list[int] = []  # the slots that find the article hold its sketch, which is put in once it is known
    article += page_sketch("\n".join(n.text for n in article_texts(root, None, article)))
    return slot_of([root], article)


def extract(page: str | None, wrapper: list | None) -> str:
    """The text of a page, given its host's wrapper."""
    return "\n".join(n.text for n in article_texts(parse(page or ""), wrapper))


def is_template(slot: list | None, own: list) -> bool:
    """Whether different articles have the same words in this slot."""
    return slot is not None and bool(slot[4]) and slot[4] == own[4] and len(slot[3]) > 1


def article_texts(root: Node, wrapper: list | None, article: list | None = None) -> list[Node]:
    """The text nodes of a page's article that aren't template in its host's wrapper; its slots are made with article."""
    sketch = [] if article is None else article
    slots: dict[int, tuple[list, list | None]] = {}  # of each element: its own slot and the wrapper's

    def place(node: Node, slot: list | None) -> None:
        groups = parts(node, sketch)
        pairs: list = [None] * len(groups)
        if slot is not None and slot[6]:
            for i, j in aligned([own for _, own in groups], slot[6], {}):
                if i is not None and j is not None:
                    pairs[i] = slot[6][j]
        for (group, own), pair in zip(groups, pairs):
            for n in group:
                slots[id(n)] = (own, pair)
                if n.children:
                    place(n, pair if not is_leaf(n) or pair is None or pair[6] else None)

    place(root, wrapper)
    masses: dict[int, float] = {}

    def mass(node: Node) -> float:
        """Varying text below the node, as its host's pages have it on average."""
        own, slot = slots[id(node)]
        if node.noise or node.tag == "header":
            masses[id(node)] = 0.0
        elif own[4] is not None:
            alone = plain_of(node)
            share = alone / own[5] if own[5] else 0.0
            masses[id(node)] = 0.0 if is_template(slot, own) else alone if slot is None else share * slot[5] / slot[2]
        else:
            masses[id(node)] = sum(map(mass, node.children))
        return masses[id(node)]

    out: list[Node] = []

    def template(node: Node) -> bool:
        own, slot = slots[id(node)]
        return own[4] is not None and is_template(slot, own)

    def titled(text: str) -> bool:
        """Whether the page's title and the text begin alike, up to the end of one of them."""
        n = min(len(root.text), len(text))
        return n > 0 and text[:n] == root.text[:n]

    def take(node: Node, article: bool) -> None:
        """The text of a node that is in the region."""
        for c in node.children:
            if c.noise == SURE or not article and (c.noise or c.tag == "header") or template(c):
                continue
            if not article and is_leaf(c) and text_of(c).startswith("©"):
                continue
            if is_leaf(c):
                if article or plain_of(c):
                    out.extend([c] if c.tag == "#text" else c.children)
            else:
                take(c, article or c.tag in ("article", "main"))

    def descend(node: Node) -> None:
        """Into the child that holds most of the varying text, up to the level that has paragraphs of its own."""
        kept = [c for c in node.children if masses[id(c)] > 0]
        paragraphs = any(listed(c) and (c.tag in ("#text", "p", "tr", "td") or c.tag in ITEMS or slots[id(c)][0][1]) for c in kept)
        best = max(kept, key=lambda c: masses[id(c)], default=None)
        if best is None or paragraphs or is_leaf(best) or 2 * masses[id(best)] <= sum(masses[id(c)] for c in kept):
            return take(node, False)
        for c in node.children:
            if c is best:
                descend(c)
            elif not c.noise and is_leaf(c) and not template(c) and (c.tag in ("h1", "h2") or titled(text_of(c))):
                out.extend([c] if c.tag == "#text" else c.children)

    articles = list(_articles(root))
    if articles:
        for a in articles:
            take(a, True)
    else:
        for c in root.children:
            mass(c)
        descend(root)
    return out


def _articles(node: Node):
    """The outermost article and main elements."""
    for c in node.children:
        if c.tag in ("article", "main") and c.noise != SURE:
            yield c
        else:
            yield from _articles(c)


def host_of(url):
    """The host of a url column, lower case, without port or user; empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:[0-9]*$", ""))


def induced(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of pages (host, html)."""

    def batch_of(items):
        columns = [[k[0] for k, _ in items], [k[1] for k, _ in items], [json.dumps(w) for _, w in items]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["host", "salt", "wrapper"])

    def first(batches):
        held: dict = {}
        for batch in batches:
            hosts, salts = batch.column("host").to_pylist(), batch.column("salt").to_pylist()
            for i, page in enumerate(batch.column("html")):
                key, own = (hosts[i], salts[i]), page_wrapper(page.as_py())
                held[key] = merged(held[key], own) if key in held else own
                if len(held) > 2000:  # bounds memory; the rest of these hosts is merged later
                    yield batch_of(list(held.items()))
                    held.clear()
        yield batch_of(list(held.items()))

    def later(batches):
        key, whole = None, None  # rows come sorted by key
        for batch in batches:
            done = []
            for at, text in zip(zip(batch.column("host").to_pylist(), batch.column("salt").to_pylist()), batch.column("wrapper").to_pylist()):
                own = json.loads(text)
                if at == key:
                    whole = merged(whole, own)
                else:
                    done += [(key, whole)] if key else []
                    key, whole = at, own
            yield batch_of(done)
        if key:
            yield batch_of([(key, whole)])

    kinds = "host string, salt int, wrapper string"
    parts = pages.select("host", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "html").mapInArrow(first, kinds)
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(later, kinds)
    whole = parts.select("host", F.lit(0).alias("salt"), "wrapper").repartition("host").sortWithinPartitions("host").mapInArrow(later, kinds)
    return whole.select("host", "wrapper")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The main text of every row: (id_col, url_col, text, n_chars).

    White space inside a block is one space, blocks are joined by one line feed. A null page is empty and gives an
    empty text, as does a page without an article's text; pages with a null url are one host. Ids aren't used, so
    nulls and repeats in them don't matter; other columns are not read; an empty table gives an empty result.

    Wrappers are never put on the rows of pages: up to ``broadcast_bytes`` of them go to every worker once; beyond
    that, rows are dealt out by host and salt, and each such group begins with its host's wrapper.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    wrappers = materialise(induced(rows), "wrappers")
    schema = f"id {kind['id']}, url {kind['url']}, text string, n_chars long"

    def result(batch, texts, keep=None):
        ids, urls = (batch.column(c) if keep is None else batch.column(c).take(keep) for c in ("id", "url"))
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    if (wrappers.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0) <= broadcast_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.toLocalIterator()})

        def run(batches):
            known: dict = {}
            for batch in batches:
                texts = []
                for page, host in zip(batch.column("html"), batch.column("host").to_pylist(), strict=True):
                    if host not in known:
                        known[host] = json.loads(sent.value[host])
                    texts.append(extract(page.as_py(), known[host]))
                yield result(batch, texts)

        out = rows.mapInArrow(run, schema)
    else:
        salts = rows.groupBy("host").agg(F.ceil(F.count("*") / ROWS_A_SALT).cast("int").alias("salts"))
        sizes = materialise(salts, "salts")
        copies = wrappers.join(sizes, "host").select(F.lit(None).cast(kind["id"]).alias("id"), F.lit(None).cast(kind["url"]).alias("url"), "host", F.lit(None).cast("string").alias("html"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), "wrapper")
        dealt = rows.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.col("salts")).cast("int")).drop("salts").withColumn("wrapper", F.lit(None).cast("string"))
        together = dealt.unionByName(copies).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull())

        def run_dealt(batches):
            wrapper = None
            for batch in batches:
                texts, keep = [], []
                for i, (page, own) in enumerate(zip(batch.column("html"), batch.column("wrapper"), strict=True)):
                    if own.is_valid:
                        wrapper = json.loads(own.as_py())
                    else:
                        keep.append(i)
                        texts.append(extract(page.as_py(), wrapper))
                yield result(batch, texts, pa.array(keep, pa.int64()))

        out = together.select("id", "url", "html", "wrapper").mapInArrow(run_dealt, schema)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
