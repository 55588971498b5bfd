"""Operator 2: HTML main-text extraction by wrapper induction.

Pages of one host are dealt into groups of about ``GROUP`` by a hash of their id (so a large host is many
tasks). In a group, the DOM trees of all pages are aligned with those of up to ``REFS`` reference pages by
simple tree matching. A text node whose aligned nodes hold the same text in most of the other pages is
template; a node that varies is a content slot. Copies of a page (``COPY`` of its text occurs in one
earlier page) are no evidence, so repeated articles do not become template.

The wrapper decides twice. A block of nothing but template text is no content: outside article elements from
``LEAST`` pages on, inside them from ``INSIDE`` pages on, since a few articles may share a line by chance. And where no article
or main element says where the content is, it is the lowest element that holds most of the slot text.
Slots that markup names as navigation, page header or footer, side bar, form, advert, notice or reader
comment are not content either: their text varies from page to page, so alignment cannot tell them.
Of several article elements those that only lead elsewhere (headed by a link, or mostly links) are left out.

Trees of any depth and width: nothing recurses. Lists of children with more than ``CELLS`` pairs, and
pages that need more than ``BUDGET``, are aligned by equal subtrees in order and not by the full grid; that may leave a
constant node unmarked, but it drops no text.

Text: references decoded, white space in a block becomes one space, blocks joined by one space in page
order. Null or empty html gives an empty text; pages with a null url or id form groups like others;
repeated rows give a row each.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

GROUP, REFS, SHARE, LEAST, INSIDE, REGION, COPY, FRAME = 16, 2, 0.8, 3, 6, 0.75, 0.7, 200
CELLS, BUDGET = 40_000, 1_000_000
# fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
PARAGRAPHS = frozenset("p blockquote pre ul ol table figure".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form button select option optgroup input textarea script style noscript template svg math canvas object embed iframe audio video map dialog menu search datalist title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense adslot dfp sponsor "
    "sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription paywall "
    "signup login social share sharing shares related recommended recommendations recirc teaser teasers comment comments commentlist respond disqus reply replies widget widgets "
    "pagination pager toolbar skip search hidden tracking".split()
)
# fixed values: words that say only where or what kind of box an element is
BOXES = frozenset(
    "a area articles bar block bottom box button buttons card cards center col column container content div embed feed form foot frame global grid group head header heading holder home icons inner "
    "item items js left link links list local main middle module more outer page panel parent placement post posts primary region right row secondary section side site slot small "
    "stories sub text thread title top unit up us user view wrap wrapper zone".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "kids", "text", "shape", "fixed", "holds", "frame", "prose", "paragraphs", "weight", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.text = tag, attrs, [], ""
        self.shape, self.fixed, self.holds, self.frame, self.weight, self.linked = -1, 0, False, False, 0, 0

    def attr(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if self.attrs else {}


def parse(source: str) -> Node:
    """A tolerant DOM: text is a node with tag '#'."""
    root = Node("#root")
    stack = [root]
    open_: Counter = Counter()  # by tag, so that nothing is looked for in vain
    at, n = 0, len(source)

    def close(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            break
        at = m.end()
        token, tag = m[0], m[1]
        if tag is None:
            if token[0] != "<" or token == "<":
                text = Node("#")
                text.text = token
                stack[-1].kids.append(text)
            elif token.startswith("<![CDATA["):
                text = Node("#")
                text.text = html.escape(token[9:-3])
                stack[-1].kids.append(text)
            continue
        tag = tag.lower()
        if token[1] == "/":
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if tag in ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option", "body"):
            mine = ("p",) if tag in ENDS_P else {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "body": ("head",)}.get(tag, (tag,))
            for k in range(len(stack) - 1, 0, -1) if any(open_[t] for t in mine) else ():
                t = stack[k].tag
                if t in mine:
                    close(k)
                    break
                if t not in INLINE and t != "p":
                    break
        node = Node(tag, m[2] or "")
        stack[-1].kids.append(node)
        if tag in VOID or token.endswith("/>") and tag in ("svg", "path", "g"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            text = Node("#")
            text.text = source[at : end.start() if end else n]
            node.kids.append(text)
            at = end.end() if end else n
            continue
        stack.append(node)
        open_[tag] += 1
    return root


# ---------------------------------------------------------------- simple tree matching


def in_order(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Equal shapes in both lists, matched by occurrence and kept where they keep the order."""
    where: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    for j, shape in enumerate(y):
        where[shape, seen[shape]] = j
        seen[shape] += 1
    seen.clear()
    ends: list[int] = []  # of the longest rising run of each length: last place in y, its pair, and the pair before
    tops: list[int] = []
    pairs: list[tuple[int, int, int]] = []
    for i, shape in enumerate(x):
        j = where.get((shape, seen[shape]))
        seen[shape] += 1
        if j is None:
            continue
        k = bisect_left(ends, j)
        pairs.append((i, j, tops[k - 1] if k else -1))
        ends[k : k + 1] = [j]
        tops[k : k + 1] = [len(pairs) - 1]
    out, at = [], tops[-1] if tops else -1
    while at >= 0:
        i, j, at = pairs[at]
        out.append((i, j))
    return out[::-1]


class Matcher:
    """Largest matching of two trees that keeps order and levels; scores are kept by shape."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.tree: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.left = BUDGET

    def shape(self, root: Node) -> None:
        """Number equal shapes (tags of the whole subtree) alike, bottom up."""
        todo = [(root, False)]
        while todo:
            node, done = todo.pop()
            if done:
                key = (node.tag, tuple(k.shape for k in node.kids))
                node.shape = self.shapes.setdefault(key, len(self.tree))
                if node.shape == len(self.tree):
                    self.tree.append(key)
                    self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
            else:
                todo.append((node, True))
                todo += [(k, False) for k in node.kids]

    def known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        return 0 if self.tree[a][0] != self.tree[b][0] else self.scores.get((a, b) if a < b else (b, a))

    def score(self, a: int, b: int) -> int:
        """The number of nodes in a largest matching of two shapes."""
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            if self.known(a, b) is None:
                x, y = self.tree[a][1], self.tree[b][1]
                head, tail = self.trimmed(x, y)
                score = 1 + sum(self.sizes[k] for k in (*x[:head], *x[len(x) - tail :]))
                x, y = x[head : len(x) - tail], y[head : len(y) - tail]
                if self.wide(x, y):
                    score += sum(self.sizes[x[i]] for i, _ in in_order(x, y))
                elif need := [(i, j) for i in set(x) for j in set(y) if self.known(i, j) is None]:
                    todo += need
                    continue
                else:
                    self.left -= len(x) * len(y)
                    score += self.grid(x, y)[-1][-1]
                self.scores[(a, b) if a < b else (b, a)] = score
            todo.pop()
        return self.known(a, b)

    def wide(self, x, y) -> bool:
        return len(x) * len(y) > min(CELLS, max(0, self.left))

    @staticmethod
    def trimmed(x, y) -> tuple[int, int]:
        """How many children are equal at the head and, of the rest, at the tail."""
        most, head, tail = min(len(x), len(y)), 0, 0
        while head < most and x[head] == y[head]:
            head += 1
        while tail < most - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail

    def grid(self, x, y) -> list[list[int]]:
        """Best sums for each pair of leading parts; the scores of all pairs are known."""
        grid = [[0] * (len(y) + 1)]
        for a in x:
            last, row = grid[-1], [0]
            for j, b in enumerate(y):
                row.append(max(row[j], last[j + 1], last[j] + self.known(a, b)))
            grid.append(row)
        return grid

    def pairs(self, a: Node, b: Node):
        """The matched nodes of two matched trees."""
        self.left = BUDGET
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            yield a, b
            if a.shape == b.shape:
                todo += zip(a.kids, b.kids, strict=True)
                continue
            x, y = [k.shape for k in a.kids], [k.shape for k in b.kids]
            head, tail = self.trimmed(x, y)
            todo += zip(a.kids[:head], b.kids[:head], strict=True)
            todo += zip(a.kids[len(x) - tail :], b.kids[len(y) - tail :], strict=True)
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if not x or not y:
                continue
            if self.wide(x, y):
                todo += [(a.kids[head + i], b.kids[head + j]) for i, j in in_order(x, y)]
                continue
            for i in set(x):
                for j in set(y):
                    self.score(i, j)
            self.left -= len(x) * len(y)
            grid = self.grid(x, y)
            i, j = len(x), len(y)
            while i and j:
                if grid[i][j] == grid[i - 1][j]:
                    i -= 1
                elif grid[i][j] == grid[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((a.kids[head + i], b.kids[head + j]))


def _leaves(root: Node) -> list[str]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "#" and not node.text.isspace():
            out.append(node.text)
        elif node.tag not in RAW:
            todo += node.kids
    return out


def induce(pages: list[Node]) -> None:
    """Mark the template text of a group of pages: fixed on every node, the number of aligned pages that repeat it."""
    seen: list[tuple[set[str], int]] = []
    distinct: list[Node] = []
    for page in pages:
        texts = set(_leaves(page))
        size = sum(map(len, texts))
        if not any(sum(map(len, texts & s)) > COPY * min(size, n) for s, n in seen):
            seen.append((texts, size))
            distinct.append(page)
    if len(distinct) < LEAST:
        return
    match = Matcher()
    for page in pages:
        match.shape(page)
    for ref in distinct[:REFS]:
        held: dict[int, Counter] = {}
        nodes: dict[int, Node] = {}
        for page in distinct:
            for a, b in match.pairs(ref, page):
                if a.tag == "#" and a is not b:
                    held.setdefault(id(a), Counter())[b.text] += 1
                    nodes[id(a)] = a
        fixed = {}
        for key, count in held.items():
            text, n = count.most_common(1)[0]
            if n >= LEAST - 1 and n >= SHARE * (len(distinct) - 1):
                fixed[key] = text, n + 1
        for page in pages if fixed else ():
            for a, b in match.pairs(ref, page):
                if b.tag == "#" and id(a) in fixed and fixed[id(a)][0] == b.text:
                    b.fixed = max(b.fixed, fixed[id(a)][1])


# ---------------------------------------------------------------- content


def named(attr: dict[str, str], names=NAMES) -> bool:
    """Whether a class or the id is a name of boilerplate: by its last word, or besides words for boxes."""
    for name in f"{attr.get('class', '')} {attr.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and (words[-1] in names or any(w in names for w in words) and all(w in names or w in BOXES or len(w) == 1 for w in words)):
            return True
    return False


def _role(node: Node) -> str:
    return node.attr().get("role", "").lower() if node.attrs else ""


def _hidden(attr: dict[str, str]) -> bool:
    return "hidden" in attr or attr.get("aria-hidden") == "true" or "display:none" in attr.get("style", "").replace(" ", "").lower()


def _boilerplate(node: Node, inside: bool) -> bool:
    if node.tag in ("html", "body", "main") or node.tag == "form" and node.frame:
        return False
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    attr = node.attr()
    if not attr:
        return False
    if _hidden(attr) and (inside or not node.holds):
        return True
    if attr.get("role", "").lower() in ROLES:
        return True
    if node.tag == "article" and not inside and "comment" not in attr.get("class", "") + attr.get("id", ""):
        return False
    if not inside and node.holds:  # a layout that is named after its side bar still holds the article
        return False
    return named(attr) or not inside and named(attr, {"header"})


def _up(page: Node):
    """All nodes, children first."""
    walk = [(page, False)]
    while walk:
        node, done = walk.pop()
        if done or not node.kids:
            yield node
        else:
            walk.append((node, True))
            walk += [(k, False) for k in node.kids]


def _weigh(page: Node, least: int) -> None:
    """Set on every node: weight, the slot characters below it, linked, those within links, holds, and on forms frame.

    prose, paragraphs: characters of text and ``p`` elements outside fields, their labels and other boilerplate tags. A
    form that holds an article, or most of the page's prose in paragraphs, is the page's frame.
    """
    nodes = list(_up(page))
    for node in nodes:
        node.holds = any(k.holds or k.tag in ("article", "main") or _role(k) in ("article", "main") for k in node.kids)
        left_out = node.tag in ("label", "legend") or node.tag in DROPPED and node.tag != "form"
        node.prose = 0 if left_out else len(node.text.strip()) if node.tag == "#" else sum(k.prose for k in node.kids)
        node.paragraphs = 0 if left_out else (node.tag == "p") + sum(k.paragraphs for k in node.kids)
    for node in nodes:
        if node.tag == "#":
            node.weight = 0 if node.fixed >= least else len(node.text.strip())
            continue
        if node.tag == "form":
            node.frame = node.holds or node.prose >= FRAME and node.paragraphs > 1 and 2 * node.prose > page.prose
        kids = [k for k in node.kids if k.tag == "#" or not _boilerplate(k, True)]
        node.weight = sum(k.weight for k in kids)
        node.linked = node.weight if node.tag == "a" else sum(k.linked for k in kids)


def _teaser(node: Node) -> bool:
    """Whether an article element only leads to another page."""
    if 2 * node.linked > node.weight:
        return True
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in HEADS:
            return x.weight > 0 and x.linked == x.weight
        todo += reversed(x.kids)
    return False


def _roots(page: Node) -> tuple[list[Node], bool]:
    """Where the content is, and whether markup says so."""
    _weigh(page, LEAST)
    articles, mains, paragraphs = [], [], []
    aside: set[int] = set()  # articles below an element that is named as boilerplate
    todo = [(page, False, False)]
    while todo:
        node, within, beside = todo.pop()
        if node.tag == "#" or _boilerplate(node, False):
            continue
        role = _role(node)
        is_article = node.tag == "article" or role == "article"
        if is_article and not within:
            articles.append(node)
            if beside:
                aside.add(id(node))
        beside = beside or node.holds and node.tag not in ("body", "main", "html") and (named(node.attr()) or _hidden(node.attr()))
        if node.tag == "main" or role == "main":
            mains.append(node)
        if node.tag in PARAGRAPHS or node.tag in HEADS:
            paragraphs.append(node)
        todo += [(k, within or is_article, beside) for k in reversed(node.kids)]
    if articles:
        if len(aside) < len(articles):
            articles = [x for x in articles if id(x) not in aside]
        elif mains:  # only a hidden or side article, and a main part beside it
            return [max(mains, key=lambda x: x.weight)], True
        best = max(articles, key=lambda x: x.weight)
        chosen = [x for x in articles if x is best or not _teaser(x)]
        return _in_main(mains, page, best, chosen), True
    if mains:
        return [max(mains, key=lambda x: x.weight)], True
    return [_region(page, paragraphs)], False


def _in_main(mains: list[Node], page: Node, best: Node, chosen: list[Node]) -> list[Node]:
    """The chosen articles and, where the best is in a main part, what stands beside them there as content, in page order: paragraphs, headings, lists that are no links, and sections of paragraphs."""
    keep, above, around = {id(x) for x in chosen}, set(), {id(best)}
    for node in _up(page):
        if any(id(k) in keep or id(k) in above for k in node.kids):
            above.add(id(node))
        if any(id(k) in around for k in node.kids):
            around.add(id(node))
    todo = [next((m for m in mains if m is not best and id(m) in around), best)]
    if todo[0] is best:
        return chosen
    out = []
    while todo:
        x = todo.pop()
        if id(x) in keep:
            out.append(x)
        elif id(x) in above:
            todo += reversed(x.kids)
        elif x.tag == "#" or x.tag == "article" or _role(x) == "article" or _boilerplate(x, False):
            continue
        elif x.weight and 2 * x.linked <= x.weight and (x.tag in PARAGRAPHS or x.tag in HEADS or x.tag == "section" and any(k.tag == "p" for k in x.kids)):
            out.append(x)
    got = {id(x) for x in out}
    return [*out, *(x for x in chosen if id(x) not in got)]


def _region(page: Node, paragraphs: list[Node]) -> Node:
    """The lowest element with most slot text, counted in paragraphs where there are any."""
    own = {id(x): x.weight for x in paragraphs}
    if not any(own.values()):
        own = {}
    total: dict[int, int] = {}
    for node in _up(page):
        below = 0 if node.tag == "#" else sum(total[id(k)] for k in node.kids)
        mine = own.get(id(node), 0) if own else node.weight if node.tag == "#" else 0
        total[id(node)] = 0 if node.tag != "#" and _boilerplate(node, False) else max(mine, below)
    at = page
    while True:
        most = max((k for k in at.kids if k.tag != "#" and k.tag not in INLINE and id(k) not in own), key=lambda k: total[id(k)], default=None)
        if most is None or total[id(most)] < REGION * total[id(page)] or not total[id(most)]:
            return at
        at = most


def main_text(page: Node) -> str:
    roots, marked = _roots(page)
    least = INSIDE if marked else LEAST
    blocks: list[str] = []
    now: list[str] = []
    slots: list[str] = []

    def close():
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text and slots:  # a block that varies in part is content as a whole
            blocks.append(text)
        slots.clear()

    def walk(root: Node):
        todo: list[Node | None] = [root]
        while todo:
            node = todo.pop()
            if node is None:
                close()
            elif node.tag == "#":
                now.append(node.text)
                if node.fixed < least and not node.text.isspace():
                    slots.append(node.text)
            elif node.tag == "br":
                now.append(" ")
            elif node is root or not _boilerplate(node, True):
                if node.tag in INLINE:
                    todo += reversed(node.kids)
                else:
                    close()
                    todo += [None, *reversed(node.kids)]

    for root in roots:
        walk(root)
    close()
    return " ".join(blocks)


def extract_group(sources: list[str]) -> list[str]:
    """The main text of each page of one group."""
    pages = [parse(s) for s in sources]
    induce(pages)
    return [main_text(p) for p in pages]


BROADCAST_HOSTS = 200_000


def extract(pages: DataFrame, work) -> DataFrame:
    """(page_id, url, text) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("binary").alias("html"))
    deals = work.put("deals", rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("deals")))
    if deals.count() <= BROADCAST_HOSTS:  # else the pages are shuffled by host first
        deals = F.broadcast(deals)

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            small = [pack(x) if x else b"" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(small, pa.binary())], names=["page_id", "url", "host", "html"])

    packed = rows.mapInArrow(squeeze, "page_id long, url string, host string, html binary")
    spread = F.pmod(F.xxhash64("page_id", "url", "html"), F.col("deals")).cast("int")
    dealt = packed.join(deals, "host").select("host", spread.alias("deal"), "page_id", "url", "html")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        now, held = None, []

        def out():
            found = extract_group([unpack(h).decode("utf-8", "replace") if h else "" for _, _, h in held])
            return table({"page_id": pa.int64(), "url": pa.string(), "text": pa.string()}, [(i, u, t) for (i, u, _), t in zip(held, found, strict=True)])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["host"], row["deal"]) != now:
                    if held:
                        yield out()
                    now, held = (row["host"], row["deal"]), []
                held.append((row["page_id"], row["url"], row["html"]))
        if held:
            yield out()

    return dealt.repartition("host", "deal").sortWithinPartitions("host", "deal", "page_id", "url").mapInArrow(run, "page_id long, url string, text string")
