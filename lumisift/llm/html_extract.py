"""Main text of web pages by a site style tree.

Pass 1 parses every page into style nodes (tag and classes below a parent node)
and merges the pages of a host. Per style node it counts the distinct contents
and the distinct child sequences seen in that place; their normalised entropies
give the importance of content and of presentation, combined as ``(1 - g**l) *
presentation + g**l * content`` for a node with ``l`` children: what is the same
on every page of a host tells nothing. A node's presentation also says how much
of its text is links, and how much text it holds beside its largest sibling:
what links alone, or a small box next to the container of most text, is not the
article though it differs on every page. Pages of equal content count once, so
copies of a page are not boilerplate.

Pass 2 parses each page again and weighs every block of text. Two things speak:
the prior of its style path (what kind of element holds it, whether it stands in
an ``article``) and the tree, on each branch that holds it. The more different
pages a host shows, the more the tree counts: with one page the prior decides,
with ``FULL`` of them the tree outweighs all that speaks for a block but a
paragraph's place in an article: a box that a site repeats goes, a paragraph of
an article that it repeats stays. Landmarks such as ``nav``, and names that mark
what is not the article, such as reader comments, which differ on every page
like text, remove a block in either case. Blocks whose weights do not add up to
more than zero are removed.

Pages are scanned once from left to right; nodes are named by 64-bit numbers, and
what an element holds is added up when it ends, so time and memory grow with
the length of a page, however its tags are nested or broken.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, small_side, stored

#: Share of a node's presentation in its importance falls with g per child.
DECAY = 0.9
#: Greatest weight of the tree against a branch and for one.
TREE, FOR = 4.0, 1.0
#: Different pages of a host at which the tree has its full weight, which grows
#: with their logarithm.
FULL = 8
#: Nodes that a task hands on together.
NODES = 20_000
#: A container speaks against its smaller siblings if it holds this share of
#: their parent's text; a sibling of less than a quarter of it is unimportant.
MOST = 0.5
#: Weights of the prior.
ARTICLE, PAGE, OUTSIDE = 3.0, 0.5, -3.0
RUN, PARTLY = 1.5, -2.5
#: Marks that remove a block whatever else speaks for it.
LANDMARK, NAMED = -8.0, -6.0

# Element classes of HTML and names that mark noise.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes template noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select head".split())
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "option", "caption", "tbody", "thead", "tfoot"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "p": ("article", "aside", "div", "section", "td", "th", "li", "blockquote", "body", "main")}
LANDMARKS = frozenset("nav footer aside form button select dialog menu head".split())
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol li dl dt dd table caption tbody thead tr td th figure figcaption".split())
MARKED = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notices popup modal overlay comment comments disqus reply replies share sharing related newsletter subscribe pagination pager toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())

_PARTS = re.compile(r"[-_]+")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""[>"']""")
#: A tag as most are written; what it cannot match ends at the next bracket.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _style(tag: str, attrs: str) -> tuple[str, float]:
    """The style name of an element, and what its kind and names weigh: a
    landmark most, a class or id that is a marked name less, and one that
    begins or ends with it (``ad-slot``, ``site-footer``) least."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)} if attrs else {}
    names = found.get("class", "").split() + found.get("id", "").split()
    weight = 0.0
    if tag in LANDMARKS or found.get("role") in ROLES:
        weight = LANDMARK
    elif not MARKED.isdisjoint(names):
        weight = NAMED
    elif any(not MARKED.isdisjoint((parts[0], parts[-1])) for parts in map(_PARTS.split, names)):
        weight = PARTLY
    return tag + "".join("." + c for c in sorted(found.get("class", "").split())), weight if tag not in ("html", "body") else 0.0


@lru_cache(maxsize=1)
def _raw_ends():
    """Patterns of the ends of raw elements, in any case."""
    return {tag: re.compile(rf"</{tag}[^>]*(?:>|$)", re.I) for tag in RAW}


def tokens(source: str):
    """``(text before, tag, attributes, closing)`` of each tag, in order, and at
    last the text after all with an empty tag. Comments and declarations are
    left out, CDATA is text, and so is a ``<`` that begins nothing.

    Quoted ``>`` do not end a tag. Where a tag's quotes cannot be matched to the
    end of the page, quotes count no more from there on: no place of the page is
    looked at more than a few times.
    """
    n, at, begun, quotes = len(source), 0, 0, True
    no_end = n  # from here on there is no ">"
    missing: set[str] = set()  # quotes that do not come again

    def end_of(start: int) -> int:
        nonlocal quotes, no_end
        i = start
        while quotes:
            m = _QUOTED.search(source, i)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            close = -1 if m[0] in missing else source.find(m[0], m.end())
            if close < 0:
                missing.add(m[0])
                break
            i = close + 1
        found = source.find(">", start)
        if found < 0:
            no_end = min(no_end, start)
        else:
            quotes = False
        return found

    while (lt := source.find("<", at)) >= 0:
        if quotes and (m := _PLAIN.match(source, lt)):
            slash, tag, attrs = m.groups()
            tag = tag.lower()
            yield source[begun:lt], tag, attrs, bool(slash)
            at = begun = m.end()
            if tag in RAW and not slash and not attrs.endswith("/"):
                raw = _raw_ends()[tag].search(source, at)
                at = begun = raw.end() if raw else n
            continue
        kind = source[lt + 1:lt + 2]
        if kind and kind in "!?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                end, text = (n, "") if end < 0 else (end + 3, "")
            elif source.startswith("<![CDATA[", lt):
                end = source.find("]]>", lt + 9)
                text = htmllib.escape(source[lt + 9:end if end >= 0 else n])
                end = n if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                end, text = (n, "") if end < 0 else (end + 1, "")
            yield source[begun:lt] + text, "", "", False
            at = begun = end
            continue
        m = _NAME.match(source, lt + 1) if lt < no_end else None
        end = end_of(m.end()) if m else -1
        if end < 0:
            at = lt + 1
            continue
        tag = m[1].lower()
        closing = kind == "/"
        yield source[begun:lt], tag, source[m.end():end], closing
        at = begun = end + 1
        if tag in RAW and not closing and not source[m.end():end].endswith("/"):
            raw = _raw_ends()[tag].search(source, at)
            at = begun = raw.end() if raw else n
    yield source[begun:], "", "", False


_ALL = (1 << 64) - 1


def _mix(a: int, b: int) -> int:
    """A number of 64 bits that depends on both and on their order."""
    x = (a * 0x9E3779B97F4A7C15 + b + 0x632BE59BD9B4E019) & _ALL
    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & _ALL
    return x ^ x >> 29


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


_known_hash, _known_style = lru_cache(maxsize=50_000)(_hash), lru_cache(maxsize=20_000)(_style)
#: Longer names and attributes are not remembered.
SHORT = 300


class _Open:
    """An element that has begun: its style node, what weighs on it, and what
    it holds so far."""

    __slots__ = ("tag", "node", "weight", "marked", "inside", "holder", "hash", "chars", "links", "children")

    def __init__(self, tag: str, node: int, weight: float, marked: bool, inside: bool, holder: str):
        self.tag, self.node, self.weight, self.marked, self.inside, self.holder = tag, node, weight, marked, inside, holder
        self.hash = self.chars = self.links = 0
        self.children: list[str] = []


class Page:
    """Text blocks and style nodes of a page, in page order.

    ``blocks``: ``(node, text, weight, in_article, marked)``, the weight being
    that of the elements around the text and ``marked`` whether a landmark or a
    marked name is among them; ``nodes``: per style node its parent, whether it
    is a container, the digest of all that it holds, its characters, those in
    links, and the digest and number of its children.
    """

    def __init__(self, source: str, sums: bool = True):
        """Without ``sums`` only blocks and parents are kept."""
        linked = 0  # characters of the text so far that stand in links
        self.blocks: list[tuple[int, str, float, bool, bool]] = []
        self.nodes: dict[int, list] = {}
        self.parents: dict[int, int] = {}
        self.has_article = False
        root = _Open("", 0, 0.0, False, False, "")
        stack = [root]
        where: dict[str, list[int]] = {}  # places in the stack of each open tag
        blocks: list[int] = []  # and of open blocks
        text: list[str] = []

        def flush() -> None:
            nonlocal linked
            if text:
                joined = "".join(text)
                joined = " ".join((htmllib.unescape(joined) if "&" in joined else joined).split())
                text.clear()
                if joined:
                    top = stack[-1]
                    self.blocks.append((top.node, joined, top.weight + RUN * (top.holder in RUNNING), top.inside, top.marked))
                    self.has_article |= top.inside and top.weight > PARTLY
                    if sums:
                        top.hash = _mix(top.hash, _hash(joined))
                        top.chars += len(joined)
                        top.links += min(linked, len(joined))
                linked = 0

        def end(element: _Open) -> None:
            """Hand what an element held to its parent and its style node; one
            without text and children leaves nothing."""
            if not element.chars and not element.children:
                return
            parent = stack[-1]
            node = self.nodes.get(element.node)
            if node is None:
                node = self.nodes[element.node] = [parent.node, element.tag not in RUNNING, 0, 0, 0, 0, 0]
            if element.chars:
                parent.hash = _mix(parent.hash, _mix(element.node, element.hash))
                parent.chars += element.chars
                parent.links += element.links
                node[2] = _mix(node[2], element.hash)
                node[3] += element.chars
                node[4] += element.links
            if element.children:
                node[5] = _mix(node[5], _hash("|".join(element.children)))
                node[6] += len(element.children)

        def pop_to(i: int) -> None:
            """Close the elements from place ``i`` of the stack on."""
            if blocks and blocks[-1] >= i:
                flush()
            while len(stack) > i:
                element = stack.pop()
                where[element.tag].pop()
                if element.tag in BLOCK:
                    blocks.pop()
                if sums:
                    end(element)

        def close(tags: tuple, stop: tuple) -> None:
            """End the last of ``tags`` unless one of ``stop`` began since."""
            i = 0
            for t in tags:
                if (open_ := where.get(t)) and open_[-1] > i:
                    i = open_[-1]
            if i:
                for t in stop:
                    if (open_ := where.get(t)) and open_[-1] > i:
                        return
                pop_to(i)

        for before, tag, attrs, closing in tokens(source):
            if before:
                text.append(before)
                if where.get("a"):
                    linked += len(" ".join(before.split()))
            if not tag:
                continue
            if closing:
                if tag == "p" and not where.get("p"):
                    flush()
                i = where[tag][-1] if where.get(tag) else 0
                if i and (tag in BLOCK or not blocks or i > blocks[-1]):
                    pop_to(i)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in RAW:
                continue
            if tag in BLOCK:
                flush()
                if tag in CLOSES_P:
                    close(("p",), SCOPE["p"])
                if tag in CLOSES:
                    close(CLOSES[tag], SCOPE[tag])
            name, own = (_known_style if len(attrs) < SHORT else _style)(tag, attrs)
            top = stack[-1]
            if tag == "header" and not top.inside:
                own = LANDMARK
            top.children.append(name)
            weight = min(top.weight, own)
            inside = top.inside or (tag in ("article", "main") and weight > NAMED)
            node = _mix(top.node, (_known_hash if len(name) < SHORT else _hash)(name))
            if node not in self.parents:
                self.parents[node] = top.node
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(_Open(tag, node, weight, top.marked or own <= NAMED, inside, tag if tag in BLOCK else top.holder))
        flush()
        pop_to(1)

    def prior(self) -> list[tuple[int, str, float, bool]]:
        """``(node, text, weight, marked)`` of every block before the tree is
        asked."""
        around = {True: ARTICLE, False: OUTSIDE if self.has_article else PAGE}
        return [(node, text, weight + around[inside], marked) for node, text, weight, inside, marked in self.blocks]

    def main_text(self, tree: dict[int, float], marks: bool = True) -> str:
        """Blocks whose weights come to more than zero: the prior's and the least
        that the tree says of a branch that holds them. A page whose every
        block the tree speaks against keeps those that the prior keeps."""
        said: dict[int, float] = {0: math.inf}
        parents = self.parents

        def branch(node: int) -> float:
            """The least weight from the root down; each node is asked once."""
            way = []
            while node not in said:
                way.append(node)
                node = parents.get(node, 0)
            least = said[node]
            for x in reversed(way):
                least = said[x] = min(least, tree.get(x, 0.0))
            return 0.0 if math.isinf(least) else least

        keep, plain = [], []
        for node, text, weight, marked in self.prior():
            if marked and marks:
                continue
            if weight > 0:
                plain.append(text)
            if weight + (branch(node) if tree else 0.0) > 0:
                keep.append(text)
        return " ".join(keep or plain)


def style_nodes(pages: DataFrame) -> DataFrame:
    """``(host, page, node, parent, container, content, chars, links, shape,
    l)``: per page one row for each style node; ``page`` is a digest of all that
    may be main text."""
    bounded_batches(pages.sparkSession)
    schema = pa.schema([
        ("host", pa.string()), ("page", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("container", pa.bool_()), ("content", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()),
        ("shape", pa.int64()), ("l", pa.int64()),
    ])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        rows = []
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source or "")
                whole = signed(xxhash.xxh64_intdigest("\n".join(f"{node}\t{text}" for node, text, weight, _ in page.prior() if weight > 0).encode("utf-8", "surrogatepass")))
                rows += [(host, whole, signed(n), signed(v[0]), v[1], signed(v[2]) if v[3] else None, v[3], v[4], signed(v[5]) if v[6] else None, v[6]) for n, v in page.nodes.items()]
                if len(rows) >= NODES:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    return pages.select("host", "html").mapInArrow(run, "host string, page long, node long, parent long, container boolean, content long, chars long, links long, shape long, l long")


def style_importance(nodes: DataFrame) -> DataFrame:
    """``(host, node, parent, container, importance, content, chars, links,
    pages)`` of every style node that holds text; ``content`` is the content's
    importance, ``chars`` and ``links`` are summed over the ``pages`` different
    pages that show it.

    Entropy is taken over the different pages, to the base of their number, so
    it is 0 if all agree and 1 if all differ, or if there is but one. All sums
    combine before their shuffles.
    """
    kinds = F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.col("content").alias("digest")), F.struct(F.lit("p").alias("kind"), F.col("shape").alias("digest"))))
    each = nodes.select("host", "page", "node", "parent", "container", "chars", "links", "l", kinds.alias("k")).select("*", "k.kind", "k.digest").drop("k").where("digest IS NOT NULL")
    pages = each.groupBy("host", "node", "kind", "digest", "page").agg(*[F.max(c).alias(c) for c in ("parent", "container", "chars", "links", "l")])
    counted = pages.groupBy("host", "node", "kind", "digest").agg(F.count(F.lit(1)).alias("d"), F.max("parent").alias("parent"), F.max("container").alias("container"), *[F.sum(c).alias(c) for c in ("chars", "links", "l")])
    sums = counted.groupBy("host", "node", "kind").agg(F.sum("d").alias("m"), F.sum(F.col("d") * F.log("d")).alias("s"), F.max("parent").alias("parent"), F.max("container").alias("container"), *[F.sum(c).alias(c) for c in ("chars", "links", "l")])
    even = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)

    def of(kind: str, value):
        return F.max(F.when(F.col("kind") == kind, value))

    both = sums.groupBy("host", "node").agg(
        of("c", F.col("parent")).alias("parent"), of("c", F.col("container")).alias("container"), of("c", even).alias("content"), of("p", even).alias("presentation"), of("p", F.col("l") / F.col("m")).alias("l"),
        of("c", F.col("chars")).alias("chars"), of("c", F.col("links")).alias("links"), of("c", F.col("m")).alias("pages"),
    ).where("content IS NOT NULL")
    weight = F.pow(F.lit(DECAY), F.coalesce("l", F.lit(0.0)))
    importance = (1 - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * F.col("content")
    return both.select("host", "node", "parent", "container", importance.alias("importance"), "content", "chars", "links", "pages")


def branch_weights(importance: DataFrame) -> DataFrame:
    """``(host, node, weight, pages)``: what the tree says for or against a
    branch: by its entropies, by the share of links in its text, and by its
    text beside that of a larger sibling; the worst of them counts.

    Siblings are looked at through their parent's sums, so a parent with many
    kinds of children is no group of one task.
    """
    around = importance.groupBy("host", F.col("parent").alias("of")).agg(F.sum("chars").alias("all"), F.max(F.struct("chars", "container", "node")).alias("top"))
    rows = importance.join(around.withColumnRenamed("host", "h"), (F.col("host") == F.col("h")) & (F.col("parent") == F.col("of")), "left")
    seen = 2 * F.greatest("importance", "content") - 1
    linked = F.least(F.lit(0.0), 1 - 2 * F.col("links") / F.col("chars"))
    large = F.col("top.container") & (F.col("top.chars") >= MOST * F.col("all")) & (F.col("top.node") != F.col("node"))
    small = F.when(large & F.col("container"), F.least(F.lit(0.0), 4 * F.col("chars") / F.col("top.chars") - 1)).otherwise(0.0)
    against = F.least(linked, small)
    x = F.when((seen < 0) | (against < 0), F.least(seen, against)).otherwise(seen)
    return rows.select("host", "node", F.when(x < 0, x * TREE).otherwise(x * FOR).alias("weight"), "pages")


def host_trees(pages: DataFrame) -> DataFrame:
    """``(host, tree)``: the weights of a host's branches, each as far as the
    different pages that show it back it, which is not at all for one page."""
    weights = branch_weights(style_importance(style_nodes(pages)))
    share = F.least(F.lit(1.0), F.log2(F.col("pages").cast("double")) / math.log2(FULL))
    said = weights.where("pages > 1").select("host", F.struct("node", (share * F.col("weight")).cast("float").alias("weight")).alias("entry"))
    return said.groupBy("host").agg(F.sort_array(F.collect_list("entry")).alias("tree"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: bool = True, marks: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    A null or empty html gives an empty text, a very long or deeply nested one
    is parsed whole; a null url has the empty host. Ties and repeated rows are
    kept. Other columns are not looked at. An empty table gives an empty
    result. ``tree=False`` leaves all to the prior; without ``marks`` landmarks
    and marked names remove nothing by themselves.

    The branch weights of a host travel with its pages: broadcast if their
    size is small, else by a join on host, whose page side skew handling may
    split.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.col(html_col).alias("html"),
    )
    if tree:
        weights = stored(host_trees(rows), "tree")
        joined = rows.join(small_side(weights), "host", "left").select("page_id", "url", "html", "tree")
    else:
        joined = rows.select("page_id", "url", "html", F.lit(None).cast("array<struct<node:long,weight:float>>").alias("tree"))
    kind = dict(pages.select(F.col(id_col).alias("i")).dtypes)["i"]

    def run(batches):
        for batch in batches:
            texts = []
            for source, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                weights = {e["node"] & (1 << 64) - 1: e["weight"] for e in said or ()}
                texts.append(Page(source or "", sums=False).main_text(weights, marks))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
