"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same path of tags, classes and
ids are one node, which has seen the contents (text blocks) and the presentations
(sequences of child tags) of all its pages. With m different pages, a content that
n of them show has entropy log n / log m, drawn towards 0 where few pages testify.
A node's importance is 1 less the mean entropy of its contents, each weighed by its
words on all pages that show it; that of a branch takes all contents below, and
what its presentations' entropy adds. Each host has its own threshold: what loses
more than TIMES as much importance as the host's words do on average is a part of
the template, so that a node with most of the words cannot be one. What the names of tags, classes and
roles say of an element is added as a feature of the node. A block goes where any
node above it, or its own, is less important than that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import release, slices, stage, staged
from tracemill.shipping import ship

#: HTML's elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = set("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
APART = set("nav footer aside form button select textarea menu dialog fieldset input option".split())
CONTENT = {"article", "main"}
#: Words of classes, ids and roles that name parts outside of an article.
APART_WORDS = set(
    "nav navbar navigation menu menubar topbar header masthead footer foot bottombar colophon sidebar sidenav aside rail ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice alert newsletter subscribe subscription signup signin login popup modal overlay dialog comment comments commentlist disqus respond reply replies discussion related recommended "
    "recommendations share sharing social breadcrumb breadcrumbs pagination pager widget search searchform skip toolbar copyright legal contentinfo complementary toc tags".split()
)
#: Elements whose start ends an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table body html article main section div".split())
FRAME = {"", "html", "body"}
LAYOUT = re.compile(r"(?:has|with|without|no|is|layout)[-_]")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


class Element:
    __slots__ = ("tag", "node", "parent", "holder", "apart", "content", "children", "silent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Element | None):
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''} {attrs.get('role') or ''}"
        style = " ".join(sorted(re.sub(r"\d+", "0", names).split()))
        words = {x.lower() for name in names.split() if not LAYOUT.match(name) for x in NAME_PARTS.findall(name)}
        if words & {"article", "entry", "post", "story"}:
            words -= {"header", "head"}  # of the article, not of the page
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        inside = bool(parent and parent.content)
        self.tag, self.parent, self.children = tag, parent, []
        self.node = key(str(parent.node) if parent else "", tag, style)  # of the whole path, in constant memory
        self.holder = parent.holder if parent and tag in INLINE else self
        self.silent = bool(parent and parent.silent) or tag in SILENT
        self.apart = bool(parent and parent.apart) or hidden or tag in APART or (tag == "header" and not inside) or (bool(words & APART_WORDS) and tag not in ("html", "body", "main"))
        self.content = inside or tag in CONTENT or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"

    def above(self) -> Element | None:
        """The branch that the element lies in: up to the page's frame, or up to the article for what is inside of one."""
        up = self.parent
        return up if up is not None and up.tag not in FRAME and up.content >= self.content else None


class Block:
    __slots__ = ("element", "text")

    def __init__(self, element: Element, text: str):
        self.element, self.text = element, text


class PageReader(HTMLParser):
    """Text blocks of a page in order, each with its innermost block element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.stack, self.blocks, self.pending = [self.root], [], []
        self.holder, self.open = self.root, Counter()

    def flush(self) -> None:
        if self.pending:
            text = " ".join("".join(self.pending).split())
            self.pending = []
            if text:
                self.blocks.append(Block(self.holder, text))

    def close_to(self, k: int) -> None:
        self.flush()
        self.drop(k)

    def drop(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE and not (tag == "a" and self.stack[-1].tag in ("nav", "menu")):
            attrs = dict(attrs)
            if not ("hidden" in attrs or attrs.get("class") or attrs.get("style")):
                return
        if tag == "br":
            self.flush()
            return
        if tag in VOID:
            return
        attrs = dict(attrs)
        if tag not in INLINE:
            self.flush()
            closed = CLOSES.get(tag, ())
            for k in range(len(self.stack) - 1, 0, -1):
                if not self.open["p"] and not any(self.open[x] for x in closed):
                    break
                above = self.stack[k].tag
                if above == "p" or above in closed:
                    self.close_to(k)
                    if above != "p":
                        break
                elif above in SCOPE:
                    break
        parent = self.stack[-1]
        if tag not in INLINE:
            parent.children.append(tag)
        self.stack.append(Element(tag, attrs, parent))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag not in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                if tag in INLINE:
                    self.open[tag] -= 1
                    del self.stack[k]
                else:
                    self.close_to(k)
                return
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.silent or (top.tag in INLINE and top.apart):
            return
        if not self.pending:
            self.holder = top.holder
        self.pending.append(data)


def read_page(html: str) -> PageReader:
    page = PageReader()
    page.feed(html)
    page.close()
    page.flush()
    return page


#: What names add to how far a node lies above its host's threshold: of parts that they set apart, of blocks outside of a page's article or main, and inside of it.
APART_FEATURE, OUTSIDE_FEATURE, INSIDE_FEATURE = -0.65, -0.65, 0.1
#: How far above it nodes are taken to lie of which the tree says nothing.
UNKNOWN = 0.3
#: A host's threshold lies as many times below 1 as its words' mean importance, within these bounds; names tell beyond them.
TIMES, LEAST_LOSS, MOST_LOSS = 3.5, 0.03, 0.6
#: Words at either end of a block that are contents of their own: a template's text often begins or ends alike on all pages.
ENDS = 3
#: Shares into which the pages that hold one node are dealt.
SALTS = 16
SEEN = "host long, row long, page long, nodes array<struct<node:long,above:long,apart:boolean>>, contents array<struct<node:long,feature:long,words:int>>, styles array<struct<node:long,feature:long>>"


def elements(blocks: list[Block]) -> list[Element]:
    """The elements that hold the blocks, and all branches that these lie in, each once."""
    seen: dict[int, Element] = {}
    for b in blocks:
        at: Element | None = b.element
        while at is not None and id(at) not in seen:
            seen[id(at)] = at
            at = at.above()
    return list(seen.values())


def features(text: str) -> list[tuple[int, int]]:
    """What a block shows, with its weight: its whole text, its first words, and its last; for a text of few words these are one."""
    words = text.count(" ") + 1
    if words <= ENDS:
        return [(key("whole", text), 3 * words)]
    return [(key("whole", text), words), (key("first", *text.split(" ", ENDS)[:ENDS]), words), (key("last", *text.rsplit(" ", ENDS)[-ENDS:]), words)]


def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the nodes that hold text with those above them, their contents, and the presentations of all.

    ``page`` is the hash of all that names do not set apart, so that copies of a page
    count once: else an article that was copied would look like a template.
    """
    names = [x.split()[0] for x in SEEN.split(", ")]
    pair = pa.list_(pa.struct([("node", pa.int64()), ("feature", pa.int64())]))
    branch = pa.list_(pa.struct([("node", pa.int64()), ("above", pa.int64()), ("apart", pa.bool_())]))
    told = pa.list_(pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("words", pa.int32())]))
    for batch, found in slices(batches, 4 << 20):
        pages, nodes, contents, styles = [], [], [], []
        for raw in found:
            blocks = read_page(raw.decode("utf-8", "ignore")).blocks
            lines = elements(blocks)
            pages.append(key(*(b.text for b in blocks if not b.element.apart)))
            above = {e.node: (e.above(), e.apart) for e in lines}
            nodes.append([{"node": n, "above": up.node if up is not None else None, "apart": apart} for n, (up, apart) in above.items()])
            contents.append([{"node": n, "feature": f, "words": w} for (n, f), w in {(b.element.node, f): w for b in blocks for f, w in features(b.text)}.items()])
            styles.append([{"node": n, "feature": f} for n, f in {e.node: key(*e.children) for e in lines if e.children}.items()])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("row"), pa.array(pages, pa.int64()), pa.array(nodes, branch), pa.array(contents, told), pa.array(styles, pair)], names)


def summed_branches(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """(host, node, lost, shown) of (host, node, lost, shown) and (host, node, above): each node's sums over its whole branch.

    Every round adds what lies up to twice as deep: a node's sums go to the node that
    many levels above it. Depth d takes log2 d rounds, whatever the shape.
    """
    tree = stage(above.join(leaves, ["host", "node"], "left").select("host", "node", F.col("above").alias("jump"), F.coalesce("lost", F.lit(0.0)).alias("lost"), F.coalesce("shown", F.lit(0)).alias("shown")), "tree-sums")
    while tree.where("jump IS NOT NULL").limit(1).count():
        below = tree.where("jump IS NOT NULL").groupBy("host", F.col("jump").alias("node")).agg(F.sum("lost").alias("more"), F.sum("shown").alias("also"))
        ahead = tree.select("host", F.col("node").alias("jump"), F.col("jump").alias("next"))
        summed = tree.join(below, ["host", "node"], "left").select("host", "node", "jump", (F.col("lost") + F.coalesce("more", F.lit(0.0))).alias("lost"), (F.col("shown") + F.coalesce("also", F.lit(0))).alias("shown"))
        tree = stage(summed.join(ahead, ["host", "jump"], "left").select("host", "node", F.col("next").alias("jump"), "lost", "shown"), "tree-sums")
    return tree.select("host", "node", "lost", "shown")


def low_branches(seen: DataFrame, presentation: float, times: float) -> DataFrame:
    """(host, node, own, branch): each host's nodes whose own contents or branch lie below its threshold, and by how much (negative, else null).

    Nodes that names set apart wherever they stand are left out: these go without being told.
    """
    chosen = seen.groupBy("host", "page").agg(F.min("uid").alias("uid"))
    sizes = stage(chosen.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"), "tree-hosts")
    once = seen.join(chosen.select("uid"), "uid", "left_semi")
    held = lambda c: once.select("host", F.explode(c).alias("x")).select("host", "x.*").groupBy("host", "node")
    shown = lambda c, *more: once.select("host", F.explode(c).alias("x")).groupBy("host", "x.node", "x.feature").agg(F.count("*").alias("times"), *more)
    weight = F.col("times") * F.col("words")
    leaves = shown("contents", F.max("x.words").alias("words")).groupBy("host", "node").agg(F.sum(weight * F.log("times")).alias("lost"), F.sum(weight).alias("shown"))
    leaves = stage(leaves.join(sizes.select("host"), "host", "left_semi"), "tree-leaves")
    share = (F.col("n") - 1) / (F.col("n") + 1) / F.log("n")  # turns sums of logarithms into entropies, as far as n pages testify
    loss = F.least(F.greatest(times * share * F.col("lost") / F.col("shown"), F.lit(LEAST_LOSS)), F.lit(MOST_LOSS))
    bounds = leaves.groupBy("host").agg(F.sum("lost").alias("lost"), F.sum("shown").alias("shown")).join(sizes, "host")
    bounds = stage(bounds.select("host", loss.alias("loss"), share.alias("share"), F.log("n").alias("most")), "tree-thresholds")
    nodes = stage(held("nodes").agg(F.min("above").alias("above"), F.min("apart").alias("apart")).join(sizes.select("host"), "host", "left_semi"), "tree-structure")
    branches = summed_branches(leaves, nodes.select("host", "node", "above")).where("shown > 0")
    whole = F.sum("times")
    styled = shown("styles").groupBy("host", "node").agg((F.log(whole) - F.sum(F.col("times") * F.log("times")) / whole).alias("styles"))
    own = leaves.select("host", "node", (F.col("lost") / F.col("shown")).alias("own"))
    judged = branches.join(nodes.where("NOT apart").select("host", "node"), ["host", "node"]).join(styled, ["host", "node"], "left").join(own, ["host", "node"], "left").join(bounds, "host")
    below = lambda x: F.when(x < 0, x)
    bonus = presentation * F.coalesce(F.col("styles"), F.lit(0.0)) / F.col("most")
    low = judged.select("host", "node", below(F.col("loss") - F.col("share") * F.col("own")).alias("own"), below(bonus - F.col("share") * F.col("lost") / F.col("shown") + F.col("loss")).alias("branch"))
    return stage(low.where("own IS NOT NULL OR branch IS NOT NULL"), "tree-low")


def low_of_pages(seen: DataFrame, low: DataFrame) -> DataFrame:
    """(row, low): of each page the low nodes that it holds, however many its host has.

    A node that all pages of a host hold is dealt with them over ``SALTS`` tasks.
    """
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = seen.select("host", "row", F.explode("nodes.node").alias("node")).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    held = pairs.join(salted, ["host", "node", "salt"])
    return held.groupBy("row").agg(F.collect_set(F.struct("node", "own", "branch")).alias("low"))


def main_blocks(page: PageReader, low: dict[int, tuple[float | None, float | None]]) -> list[str]:
    """Blocks whose own node's contents, and all branches that hold them, are at their host's threshold or above; ``low`` has by how much others lie below."""
    whole = any(b.element.content and not b.element.apart for b in page.blocks)
    nothing = (None, None)
    memo: dict[int, bool] = {}

    def gone(margin: float | None, e: Element, outside: bool = False) -> bool:
        feature = APART_FEATURE if e.apart else OUTSIDE_FEATURE if outside else INSIDE_FEATURE if e.content else 0.0
        return (UNKNOWN if margin is None else margin) + feature < 0

    def cut(e: Element) -> bool:
        line, at = [], e
        while at is not None and id(at) not in memo:
            line.append(at)
            at = at.above()
        found = memo[id(at)] if at is not None else False
        for at in reversed(line):
            found = memo[id(at)] = found or gone(low.get(at.node, nothing)[1], at)
        return found

    return [b.text for b in page.blocks if not gone(low.get(b.element.node, nothing)[0], b.element, whole and not b.element.content) and not cut(b.element)]


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, found in slices(batches, 4 << 20):
        lows = [{x["node"]: (x["own"], x["branch"]) for x in low or ()} for low in batch.column("low").to_pylist()]
        out = ["\n".join(main_blocks(read_page(raw.decode("utf-8", "ignore")), low)) for raw, low in zip(found, lows, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", presentation: float = 0.1, times: float = TIMES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty html give an empty text. A null url, or one without a host, is
    of the host ''. Pages of equal content count once for their host's tree, so
    copies do not make an article look like a template; a host of one page, or one
    whose nodes are all alike, has no low branches and is judged by names alone. A
    page of which all is cut has an empty text. Repeated rows and ids give repeated
    results. Memory grows with a page's length alone, however deep it is nested.
    """
    ship(pages.sparkSession)
    begun = staged()
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("host", "text"))  # pages of equal html hold equal nodes
    seen = stage(rows.select("host", "row", "text").mapInArrow(observed, SEEN).withColumn("uid", F.monotonically_increasing_id()), "tree-pages")
    low = stage(low_of_pages(seen, low_branches(seen, presentation, times)), "tree-low-pages")
    release(pages.sparkSession, begun, but=1)
    kind = rows.schema["page_id"].dataType.simpleString()
    joined = rows.join(low, "row", "left").select("page_id", "url", "low", "text")
    return joined.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
