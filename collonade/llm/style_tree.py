"""HTML extraction by site style trees.

The pages of a host are laid over each other: elements with the same path of tags
and classes are one node, which remembers in how many pages it occurs, how it is
laid out (its children in runs, and how much text of its own it has) and which
texts it holds.  Two entropies say what a node tells:

* presentation: the entropy of its layouts, zero if all pages show the same;
* content: one less the mean entropy of its texts over the pages, zero if every
  page has the same texts and one if each has its own.

A node with texts weighs its content by the largest presentation entropy on its
line, from the root through it to what lies below, as a share of the most that a
node of the host has.  A branch is as important as its most important node, and
branches of low importance are removed from each page: menus, headers, footers
and adverts repeat their texts or keep their shape, articles do neither.  Inside a
block of content, an element with important texts right below it, what repeats may be
the article's all the same: headings, captions, tables, lists and bylines stay there, and
so does anything whose texts are several, unless its names tell another use.

Entropies need pages: a node in under ``fewest`` pages is judged by its tag, role
and class names alone, and on hosts where that holds for all nodes an article or
main element, if there is one, is the text.  Scripts, forms, hidden parts and
reader comments go by their names on every host, since comments vary as articles
do; but no class name removes what holds over half of a page's words.

Spark merges the trees: pages give (host, node, feature) counts, pre-aggregated in
each batch, and the importances are grouped aggregates over them.  Each page is
joined with the verdicts on its own nodes only, salted, so that a host with a third
of all pages costs no more than others.

Defined results: a null or empty page has an empty text; a null url is a host of
its own; repeated pages count as often as they occur; pages of any length are read
whole; of ties in importance all stay; an empty table gives no rows; only the
columns asked for are carried, so other names can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import join_sized, keep

#: Pages that a node must occur in to be judged by the tree, and the importance below which a branch is removed.
FEWEST, LOW = 12, 0.65
#: The content from which a node of low importance stays in a block of content.
SEVERAL = 0.2
#: What every presentation entropy has added, in nats, so that a host whose pages all have one shape is judged by content.
FLOOR = 0.1
#: Pages that a task holds as Python objects at once.
SLICE = 256
#: Levels of a tree; what lies deeper counts as part of its ancestor on the last level.
DEPTH = 256
#: Parts that the pages of a host are dealt to, where the verdicts are too many to be broadcast.
SALTS = 16
# Elements of HTML by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
NEVER_TEXT = set("head form script style noscript iframe template button select option textarea input svg canvas object title".split())
COMMENT_NAMES = set("comment comments disqus replies respond".split())
FRAME_TAGS = set("nav header footer aside dialog menu".split())
FRAME_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
FRAME_NAMES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget widgets copyright legal disclaimer".split())
CONTENT = {"article", "main"}
# Elements and names that belong to the content that they stand in.
CONTENT_PARTS, SECTION_HEADS = set("h1 h2 h3 h4 h5 h6 figure figcaption table caption thead tbody tfoot tr th td ul ol li dl dt dd blockquote pre".split()), set("h2 h3 h4 h5 h6".split())
CONTENT_NAMES = set("author byline caption credit dateline headline subtitle".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|([^<]++|<)""", re.S)
#: What ends an element whose content holds no tags.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BARE_ATTRIBUTE = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.I)
NAMES = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")


def hashed(s: str, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(s, seed & 0xFFFFFFFFFFFFFFFF)
    return h - (h >> 63 << 64)


class Element:
    """An open element: its node, the nodes from the root to it, and what its names and those above say."""

    __slots__ = ("above", "article", "chain", "label", "named", "never", "node", "part", "tag")

    def __init__(self, tag: str, attributes: str, above: Element | None, count: int):
        # Most attributes tell nothing here (links, images).
        self.label, hidden, role, frame, comment, self.part = told(tag, attributes if attributes and TELLING.search(attributes) else "")
        self.tag, self.above = tag, above
        chain = above.chain if above else ()
        if len(chain) < DEPTH:
            self.node = hashed(self.label, above.node if above else 0)
            self.chain = (*chain, self.node)
        else:
            self.node, self.chain = chain[-1], chain
        self.never = hidden or (above is not None and above.never)
        inside = above is not None and above.article
        frame = frame or role or tag in FRAME_TAGS and not (tag == "header" and inside)
        self.named = above.named if above else ()
        if (frame or comment) and tag not in ("html", "body"):
            self.named = (*self.named, (count, comment, self.node))
        self.article = inside or tag in CONTENT


TELLING = re.compile("class|id|role|hidden", re.I)


@lru_cache(maxsize=4096)
def told(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """What a tag says by itself: its label, whether it never holds text, whether its role, its names or its comment names tell no content, and whether it is a part of what it stands in."""
    found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    parts = set(NAMES.findall(names))
    label = tag + ("." + DIGITS.sub("0", " ".join(sorted(names.split()))) if names.strip() else "")
    hidden = tag in NEVER_TEXT or found.get("aria-hidden") == "true" or BARE_ATTRIBUTE.search(attributes) is not None
    frame = not FRAME_NAMES.isdisjoint(parts)
    part = not frame and (tag in CONTENT_PARTS or not CONTENT_NAMES.isdisjoint(parts))
    return label, hidden, found.get("role", "").lower() in FRAME_ROLES, frame, not COMMENT_NAMES.isdisjoint(parts), part


def walk(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """Events of a page in its order: ("open", element, ""), ("text", element it is in, text), ("break", None, tag)."""
    stack: list[Element] = []
    opened: Counter = Counter()
    at = count = 0

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    while m := TOKEN.search(page, at):
        at = m.end()
        closing, tag, attributes, text = m[1], m[2], m[3], m[4]
        if text is not None:
            yield "text", stack[-1] if stack else None, text
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            while opened[tag]:
                name = stack[-1].tag
                cut(len(stack) - 1)
                if name not in INLINE:
                    yield "break", None, name
                if name == tag:
                    break
            continue
        for k in range(len(stack) - 1, -1, -1):  # elements whose end tag may be left out
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                cut(k)
                break
            if stack[k].tag not in INLINE and stack[k].tag not in CLOSED_BY:
                break
        if tag not in INLINE or tag == "br":
            yield "break", None, tag
        count += 1
        element = Element(tag, attributes, stack[-1] if stack else None, count)
        yield "open", element, ""
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            else:
                stack.append(element)
                opened[tag] += 1


def outline(page: str) -> tuple[Counter, dict[int, tuple[int, ...]]]:
    """What a page adds to its host's tree: (node, kind, feature) with 0 for the node itself, 1 for a layout's hash and 2 for a text's; and the nodes from the root to each."""
    chains: dict[int, tuple[int, ...]] = {}
    shapes: dict[int, tuple[Element, list[list], list[int]]] = {}  # of each element: runs of like children, words of its own
    out: Counter = Counter()
    for kind, e, what in walk(page):
        if e is None or e.never:
            continue
        if kind == "open":
            chains[e.node] = e.chain
            shapes[id(e)] = (e, [], [0])
            if e.above is not None and id(e.above) in shapes:
                runs = shapes[id(e.above)][1]
                if runs and runs[-1][0] == e.label:
                    runs[-1][1] += 1
                else:
                    runs.append([e.label, 1])
        elif text := " ".join(what.split()):
            if id(e) in shapes:
                shapes[id(e)][2][0] += text.count(" ") + 1
            out[e.node, 2, hashed(text)] = 1
    for node in chains:
        out[node, 0, 0] = 1
    for e, runs, words in shapes.values():
        # Words count by powers of four, so that small differences are none.
        out[e.node, 1, hashed(" ".join(f"{label}*{n}" for label, n in runs) + f"#{(words[0].bit_length() + 1) // 2}")] += 1
    return out, chains


def text_of(page: str, low: set[int], judged: set[int], several: frozenset | set = frozenset(), content: frozenset | set = frozenset()) -> str:
    """The blocks of the page that stay, each with its white space made single, joined by single spaces.

    low, several and content are nodes of low importance, those of them with several texts, and blocks of content.
    """
    blocks: list[list[tuple[Element, str]]] = [[]]
    words: Counter = Counter()
    whole = 0
    for kind, e, what in walk(page):
        if kind == "break":
            if what == "br":
                if blocks[-1]:
                    blocks[-1].append((blocks[-1][-1][0], " "))
            elif blocks[-1]:
                blocks.append([])
        elif kind == "text" and e is not None and not e.never:
            blocks[-1].append((e, entities.unescape(what)))
            n = len(what.split())
            whole += n
            for at, _, _ in e.named:
                words[at] += n
    kept: dict[int, bool] = {}
    lines: dict[int, tuple[bool, bool]] = {}

    def line(e: Element) -> tuple[bool, bool]:
        """Whether the tree lets an element stay, and whether only as a part of the content around it."""
        todo = []
        while e is not None and id(e) not in lines:
            todo.append(e)
            e = e.above
        got = lines[id(e)] if e is not None else (True, False)
        for x in reversed(todo):
            if x.node in low and got[0]:
                own_name = bool(x.named) and x.named[-1][2] == x.node
                # What stands right in the body may frame the text as well; there only section headings are its parts.
                part = x.part or x.node in several
                if x.above is not None and x.above.tag in ("body", "html"):
                    part = x.tag in SECTION_HEADS
                inside = x.above is not None and x.above.node in content and not own_name and part
                got = (inside or got[1], inside or got[1])
            lines[id(x)] = got
        return got

    def stays(e: Element) -> bool:
        if id(e) not in kept:
            kept[id(e)] = line(e)[0] and not any((always or node not in judged) and 2 * words[at] <= whole for at, always, node in e.named)
        return kept[id(e)]

    texts = [("".join(t for e, t in block if stays(e)), any(e.article for e, _ in block if stays(e))) for block in blocks]
    texts = [(" ".join(t.split()), inside) for t, inside in texts]
    narrow = not judged and any(inside and t for t, inside in texts)
    return " ".join(t for t, inside in texts if t and (inside or not narrow))


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


OUTLINE = "host string, page bigint, node bigint, kind int, feature bigint, n bigint, chain array<bigint>, nodes array<bigint>"
#: The kind of rows that list a page's nodes.
PAGE = 3


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE rows."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def outlines(pages: DataFrame) -> DataFrame:
    """What one walk of each page (host, page, html) tells: rows (host, node, kind, feature, n, chain), summed up in each slice, and rows (host, page, nodes) of kind PAGE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            total: Counter = Counter()
            chains: dict[tuple[str, int], tuple[int, ...]] = {}
            own: list[tuple] = []
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                features, lines = outline(text or "")
                for k, n in features.items():
                    total[host, *k] += n
                for node, chain in lines.items():
                    chains[host, node] = chain
                own.append((host, page, None, PAGE, None, None, None, list(lines)))
            rows = [(host, None, node, kind, feature, n, chains[host, node] if kind == 0 else None, None) for (host, node, kind, feature), n in total.items()]
            columns = [[r[i] for r in rows] + [r[i] for r in own] for i in range(8)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUTLINE.split(", ")])

    return pages.select("host", "page", "html").mapInArrow(run, OUTLINE)


def style_tree(pages: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(host, node, pages, presentation, content, importance) of the nodes of pages (host, html), see importances()."""
    outlined = keep(outlines(pages.select("host", F.xxhash64("html").alias("page"), "html")), "style-outlines")
    return importances(outlined, fewest).drop("parent", "own")


def importances(outlined: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(host, node, parent, pages, presentation, content, importance, own) of each node that occurs in enough pages; importance is a branch's, own that of its own texts, null if there are none."""
    seen = outlined.where(F.col("kind") < PAGE).groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.any_value("chain").alias("chain"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    nodes = seen.groupBy("host", "node").agg(
        F.sum(of(0, F.col("n"))).alias("pages"),
        F.max(of(0, F.col("chain"))).alias("chain"),
        F.sum(of(1, F.col("n"))).alias("layouts"),
        F.sum(of(1, F.col("n") * F.log("n"))).alias("nlogn"),
        F.sum(of(2, F.col("n"))).alias("texts"),
        F.sum(of(2, F.col("n") * F.log("n"))).alias("tlogt"),
    )
    m = F.greatest(F.log("pages"), F.lit(1e-9))
    presentation = F.greatest(F.log("layouts") - F.col("nlogn") / F.col("layouts"), F.lit(0.0))
    content = F.greatest(1 - F.col("tlogt") / F.col("texts") / m, F.lit(0.0))  # a text in k of m pages has the entropy log_m(k)
    nodes = keep(nodes.where(F.col("pages") >= fewest).select("host", "node", "pages", "chain", presentation.alias("presentation"), content.alias("content")), "style-nodes")
    up = nodes.select("host", F.explode("chain").alias("above"), "node", "presentation")
    down = up.groupBy("host", F.col("above").alias("node")).agg(F.max("presentation").alias("below"))
    line = up.join(nodes.select("host", F.col("node").alias("above"), F.col("presentation").alias("p")), ["host", "above"]).groupBy("host", "node").agg(F.max("p").alias("over"))
    own = nodes.join(down, ["host", "node"]).join(line, ["host", "node"]).withColumn("own", F.col("content") * (F.greatest("below", "over") + FLOOR))
    branch = own.select("host", F.explode("chain").alias("node"), "own").groupBy("host", "node").agg(F.max("own").alias("branch"))
    most = own.groupBy("host").agg(F.max("own").alias("most"))
    out = nodes.join(branch, ["host", "node"]).join(own.select("host", "node", "own"), ["host", "node"]).join(most, "host")
    share = lambda c: F.col(c) / F.greatest("most", F.lit(1e-9))
    parent = F.get("chain", F.size("chain") - 2)
    return out.select("host", "node", parent.alias("parent"), "pages", "presentation", "content", share("branch").alias("importance"), share("own").alias("own"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", fewest: int = FEWEST, low: float = LOW) -> DataFrame:
    """(key, url, text) of each page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("url", "html"))
    outlined = keep(outlines(rows), "style-outlines")
    judged = keep(importances(outlined, fewest), "style-tree")
    is_low = F.coalesce(F.col("importance") < low, F.lit(False))
    holds = judged.where((F.col("own") >= low) & F.col("parent").isNotNull()).select("host", F.col("parent").alias("node"), F.lit(True).alias("block")).distinct()
    several = is_low & F.coalesce(F.col("content") >= SEVERAL, F.lit(False))
    tree = judged.select("host", "node", is_low.alias("low"), several.alias("several")).join(holds, ["host", "node"], "left")
    tree = keep(tree.withColumn("block", F.coalesce("block", F.lit(False))), "style-verdicts")

    # A page is known by its host and content, so that the two passes over the table need no common numbering.
    own = outlined.where(F.col("kind") == PAGE).select("host", "page", F.explode("nodes").alias("node"))
    met = join_sized(own, tree, ["host", "node"], salt=F.pmod("page", F.lit(SALTS)).cast("int"), salts=SALTS)
    those = lambda c: F.collect_set(F.when(F.col(c), F.col("node"))).alias(c)
    verdicts = keep(met.groupBy("host", "page").agg(F.collect_set("node").alias("judged"), those("low"), those("several"), those("block")), "page-verdicts")
    joined = join_sized(rows, verdicts, ["host", "page"], "left").select("key", "url", "html", "low", "judged", "several", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [text_of(page or "", *(set(x or ()) for x in nodes)) for page, *nodes in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, url string, text string").withColumnRenamed("key", key)


def digests(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    """What op7 returns."""
    return extracted.select(key, "url", "text", F.length("text").cast("bigint").alias("n_chars"))
