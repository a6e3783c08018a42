"""HTML extraction with site style trees.

The pages of a host are merged into one tree whose nodes are element paths. A node's presentation importance is the
entropy of the ways its children are laid out over pages; its content importance falls with the entropy of its texts over
pages, that is, with how many pages share them. Branches that hold no important node are removed from each page. Where
a host has few pages, the tree of all hosts speaks with it. HTML's own sectioning says some things outright: navigation,
headers, footers, asides, forms and the like are never main text. An article is a prior: nodes inside it start as
important, those outside it, on a page that has one, as unimportant, and the host's pages can outweigh both.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import free_name, strings
from gavilla.operators.keys import attach
from gavilla.session import materialise

LOW = 0.35  # branches of lower importance go
BACKGROUND = 5.0  # weight of the tree of all hosts, in pages
PRIOR = 5.0  # weight of what a page's article says of a node inside or outside it, in pages
PLAIN_PAGES = 3  # a node on fewer pages of all hosts together is not judged
BROADCAST_CHARS = 16_000_000  # paths of verdicts that are broadcast by host; more are joined page by page,
HOST_ROWS = 1_000  # as are those of a host with more verdicts

# Elements that hold no main text.
FURNITURE = set(
    "script style template noscript nav footer aside form button select option textarea input iframe object embed svg canvas "
    "audio video map dialog menu head title meta link".split()
)
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noframes"}
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
BLOCKS = set(
    "html body p div article section main ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary hr center".split()
)
# Words of class, id or role that mark furniture and reader comments; all words of one name have to be here.
NAMES = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup "
    "modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer masthead topbar toolbar share sharing social related recommended widget comment comments discussion disqus "
    "reply replies respond pagination pager search complementary contentinfo alert".split()
)
INNER = {"article", "main"}
WHOLE = {"html", "body"}  # elements whose names speak of the whole page
# Start tags that end an open element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z0-9]+")


class Block:
    """One block of text with the path of its element."""

    __slots__ = ("path", "text", "inner", "pieces")

    def __init__(self, path, inner, pieces):
        self.path, self.text, self.inner, self.pieces = path, "", inner, pieces


def blocks_of(html: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks outside furniture in page order, and for each path of elements the kinds of its block children in order.

    What an element's names say is settled at the end, when it is known how much of the page's text it holds.
    """
    html = html or ""
    # tag, path, furniture by tag, inside the article, numbers of the elements around that names mark
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
    held_main: set[int] = set()  # marked elements around a main element
    n_marks = 0
    found: list[Block] = []
    children: dict[str, list[str]] = {}
    held: list[tuple[str, tuple[int, ...]]] = []  # pieces of text, each with the marked elements around it

    def flush():
        if held:
            if any(not piece.isspace() for piece, _ in held if piece):
                found.append(Block(stack[-1][1], stack[-1][3], held.copy()))
            held.clear()

    at, size = 0, len(html)
    while at < size:
        match = MARKUP.search(html, at)
        if match is None:
            if not stack[-1][2]:
                held.append((html[at:], stack[-1][4]))
            break
        if not stack[-1][2]:  # nothing of furniture is kept
            held.append((html[at : match.start()], stack[-1][4]))
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCKS or tag in FURNITURE
        if match[1]:  # end tag
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if not depth or (not block and any(s[0] in BLOCKS for s in stack[depth + 1 :])):
                continue
            if block or any(s[0] in BLOCKS for s in stack[depth:]):
                flush()
            del stack[depth:]
            continue
        words, named = set(), False
        for value in NAMED.findall(match[3]) if match[3] else ():
            for name in "".join(value).lower().split():
                parts = PART.findall(name)
                words.update(parts)
                named = named or (not NAMES.isdisjoint(parts) and all(w in NAMES or w.isdigit() for w in parts))
        named = named and tag not in WHOLE
        _, path, furniture, inner, marks = stack[-1]
        mark = tag in FURNITURE or (tag == "header" and not inner)
        if block:
            flush()
        if tag in VOID:
            if tag == "br":
                held.append((" ", ()))
            continue
        if block:
            # What this start tag ends: an open paragraph, or an element of the same list or table.
            ends, until = CLOSES.get(tag, (set(), set()))
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in until or (name in BLOCKS and name not in ends and name != "p"):
                    break
                if name in ends or name == "p":
                    del stack[k:]
            _, path, furniture, inner, marks = stack[-1]
        if block or mark or named:
            kind = tag + "".join(sorted("." + w for w in words if not w.isdigit()))[:60]
            siblings = children.setdefault(path, [])
            if not siblings or siblings[-1] != kind:
                siblings.append(kind)
            path = f"{path}>{kind}" if path else kind
        if named:
            n_marks += 1
            marks = (*marks, n_marks)
        if tag == "main":
            held_main.update(marks)
        stack.append((tag, path, furniture or mark, inner or (tag in INNER and not furniture), marks))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else size
    flush()
    return _unmarked(found, held_main), children


def _unmarked(found: list[Block], held_main: set[int]) -> list[Block]:
    """The blocks outside elements whose names mark furniture.

    Names do not count where the element holds the page's main, or most of the text of a page without an article elsewhere.
    """
    free = set(held_main)
    sizes: dict[int, int] = {}
    total, article = 0, False
    for b in found:
        for piece, marks in b.pieces:
            size = len(piece.strip())
            total += size
            article = article or (size > 0 and b.inner and free.issuperset(marks))
            for mark in marks:
                sizes[mark] = sizes.get(mark, 0) + size
    if not article:
        free.update(mark for mark, size in sizes.items() if 2 * size > total)
    for b in found:
        b.text = " ".join(unescape("".join(piece for piece, marks in b.pieces if free.issuperset(marks))).split())
        b.pieces = ()
    return [b for b in found if b.text]


# Where a block stands: inside an article, outside it on a page that has one, or on a page without one.
INSIDE, OUTSIDE, NEITHER = "+", "-", ""


def placed(kept: list[Block]) -> list[tuple[str, Block]]:
    """The blocks of a page, each with its place."""
    outer = OUTSIDE if any(b.inner for b in kept) else NEITHER
    return [(INSIDE if b.inner else outer, b) for b in kept]


def main_text(html: str | None, judged: frozenset[str] | set[str] = frozenset()) -> str:
    """The blocks outside furniture that the verdicts leave, one per line.

    ``judged`` holds branches with their place before them: low ones, which go, and for blocks outside the article the
    important paths, which stay.
    """
    kept, _ = blocks_of(html)
    stays = lambda place, b: place + b.path in judged if place == OUTSIDE else not _under(place, b.path, judged)
    return "\n".join(b.text for place, b in placed(kept) if stays(place, b))


def _under(place: str, path: str, low) -> bool:
    return bool(low) and any(place + branch in low for branch in _branches(path))


def _branches(path: str) -> list[str]:
    parts = path.split(">")
    return [">".join(parts[: k + 1]) for k in range(len(parts))]


def _branches_column() -> F.Column:
    parts = F.split("path", ">")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ">"))


# -- style trees -----------------------------------------------------------------------------------

NODES = "array<struct<place: string, path: string, style: bigint, texts: array<bigint>>>"


def with_nodes(pages: DataFrame, out: str) -> DataFrame:
    """``pages`` with ``out``: for each path of the page outside furniture its place, a hash of its layout and the hashes of its texts."""
    import xxhash

    number = lambda text: int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64))

    @F.arrow_udf(NODES)
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for html in strings(column):
            kept, children = blocks_of(html)
            texts: dict[tuple[str, str], set[int]] = {}
            for place, b in placed(kept):
                texts.setdefault((place, b.path), set()).add(number(b.text))
            rows.append(
                [
                    {"place": at, "path": p, "style": number("|".join(children.get(p, []))), "texts": sorted(t)}
                    for (at, p), t in sorted(texts.items())
                ]
            )
        kind = pa.struct([("place", pa.string()), ("path", pa.string()), ("style", pa.int64()), ("texts", pa.list_(pa.int64()))])
        return pa.array(rows, pa.list_(kind))

    return pages.withColumn(out, of(F.col("html").cast("string")))


def importance(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, path, pages, own) of nodes (*keys, page, path, style, texts): mean of the node's two importances.

    Content: 1 - mean over its texts of log(pages with the text) / log(pages); the entropy of a text that k of m pages
    share is log k / log m. Presentation: entropy of the layouts over pages, in units of log m. A node on one page is
    fully important. Everything is a grouped count, combined in the tasks before it is shuffled.
    """
    group = [*keys, "path"]
    pages = nodes.groupBy(*group).agg(F.count("*").alias("pages"))
    scale = F.log(F.greatest(F.col("pages"), F.lit(2)))
    texts = nodes.select(*group, F.explode("texts").alias("t")).groupBy(*group, "t").agg(F.count("*").alias("k"))
    texts = texts.groupBy(*group).agg(F.sum("k").alias("uses"), F.sum(F.col("k") * F.log("k")).alias("shared"))
    styles = nodes.groupBy(*group, "style").agg(F.count("*").alias("k")).groupBy(*group)
    styles = styles.agg(F.sum(F.col("k") * F.log("k")).alias("same"))
    content = 1 - F.col("shared") / F.col("uses") / scale
    layout = (F.log("pages") - F.col("same") / F.col("pages")) / scale
    own = F.when(F.col("pages") > 1, 0.8 * content + 0.2 * layout).otherwise(F.lit(1.0))
    joined = pages.join(texts, group).join(styles, group)
    return joined.select(*group, "pages", own.alias("own"))


def verdicts(nodes: DataFrame) -> DataFrame:
    """(host, place, path) of the branches that decide: the low ones, in which no node has an importance of LOW or more.

    Of places outside the article of a page the others are given instead, since there a branch that is not judged goes.
    """
    by_host = materialise(importance(nodes, ["host"]), "host-tree")
    overall = importance(nodes, []).select("path", F.col("own").alias("overall"), F.col("pages").alias("everywhere"))
    both = by_host.join(overall, "path").where(F.col("everywhere") >= PLAIN_PAGES)
    both = both.join(nodes.select("host", "path", "place").distinct(), ["host", "path"])
    known = F.when(F.col("place") == NEITHER, F.lit(0.0)).otherwise(F.lit(PRIOR))
    said = F.when(F.col("place") == INSIDE, F.lit(PRIOR)).otherwise(F.lit(0.0))
    mixed = (F.col("own") * F.col("pages") + F.col("overall") * BACKGROUND + said) / (F.col("pages") + BACKGROUND + known)
    above = both.select("host", "place", mixed.alias("mixed"), F.explode(_branches_column()).alias("path"))
    most = above.groupBy("host", "place", "path").agg(F.max("mixed").alias("most"))
    return most.where((F.col("most") < LOW) != (F.col("place") == OUTSIDE)).select("host", "place", "path")


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """``pages`` (url, html, ...) with ``out``, the main text of each.

    A first pass writes the nodes of all pages; the host's tree is worked out from counts; and each page, joined with the
    verdicts of its host (by broadcast) or, where these are many, of its own nodes, is rendered in a second pass. Null and
    empty pages have an empty text. Rows that repeat get the same text, and a host's equal pages count once in its tree; a
    page without a url belongs to a host of its own, the empty one.
    """
    key, site, judged = free_name(pages, "_page"), free_name(pages, "_host"), free_name(pages, "_judged")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.lit("")))
    marked = pages.withColumn(site, host).withColumn(key, F.xxhash64(F.col(site), F.col("html")))
    nodes = with_nodes(marked.select(F.col(key).alias("page"), F.col(site).alias("host"), "html"), "nodes")
    nodes = nodes.where(F.size("nodes") > 0).select("page", "host", F.inline("nodes"))
    nodes = materialise(nodes.distinct(), "page-nodes")  # copies of a page count once
    decided = materialise(verdicts(nodes), "verdicts")
    sizes = decided.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("path") + F.length("host")).alias("chars"))
    most, chars = sizes.agg(F.max("n"), F.sum("chars")).first()
    if (most or 0) <= HOST_ROWS and (chars or 0) <= BROADCAST_CHARS:
        of_host = decided.groupBy("host").agg(F.collect_set(F.concat("place", "path")).alias(judged)).withColumnRenamed("host", site)
        joined = marked.join(F.broadcast(of_host), site, "left")
    else:
        joined = marked.join(_of_page(nodes, decided, judged).withColumnRenamed("page", key), key, "left")

    @F.arrow_udf("string")
    def text_of(html: pa.Array, judged: pa.Array) -> pa.Array:
        return pa.array([main_text(h, set(g or ())) for h, g in zip(strings(html), judged.to_pylist())], pa.string())

    return joined.withColumn(out, text_of(F.col("html").cast("string"), F.col(judged))).drop(key, site, judged)


def _of_page(nodes: DataFrame, decided: DataFrame, out: str) -> DataFrame:
    """(page, out) with the verdicts that each page's own nodes meet."""
    paths = nodes.select("host", "place", "path").distinct()
    paths = paths.select("host", "place", "path", F.explode(_branches_column()).alias("branch"))
    hit = paths.join(decided.withColumnRenamed("path", "branch"), ["host", "place", "branch"]).groupBy("host", "place", "path")
    hit = hit.agg(F.collect_set(F.concat("place", "branch")).alias("gone"))
    sizes = nodes.groupBy("host", "place", "path").agg(F.count("*").alias("n"))
    hit = materialise(hit.join(sizes, ["host", "place", "path"]), "low-paths")
    total = hit.agg(F.sum("n")).first()[0] or 0
    of_page = attach(nodes.select("page", "host", "place", "path"), hit, ["host", "place", "path"], total, "n").groupBy("page")
    return of_page.agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias(out))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
