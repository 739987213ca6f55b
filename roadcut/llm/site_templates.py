"""Main text of HTML pages by removal of site templates."""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.llm import _io

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Text around the start and the end of these belongs to one block.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP = _RAW | set("nav header footer aside form menu head button select option input svg canvas object embed dialog fieldset audio video map math".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar", "status"}
#: Words in class or id that mark what isn't the article.
_MARKS = set("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
nav navbar navigation menu submenu breadcrumb breadcrumbs topbar toolbar masthead header footer sidebar side aside
widget widgets cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup
login share sharing social related recommended comment comments commentlist respond reply replies disqus form search
pagination pager skip copyright legal""".split())
_TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "article", "main", "body", "html"}
#: A start tag that ends open elements: those named, up to the nearest of the others.
_P_ENDS = set("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_FENCE = {"article", "main", "body", "html", "div", "section", "table", "td", "th", "ul", "ol", "blockquote", "aside", "nav", "header", "footer", "form", "li"}


class Node:
    __slots__ = ("tag", "marks", "drop", "kids", "digest", "text")

    def __init__(self, tag: str, marks: str, drop: bool):
        self.tag, self.marks, self.drop, self.kids, self.digest, self.text = tag, marks, drop, [], 0, False


def _start(tag: str, raw: str) -> Node:
    marks, drop = "", tag in _DROP
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                marks += f" {value}"
                drop |= tag not in ("body", "html", "article", "main") and not _MARKS.isdisjoint(re.split(r"[^a-z]+", value))
            elif name == "role":
                drop |= value in _ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                drop = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                drop = True
    return Node(tag, marks, drop)


def parse(page: str) -> Node:
    """Element tree of any text: unknown, unclosed and misplaced tags don't stop it."""
    root = Node("html", "", False)
    stack, at = [root], 0

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].kids.append(page[a:b])

    while m := _TAG.search(page, at):
        text(at, m.start())
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag == "html":
            continue
        ends, fence = ({"p"}, _FENCE) if tag in _P_ENDS else _ENDS.get(tag, ((), ()))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in fence:
                    break
        node = _start(tag, raw)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not raw.endswith("/"):
            stack.append(node)
    text(at, len(page))
    _digests(root)
    return root


def _digests(root: Node) -> None:
    """Hash of every subtree: its tag, class and id, texts and subtrees in order."""
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(k, False) for k in node.kids if type(k) is Node]
            continue
        h = hashlib.blake2b(f"{node.tag}|{node.marks}".encode(), digest_size=8)
        for k in node.kids:
            if type(k) is Node:
                h.update(b"\1" + k.digest.to_bytes(8, "little", signed=True))
                node.text |= k.text
            elif said := " ".join(k.split()):
                h.update(b"\2" + said.encode("utf-8", "surrogatepass"))
                node.text = True
        node.digest = int.from_bytes(h.digest(), "little", signed=True)


def subtrees(root: Node) -> set[int]:
    """Digests of the elements with text, inline ones aside."""
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        kids = [k for k in node.kids if type(k) is Node and k.text]
        todo += kids
        if node.tag not in _INLINE and node is not root:
            out.add(node.digest)
    return out


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the article, in page order, one a line.

    Dropped: subtrees of the template (inside an article only containers, since a repeated paragraph is its author's),
    elements that aren't content by tag, role, class or id. If elements named article are left, they are the content;
    else one named main; else all.
    """

    def gone(node: Node, inside: bool) -> bool:
        return node.drop or node.digest in template and not (inside and node.tag in _TEXT_BLOCKS)

    def first(tag: str) -> list[Node]:
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag and node.text:
                found.append(node)
            elif not (node.drop and node.tag not in ("header",)):
                todo += [k for k in reversed(node.kids) if type(k) is Node]
        return found

    tops = first("article") or first("main")
    inside, tops = bool(tops), tops or [root]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if said := " ".join(entities.unescape("".join(line)).split()):
            blocks.append(said)
        line.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            k = todo.pop()
            if k is None:
                flush()
            elif type(k) is str:
                line.append(k)
            elif k is not top and gone(k, inside):
                if k.tag not in _INLINE:
                    flush()
            elif k.tag in _INLINE:
                todo += reversed(k.kids)
            else:
                flush()
                todo.append(None)
                todo += reversed(k.kids)
        flush()
    return "\n".join(blocks)


def host_of(url: str) -> str:
    """Column expression: the host of a URL in lower case without port and user; empty if null."""
    return f"lower(regexp_extract(coalesce({url}, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def templates(pages: DataFrame, share: float = 0.3, least: int = 5) -> DataFrame:
    """host, template (array of digests): subtrees on at least ``share`` of a host's pages and on ``least`` of them.

    A page counts once for each of its subtrees, so the digests of a host are at most 1 / share times the subtrees of
    its mean page, however many pages it has.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                host, digest = [], []
                for h, page in zip(batch.column("host")[i : i + 256].to_pylist(), batch.column("html")[i : i + 256].to_pylist()):
                    found = list(subtrees(parse(page)))
                    host += [h] * (len(found) + 1)
                    digest += [None, *found]
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(digest, pa.int64())], names=["host", "digest"])

    p = pages.select(F.expr(host_of("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    counts = p.mapInArrow(run, "host string, digest long").groupBy("host", "digest").agg(F.count("*").alias("n"))
    # the null digest counts the pages; only subtrees of several pages go on
    counts = _io.stored(counts.where(F.col("digest").isNull() | (F.col("n") >= least)), "subtrees")
    of = counts.where("digest IS NULL").select("host", F.col("n").alias("pages"))
    often = counts.where("digest IS NOT NULL").join(of, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("digest").alias("template"))


#: Bytes of templates up to which they are sent to all executors.
BROADCAST_BYTES = 8 << 20


def extract(pages: DataFrame, share: float = 0.3, least: int = 5) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points), n_template (digests known for the host).

    Null html: empty text. Null url: the empty host, a host like others. Text that isn't HTML is one block. Rows that
    repeat are returned each. An empty table gives no rows. Columns other than page_id, url and html are not read.
    """
    p = _io.small_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.expr(host_of("url")).alias("host"))
    found = _io.stored(templates(p, share, least), "templates")
    size = found.agg(F.sum(F.size("template") * 8 + F.octet_length("host") + 32).alias("n")).first().n or 0
    found = found.withColumnRenamed("host", "of_host")
    # few hosts: sent to all; else joined by host, where Spark splits hosts with many pages
    joined = p.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, p["host"] == found["of_host"], "left")

    def run(batches):
        for batch in batches:
            template = batch.column("template").to_pylist()
            text = [main_text(parse(h), frozenset(t or ())) for h, t in zip(batch.column("html").to_pylist(), template)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(t or ()) for t in template], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    return joined.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_template long")


def op1_site_templates(spark, sf_dir: str) -> DataFrame:
    return extract(_io.table(spark, sf_dir, "pages"))
