"""Main text of web pages, with site templates removed.

Two passes. The first parses each page into a tree and emits a hash of every element subtree that has text;
Spark counts, for each host, on how many pages *with different main text* a hash occurs (copies of one
article are one page here, else a much-copied article would be a template). Hashes on at least
LEAST_PAGES such pages and LEAST_SHARE of the host's are templates. The second pass parses again and
writes the text of the page without template subtrees, menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments; nothing else is left out, wherever it stands. Subtrees of the whole page are counted, and templates go inside
articles too; only what stands in a line with other text (a bold word, a cell of a row) is no template by itself.

Each block's white space becomes one space, blocks are joined by one newline in page order.

Null html gives an empty text; a null or odd URL is the host ''. A page of any size or depth is parsed
without recursion. Repeated rows give repeated results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: A subtree with a boilerplate name goes if it has so few characters, so little of the page's text or so much of its own in links.
SMALL, SMALL_SHARE, LINKED_SHARE = 200, 0.25, 0.5

# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("option td th tr tbody thead tfoot caption legend html body".split())
#: An open element (the key) ends where one of these begins.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
#: Those end only inside the nearest of these.
SCOPE = frozenset("ul ol dl table select body html article section div main".split())

# What is never main text: elements, roles, and names: a class or id of WORDS, with PLAIN words at most.
DROPPED = frozenset("script style noscript template iframe object svg canvas form nav aside footer button select textarea input dialog menu head title embed audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar rail footer cookie cookies consent gdpr notice notices alert banner advert advertisement adverts "
    "ad ads adsense sponsor sponsored promo promotion share sharing social comment comments disqus respond related recommended newsletter subscribe subscription signup "
    "login popup modal overlay widget widgets pagination pager toolbar copyright masthead topbar paywall skip".split()
)
PLAIN = frozenset("box block bar wrapper container inner outer list item items links posts articles area section panel site page top bottom main global".split())
CELLS = frozenset(["td", "th"])

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*|[^>]*)>|<(?=[a-zA-Z/!?])[^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z|["'])""", re.I)
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"


class Node:
    __slots__ = ("tag", "named", "names", "role", "hidden", "parent", "items", "size", "linked", "digest", "holds", "inside", "part")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.named, self.names, self.role, self.hidden = (), (), "", False
        self.size = self.linked = 0
        self.digest = b""
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main") or parent.role == "main")
        self.part = False  # of a line with other text
        self.holds = tag in ("article", "main")
        if attributes and not attributes.isspace():
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    self.names = (*self.names, *value.split())
                    self.named = (*self.named, *(w.lower() for w in SPLIT.split(value) if w))
                elif name == "role":
                    self.role = value.lower()
                elif name == "style":
                    self.hidden |= "display:none" in value.replace(" ", "").lower()
                elif name == "hidden" or value.lower() == "true":
                    self.hidden = True
            self.holds |= self.role == "main"

    def dropped(self, total: int) -> bool:
        """Whether this is never main text. total: of the page's text."""
        if self.tag in ("html", "body"):
            return False
        if self.tag in ("article", "main") or self.role == "main":
            return self.named_as(("comment", "comments")) and self.minor(total)
        if self.holds:  # a form, a header or a name around the main text tells nothing of it
            return (self.tag in DROPPED and self.tag != "form") or (self.role in ROLES and self.role != "form")
        if self.tag in DROPPED or self.hidden or self.role in ROLES:
            return True
        if self.tag == "header" and not self.inside:
            return True
        return (self.named_as(WORDS) or (not self.inside and self.named_as(("header",)))) and self.minor(total)

    def named_as(self, words) -> bool:
        """Whether a whole class or id consists of these words, and plain ones."""
        if not any(w in words for w in self.named):
            return False
        for name in self.names:
            parts = [w.lower() for w in SPLIT.split(name) if w]
            if any(w in words for w in parts) and all(w in words or w in PLAIN or w.isdigit() for w in parts):
                return True
        return False

    def minor(self, total: int) -> bool:
        return self.size <= SMALL or self.size <= SMALL_SHARE * total or self.linked > LINKED_SHARE * self.size


def parse(page: str) -> Node:
    """The tree of a page. Subtree hashes, and sizes of all text and of links, are set as elements end."""
    root = top = Node("html", "", None)
    order = [root]
    at, n = 0, len(page)
    while at < n:
        mark = TOKEN.search(page, at)
        stop = mark.start() if mark else n
        if stop > at:
            top.items.append(html.unescape(page[at:stop]))
        if not mark:
            break
        at = mark.end()
        tag = mark[2]
        if not tag:
            continue
        tag = tag.lower()
        if mark[1]:
            found = top
            while found is not root and found.tag != tag:
                found = found.parent
            if found is not root:
                top = found.parent
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            open_p = top
            while open_p is not root and open_p.tag != "p" and open_p.tag not in BLOCK:
                open_p = open_p.parent
            if open_p.tag == "p":
                top = open_p.parent
        look = top
        while look is not root:
            if tag in ENDED_BY.get(look.tag, ()):
                top = look.parent
                break
            if look.tag in SCOPE:
                break
            look = look.parent
        node = Node(tag, mark[3], top)
        top.items.append(node)
        order.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            top = node
    for node in reversed(order):
        hashed = hashlib.blake2b(f"{node.tag}\0{' '.join(node.named)}\0".encode(), digest_size=8)
        for x in node.items:
            if isinstance(x, str):
                words = " ".join(x.split())
                node.size += len(words)
                hashed.update(words.encode("utf-8", "surrogatepass"))
            else:
                node.size += x.size
                node.linked += x.size if x.tag == "a" else x.linked
                hashed.update(b"\1" + x.digest)
        node.digest = hashed.digest()
        _mark_lines(node)
    for node in reversed(order):
        if node.holds and node.parent is not None and not node.dropped(root.size):
            node.parent.holds = True
    for node in order:
        if node.part:
            for x in node.items:
                if not isinstance(x, str) and x.tag not in BLOCK:
                    x.part = True
    return root


def _mark_lines(node: Node) -> None:
    """Marks the elements that stand in a line with other text."""
    line: list[Node] = []
    texts = 0
    for x in [*node.items, None]:
        if isinstance(x, str):
            texts += not x.isspace()
        elif x is None or x.tag == "br" or (x.tag in BLOCK and x.tag not in CELLS):
            if texts > 1:
                for y in line:
                    y.part = True
            line, texts = [], 0
        else:
            texts += x.size > 0
            line.append(x)


def main_parts(root: Node) -> tuple[list[Node]]:
    """The elements whose text is looked at: the whole page."""
    return ([root],)


def _menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "section") and node.size > 0 and node.linked > 0.7 * node.size


def blocks(parts: list[Node], templates: frozenset | set) -> list[str]:
    """The text blocks of these elements."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            if words := " ".join("".join(line).split()):
                out.append(words)
            line.clear()

    total = sum(x.size for x in parts)
    for part in parts:
        stack: list = [part]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x is not part and (x.dropped(total) or (x.digest in templates and not x.part) or (not x.inside and not x.holds and _menu(x))):
                if x.tag in BLOCK:
                    flush()
                continue
            elif x.tag == "br":
                line.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.items))
        flush()
    return out


def subtrees(root: Node) -> set[bytes]:
    """Hashes of the subtrees that could be templates of the site."""
    found: set[bytes] = set()
    stack = [root]
    while stack:
        for x in stack.pop().items:
            if not isinstance(x, str) and x.size:
                if not x.part:
                    found.add(x.digest)
                stack.append(x)
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text and n_chars of every page."""
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"), host.alias("host"))

    def count(batches):
        for batch in small_batches(batches, 0):
            hosts, texts, hashes = [], [], []
            for page, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                text = hashlib.blake2b("\n".join(blocks(*main_parts(root), ())).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                for digest in [b"", *subtrees(root)]:
                    hosts.append(at)
                    texts.append(text)
                    hashes.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.binary()), pa.array(hashes, pa.binary())], ["host", "text", "subtree"])

    seen = rows.select("html", "host").mapInArrow(count, "host string, text binary, subtree binary").distinct()
    per = keep(seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")), "subtree-counts")
    # the row without a subtree counts the host's pages
    all_pages = per.where(F.length("subtree") == 0).select(F.col("host").alias("of"), F.col("n").alias("pages"))
    many = per.where((F.length("subtree") > 0) & (F.col("n") >= LEAST_PAGES)).join(all_pages, F.col("host") == F.col("of"))
    # of a share of LEAST_SHARE there are at most (subtrees of a page) / LEAST_SHARE on a host
    templates = keep(many.where(F.col("n") >= LEAST_SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("templates")), "site-templates")

    def write(batches):
        for batch in small_batches(batches, 1):
            texts = []
            for page, known in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append("\n".join(blocks(*main_parts(parse(page or "")), set(map(bytes, known or ())))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    both = rows.join(templates.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left").select("id", "html", "url", "templates")
    return both.mapInArrow(write, f"id {kind}, url {url_kind}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
