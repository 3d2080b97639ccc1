"""Main text of web pages by site template removal.

Every block element's subtree of a page is hashed over its tags, classes and text. Spark counts on how
many different pages of a host each occurs (equal pages count once), and subtrees that recur on a
large share of the host's pages, or on very many, are its template: they are deleted with all they
hold, inside article and main elements and outside. What is left of the page's content, block by
block, is its text. Inline elements are never deleted by count, so a sentence keeps its words.

Prose blocks inside an article or main element are the page's own words even if another page quotes
them, so there they must recur on nearly all pages. A class or id word that names furniture (ad,
sidebar, comments) is a hint: the element's shell, its tag and such words without the text, is counted
as well, on the host and over all hosts, and takes a lower share, since adverts and comments differ
from page to page. Elements whose tag, role or attributes say that they are no text (navigation, page
header and footer, aside, form, hidden) go without a count; the header of an article stays.
On a host with too few pages for a count, an article or main element that holds most of a page's text
stands for all of it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship
from quarrylight.session import small_side

#: A subtree is template if it occurs on at least so many different pages of its host and such a share of them.
PAGES, SHARE = 4, 0.3
#: Prose inside an article or main element takes this share; other blocks than prose do with so many pages.
NEARLY, MANY = 0.9, 1000
#: A shell with a telling word goes from such a share of a host's pages, or of all pages.
HINTED = 0.05

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select".split())
NEVER = frozenset("head nav header footer aside form button menu dialog audio video".split()) | RAW
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
BLOCKS = PROSE | frozenset(
    "html body article main section div ul ol dl table thead tbody tfoot tr caption figure address hr center "
    "fieldset details summary nav header footer aside form".split()
)
CONTENT = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert popup modal newsletter subscribe subscription nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars widget widgets footer header masthead related recommended share sharing social "
    "comment comments reply replies disqus discussion respond pagination pager login signup copyright".split()
)
CLOSES_P = BLOCKS - {"li", "td", "th", "tr", "dt", "dd", "thead", "tbody", "tfoot", "caption", "figcaption", "summary"}
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table html body article main section div nav aside footer header form".split())

#: A quote opens a value only behind an equals sign; elsewhere it is a character like others.
piece = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S
)
attribute = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


#: Stands for the page itself among its subtrees; as part of a template it says that the host is counted.
WHOLE = 0


class Node:
    __slots__ = ("hints", "kids", "never", "tag", "words")

    def __init__(self, tag: str, words: str = "", never: bool = False, hints: frozenset[str] = frozenset()):
        self.tag, self.words, self.never, self.hints, self.kids = tag, words, never, hints, []

    def shell(self) -> int:
        """The hash of the tag and its telling words; 0 without any."""
        return xxhash.xxh3_64_intdigest(" ".join([self.tag, *sorted(self.hints)])) if self.hints else 0


def parse(source: str) -> Node:
    """The element tree of a page; text is a str among the kids. Unclosed and stray tags are tolerated."""
    root = Node("#root")
    stack, at, size = [root], 0, len(source)
    while at < size:
        found = piece.search(source, at)
        if found is None:
            stack[-1].kids.append(source[at:])
            break
        if found.start() > at:
            stack[-1].kids.append(source[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        _close(stack, tag)
        node = _element(tag, found[3])
        stack[-1].kids.append(node)
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    """End the elements that the start of another ends."""
    if tag in CLOSES_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in BLOCKS:
                break
    ended = SIBLINGS.get(tag)
    if ended:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ended:
                del stack[depth:]
                break
            if stack[depth].tag in SCOPES:
                break


def _element(tag: str, rest: str) -> Node:
    if not rest.strip(" /"):
        return Node(tag, "", tag in NEVER)
    words, never = [], tag in NEVER
    for name, *values in attribute.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            words.append(value)
        elif name == "role":
            never = never or value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            never = True
    tokens = MARKS.intersection(" ".join(words).split()) if tag not in ("html", "body", *CONTENT) else ()
    return Node(tag, " ".join(words), never, frozenset(tokens))


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def subtree_hashes(root: Node) -> tuple[dict[int, int], dict[int, bool]]:
    """(hash of each element by id(), whether it is prose by hash of the blocks that hold text), without recursion."""
    hashes: dict[int, int] = {}
    lively: dict[int, bool] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.kids if isinstance(x, Node))
    full: dict[int, bool] = {}
    for node in reversed(order):
        digest, some = xxhash.xxh3_64(f"{node.tag}\x1f{node.words}\x1f".encode("utf-8", "replace")), False
        for kid in node.kids:
            if isinstance(kid, Node):
                digest.update(hashes[id(kid)].to_bytes(8, "little"))
                some = some or full[id(kid)]
            else:
                text = " ".join(kid.split())
                if text:
                    digest.update(b"\x1e" + text.encode("utf-8", "replace"))
                    some = True
        hashes[id(node)], full[id(node)] = digest.intdigest(), some
        if some and node.tag in BLOCKS:
            lively[hashes[id(node)]] = node.tag in PROSE
    return hashes, lively


def shells(root: Node) -> set[int]:
    """The shells of a page's elements with telling words."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        found.add(node.shell())
        todo.extend(x for x in node.kids if isinstance(x, Node))
    return found - {0}


def main_text(
    root: Node, hashes: dict[int, int], template: set[int], everywhere: set[int] = frozenset(), counted: bool = False,
    gone: set[int] = frozenset(),
) -> str:
    """The blocks of a page outside its template, one line each.

    `everywhere` is the part of the template that recurs on nearly all pages, `gone` the shells that recur. Where the host has too
    few pages to be `counted`, articles or main elements with most of the text stand for the page.
    """
    lines = _blocks(root, hashes, template, everywhere, gone)
    inside = [text for text, content in lines if content]
    if not counted and 2 * sum(map(len, inside)) >= sum(len(text) for text, _ in lines):
        return "\n".join(inside)
    return "\n".join(text for text, _ in lines)


def _blocks(
    root: Node, hashes: dict[int, int], template: set[int], everywhere: set[int], gone: set[int]
) -> list[tuple[str, bool]]:
    """(text, whether it is inside an article or main element) of each block."""
    lines, line = [], []

    def end_line(content):
        text = clean("".join(line))
        line.clear()
        if text:
            lines.append((text, content))

    todo: list = [(root, False, False)]
    while todo:
        node, content, prose = todo.pop()
        if node is None:
            end_line(content)
        elif isinstance(node, str):
            line.append(node)
        elif node.never and not (content and node.tag == "header"):
            continue
        elif node.hints and not prose and not (content and node.tag in PROSE) and node.shell() in gone:
            if node.tag in BLOCKS:
                end_line(content)
        elif node.tag in BLOCKS and hashes[id(node)] in template and node.tag not in ("html", "body", *CONTENT) and not (
            content and node.tag in PROSE and hashes[id(node)] not in everywhere
        ):
            end_line(content)
        else:
            within = content or node.tag in CONTENT
            if node.tag == "br":
                line.append(" ")
            if node.tag in BLOCKS:
                end_line(content)
                todo.append((None, within, False))
            inner = prose or node.tag in PROSE - {"li", "td", "th", "dd"}
            todo.extend((kid, within, inner) for kid in reversed(node.kids))
    end_line(False)
    return lines


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _profile(batches):
    """Per page: the text's hash, the hashes of its blocks with text, those of prose apart, and its shells."""
    for batch in batches:
        bodies, trees, prose, hinted = [], [], [], []
        for source in batch.column(2).to_pylist():
            root = parse(source or "")
            hashes, lively = subtree_hashes(root)
            bodies.append(_signed(hashes[id(root)]))
            trees.append([_signed(x) for x in sorted(lively) if not lively[x]])
            prose.append([_signed(x) for x in sorted(lively) if lively[x]])
            hinted.append([_signed(x) for x in sorted(shells(root))])
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(bodies, pa.int64()),
             *(pa.array(x, pa.list_(pa.int64())) for x in (trees, prose, hinted))],
            ["host", "key", "body", "trees", "prose", "shells"],
        )


def _extract(batches):
    for batch in batches:
        texts, sizes = [], []
        columns = [batch.column(x).to_pylist() for x in ("html", "template", "everywhere", "gone")]
        for source, *found in zip(*columns, strict=True):
            root = parse(source or "")
            hashes, _ = subtree_hashes(root)
            template, everywhere, gone = ({x & ((1 << 64) - 1) for x in part or ()} for part in found)
            texts.append(main_text(root, hashes, template, everywhere, WHOLE in template, gone))
            sizes.append(len(texts[-1]))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def host_of(column: str = "url"):
    """The host of a url in lower case; empty for null and for anything without one."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(column).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def profiles(pages: DataFrame) -> DataFrame:
    """(host, key, body, trees, prose, shells) of the different pages of each host; `key` is page_key()."""
    ship(pages.sparkSession)
    return land(pages.select(host_of().alias("host"), page_key().alias("key"), F.col("html").cast("string").alias("html")).mapInArrow(
        _profile, "host string, key long, body long, trees array<long>, prose array<long>, shells array<long>"
    ).dropDuplicates(["host", "key"]), "profiles")


def page_key():
    return F.xxhash64(F.col("html").cast("string"))


#: What a counted hash is of: a block, a block of prose, or the shell of an element with telling words.
BLOCK_KIND, PROSE_KIND, SHELL_KIND = 0, 1, 2


def _each_tree(known: DataFrame) -> DataFrame:
    """(host, key, tree, kind), a row for each counted hash of each page."""
    marked = lambda part, kind: F.transform(part, lambda x: F.struct(x.alias("tree"), F.lit(kind).alias("kind")))
    whole = F.array(F.lit(WHOLE).cast("long"))
    return known.select("host", "key", F.inline(F.concat(
        marked(whole, BLOCK_KIND), marked("trees", BLOCK_KIND), marked("prose", PROSE_KIND), marked("shells", SHELL_KIND)
    )))


def templates(
    known: DataFrame, least: int = PAGES, share: float = SHARE, nearly: float = NEARLY, many: int = MANY, hinted: float = HINTED
) -> tuple[DataFrame, DataFrame]:
    """(host, tree, kind, everywhere), the recurring hashes of each host with enough pages, and WHOLE; (tree), the shells
    that recur over all hosts.

    `known` has the profiles of the pages. Pages alike in all but attributes count once, so a page
    that was copied often makes no template.
    """
    each = _each_tree(known.dropDuplicates(["host", "body"]))
    counted = each.groupBy("host", "tree", "kind").agg(F.count(F.lit(1)).alias("pages"))
    counts = land(counted.filter((F.col("pages") >= least) | (F.col("kind") == SHELL_KIND) | (F.col("tree") == WHOLE)), "subtrees")
    sizes = counts.filter(F.col("tree") == WHOLE).select("host", F.col("pages").alias("all"))
    hosts = small_side(sizes.filter(F.col("all") >= least))
    shell, pages = F.col("kind") == SHELL_KIND, F.col("pages")
    recurs = (pages >= share * F.col("all")) | ((F.col("kind") == BLOCK_KIND) & (pages >= many)) | (
        shell & (pages >= 2) & (pages >= hinted * F.col("all"))
    )
    on_host = counts.filter(shell | (pages >= least)).join(hosts, "host").filter(recurs).select(
        "host", "tree", "kind", (pages >= nearly * F.col("all")).alias("everywhere")
    )
    total = sizes.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    over_all = counts.filter(shell).groupBy("tree").agg(F.sum("pages").alias("pages")).filter(
        (pages >= least) & ((pages >= hinted * total) | (pages >= many))
    )
    return on_host, over_all.select("tree")


def extract(
    pages: DataFrame, least: int = PAGES, share: float = SHARE, nearly: float = NEARLY, many: int = MANY, hinted: float = HINTED
) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars) from (page_id, url, html).

    Character references are decoded, white space within a block is one space, blocks are joined by
    one line feed in page order. Null and empty pages have an empty text; so have pages that are all
    template. Pages without a host count as one host. Repeated rows give repeated rows. Other
    columns are not read. An empty table gives an empty result.
    """
    known = profiles(pages)
    on_host, over_all = templates(known, least, share, nearly, many, hinted)
    each, shell = _each_tree(known), F.col("kind") == SHELL_KIND
    found = each.join(small_side(on_host), ["host", "tree", "kind"]).unionByName(
        each.filter(shell).join(small_side(over_all), "tree").withColumn("everywhere", F.lit(False))
    )
    # A page gets the part of its host's template that it holds: a host's may be long, a page's is not.
    held = small_side(found.groupBy("host", "key").agg(
        F.collect_list(F.when(~shell, F.col("tree"))).alias("template"),
        F.collect_list(F.when(~shell & F.col("everywhere"), F.col("tree"))).alias("everywhere"),
        F.collect_set(F.when(shell, F.col("tree"))).alias("gone"),
    ))
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = plain.schema["page_id"].dataType.simpleString()
    return plain.withColumns({"host": host_of(), "key": page_key()}).join(held, ["host", "key"], "left").select(
        "page_id", "url", "html", "template", "everywhere", "gone"
    ).mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
