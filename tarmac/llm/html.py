"""HTML extraction by site template removal.

A page is parsed into blocks of text. Every element around a block is a subtree with a hash of its
tags and texts. Spark counts on how many different pages of a host each subtree stands; subtrees
that recur on many of them are the site's template, and their blocks go. What is marked as
furniture by its element or its class (menus, footers, forms, adverts, comments …) goes as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named, scratch_name

#: A subtree is template when it stands on this many different pages of a host, and this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1

#: Quotes start a value only after an equals sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements nested deeper than this count as their ancestor at this depth, as in browsers.
MAX_DEPTH = 512

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_FURNITURE = frozenset(
    "aside audio button canvas dialog fieldset footer form head header iframe input label menu nav noscript object option "
    "script select style svg template textarea title video".split()
)
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disqus dropdown footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain pagination pager popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "taboola toolbar widget widgets".split()
)
#: Words that say where or how large a part is, not what it is: with these a marked word is still the whole name.
_PLAIN = frozenset(
    "area articles bar block bottom box btn button buttons c col column container desktop fixed form global group holder icon icons inner item items js l "
    "left link links list main mobile o outer page panel posts primary right row secondary section site slot small sticky stories top u unit wrap wrapper".split()
)
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("article body div html li main section table td th ul ol dl blockquote".split())
#: Inside an article only these can be template; all else is its text, however often a passage recurs.
_CONTAINERS = frozenset("address article aside center details dialog dir div fieldset footer form header hgroup main menu nav section summary".split())


def _is_marked(name: str) -> bool:
    """Whether a class, id or role names furniture: marked words, with plain words beside them at most."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in _MARKED for w in words) and all(w in _MARKED or w in _PLAIN for w in words)


class _Node:
    __slots__ = ("tag", "names", "hidden", "hash")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag = tag
        self.names: list[str] = []
        if attributes:
            for found in _MARK.finditer(attributes):
                self.names += (found[1] or found[2] or found[3] or "").split()
        self.hidden = bool(attributes) and _HIDDEN.search(attributes) is not None
        self.hash = xxhash.xxh64(tag.encode("utf-8", "replace"))

    @property
    def is_content(self) -> bool:
        return self.tag in ("article", "main") or (self.tag != "html" and any(n.lower() == "main" for n in self.names))

    @property
    def is_furniture(self) -> bool:
        """By its element, or a comment by its class."""
        if self.hidden or self.tag in _FURNITURE:
            return True
        return self.tag == "article" and any(set(map(str.lower, _WORDS.findall(n))) & {"comment", "comments", "reply"} and _is_marked(n) for n in self.names)

    @property
    def is_marked(self) -> bool:
        return self.tag not in ("html", "body", "main", "article") and any(map(_is_marked, self.names))


def blocks(html: str) -> list[tuple[str, bool, list[int]]]:
    """(text, is in an article or main element, hashes of the subtrees around it) per block of text.

    Furniture is left out. A subtree's hash covers its tags and its text in page order, that of
    furniture too; it is folded into its parent's when the subtree ends. What holds the whole page or its article is no subtree in this sense; inside an
    article only named block containers are, never prose or inline elements. A class that names furniture
    counts above an article only on pages that have another article without one.
    """
    root = _Node("", "")
    stack = [root]
    kinds = [(False, False, False)]  # per open element: furniture, marked, content
    found: list[tuple[str, bool, list[_Node], bool]] = []
    text: list[str] = []
    at = deeper = paragraphs = 0
    place: tuple | None = None  # as ``where`` gives it, while the open elements stay the same

    def flush() -> None:
        nonlocal place
        if text:
            whole = " ".join(unescape("".join(text)).split())
            text.clear()
            if whole:
                stack[-1].hash.update(whole.encode("utf-8", "replace"))
                if place is None:
                    place = where()
                if place:
                    found.append((whole, *place))

    def where() -> tuple:
        """Of the open elements: is content, subtrees, has a marked element above its article; empty in furniture."""
        if any(f for f, _, _ in kinds):
            return ()
        content = next((i for i, (_, _, c) in enumerate(kinds) if c), None)
        article = max((i for i, n in enumerate(stack) if n.tag == "article"), default=content or 0)
        above = any(m for _, m, _ in kinds[:article])
        if any(m for _, m, _ in kinds[article:]) or (content is None and above):
            return ()
        within = stack[1:] if content is None else [n for n in stack[content + 1 :] if n.tag in _CONTAINERS]
        return content is not None, [n for n in within if n.tag not in ("html", "body")], above

    def close(depth: int) -> None:
        nonlocal paragraphs, place
        if any(n.tag in _BLOCKS or f or m for n, (f, m, _) in zip(stack[depth:], kinds[depth:], strict=True)):
            flush()
        for i in range(len(stack) - 1, depth - 1, -1):
            paragraphs -= stack[i].tag == "p"
            stack[i - 1].hash.update(stack[i].hash.digest())
        del stack[depth:], kinds[depth:]
        place = None

    while (token := _TOKEN.search(html, at)) is not None:
        if token.start() > at:
            text.append(html[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if deeper and tag not in _VOID:
                deeper -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in _VOID:
            if tag in _BLOCKS:
                flush()
            else:
                text.append(" " if tag == "br" else "")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = len(html) if end is None else end.end()
            continue
        if len(stack) > MAX_DEPTH:
            deeper += 1
            if tag in _BLOCKS:
                flush()
            continue
        if tag in _BLOCKS and paragraphs:
            depth = max(i for i, n in enumerate(stack) if n.tag == "p")
            if not any(n.tag in _SCOPES for n in stack[depth + 1 :]):
                close(depth)
        closing = _CLOSED_BY.get(tag)
        if closing is not None:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closing:
                    close(depth)
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        node = _Node(tag, token[3])
        kind = (node.is_furniture, node.is_marked, node.is_content)
        if tag in _BLOCKS or kind[0] or kind[1]:
            flush()
        elif tag in ("td", "th"):
            text.append(" ")
        stack.append(node)
        kinds.append(kind)
        place = None
        paragraphs += tag == "p"
    text.append(html[at:])
    close(1)
    flush()
    free = any(inside and not above for _, inside, _, above in found)
    hashes: dict[int, list[int]] = {}  # texts of one place share their list
    for _, _, around, _ in found:
        if id(around) not in hashes:
            hashes[id(around)] = [n.hash.intdigest() - (1 << 63) for n in around]
    return [(t, inside, hashes[id(around)]) for t, inside, around, above in found if not (above and free)]


def _parsed(html: Column) -> Column:
    @F.pandas_udf("texts array<string>, inside array<boolean>, around array<array<long>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [blocks(h or "") for h in batch]
            yield pd.DataFrame(
                {
                    "texts": [[t for t, _, _ in page] for page in parsed],
                    "inside": [[i for _, i, _ in page] for page in parsed],
                    "around": [[a for _, _, a in page] for page in parsed],
                }
            )

    return parse(html)


def extract_text(
    df: DataFrame,
    html_col: str = "html",
    url_col: str = "url",
    text_col: str = "text",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Add the main text of every page: its blocks, in page order, joined by a line break.

    A page with an article or main element has the blocks inside it, another one all blocks;
    furniture and template subtrees are left out. White space inside a block is one space;
    character references are decoded; malformed markup is read as browsers do, roughly, elements nested over ``MAX_DEPTH`` deep as part of the one at that depth. A subtree
    is template when it stands on at least ``min_pages`` different pages of its host that are at
    least ``min_share`` of them; copies of a page count once. In an article only block
    containers (div, section, aside and the like) can be template, so passages that recur are kept. A null or empty page
    has an empty text; pages without a host are one site. Repeated pages have equal texts. Empty
    tables stay empty. ``html_col`` is dropped and a column named ``text_col`` replaced; others are kept.
    """
    names = {n: scratch_name(df, f"_{n}") for n in ("page", "host", "parsed", "gone")}
    page, host, parsed, gone = names.values()
    html = F.coalesce(named(html_col).cast("string"), F.lit(""))
    site = F.lower(F.regexp_extract(F.coalesce(named(url_col).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    read = df.withColumns({page: F.xxhash64(html), host: site, parsed: _parsed(html)})
    has_content = F.exists(F.col(parsed)["inside"], lambda x: x)
    blocks_of = F.filter(
        F.arrays_zip(F.col(parsed)["texts"].alias("texts"), F.col(parsed)["inside"].alias("inside"), F.col(parsed)["around"].alias("around")),
        lambda b: b["inside"] | ~has_content,
    )
    # Parsed once for the counts and once for the texts: cheaper than a written copy of all pages.
    read = read.withColumn(parsed, blocks_of).drop(html_col, text_col)
    subtrees = read.select(host, page, F.explode(F.array_distinct(F.flatten(F.col(parsed)["around"]))).alias("subtree")).distinct()
    counted = subtrees.groupBy(host, "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = read.select(host, page).distinct().groupBy(host).agg(F.count("*").alias("pages"))
    template = counted.join(sizes, host).where(F.col("n") >= F.col("pages") * min_share).select(host, "subtree")
    marked = subtrees.join(template, [host, "subtree"]).groupBy(host, page).agg(F.collect_set("subtree").alias(gone))
    left = read.join(marked, [host, page], "left")
    kept = F.filter(F.col(parsed), lambda b: F.col(gone).isNull() | ~F.arrays_overlap(b["around"], F.col(gone)))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), "\n")
    return left.withColumn(text_col, text).drop(*names.values())
