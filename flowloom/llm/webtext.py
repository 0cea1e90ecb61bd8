"""Main text of web pages by tree scoring (operator 8).

Paragraphs pass points for length and commas to their ancestors, discounted by link density; the best
container is kept with all of the article around it, or else with its good siblings.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|object|svg|math|select|textarea|button|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|</?[a-zA-Z][^<]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
# Element and attribute words of pages.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CUT = frozenset("nav footer aside form menu dialog head".split())
_CLOSED_BY = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
              "th": {"td", "th", "tr"}, "option": {"option"}}
_NOISE = frozenset("ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner menu nav navbar navigation "
                   "breadcrumb breadcrumbs sidebar side aside rail widget footer header masthead notice notices cookie cookies consent gdpr "
                   "alert popup modal newsletter subscribe signup login comment comments disqus respond replies share sharing social related "
                   "pagination pager toolbar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())


class _Node:
    __slots__ = ("tag", "parent", "cut", "score", "own", "chars", "link", "kept")

    def __init__(self, tag: str, parent: _Node | None, cut: bool):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.score, self.own, self.chars, self.link, self.kept = 0.0, 0.0, 0, 0, None


def _is_noise(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in _CUT or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and not _NOISE.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _blocks(page: str) -> list[tuple[_Node, str, int]]:
    """Text blocks outside noise, in page order: their element, text and characters inside links."""
    top = _Node("#", None, False)
    node, out, buffer, linked, links, articles = top, [], [], 0, 0, 0
    block = top

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append((block, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(target: _Node) -> None:
        nonlocal node, links, articles, block
        while node is not target.parent:
            if node.tag in _BLOCK:
                flush()
            links -= node.tag == "a"
            articles -= node.tag in ("article", "main")
            node = node.parent
        block = node
        while block.tag not in _BLOCK and block.parent:
            block = block.parent

    def add(text: str) -> None:
        nonlocal linked
        if text and not node.cut:
            buffer.append(text)
            linked += len(text.strip()) if links else 0

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            target = node
            while target.parent and target.tag != tag:
                target = target.parent
            if target.parent:
                close(target)
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            add(" ")
        if tag in _VOID:
            continue
        open_ = node
        while open_.parent and (open_.tag not in _BLOCK or open_.tag in _CLOSED_BY):
            if tag in _CLOSED_BY.get(open_.tag, ()):
                close(open_)
                break
            open_ = open_.parent
        node = _Node(tag, node, node.cut or _is_noise(tag, m[4], articles > 0))
        if tag in _BLOCK:
            block = node
        links += tag == "a"
        articles += tag in ("article", "main")
    add(page[at:])
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text: blocks in page order, one line each."""
    blocks = _blocks(page or "")
    seen: dict[int, _Node] = {}
    for node, text, linked in blocks:
        points = 1.0 + text.count(",") + min(len(text) / 100.0, 3.0)
        up, level = node.parent if node.tag not in ("body", "article", "main", "div", "section") and node.parent else node, 0
        node.own += points if up is not node else 0
        walk = node
        while walk:
            walk.chars += len(text)
            walk.link += linked
            seen[id(walk)] = walk
            walk = walk.parent
        while up and level < 6:
            up.score += points / (1, 2, 6, 9, 12, 15)[level]
            up, level = up.parent, level + 1
    if not blocks:
        return ""
    final = {k: n.score * (1.0 - n.link / max(1, n.chars)) for k, n in seen.items()}
    best = max(seen.values(), key=lambda n: final[id(n)])
    if final[id(best)] <= 0:
        return ""
    least = max(1.0, 0.2 * final[id(best)])
    whole = best
    while whole and whole.tag not in ("article", "main"):
        whole = whole.parent
    siblings = [n for n in seen.values() if n.parent is best.parent and n is not best]
    if whole is None and best.parent is not None and all(n.link < 0.5 * n.chars for n in siblings):
        whole = best.parent
    best.kept = True
    if whole:
        whole.kept = True
    for n in siblings:
        own = n.own * (1.0 - n.link / max(1, n.chars))
        n.kept = n.kept or (n.link < 0.5 * n.chars and (max(final[id(n)], own) >= least or (n.tag not in ("div", "section") and n.chars > 80)))

    def inside(node: _Node | None) -> bool:
        while node:
            if node.kept:
                return True
            node = node.parent
        return False

    return "\n".join(text for node, text, _ in blocks if inside(node))


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (column html) with ``text``; given columns stay, a given ``text`` is replaced.

    Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers
    and markup go; character references are decoded, white space inside a block becomes one space. A
    null or empty page, or one without main text, gives an empty string. Unclosed and cut tags are
    tolerated. Pages are independent rows; an empty table gives an empty table.
    """
    pages = pages.drop("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch["html"].to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return pages.mapInArrow(run, f"{kinds}, text string")
