"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level elements.  The first pass decides blocks by what they are: parts of a menu, footer,
sidebar, form, notice, advert or list of comments (by their elements, roles, classes and ids) are boilerplate, and so are
blocks of links; a long block with many stop words is text; what stands outside the page's articles, if it has any, is boilerplate.
The second pass gives the others, mostly short ones, the label of the nearest decided block of their region (the articles, or the
page where it has none).  In an article, which says itself that it is the text, only blocks of links are boilerplate
and short blocks are lost to nothing but these.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import map_arrow

# Frequent words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this from or an at not which but have they you all "
    "le la les de des du et un une en est que qui dans pour sur pas avec par au ce il elle ne se sont "
    "der die das und ist von den mit zu auf für im dem nicht ein eine als auch es an sich wie aus er sie "
    "el los las y en que por con para una su al lo como más pero sus del se no si "
    "il di che è per non sono con della gli nel alla "
    "o os um uma em para com não por mais dos da "
    "het een van dat op te zijn voor met niet".split()
)
# Elements that begin and end blocks, that have no content, whose content is no text, and that are never main text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript object script select style svg template textarea title xmp button canvas audio video".split())
NEVER_TAGS = frozenset("aside dialog footer form menu nav".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of classes and ids that name boilerplate; names that tell only how a page is laid out.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay newsletter "
    "subscribe subscription signup login comment comments disqus reply replies sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer "
    "masthead topbar toolbar social share sharing related recommended trending copyright search".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies".split())
LAYOUT_FIRST, LAYOUT_LAST = frozenset("has with no without is not".split()), frozenset("open closed enabled layout".split())

#: Length from which a block can be decided as text, and from which a block is not short; parts of stop words for text and for likely text; part of
#: link text from which a block is one of links.
LONG, SHORT, STOP_HIGH, STOP_LOW, LINKS = 200, 70, 0.3, 0.15, 0.34

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"ul", "ol", "dl", "table", "select", "menu"}


@dataclass
class Block:
    """A run of text between block boundaries; label: True for text, False for boilerplate, None if not decided."""

    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    article: bool = False
    never: bool = False
    text: str = ""
    label: bool | None = None


@dataclass
class _Open:
    name: str
    article: bool
    never: bool
    form: bool
    link: bool


def _names_boilerplate(name: str, attributes: str) -> bool:
    """Whether an element's role, class or id says that it is boilerplate, or that it is hidden."""
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.lower() in NEVER_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            known = COMMENT_WORDS if name == "article" else NEVER_WORDS
            for one in value.split():
                found = [w.lower() for w in _NAME_WORD.findall(one)]
                if found and found[0] not in LAYOUT_FIRST and found[-1] not in LAYOUT_LAST and not known.isdisjoint(found):
                    return True
    return False


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    now = Block()

    def top() -> _Open | None:
        return stack[-1] if stack else None

    def end_block() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        now = Block()
        if t := top():
            now.article, now.never = t.article, t.never

    def add(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        t = top()
        if t and t.never != now.never and now.parts and text.strip():  # an inline element that is boilerplate is a block of its own
            end_block()
        if not now.parts and t:
            now.article, now.never = t.article, t.never
        now.parts.append(text)
        if t and t.link:
            now.link_chars += len("".join(text.split()))

    def close(k: int) -> None:
        opened.subtract(x.name for x in stack[k:])
        del stack[k:]

    at, size = 0, len(html)
    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = found[3] or found[6] or ""
        if found[1] or found[4]:  # an end tag
            if name in BLOCK_TAGS:
                end_block()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
                if stack[k].name in ("article", "main", "body") and name not in BLOCK_TAGS:
                    break
            if name in BLOCK_TAGS:
                end_block()
            continue
        if name in RAW_TAGS:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name == "br":
            add(" ")
            continue
        block = name in BLOCK_TAGS
        if block:
            end_block()
            if stack and stack[-1].name == "p":
                close(len(stack) - 1)
            for k in range(len(stack) - 1, -1, -1) if any(opened[x] for x in _CLOSED_BY.get(name, ())) else ():
                if stack[k].name in _CLOSED_BY[name]:
                    close(k)
                    break
                if stack[k].name in _SCOPES:
                    break
        if name in VOID_TAGS or attributes.endswith("/") and not block:
            if name != "wbr" and block:
                end_block()
            continue
        named = bool(attributes) and _names_boilerplate(name, attributes)
        if block or named or name == "a":
            t = top()
            article, never, form, link = (t.article, t.never, t.form, t.link) if t else (False, False, False, False)
            if name in ("main", "article") and not named:
                never = never and not form and name != "main"
                form = False
                article = article or not never
            elif named or name in NEVER_TAGS or name == "header" and not article:
                form = name == "form" and not named and not never
                never = True
            opened[name] += 1
            stack.append(_Open(name, article, never, form, link or name == "a" and "href" in attributes.lower()))
            if block:
                end_block()
    end_block()
    return out


def first_pass(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> None:
    """Label the blocks that decide themselves."""
    has_article = any(b.article and not b.never for b in blocks)
    for b in blocks:
        size = len("".join(b.text.split()))
        links = b.link_chars / size
        if b.never or has_article and not b.article or links >= LINKS:
            b.label = False
        elif b.article and len(b.text) < LONG:
            continue
        elif not b.article and (len(b.text) < SHORT and links > 0 or "©" in b.text):
            b.label = False
        else:
            words = _WORD.findall(b.text.lower())
            density = sum(w in stop_words for w in words) / max(len(words), 1)
            if density >= STOP_HIGH and len(b.text) >= LONG:
                b.label = True
            elif density < STOP_LOW and len(b.text) >= SHORT and not b.article:
                b.label = False


def second_pass(blocks: list[Block]) -> None:
    """Label the others by the nearest decided block of their region; the farther side, or an article, decides for text."""
    has_article = any(b.article and not b.never for b in blocks)
    region = [b for b in blocks if (b.article and not b.never if has_article else not b.never)]
    any_text = any(b.label for b in region)
    decided = [(k, b.label) for k, b in enumerate(region) if b.label is not None]
    before: list[tuple[int, bool] | None] = []
    last = None
    for k, b in enumerate(region):
        last = (k, b.label) if b.label is not None else last
        before.append(last)
    after = None
    labels: list[bool] = []
    for k in range(len(region) - 1, -1, -1):
        b = region[k]
        after = (k, b.label) if b.label is not None else after
        if b.label is not None:
            labels.append(b.label)
        elif not any_text:
            labels.append(has_article or len(b.text) >= SHORT or not decided)
        else:
            near = [(abs(k - at), not label) for at, label in filter(None, (before[k], after))]
            labels.append(not min(near)[1])
    for b, label in zip(region, reversed(labels)):
        b.label = label


def main_text(html: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text of a page: its blocks joined by line feeds."""
    blocks = blocks_of(html or "")
    first_pass(blocks, stop_words)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract_text(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html): the main text and its code points.

    A null or empty html, and a page without main text, give an empty text; repeated rows are read each; null ids and urls stay; an
    empty table gives no rows; other columns are not read.  Pages are read whole, however long or broken: an element
    that is not closed ends where its parent does, a tag that is not ended is text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), stop_words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op11_html_extraction(pages: DataFrame) -> DataFrame:
    return extract_text(pages)
