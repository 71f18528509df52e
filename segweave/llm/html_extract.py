"""HTML extraction by two-pass block rules.

Pass one cuts a page into blocks at block-level tags and classifies each block by itself: good, bad or ambiguous, from
its stop-word density, length, link density and the elements that hold it (menus, forms, adverts and the like are
decided bad). Pass two gives ambiguous blocks the label of the nearest decided neighbour; leaving the container that
holds a block counts as distance, so a short last paragraph follows its article, not the footer after it, and a heading
follows what it introduces. One row in, one row out: no shuffle, memory bounded by the largest page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import bound_batches, tidy

#: Frequent function words of four languages; pages in others are judged by length and links alone.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you
    were all we when there can been has more if will would who so no
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec on son aux d l s n
    ou mais comme nous sa
    el los del las por con para su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser y
    """.split()
)
#: Elements whose content never belongs to the text. Without an end tag script and style run to the page's end, as in
#: browsers; of others only the tag goes, and a title ends at the next tag.
RAW = frozenset("script style noscript template svg iframe textarea select object canvas title".split())
TO_THE_END = frozenset(("script", "style"))
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form button dialog menu fieldset label option".split())
#: Words of class, id or role that name page furniture.
HINTS = frozenset(
    """
    ad ads adbox adslot adsbygoogle adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments
    commentlist disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay menu menus nav
    navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe
    subscription signup login search pagination pager widget toolbar copyright legal disclaimer complementary contentinfo
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    p div section article main header nav footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th caption h1
    h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr body html head fieldset details summary dialog menu center
    """.split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose hints say nothing of their content as a whole.
UNHINTED = frozenset(("html", "body", "article", "main", "a", "img", *HEADINGS))
#: Elements that a heading or a short block stays inside of when it looks for a neighbour.
CONTAINERS = frozenset("article main section div td aside nav footer header form body ul ol".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAMES = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")

ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}

#: Share of stop words, over a page's longer blocks, below which its language is none of those known.
UNKNOWN_STOPS = 0.03
MAX_LINK_DENSITY, MAX_LINK_DENSITY_ARTICLE = 0.2, 0.5
LOW_STOPS, HIGH_STOPS = 0.10, 0.20
SHORT, LONG = 70, 200
#: Blocks that leaving a container counts as.
LEAVING = 20


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    furniture: bool
    in_article: bool
    container: int
    label: str = ""


def _furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attrs or name in UNHINTED:
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role") and not HINTS.isdisjoint(x.lower() for x in NAMES.split(value)):
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", attrs))


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, white space in each turned into one space."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, in article, container
    texts: list[str] = []
    state = {"tag": "body", "linked": 0, "containers": 0, "p_furniture": False}
    link = 0

    def top() -> tuple[str, bool, bool, int]:
        return stack[-1] if stack else ("", False, False, 0)

    def flush() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                _, bad, art, box = top()
                blocks.append(Block(text, state["linked"], state["tag"], bad or state["p_furniture"], art, box))
        state["linked"] = 0

    def add(raw: str) -> None:
        text = html_lib.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if link:
            state["linked"] += len("".join(text.split()))

    at = 0
    unended: set[str] = set()
    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if name == "title":
                flush()
            if m["end"]:
                continue
            end = None if name in unended else ENDS[name].search(page, at)
            if end is not None:
                at = end.end()
                continue
            unended.add(name)
            if name in TO_THE_END:
                at = len(page)
            elif name == "title":
                at = found if (found := page.find("<", at)) >= 0 else len(page)
            continue
        block = name in BLOCK_TAGS
        if m["end"]:
            if name == "a":
                link = 0
                continue
            held = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if block or held is not None and stack[held][1] != (stack[held - 1][1] if held else False):
                flush()
            if held is not None:
                del stack[held:]
            if block:
                state["tag"], state["p_furniture"] = "body", False
            continue
        if name in VOID:
            if name == "br":
                texts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name == "a":
            link = 1
            continue
        _, bad, art, box = top()
        hinted = _furniture(name, m["attrs"], art)
        if block or hinted:
            flush()
        if block:
            link = 0
            state["tag"], state["p_furniture"] = name, False
        if name == "p" or name in HEADINGS:
            state["p_furniture"] = hinted
        elif block or hinted:
            if name in CONTAINERS:
                state["containers"] += 1
                box = state["containers"]
            if m["attrs"].endswith("/") and name not in BLOCK_TAGS:
                continue
            stack.append((name, bad or hinted, art or name in ("article", "main"), box))
    if at < len(page):
        add(page[at:])
    flush()
    return blocks


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def knows_language(blocks: list[Block]) -> bool:
    """Whether the page's longer blocks hold stop words at all."""
    return stop_share(" ".join(b.text for b in blocks if not b.furniture and len(b.text) >= SHORT)) >= UNKNOWN_STOPS


def classify(block: Block, known: bool = True) -> str:
    """good, bad or ambiguous, by the block alone; known: the page's language has a list of stop words."""
    if block.furniture:
        return "bad"
    letters = len(block.text.replace(" ", ""))
    links = block.linked / max(letters, 1)
    if links > (MAX_LINK_DENSITY_ARTICLE if block.in_article else MAX_LINK_DENSITY):
        return "ambiguous" if block.in_article and len(block.text) >= SHORT else "bad"
    if block.tag in HEADINGS or len(block.text) < SHORT:
        return "ambiguous"
    if not known:
        return "good" if len(block.text) > LONG else "ambiguous"
    stops = stop_share(block.text)
    if stops >= HIGH_STOPS or stops >= LOW_STOPS and len(block.text) > LONG:
        return "good"
    return "ambiguous" if block.in_article or stops >= LOW_STOPS else "bad"


def label_blocks(blocks: list[Block]) -> list[Block]:
    """Both passes; sets each block's label to good or bad."""
    known = knows_language(blocks)
    first = [classify(b, known) for b in blocks]
    n = len(blocks)

    def reach(order: range) -> list[tuple[int, str]]:
        """For each block the nearest decided block met before it in order: distance, label."""
        out, seen = [(1 << 30, "")] * n, -1
        inside: dict[int, int] = {}
        for i in order:
            best = (1 << 30, "")
            if seen >= 0:
                best = (abs(i - seen) + LEAVING * (blocks[seen].container != blocks[i].container), first[seen])
            if (j := inside.get(blocks[i].container, -1)) >= 0:
                best = min(best, (abs(i - j), first[j]), key=lambda x: x[0])
            out[i] = best
            if first[i] != "ambiguous":
                seen = inside[blocks[i].container] = i
        return out

    before, after = reach(range(n)), reach(range(n - 1, -1, -1))
    for i, b in enumerate(blocks):
        b.label = first[i]
        if first[i] != "ambiguous":
            continue
        (d0, l0), (d1, l1) = before[i], after[i]
        if b.in_article and min(d0, d1) > LEAVING:
            b.label = "good"  # nothing decided shares its article
        elif not l0 and not l1:
            b.label = "good" if len(b.text) >= SHORT else "bad"
        elif b.tag in HEADINGS and l1 and d1 <= LEAVING:
            b.label = l1
        elif d0 == d1:
            b.label = "good" if l0 == l1 == "good" or b.in_article and "good" in (l0, l1) else "bad"
        else:
            b.label = l0 if d0 < d1 else l1
    return blocks


def main_text(page: str | None) -> str:
    """The page's good blocks joined by newlines; empty if none. Null counts as empty."""
    return "\n".join(b.text for b in label_blocks(blocks_of(page or "")) if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    Null or empty html gives empty text; rows with null ids or urls, and repeated rows, come out as they came in;
    further columns are not read. A page without markup is one block. End tags that HTML leaves optional may be missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    bound_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
