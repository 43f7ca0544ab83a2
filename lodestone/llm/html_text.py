"""Main text of web pages by tag-path ratios.

A page's text blocks are grouped by their root-to-leaf tag path. Per path, text length, punctuation
and the part that isn't links are aggregated to ratios and fused to one score, together with what the path's own names
say of it (an article, or a sidebar). The scores are smoothed along the page and thresholded by their mean over the page's text. What
passes marks the content: the articles with marked text, or without articles the smallest node that holds the elements around all of it.
Of an article all blocks stay but those inside elements whose names say that they are something else, and articles in it (comments);
of another node those whose path doesn't fall far behind the marked ones, or is one of theirs. Only elements and roles
that never are main text (menus, footers, forms, scripts) take no part from the start.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, python_batches, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?$")

# Fixed values of HTML: elements without content, inline elements, and what opens implies the end of.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}
#: What never is main text: elements, roles, and words in class or id.
NEVER = frozenset("head nav footer aside form button select fieldset dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
JUNK = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner sidebar comment comments commentlist disqus reply replies respond responses discussion discussions kommentar kommentare commentaire commentaires comentario comentarios cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar".split())
#: Words that say nothing by themselves: a name of such words and one of JUNK (comment-list) speaks against its path; any other (menu-planning) doesn't.
NEUTRAL = frozenset("area bar block body bottom box col column container content fixed form group holder inner item items left link links list main message nav outer page panel right row section site slot text title top unit wrap wrapper".split())
#: Factors of a path's score for names that speak against it and for articles; parts of the page's mean score that marks a block, and of the marked paths' best below which a path is left out.
AGAINST, ARTICLE, LIMIT, FAR = 0.0005, 4.0, 0.6, 0.06
_PUNCTUATION = frozenset(",.;:!?，。；：！？、؟،")


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    path: str
    out: bool  # inside something that never is main text
    against: bool  # inside something whose name speaks against it
    main: int | None  # the outermost article or main element around it
    above: tuple
    link: bool = False
    article: bool = False  # an article or inside one


@dataclass(slots=True)
class Block:
    path: str
    above: tuple
    main: int | None
    against: bool = False
    text: str = ""
    linked: int = 0
    marks: int = field(default=0)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or raw.strip(" /") else {}


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks outside menus and the like, in order."""
    root = Element("", 0, "", False, False, None, (0,))
    stack, out, parts = [root], [], []
    linked = number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            top = next(e for e in reversed(stack) if e.tag not in INLINE)
            if text and not top.out:
                out.append(Block(top.path, top.above, top.main, top.against, text, min(linked, len(text)), sum(c in _PUNCTUATION for c in text)))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        if any(e.tag not in INLINE for e in stack[to:]):
            flush()
        del stack[to:]

    def word(raw: str) -> None:
        nonlocal linked
        if stack[-1].out:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            word(page[at : m.start()])
        at = m.end()
        if m[1] or not (m[3] or m[6]):
            continue
        closing, tag, raw = (m[2], m[3].lower(), m[4]) if m[3] else (m[5], m[6].lower(), m[7])
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = ENDS.get(tag, set())
            stops = HOLDS.get(tag, set())
            i = len(stack) - 1
            while i and stack[i].tag not in stops:
                if stack[i].tag in ends:
                    pop(i)
                    if tag not in ("tbody", "tr", "body"):
                        break
                elif stack[i].tag == "p":  # a block ends an open paragraph
                    pop(i)
                i = min(i, len(stack)) - 1
        if tag in VOID or raw.endswith("/") and tag in INLINE:
            continue
        up, given = stack[-1], _attributes(raw)
        number += 1
        names = f"{given.get('class', '')} {given.get('id', '')}".lower().split() if given else ()
        aside = tag in NEVER or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        aside |= up.main is None and tag == "header"
        # by HTML's definition an article inside an article belongs to it as comments do
        against = up.against or tag not in ("html", "body", "main") and any(_speaks_against(n) for n in names) or tag == "article" and up.article
        is_main = tag in ("article", "main") or given.get("role", "").lower() == "main"
        # a path is kept as its hash and last step, so that deep nesting costs no more than its elements
        step = tag + ("." + given["class"].strip().lower() if given.get("class") else "")
        path = up.path if tag in INLINE else f"{hash(up.path):x}/{step}"
        stack.append(Element(tag, number, path, up.out or aside, against, up.main if up.main is not None else number if is_main else None, up.above if tag in INLINE else (up.above, number), up.link or tag == "a", up.article or tag == "article"))
    if at < len(page):
        word(page[at:])
    flush()
    return out


def _speaks_against(name: str) -> bool:
    words = _WORDS.findall(name)
    return any(w in JUNK for w in words) and all(w in JUNK or w in NEUTRAL for w in words)


def path_scores(blocks: list[Block]) -> list[float]:
    """For each block its path's score: text a block, punctuation a block, the part that isn't links, and the path's names, fused."""
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    key = lambda b: (b.path, b.against, b.main is not None)
    for b in blocks:
        s = sums[key(b)]
        for i, x in enumerate((1, len(b.text), b.marks, b.linked)):
            s[i] += x
    score = {}
    for k, (n, length, marks, linked) in sums.items():
        score[k] = math.sqrt(length / n * (1 + marks / n)) * (1 - linked / max(1, length)) * (AGAINST if k[1] else 1) * (ARTICLE if k[2] else 1)
    return [score[key(b)] for b in blocks]


def marked(blocks: list[Block], raw: list[float]) -> list[bool]:
    """Which blocks pass: their paths' scores, by themselves and smoothed along the page, against the mean score of the page's text.

    The mean weighs blocks by their length: short blocks (menus, notices, headings) hardly move it, however many there are. At
    least the best score passes, if it isn't 0.
    """
    kernel = (0.25, 0.5, 0.25)
    smooth = [sum(k * raw[min(max(i + d, 0), len(raw) - 1)] for k, d in zip(kernel, (-1, 0, 1), strict=True)) for i in range(len(raw))]
    limit = LIMIT * sum(r * len(b.text) for b, r in zip(blocks, raw, strict=True)) / sum(len(b.text) for b in blocks)
    best = max(raw)
    return [r > 0 and (r == best or min(x, r) >= limit) for x, r in zip(smooth, raw, strict=True)]


def _up(above: tuple) -> Iterator[int]:
    """Element numbers from a block's own to the root's."""
    while len(above) > 1:
        yield above[1]
        above = above[0]
    yield above[0]


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by line feeds; empty if there is none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    raw = path_scores(blocks)
    chosen = marked(blocks, raw)
    if not any(chosen):
        return ""
    # the marked text of each article, and of what is in none
    mass: dict[int | None, float] = defaultdict(float)
    for b, c, r in zip(blocks, chosen, raw, strict=True):
        mass[b.main] += len(b.text) * r if c else 0.0
    far = FAR * max(r for c, r in zip(chosen, raw, strict=True) if c)
    near = lambda i: raw[i] >= far or bool(_HEADING.search(blocks[i].path)) and not blocks[i].against and 2 * blocks[i].linked <= len(blocks[i].text)
    if max(mass, key=mass.get) is not None:
        mains = {m for m, x in mass.items() if m is not None and x > 0}
        kept = [b.text for b in blocks if b.main in mains and not b.against]
        # where all of it is inside an element with such a name, the names say nothing
        return "\n".join(kept or [b.text for i, b in enumerate(blocks) if b.main in mains and near(i)])
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    around = lambda b: b.above[0] if len(b.above) > 1 else b.above
    common = list(_up(around(blocks[first])))
    for b, c in zip(blocks, chosen, strict=True):
        if c:
            known = set(_up(around(b)))
            common = [x for x in common if x in known]
    inside = lambda b: common[0] in set(_up(b.above))
    # what follows on the marked blocks' paths belongs to them, however short
    paths = {b.path for b, c in zip(blocks, chosen, strict=True) if c and not b.against}
    while last + 1 < len(blocks) and blocks[last + 1].path in paths and not blocks[last + 1].against and inside(blocks[last + 1]):
        last += 1
    # a heading right before the first marked block opens the text
    while first and inside(blocks[first - 1]) and _HEADING.search(blocks[first - 1].path):
        first -= 1
    return "\n".join(b.text for i, b in enumerate(blocks) if first <= i <= last and inside(b) and (near(i) or b.path in paths and not b.against))


def extract(pages: DataFrame, markup: str, keep: list[str]) -> DataFrame:
    """The columns keep, text (the main text of column markup) and n_chars (its code points).

    A null or empty page, or one without text, has an empty text; repeated rows give a row each; a kept
    column that is called text or n_chars gives way to the new one; other columns are left out. Whole pages are
    parsed, each in its own task: there is no shuffle.
    """
    python_batches(pages.sparkSession)
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.col(markup).alias(free_name(pages, "markup")), *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), "html", ["page_id", "url"])
