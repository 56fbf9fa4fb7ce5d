"""Main text of raw web pages by two-pass block rules.

Pass one cuts the page into blocks at block-level tags and adds up evidence for
each: what its words say (length, stop-word density, link density) and what the
page declares (inside its article, outside it, or inside an element that never
holds an article: navigation, footers, forms, advert or comment containers).
An article element counts as declared only if its blocks hold a third or more of
the page's words that read as prose, so a page of teaser cards does not pass for
an article.  Blocks of much evidence for or against are decided; pass two lets
the ambiguous ones, mostly short, inherit the label of their nearest decided
neighbours.

Defined cases: null or empty html gives an empty text; truncated and unbalanced
markup is read as far as it goes, the rest of the page goes only with an unclosed
script or style; character references are decoded once; white space inside a
block (also no-break space and line breaks) becomes one space; blocks keep page
order and are joined by two newlines; a page without a block that reads as prose
keeps all blocks that nothing speaks against; nothing else is dropped or capped.
An empty table gives no rows; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of the languages in use.
STOP_WORDS = frozenset(
    """a about after all an and any are as at be been but by can could did do for from had has have he her his if in into is it its just like me more my
    no not of on only or other our out over she so some such than that the their them then there these they this to up was we were what when which who
    will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit
    nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur
    un une vous
    al como con de del el ella en entre era es esa ese esta este está ha hay la las lo los más me mi muy no nos o para pero por que se sin sobre su sus
    también un una y ya yo""".split()
)

#: Element names by role.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out up to their end tag; of these, CODE_TAGS also where it is missing.
RAW_TAGS = frozenset("script style noscript template textarea iframe svg title select button".split())
CODE_TAGS = frozenset("script style".split())
OUT_TAGS = frozenset("nav footer aside form head menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of class, id and role names that mark what is no article.
OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus
    footer gdpr header login masthead menu modal nav navbar navigation navigator newsletter notice notices paywall popup promo promoted promotion related
    remark remarks reply replies respond response responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget
    teaser contentinfo complementary search alert privacy copyright recommended recommendations discussion feedback outbrain taboola""".split()
)
#: Of these, those that only mean page furniture outside an article; those that
#: inside one count only as a whole name and not on a section, whose name may be
#: its topic; and those that also disqualify an article element itself.
OUTSIDE_WORDS = frozenset("header masthead banner disclaimer copyright notice notices search alert privacy".split())
TOPIC_WORDS = frozenset("related respond response responses remark remarks discussion feedback recommended recommendations promotion subscription social navigation".split())
#: Of these, those that are weak evidence where they are part of a name.
DOUBTFUL_WORDS = TOPIC_WORDS | frozenset("privacy search alert disclaimer copyright".split())
NESTED_WORDS = frozenset("comment comments reply replies remark remarks teaser promo promoted sponsored ad advert advertisement".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMING = frozenset("class id role aria-label".split())
_NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.20
LINKS_MOST = 0.33
#: Evidence for (positive) or against a block.  GOOD or more is text, BAD or
#: less is not; what lies between is ambiguous.
PROSE, LISTED, LINKED = 2, -1, -4
DECLARED, ELSEWHERE, FURNITURE, DOUBTFUL = 2, -4, -9, -3
GOOD, BAD = 2, -2
#: Share of a page's prose words that an article element holds at least.
CREDIBLE = 1 / 3


#: What an element's kind or name says against its blocks.
NOTHING, WEAK, STRONG = range(3)


class Block:
    __slots__ = ("text", "linked", "against", "main", "heading", "label")

    def __init__(self, text, linked, against, main, heading):
        self.text, self.linked, self.against, self.main, self.heading = text, linked, against, main, heading
        self.label = ""


def _against(tag: str, attrs: str, inside: bool) -> int:
    if tag in OUT_TAGS or tag == "header" and not inside:
        return STRONG
    if not attrs or tag in ("html", "body"):
        return NOTHING
    bad = NESTED_WORDS if tag in MAIN_TAGS else OUT_WORDS - OUTSIDE_WORDS - TOPIC_WORDS if inside else OUT_WORDS
    worst = NOTHING
    for m in _ATTR.finditer(attrs):
        attr, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attr == "hidden" or attr == "aria-hidden" and value.lower() == "true" or attr == "style" and _NOT_SHOWN.search(value):
            return STRONG
        for name in value.split() if attr in _NAMING else ():
            words = [w.lower() for w in _NAME.findall(name)]
            named = bad.intersection(words)
            if inside and tag != "section" and len(words) == 1 and words[0] in TOPIC_WORDS:
                return STRONG
            if named:
                worst = max(worst, WEAK if len(words) > 1 and named <= DOUBTFUL_WORDS else STRONG)
    return worst


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; text is decoded, white space is single spaces."""
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int]] = []
    links = main = heading = 0
    counts = [0, 0, 0]  # open elements by what speaks against them

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, linked, STRONG if counts[STRONG] else WEAK if counts[WEAK] else NOTHING, main > 0, heading > 0))
        parts, linked = [], 0

    def close(upto: int):
        nonlocal links, main, heading
        while len(stack) > upto:
            tag, against = stack.pop()
            counts[against] -= 1
            links -= tag == "a"
            main -= tag in MAIN_TAGS
            heading -= tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    at, n = 0, len(page)
    ends: dict[str, int] = {}
    while at < n:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            text = _html.unescape(chunk)
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK_TAGS and stack[k][0] in BLOCK_TAGS:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
                _implied(stack, tag, close)
        if tag == "br":
            parts.append("\n")
            continue
        if tag in RAW_TAGS and not m[3].endswith("/"):
            end = _end_of(page, tag, at, ends)
            if end or tag in CODE_TAGS:
                at = end or n
            parts.append(" ")
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        against = _against(tag, m[3], main > 0)
        if tag in MAIN_TAGS and not against and not main and not any(b.main for b in found):
            stack[:] = [(t, NOTHING) for t, _ in stack]  # the first article undoes what its containers are named
            counts[:] = [len(stack), 0, 0]
        stack.append((tag, against))
        counts[against] += 1
        links += tag == "a"
        main += tag in MAIN_TAGS
        heading += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return found


def _end_of(page: str, tag: str, at: int, ends: dict[str, int]) -> int:
    """Where the next end tag of ``tag`` is over; 0 if none follows."""
    if at >= ends.get(tag, len(page)):
        return 0
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    if not end:
        ends[tag] = at  # looked for once: none follows this place
    return end.end() if end else 0


def _implied(stack, tag, close):
    """A paragraph or item ends an open one of its kind."""
    for k in range(len(stack) - 1, -1, -1):
        name = stack[k][0]
        if name == tag:
            close(k)
            return
        if name in BLOCK_TAGS:
            return


def evidence(b: Block) -> int:
    """What a block's own words say: prose, linked, listed, or nothing."""
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if b.linked > LINKS_MOST * len(b.text):
        return 0 if b.main and b.heading else LINKED
    if len(b.text) < LENGTH_LOW:
        return 0
    if stops >= STOP_HIGH or stops >= STOP_LOW and len(b.text) >= LENGTH_HIGH:
        return PROSE
    return LISTED if stops < STOP_LOW and len(b.text) >= LENGTH_HIGH else 0


def decide(blocks: list[Block], weights: tuple[int, int, int] = (0, DOUBTFUL, FURNITURE)) -> None:
    """Pass one (good, bad or ambiguous), then pass two.  ``weights`` are what
    speaks against a block's element; at FURNITURE it takes no part."""
    said = list(map(evidence, blocks))
    out = [weights[b.against] <= FURNITURE for b in blocks]
    prose = {main: sum(len(b.text) for b, x, o in zip(blocks, said, out) if x == PROSE and not o and b.main == main) for main in (True, False)}
    declared = any(b.main and not o for b, o in zip(blocks, out)) and prose[True] >= CREDIBLE * (prose[True] + prose[False])
    for b, x in zip(blocks, said):
        x += weights[b.against]
        if weights[b.against] > FURNITURE and declared:
            x += DECLARED if b.main else ELSEWHERE
        b.label = "good" if x >= GOOD else "bad" if x <= BAD else "ambiguous"
    said = [x for x, o in zip(said, out) if not o]
    usable = [b for b, o in zip(blocks, out) if not o]
    decided = [k for k, b in enumerate(usable) if b.label != "ambiguous"]
    fixed = [usable[k].label for k in decided]
    for k, b in enumerate(usable):
        if b.label != "ambiguous":
            continue
        at = bisect.bisect(decided, k)
        tie = "bad" if said[k] < 0 else "good"
        near = [(abs(decided[i] - k), fixed[i] != tie, fixed[i]) for i in (at - 1, at) if 0 <= i < len(decided)]
        b.label = min(near)[2] if "good" in fixed else "good"


def extract(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    for weights in ((0, DOUBTFUL, FURNITURE), (0, 0, DOUBTFUL), (0, 0, 0)):
        decide(blocks, weights)
        text = "\n\n".join(b.text for b in blocks if b.label == "good")
        if text or PROSE not in map(evidence, blocks):
            break
    return text


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
