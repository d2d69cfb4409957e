"""Main-text extraction from HTML by two-pass block rules.

The page is cut into text blocks. Pass one classifies each from its link density, its length
and its stop-word density; the elements around it vote too. Boilerplate elements (menus,
footers, sidebars, notices, adverts, forms, comments: by tag, or by a class that says nothing
else) decide against a block, a class that merely holds such a word is one vote that density
can outweigh. Where a page marks an article, only that zone can hold main text, and what
stands around the zone does not count against what is in it. Pass two gives blocks that were
too short or too close to call the label of the nearest decided neighbours in the same zone.

Zones, the first that has text: elements marked as article or main; elements whose id says so;
the same inside boilerplate elements (a form or a sidebar class round the page); else the whole
page. A page that loses all its text to a form round it is read as if the form were not there.

Cases: null or empty html gives empty text; an unclosed tag, comment or
character reference at the end of a truncated page is tolerated; unknown tags
are inline; a page without any decided block keeps its undecided blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import by_value

# Frequent function words of the languages handled.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how i
    if in into is it its just more not of on one only or other our out she so some than that the their them then there
    these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für
    hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wer
    wie wir wird zu zum zur
    au aux avec ce ces comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où
    par pas pour plus qu que qui sa se ses son sont sur ta te tu un une vous
    al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o
    para pero por porque que se si sin sobre su sus también un una uno y ya""".split()
)
# HTML element classes of behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul""".split()
)
CUT_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
FORM_TAGS = frozenset("form fieldset".split())
SELF_CLOSING = frozenset("p li dt dd tr td th".split())  # their end tags may be left out
# Class, id and role words that mark boilerplate.
CUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar
    comment comments respond replies reply disqus discussion share sharing social related recommended recommendations
    newsletter subscribe subscription signup login popup modal overlay pagination pager widget widgets complementary
    contentinfo search paywall tags""".split()
)
# Words of layout, which beside one of the former leave its meaning as it is.
LAYOUT_WORDS = frozenset(
    """area bar block body bottom box button cell col column container element footer group header holder inner item items
    layer left link links list main middle module outer page panel part region right row section side site slot top unit
    view wrap wrapper zone js is post entry article text title form thread""".split()
)
ARTICLE_WORDS = frozenset("main article articlebody".split())
ARTICLE_IDS = frozenset("main content article maincontent main-content page-content article-body story".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<close>>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|itemprop|aria-hidden|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, -1
SHORT_CHARS, LONG_CHARS = 70, 200
LINKS_MOST, LINKS_WEAK, STOPS_LOW, STOPS_HIGH = 0.5, 0.2, 0.15, 0.30
ARTICLE_WORDS_LEAST = 6


def _says(value: str) -> tuple[bool, bool]:
    """(boilerplate, perhaps): whether a name of a class, id or role is one for boilerplate, by
    itself or beside words of layout, or only holds a word for it."""
    strong = weak = False
    for name in value.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
        if any(w in CUT_WORDS for w in words):
            sure = all(w in CUT_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in words)
            strong |= sure
            weak |= not sure
    return strong, weak


def _marks(attrs: str) -> tuple[bool, bool, bool, bool, bool]:
    """(boilerplate, perhaps boilerplate, article, article by id, hidden) as attributes say."""
    strong = weak = article = by_id = hidden = False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            sure, perhaps = _says(value)
            strong, weak = strong or sure, weak or perhaps
            article |= key in ("role", "itemprop") and value.lower() in ARTICLE_WORDS
            by_id |= key == "id" and value.lower() in ARTICLE_IDS
    return strong, weak, article, by_id, hidden


@dataclass
class Block:
    """A block's text with what surrounds it: how many boilerplate elements and forms are
    open, how many of them were when the outermost article (by tag, by id) was opened, and how
    many elements perhaps are boilerplate."""

    text: str
    linked: int
    cuts: int
    forms: int
    weak: int
    tag_base: tuple[int, int] | None
    id_base: tuple[int, int] | None


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without scripts, styles and hidden elements."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, int, int, int], tuple | None]] = []
    opened: Counter[str] = Counter()  # how many of each name are on the stack
    drops = cuts = forms = weak = links = 0
    bases: dict[str, tuple[int, int] | None] = {"tag": None, "id": None}
    parts: list[str] = []
    linked_parts: list[str] = []
    at = 0

    def flush() -> None:
        nonlocal parts, linked_parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(linked_parts)).split())) if linked_parts else 0
                out.append(Block(text, linked, cuts, forms, weak, bases["tag"], bases["id"]))
        parts, linked_parts = [], []

    def pop_to(depth: int) -> None:
        nonlocal drops, cuts, forms, weak
        while len(stack) > depth:
            name, (d, c, f, w), zone = stack.pop()
            opened[name] -= 1
            drops, cuts, forms, weak = drops - d, cuts - c, forms - f, weak - w
            if zone:
                bases[zone] = None

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        upto = m.start() if m else size
        if upto > at and not drops:
            piece = page[at:upto]
            parts.append(piece)
            if links:
                linked_parts.append(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ending = m["end"] or m["end2"]
        if ending:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK or name in ("td", "th"):
                flush() if name in BLOCK else parts.append(" ")
                for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[depth][0] == name:
                        pop_to(depth)
                        break
            elif drops or cuts:
                for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[depth][0] in BLOCK and stack[depth][0] != name:
                        break
                    if stack[depth][0] == name:
                        pop_to(depth)
                        break
            else:
                for depth in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                    if stack[depth][0] == name:
                        del stack[depth]
                        opened[name] -= 1
                        break
            continue
        if name == "head":
            continue
        if name in RAW:
            if not (m["attrs"] or "").endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in ("br", "wbr", "td", "th"):
            if not drops:
                parts.append("" if name == "wbr" else " ")
            if name in ("br", "wbr"):
                continue
        if name in BLOCK:
            flush()
            links = 0
        if name in VOID:
            continue
        if name in SELF_CLOSING:
            for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "blockquote"):
                    break
        elif name in BLOCK and stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if name == "a":
            links += 1
        attrs = m["attrs"] or ""
        strong, perhaps, article, by_id, hidden = _marks(attrs) if attrs else (False,) * 5
        if name in ("html", "body"):
            strong = perhaps = hidden = False
        # a word that an inline element wraps is part of its sentence, whatever its class says
        cell = name in ("td", "th")
        strong = strong and (name in BLOCK or cell) and name not in ("article", "main", "h1")
        if name == "article" and attrs:
            strong = _marks(attrs)[0] and "comment" in attrs.lower()
        form = name in FORM_TAGS
        cut = not form and (strong or name in CUT_TAGS or (name == "header" and bases["tag"] is None))
        drop = hidden or (cut and name not in BLOCK)
        zone = None
        if not cut:
            if (article or name in ("article", "main")) and bases["tag"] is None:
                zone = "tag"
            elif by_id and name in BLOCK and bases["id"] is None:
                zone = "id"
        if not attrs.endswith("/") and (name in BLOCK or cell or drop or zone or name != "a"):
            marks = (int(drop), int(cut and not drop), int(form), int(perhaps and name in BLOCK and not cut and zone is None))
            stack.append((name, marks, zone))
            opened[name] += 1
            if zone:
                bases[zone] = (cuts, forms)
            drops, cuts, forms, weak = drops + marks[0], cuts + marks[1], forms + marks[2], weak + marks[3]
    flush()
    return out


def first_pass(text: str, linked: int, zone: bool, boilerplate: bool, weak: bool) -> tuple[int, bool]:
    """(label, by density): what a block's numbers say, and its surroundings where these leave
    it open. Links decide first, everywhere; then the elements around it; then length and stop
    words."""
    n = len(text)
    found = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    links = linked / n
    if links > LINKS_MOST and (not zone or stops < STOPS_HIGH):
        # in an article a short link between paragraphs is left to its neighbours
        return (OPEN, True) if zone and n < SHORT_CHARS and not boilerplate and not weak else (BAD, True)
    if boilerplate:
        return BAD, False
    prose = stops >= STOPS_LOW and (n >= LONG_CHARS or (zone and len(found) >= ARTICLE_WORDS_LEAST))
    if weak and not (prose and links <= LINKS_WEAK):
        return (BAD, True) if stops < STOPS_LOW or links > LINKS_WEAK else (OPEN, True)
    if zone:
        return (GOOD if prose or n >= LONG_CHARS else OPEN), True
    if n < SHORT_CHARS:
        return (BAD if linked else OPEN), True
    if stops >= STOPS_LOW:
        return (GOOD if n >= LONG_CHARS else OPEN), True
    return BAD, True


def second_pass(labels: list[int], tie: int) -> list[int]:
    """Undecided blocks take the label of the nearest decided one; two equally
    near that differ, or none, give ``tie``."""
    n, none = len(labels), (None, 1 << 60)
    left, right = [none] * n, [none] * n
    last = none
    for i, x in enumerate(labels):
        last = (x, i) if x != OPEN else last
        left[i] = last
    last = none
    for i in range(n - 1, -1, -1):
        last = (labels[i], i) if labels[i] != OPEN else last
        right[i] = last
    out = []
    for i, x in enumerate(labels):
        if x == OPEN:
            (a, ai), (b, bi) = left[i], right[i]
            if a is None and b is None or a is not None and b is not None and a != b and i - ai == bi - i:
                x = tie
            else:
                x = a if b is None or a is not None and i - ai <= bi - i else b
        out.append(x)
    return out


def zone_of(found: list[Block]) -> tuple[list[tuple[Block, bool]], bool]:
    """The blocks of the page's zone, each with whether boilerplate holds it inside the zone,
    and whether the page has a zone at all."""
    for inside_cut in (False, True):
        for base in ("tag_base", "id_base"):
            rows = [(x, getattr(x, base)) for x in found if getattr(x, base) is not None]
            rows = [(x, (x.cuts, x.forms) != b) for x, b in rows if (sum(b) > 0) == inside_cut]
            if any(not cut for _, cut in rows):
                return rows, True
    return [(x, x.cuts + x.forms > 0) for x in found], False


def main_text(page: str | None) -> tuple[str, int, int, int]:
    """(text, blocks kept, blocks seen, blocks that their numbers or neighbours decided)."""
    found = blocks_of(page) if page else []
    if found and all(x.cuts + x.forms > 0 for x in found) and any(x.forms and not x.cuts for x in found):
        bare = lambda base: base and (base[0], 0)
        found = [replace(x, forms=0, tag_base=bare(x.tag_base), id_base=bare(x.id_base)) for x in found]
    inside, zone = zone_of(found)
    first = [first_pass(x.text, x.linked, zone, cut, x.weak > 0) for x, cut in inside]
    labels = second_pass([label for label, _ in first], GOOD)
    kept = [x.text for (x, _), label in zip(inside, labels, strict=True) if label == GOOD]
    # blocks outside the zone are held against their numbers too, for the count alone
    held = {id(x) for x, _ in inside}
    apart = sum(first_pass(x.text, x.linked, False, True, False)[1] for x in found if id(x) not in held)
    return "\n".join(kept), len(kept), len(found), sum(by for _, by in first) + apart


RESULT = T.StructType(
    [T.StructField("text", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("n_kept", "n_blocks", "n_by_density")]
)


def main_text_column(page: Column) -> Column:
    by_value("lodestar.llm.html_text")

    @F.pandas_udf(RESULT)
    def extract(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(p) for p in pages], columns=RESULT.names)

    return extract(page)


def extract_main_text(df: DataFrame, html_col: str = "html", out: str = "main") -> DataFrame:
    """df with ``out``: struct(text, n_kept, n_blocks, n_by_density)."""
    return df.withColumn(out, main_text_column(F.col(f"`{html_col}`")))
