"""Main text of web pages by two-pass block rules.

A page is split into blocks at block-level tags. The first pass classifies each
block by its length, its link density and its stop-word density as good, bad,
near-good or short (undecided). What the markup says is evidence beside these:

* Blocks in menus, page headers, footers, sidebars and dialogs are bad, and so
  are those in forms and in elements whose class, id or role names an advert, a
  notice, navigation or readers' comments, unless the page has no other text;
  then such a name only lowers a block's label by one step.
* Vaguer names (a side, a share bar) lower it by one step, unless their element
  holds half of the page's words.
* ``article`` (or else ``main``) elements that hold at least half of the page's
  other words are its article: blocks in them are decided among themselves, and
  long ones of few stop words count as near-good; a block elsewhere needs the
  density of a good one and twice its length.

In the second pass near-good and short blocks inherit the label of the nearest
decided neighbours: the one both sides agree on, and where they differ that of
the nearer one (near-good ones then count as good). Sections under a heading
that says "Comments", and no more, are left out.

Pages are independent rows, worked on in Arrow batches; nothing is shuffled.
Time and memory are linear in a page's length, whatever its markup.

Defined cases: null and empty html give an empty text; malformed and cut-off
markup is read as far as it goes (an unclosed comment or script ends with the
page, an unclosed quote at the next angle bracket); a page whose blocks are all
undecided keeps those outside boilerplate elements; ties go to the good side;
repeated rows are extracted each; other columns are kept by ``extract`` as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    (
        "a an and are as at be by for from has have he her his i in is it its not of on only or she that the their they this to was we were which will with you "
        "als an auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch sich sie sind so über um und von vor war was wie wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
        "al como con de del el ella en es esta este fue ha la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus un una y ya"
    ).split()
)
# HTML elements by what they do here.
DROPPED = frozenset("script style noscript template head title svg math canvas iframe object select option textarea button datalist audio video".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that a new paragraph or list item ends, as HTML has it.
CLOSES_P = BLOCKS - {"html", "body"}


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?<!no[-_])(?<!has[-_])(?<!with[-_])(?<![a-z0-9])(?:{words})(?![a-z0-9])", re.I)


#: Words of a class, id or role that name something else than the article.
NAMED = _names(
    r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|signup|login|paywall"
    r"|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|masthead|site-?header|site-?footer|copyright|sidebar\w*|aside|related\w*|recommend\w*|trending"
    r"|comments?|commentlist|reader-?comments?|reply|replies|respond|disqus|complementary|contentinfo"
)
#: Words that may do so.
VAGUE = _names(
    r"header|footer|foot|head|legal|side|left|right|popular|more|follow|tags?|discussion|form|hidden|meta|info|disclaimer|bar|top|bottom"
    r"|share|sharing|social\w*|tagcloud|search\w*|skip|banner|alert|popup|modal|overlay|promo\w*|toolbar|topbar|widget\w*"
)
ARTICLE = _names(r"article\w*|post|entry|content|main|body|story|text")
#: A heading of a section in which readers speak, as a whole: "Comments", "12 comments", "Comments (3)".
READERS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)s?\W*\s+)?(?:comments?|replies|responses|kommentare?|leserkommentare|commentaires?|comentarios?)\s*(?:\(\s*\d+\s*\)|\[\s*\d+\s*\]|:?\s*\d+)?\s*:?", re.I)
TOKEN = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
#: What stands in a tag after its name: with quoted values, and up to the next angle bracket.
INSIDE, INSIDE_PLAIN = re.compile(r"(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+"), re.compile(r"[^<>]*+")
#: Unclosed quotes in one page after which quotes in tags are not heeded any more.
MAX_UNCLOSED = 16
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Elements of which nothing is read, up to their closing tag.
SKIPPED = DROPPED | {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
#: Those of them whose content is no markup: unclosed, they end with the page.
RAW = frozenset("script style textarea title noscript iframe template".split())
CLOSING = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in SKIPPED}
WORD = re.compile(r"[^\W\d_]+")

#: Words from which a block counts as long, and below which it is short.
LONG, SHORT = 30, 8
#: Densities (of words that are stop words, of words that are in links).
STOP_HIGH, STOP_LOW, MAX_LINKS = 0.16, 0.08, 0.4
#: Share of a page's words from which ``article`` (or ``main``) elements are its article.
MAIN_SHARE = 0.5
#: Vaguely named elements, one in another, that are told apart.
MAX_VAGUE = 8
LOWER = {"good": "near", "near": "short", "short": "bad", "bad": "bad"}


@dataclass(slots=True)
class Block:
    text: str
    #: Words in links.
    linked: int
    #: The element it begins in, and the level of the heading or 0.
    element: str
    heading: int
    #: In an element that is boilerplate; in one named so; the numbers of those vaguely named so that it is in.
    boilerplate: bool
    named: bool
    vague: tuple[int, ...]
    article: bool
    main: bool

    @property
    def words(self) -> int:
        return len(self.text.split())


def blocks(page: str) -> list[Block]:
    """Blocks in page order."""
    out: list[Block] = []
    # an open element: (name, boilerplate, named, vague, article, main)
    outside = ("", False, False, (), False, False)
    stack = [outside]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    element, heading, links, unclosed, number = "", 0, 0, 0, 0
    absent: set[str] = set()  # elements without a closing tag from here on

    def end() -> None:
        nonlocal parts, linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len("".join(linked).split()), element, heading, *stack[-1][1:]))
        parts, linked = [], []

    def leave(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data:
            parts.append(data)
            if links:
                linked.append(data + " ")
        if not m:
            break
        at = m.end()
        if m[1]:
            parts.append(html_lib.escape(m[1]))
        if not m[3]:
            continue
        name = m[3].lower()
        inside = (INSIDE if unclosed < MAX_UNCLOSED else INSIDE_PLAIN).match(page, at)
        if inside.end() < len(page) and page[inside.end()] in "\"'":
            unclosed += 1
            inside = INSIDE_PLAIN.match(page, at)
        about = inside[0]
        at = inside.end() + (page[inside.end() : inside.end() + 1] == ">")
        if m[2]:  # a closing tag
            if name == "a":
                links = 0
            elif name == "br":
                parts.append(" ")
            elif name in BLOCKS:
                end()
                element, heading, links = "", 0, 0
                if opened[name] > 0:
                    leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if name in SKIPPED:
            parts.append(" ")
            close = CLOSING[name].search(page, at) if name not in absent else None
            if close:
                at = close.end()
            elif name in RAW:
                break
            else:
                absent.add(name)
            continue
        if name == "a":
            links = 1  # links do not nest
        elif name in ("br", "img", "input"):
            parts.append(" ")
        elif name in BLOCKS:
            end()
            links = 0
            if name in CLOSES_P and any(x[0] == "p" for x in stack[-3:]):
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"))
            element, heading = name, int(name[1]) if name in ("h1", "h2", "h3", "h4", "h5", "h6") else 0
            if name == "hr" or about.rstrip().endswith("/"):
                continue
            _, boilerplate, named, vague, article, main = stack[-1]
            values = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(about)} if about else {}
            label = " ".join(values[k] for k in ("class", "id", "role") if k in values)
            if label and name not in ("html", "body", "main"):
                named = named or bool(NAMED.search(label))
                if len(vague) < MAX_VAGUE and VAGUE.search(label) and not ARTICLE.search(label):
                    number += 1
                    vague = (*vague, number)
            hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(NO_DISPLAY.search(values.get("style", "")))
            # the header of an article is its own heading
            boilerplate = boilerplate or hidden or name in BOILERPLATE and not (name == "header" and (article or main))
            named = named or name == "form"
            stack.append((name, boilerplate, named, vague, article or name == "article", main or name == "main"))
            opened[name] += 1
    end()
    return out


def classify(text: str, in_links: int, heading: int) -> str:
    """First pass: good, bad, near (good) or short, by densities alone."""
    words = text.split()
    n = len(words)
    if in_links > MAX_LINKS * n:
        return "bad"
    if text[0] == "©" or n < SHORT and "©" in text:
        return "bad"
    if n < SHORT or heading:
        return "short" if not in_links else "bad"
    found = [w.lower() for w in WORD.findall(text)]
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if density >= STOP_HIGH:
        return "good" if n >= LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "short"  # too few stop words to tell the language, not to tell it is none


def inherit(labels: list[str]) -> list[bool]:
    """Second pass: whether each block is kept."""
    decided = [(i, x == "good") for i, x in enumerate(labels) if x in ("good", "bad")]
    if not any(x == "good" for x in labels):  # nothing sure: near-good ones are the best there is, then short ones
        best = "near" if "near" in labels else "short"
        decided = [(i, x == best) for i, x in enumerate(labels) if x in ("bad", best)]
    left: list[tuple[int, bool] | None] = []
    last = None
    at = dict(decided)
    for i in range(len(labels)):
        last = (i, at[i]) if i in at else last
        left.append(last)
    out = [False] * len(labels)
    last = None
    for i in range(len(labels) - 1, -1, -1):
        last = (i, at[i]) if i in at else last
        if i in at:
            out[i] = at[i]
        else:
            sides = [s for s in (left[i], last) if s]
            # of two sides that differ the nearer counts, at one distance the good one; near-good blocks need one good side
            out[i] = any(s[1] for s in sides) if labels[i] == "near" or len({s[1] for s in sides}) == 1 else min(sides, key=lambda s: (abs(s[0] - i), not s[1]))[1] if sides else True
    return out


def without_readers(found: list[Block]) -> list[Block]:
    """``found`` without the sections of readers: from their heading to the next one of its level or above, or to where an article begins or ends. A heading before any text is the title, and begins none."""
    out = []
    level = 0
    begun = inside = False
    for b in found:
        if level and (b.article != inside or 0 < b.heading <= level):
            level = 0
        if not level and begun and b.heading > 1 and READERS.fullmatch(b.text):
            level, inside = b.heading, b.article
        begun = begun or b.heading > 0 or classify(b.text, b.linked, b.heading) in ("good", "near")
        if not level:
            out.append(b)
    return out


def kept(found: list[Block]) -> list[Block]:
    """Both passes over the blocks that stand in no boilerplate element."""
    first = {id(b): classify(b.text, b.linked, b.heading) for b in found}
    if any(first[id(b)] != "bad" for b in found if not b.named):
        found = [b for b in found if not b.named]
    total = sum(b.words for b in found)
    held: Counter[int] = Counter()
    for b in found:
        held.update(dict.fromkeys(b.vague, b.words))
    region = next((x for x in ("article", "main") if total and sum(b.words for b in found if getattr(b, x)) >= MAIN_SHARE * total), None)
    within, labels = [], []
    sure: set[int] = set()
    for b in found:
        label = first[id(b)]
        if b.named or any(held[x] < MAIN_SHARE * total for x in b.vague):
            label = LOWER[label]
            if label == "bad" != first[id(b)]:
                continue  # by its name, which tells nothing about its neighbours
        if region is None:
            within.append(b)
            labels.append(label)
        elif getattr(b, region):
            if label == "short" and b.words >= SHORT and not b.heading:
                label = "near"
            elif label == "bad" and b.linked and (b.element == "p" or b.heading):  # a paragraph or heading that is mostly a link
                label = "short"
            within.append(b)
            labels.append(label)
        elif label == "good" and b.words >= 2 * LONG:
            sure.add(id(b))
    sure |= {id(b) for b, keep in zip(within, inherit(labels), strict=True) if keep}
    return [b for b in found if id(b) in sure]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in kept(without_readers([b for b in blocks(page or "") if not b.boilerplate])))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The rows and columns of ``pages`` with ``out``, the main text of ``html_col``."""
    (source,) = fresh(pages, "html")

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    return pages.withColumn(source, F.coalesce(F.col(html_col).cast("string"), F.lit(""))).withColumn(out, texts(F.col(source))).drop(source)
