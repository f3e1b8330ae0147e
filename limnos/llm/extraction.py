"""Main text of web pages by two-pass block rules.

The markup is cut into blocks at block-level tags; scripts, styles and other unseen parts are dropped. First pass: each
block is judged by itself on the regions it stands in (menus, notices, forms, ...), its share of linked characters, its
length and its share of stop words: good, bad, near-good or short. Where no block of a page speaks a language served,
stop words say nothing, and length and links decide. Second pass: near-good and short blocks take over the
label of their nearest decided neighbours; where the two sides differ, a near-good block is kept and a short one is
kept only if the near-good blocks on its way to a good one outnumber none. Headings and short blocks inside an article
element belong to it.

Regions: some elements name one (nav, aside, footer, ...), and so do words of class, id and role values, unless the same
name takes them back (``has-sidebar``, ``no-comments``, ``ad-free``); an article or main element is named by a whole value only.
What a value or a form names is no region if it holds more than half of the page's unlinked text, for then it wraps the
page; comments and hidden parts stay out whatever they hold.

Defined results: a null or empty page, or one without a good block, has the empty text; unclosed and misnested tags end
with the element around them; copies of a page have the same text; extra columns pass by untouched.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.registry import query, table

# Thresholds of the block rules.
LINKED = 0.33
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.18, 0.25

# Frequent function words of the languages served.
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you",
    "de": "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat im in ist mit nach nicht noch oder sich sie sind so und von war wie wird zu zum zur",
    "fr": "à au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous",
    "es": "a al con como de del el en es esta este ha la las lo los más no o para pero por que se ser sin sobre su sus un una y ya",
}
_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

_UNSEEN = frozenset("script style noscript template head title textarea select option button iframe object svg canvas math audio video map".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_TAGS = frozenset("nav aside footer menu dialog".split())
#: Bad unless they hold most of the page.
_WRAPPING_TAGS = frozenset("form fieldset".split())
_MAIN_TAGS = frozenset("article main".split())
# Words of class, id and role values that name a region outside the main text.
_BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter notice "
    "paywall popup promo promoted promotion related reply replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Of these, the ones that stay out whatever they hold.
_READERS_WORDS = frozenset("comment comments disqus reply replies respond".split())
# Words that take back what the rest of a name says.
_TAKING_BACK = frozenset("has no not non with without free enabled disabled hide hides is".split())
#: A wrapper's share of the page's unlinked characters.
MOST = 0.5
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# A cheap first look; _hidden decides.
_HIDDEN = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_DISPLAY = re.compile(r"(?:^|;)(?:\s|/\*.*?\*/)*display\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I | re.S)
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")


@dataclass
class Region:
    """A part of the page outside the main text; a wrapping one only if it does not hold most of the page."""

    wrapping: bool
    size: int = 0  # unlinked characters


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    heading: bool
    main: bool
    regions: tuple[Region, ...] = ()
    bad: bool = False
    label: str = field(default="")


@dataclass(frozen=True)
class _Open:
    """An open element, with what it inherits from those around it."""

    name: str
    main: bool = False
    regions: tuple[Region, ...] = ()
    heading: bool = False
    link: bool = False
    unseen: bool = False

    def inside(self, name: str, attributes: str) -> _Open:
        kind = _named(name, attributes, self.main)
        regions = self.regions if kind is None else (*self.regions, Region(kind))
        return _Open(name, self.main or name in _MAIN_TAGS, regions, self.heading or name in _HEADINGS, self.link or name == "a", self.unseen or name in _UNSEEN)


def _named(name: str, attributes: str, in_main: bool) -> bool | None:
    """Whether the region that an element opens is a wrapping one; None if it opens none."""
    if name in ("html", "body"):
        return None
    if name in _BAD_TAGS or (name == "header" and not in_main) or (attributes and _HIDDEN.search(attributes) and _hidden(attributes)):
        return False
    kind = True if name in _WRAPPING_TAGS else None
    for value in (v for m in _NAMES.finditer(attributes) for v in (m[1] or m[2] or m[3] or "").lower().split()) if attributes else ():
        words = set(re.split(r"[^a-z]+", value)) - {""}
        if words & _TAKING_BACK or not words & _BAD_WORDS or (name in _MAIN_TAGS and len(words) > 1 and not words & _READERS_WORDS):
            continue
        if words & _READERS_WORDS:
            return False
        kind = True
    return kind


def _hidden(attributes: str) -> bool:
    """Whether an element is unseen: by attributes of its own name hidden or aria-hidden, or by its style's last display (an important one first)."""
    values: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").strip().lower())
    found = _DISPLAY.findall(values.get("style", ""))
    display = [x for x, important in found if important] or [x for x, _ in found]
    return values.get("hidden", "false") != "false" or values.get("aria-hidden") == "true" or display[-1:] == ["none"]


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with what the rules ask about them."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack = [_Open("")]
    opened: Counter = Counter()

    def close_block() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            out.append(Block(text, linked, top.heading, top.main, top.regions))
        parts.clear()
        linked = 0

    def leave() -> None:
        opened[stack.pop().name] -= 1

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not stack[-1].unseen:
            raw = page[at:end]
            parts.append(raw)
            if stack[-1].link:
                linked += len(_SPACE.sub(" ", entities.unescape(raw)).strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name in _BLOCK:
            close_block()
        if closing:
            if opened[name] > 0:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name)
                # An inline end tag does not reach beyond the block it stands in.
                if name in _BLOCK or not any(x.name in _BLOCK for x in stack[depth + 1 :]):
                    while len(stack) > depth:
                        leave()
        elif name not in _VOID and not m[3].rstrip().endswith("/"):
            if name in _BLOCK:
                # A paragraph ends where a block begins, and with it the inline elements left open in it.
                while len(stack) > 1 and (stack[-1].name == "p" or stack[-1].name not in _BLOCK | _UNSEEN):
                    leave()
                if name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].name == name:
                    leave()
            if name in _RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if close is None and name in ("script", "style"):
                    break
                at = close.end() if close else at
            else:
                stack.append(stack[-1].inside(name, m[3]))
                opened[name] += 1
    close_block()
    for b in out:
        for region in b.regions:
            region.size += max(0, len(b.text) - b.linked)
    whole = sum(max(0, len(b.text) - b.linked) for b in out)
    for b in out:
        b.bad = any(not (r.wrapping and r.size > MOST * whole) for r in b.regions)
    return out


def first_label(b: Block, spoken: bool = True) -> str:
    """good, bad, near or short, from the block alone; spoken: stop words of the page's language are known."""
    if b.bad:
        return "bad"
    size = len(b.text)
    if b.linked > LINKED * size:
        return "bad"
    if b.main:
        # Inside the article only links and regions speak against a block.
        return "good"
    if size < SHORT:
        return "short"
    stops = _stop_share(b.text) if spoken else 1.0
    if stops >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in _STOPS for w in words) / max(1, len(words))


def classify(found: list[Block]) -> list[Block]:
    """Both passes; every block ends as good or bad."""
    judged = [b for b in found if not b.bad and not b.main and len(b.text) >= SHORT and b.linked <= LINKED * len(b.text)]
    spoken = any(b.main and not b.bad for b in found) or any(_stop_share(b.text) >= STOP_LOW for b in judged)
    first = [first_label(b, spoken) for b in found]
    n = len(found)

    def nearest(i: int, step: int, decided: tuple[str, ...]) -> str:
        j = i + step
        while 0 <= j < n:
            if first[j] in decided:
                return first[j]
            j += step
        return "bad"

    for i, b in enumerate(found):
        b.label = first[i]
        if first[i] in ("near", "short"):
            sides = {nearest(i, -1, ("good", "bad")), nearest(i, 1, ("good", "bad"))}
            if len(sides) == 1:
                b.label = sides.pop()
            else:
                closest = {nearest(i, -1, ("good", "bad", "near")), nearest(i, 1, ("good", "bad", "near"))}
                b.label = "good" if first[i] == "near" or "near" in closest and "bad" not in closest else "bad"
            if b.heading and first[i] == "short" and nearest(i, 1, ("good", "bad", "near")) in ("good", "near"):
                b.label = "good"
    return found


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kept = [b.text for b in classify(found) if b.label == "good"]
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("page")]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(page).alias("page")).mapInArrow(run, "key long, url string, text string, n_chars long")


@query("op6_extraction")
def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")
