"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags; inline parts that are hidden, buttons or named as adverts are left out of theirs. Pass one
decides blocks by where they stand (menus, footers, asides, forms, containers named as adverts, notices or comments are out), by link density, length
and the density of stop words; short blocks, and blocks of middling density, stay open. A name is what its last telling word says ("main-menu", "ad-slot");
such a word elsewhere ("cookie-recipe") is a suspicion, which long text with few links and many stop words outweighs. An article or main element is never out by its name.
Pass two gives each open block the label of its nearest decided neighbours
in the same container; headings look ahead, and where neighbours at the same distance differ, text inside an article stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

#: Lengths in code points and densities of the block rules.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.5, 0.10, 0.20
#: Tags that break blocks, tags without content, tags whose content is no text, tags that are never article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title svg math iframe object canvas audio video noframes".split())
OUT_TAGS = frozenset("nav footer aside form menu dialog button select head search".split())
CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words, and beginnings of words, in class, id or role that name what is not article; words that do so only if they are the whole name.
OUT_WORDS = frozenset(
    "ad ads adv adbox nav navbar share sharing social related login signin signup search alert notice notices widget toolbar reply replies respond responses consent gdpr skip legal masthead "
    "complementary contentinfo navigation menubar dialog toc header".split()
)
OUT_STARTS = tuple(
    "advert adsense banner breadcrumb comment cookie copyright disclaimer discussion disqus footer menu modal newsletter notification pagination pager popup promo recommend sidebar sponsor subscri topbar".split()
)
OUT_ALONE = frozenset("side teaser".split())
#: Words at the end of a name that tell nothing.
EMPTY_WORDS = frozenset(
    "area articles bar block body bottom box btn button center col column container content cta feed form frame group inner item items label large layer left link links list lists main message module news "
    "outer pane panel placeholder posts primary region right row secondary section sections set slot small space stories text thread title top unit view wrap wrapper zone".split()
)
#: Words that make a name tell what a page has or is about.
NOT_NAMES = frozenset("has with without no category tag topic".split())
#: Inline elements that cannot hold blocks.
PHRASING_TAGS = frozenset("abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or she so that the their them there they this to up was we were what when which who will with would you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind über um und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et être il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ese esta este está ha hay lo los las más muy o para pero por se sin sobre su sus también una y ya".split()
)
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|style|aria-hidden|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|$)""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What an element's attributes say of it.
PLAIN, SUSPECT, NAMED_OUT, HIDES = range(4)


@lru_cache(maxsize=10_000)
def _name_says(name: str, in_article: bool) -> int:
    """PLAIN, SUSPECT or NAMED_OUT for one name."""
    words = [w.lower() for w in NAME.findall(name)]
    if not NOT_NAMES.isdisjoint(words):  # "has-sidebar" names the page, not a side bar
        return PLAIN
    while len(words) > 1 and (words[-1] in EMPTY_WORDS or len(words[-1]) == 1):
        words.pop()
    tells = lambda w: w in OUT_WORDS and not (w == "header" and in_article) or w.startswith(OUT_STARTS)
    if words and (tells(words[-1]) or len(words) == 1 and words[0] in OUT_ALONE):
        return NAMED_OUT
    return SUSPECT if any(tells(w) or w in OUT_ALONE for w in words) else PLAIN


def _says(tag: str, attributes: str, in_article: bool) -> int:
    """The most that an element's attributes say."""
    said = PLAIN
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return HIDES
        if key in ("class", "id", "role") and tag not in ("html", "body", "main", "article"):
            said = max([said, *(_name_says(name, in_article) for name in value.split())])
    return said


class Block:
    __slots__ = ("text", "linked", "out", "suspect", "region", "heading", "label")

    def __init__(self, text: str, linked: int, out: bool, suspect: bool, region: int, heading: bool):
        self.text, self.linked, self.out, self.suspect, self.region, self.heading, self.label = text, linked, out, suspect, region, heading, None


class Open:
    """An open element: where it is out, suspect and of which article, and whether its own name alone puts it out."""

    __slots__ = ("tag", "out", "suspect", "region", "named")

    def __init__(self, tag: str, out: bool, suspect: bool, region: int, named: bool):
        self.tag, self.out, self.suspect, self.region, self.named = tag, out, suspect, region, named


class Stack:
    """Open elements, with the places of each tag's and of the blocks among them, so an end tag costs what it closes."""

    def __init__(self):
        self.all: list[Open] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.none = Open("", False, False, 0, False)

    @property
    def top(self) -> Open:
        return self.all[-1] if self.all else self.none

    @property
    def block(self) -> str:
        """The tag of the innermost open block."""
        return self.all[self.blocks[-1]].tag if self.blocks else ""

    def count(self, tag: str) -> int:
        return len(self.at.get(tag, ()))

    def push(self, e: Open) -> None:
        self.at.setdefault(e.tag, []).append(len(self.all))
        if e.tag in BLOCK_TAGS:
            self.blocks.append(len(self.all))
        self.all.append(e)

    def pop(self) -> None:
        e = self.all.pop()
        self.at[e.tag].pop()
        if e.tag in BLOCK_TAGS:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag: what is inside is closed as well; an inline element's does not reach out of the block that it stands in."""
        places = self.at.get(tag)
        if places and (tag in BLOCK_TAGS or not self.blocks or places[-1] > self.blocks[-1]):
            for _ in range(len(self.all) - places[-1]):
                self.pop()

    def close_block(self) -> None:
        for _ in range(len(self.all) - self.blocks[-1]):
            self.pop()


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """Blocks with text in page order, region being the number of the article or main element around, 0 outside; and the main around each article, by region."""
    found: list[Block] = []
    within: dict[int, int] = {}
    stack = Stack()
    parts: list[tuple[str, Open]] = []
    linked = regions = at = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            inside = [x for x in parts if not x[1].out]
            some = inside if any(not t.isspace() for t, _ in inside) else parts
            text = " ".join("".join(t for t, _ in some).split())
            if text:
                first = next(e for t, e in some if t and not t.isspace())
                found.append(Block(text, linked, first.out, any(e.suspect for _, e in some), first.region, any(stack.count(h) for h in HEADINGS)))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append((text, stack.top))
        if stack.count("a") and not stack.top.out:
            linked += len("".join(text.split()))

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, begin)
        if not m:
            after = page[begin + 1 : begin + 2]
            if after in ("!", "?") or after == "/" or after.isalpha():  # a declaration, or a tag that is not well formed
                end = page.find(">", begin)
                at = size if end < 0 else end + 1
            else:
                say("<")
                at = begin + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            parts.append((" ", stack.top))
            continue
        block = tag in BLOCK_TAGS
        if closing:
            if block:
                flush()
            stack.close(tag)
            continue
        if tag in RAW_TAGS:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I | re.A).search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = size if end < 0 else end + 1
            if block:
                flush()
            continue
        if block:
            flush()
            while stack.all and stack.top.named and stack.top.tag in PHRASING_TAGS:  # an inline advert that was not closed
                stack.pop()
            while stack.blocks and tag in CLOSED_BY.get(stack.block, ()):
                stack.close_block()
            if tag in ("main", "article") and not stack.top.region:  # what stands around the article was not closed
                while stack.all and stack.top.tag in ("nav", "menu", "form", "p", "ul", "li", "a"):
                    stack.pop()
        if tag in VOID_TAGS or attributes.endswith("/") and not block:
            continue
        here = stack.top
        said = _says(tag, attributes, here.region > 0)
        out = here.out or said == HIDES or tag in OUT_TAGS or tag == "header" and not here.region
        out = out or tag == "article" and stack.count("article") > 0  # an article inside one is a comment or a hint at another
        named = not out and said == NAMED_OUT
        region = here.region
        if tag in ("main", "article") and not out and not named and not (region and tag == "main"):
            regions += 1
            within[regions] = region
            region = regions
        stack.push(Open(tag, out or named, here.suspect or said == SUSPECT, region, named))
    flush()
    return found, within


def _density(text: str) -> float:
    """Share of stop words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def decide(b: Block, by_words: bool = True) -> bool | None:
    """Pass one: True for article, False for the rest, None if the block is short or middling. Without `by_words` length alone tells."""
    length = len(b.text)
    if b.out or b.linked > LINKS * length:
        return False
    if b.suspect:
        if b.heading or length < SHORT:
            return None
        return _density(b.text) >= (STOP_HIGH if length < LONG else STOP_LOW) if by_words else length >= LONG
    if not b.region and length < LONG and ("©" in b.text or "copyright" in b.text.lower()):
        return False
    if b.heading or length < SHORT:
        return None
    if not by_words:
        return True
    density = _density(b.text)
    if density >= STOP_HIGH or density >= STOP_LOW and length >= LONG:
        return True
    return None if b.region or density >= STOP_LOW or length < LONG else False


def inherit(found: list[Block]) -> None:
    """Pass two: open blocks take the label of the nearest decided neighbours in their region, suspect ones of suspect ones."""
    regions: dict[tuple[int, bool], list[Block]] = {}
    for b, after in zip(found, [*found[1:], None], strict=False):
        if b.heading and b.region and after and after.out and after.region == b.region:
            b.label = False  # the heading of comments or hints inside an article
        if not b.out:  # what stands in a menu or notice says nothing about text between
            regions.setdefault((b.region, b.suspect), []).append(b)
    for (region, suspect), some in regions.items():
        n = len(some)
        before, after, last = [None] * n, [None] * n, None
        for i in range(n):
            before[i] = last
            last = i if some[i].label is not None else last
        last = None
        for i in range(n - 1, -1, -1):
            after[i] = last
            last = i if some[i].label is not None else last
        said = []
        for i, b in enumerate(some):
            p, q = before[i], after[i]
            if b.label is not None:
                said.append(b.label)
            elif p is None and q is None:
                said.append(not suspect)
            elif b.heading and q is not None:
                said.append(some[q].label)
            elif p is None or q is None:
                said.append(some[q if p is None else p].label)
            elif some[p].label == some[q].label:
                said.append(some[p].label)
            elif i - p != q - i:
                said.append(some[p if i - p < q - i else q].label)
            else:
                said.append(region > 0 and not suspect)
        for b, label in zip(some, said, strict=True):
            b.label = label


def extract(page: str | None) -> str:
    """The article's blocks, each with white space as single spaces, joined by newlines; empty for a null page."""
    found, within = blocks(page or "")
    for by_words in (True, False):  # a page without any article by its words is in a language whose stop words are not listed
        for b in found:
            b.label = decide(b, by_words)
        if by_words and any(b.label is False and not b.out and not b.linked for b in found) and not any(b.label for b in found):
            continue
        inherit(found)
        break
    said: dict[int, int] = {}  # characters of each article or main
    for b in found:
        if b.label:
            said[b.region] = said.get(b.region, 0) + len(b.text)
    for main in {m for m in within.values() if m}:  # of a main with articles the articles count, unless they are hints beside its text
        if sum(said.get(r, 0) for r, m in within.items() if m == main) >= said.get(main, 0):
            said.pop(main, None)
    if any(said.get(r) for r in within):  # with an article, what stands outside is not of it
        said.pop(0, None)
    return "\n".join(b.text for b in found if b.label and b.region in said)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) for every row of pages.

    A null page counts as empty and has empty text; null and repeated ids and urls are carried as they are; other columns are not
    read. Pages of any length are read whole. An empty table has an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html"):
            texts = pa.array([extract(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), texts], names=["id", "url", "text"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
