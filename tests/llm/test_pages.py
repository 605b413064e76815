"""Main text of pages against a plain second version of the two passes, over generated pages."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import BLOCK_TAGS, CLOSED_BY, HEADINGS, OUT_TAGS, PHRASING_TAGS, VOID_TAGS

PLAIN, SUSPECT, OUT, HIDDEN = range(4)


def plain_name(name, in_article):
    words = [w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", name)]
    if set(words) & html_text.NOT_NAMES:
        return PLAIN
    tells = [w.startswith(html_text.OUT_STARTS) or w in html_text.OUT_WORDS and (w != "header" or not in_article) for w in words]
    alone = [w in html_text.OUT_ALONE for w in words]
    while len(words) > 1 and (words[-1] in html_text.EMPTY_WORDS or len(words[-1]) == 1):
        words, tells, alone = words[:-1], tells[:-1], alone[:-1]
    if words and (tells[-1] or alone == [True]):
        return OUT
    return SUSPECT if any(tells) or any(alone) else PLAIN


class Plain(HTMLParser):
    """A list of (text, open elements at it), with None between blocks. An element is [tag, what its attributes say, number]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.leaves, self.made = [], [None], 0

    def says(self, tag, attrs):
        said = PLAIN
        for k, v in attrs:
            v = v or ""
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "none" in v:
                return HIDDEN
            if k in ("class", "id") and tag not in ("main", "article", "body"):
                said = max([said, *(plain_name(n, bool(regions(self.path))) for n in v.split())])
        return said

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.leaves.append((" ", list(self.path)))
            return
        if tag in BLOCK_TAGS:
            self.leaves.append(None)
            while self.path and self.path[-1][0] in PHRASING_TAGS and self.path[-1][1] == OUT and not out(self.path[:-1]):
                self.path.pop()
            while (inner := [i for i, e in enumerate(self.path) if e[0] in BLOCK_TAGS]) and tag in CLOSED_BY.get(self.path[inner[-1]][0], ()):
                del self.path[inner[-1] :]
            if tag in ("main", "article") and not regions(self.path):  # menus and forms around it count as not closed
                while self.path and self.path[-1][0] in "nav menu form p ul li a".split():
                    self.path.pop()
        if tag not in VOID_TAGS:
            self.made += 1
            self.path.append([tag, self.says(tag, attrs), self.made])

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.leaves.append(None)
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return
            if self.path[i][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                return

    def handle_data(self, data):
        if not (self.path and self.path[-1][0] in ("script", "style", "title")):
            self.leaves.append((data, list(self.path)))


def out(path):
    for i, (tag, said, _) in enumerate(path):
        above = [t for t, _, _ in path[:i]]
        if said >= OUT or tag in OUT_TAGS or tag == "article" and "article" in above or tag == "header" and not {"article", "main"} & set(above):
            return True
    return False


def regions(path):
    """Numbers of the main and article elements around, outermost first."""
    found = []
    for i, (tag, _, n) in enumerate(path):
        if tag in ("main", "article") and not out(path[: i + 1]) and not (found and tag == "main"):
            found.append(n)
    return found


def plain_blocks(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    found, now, within = [], [], {}
    for leaf in [*parser.leaves, None]:
        if leaf is not None:
            now.append(leaf)
            continue
        told = [x for x in now if not out(x[1])]
        told = told if "".join(t for t, _ in told).strip() else now
        text = " ".join("".join(t for t, _ in told).split())
        if text:
            path = next(p for t, p in told if t.strip())
            around = regions(path)
            for a, b in zip([0, *around], around, strict=False):
                within[b] = a
            linked = sum(len("".join(t.split())) for t, p in now if not out(p) and any(e[0] == "a" for e in p))
            suspect = any(e[1] == SUSPECT for _, p in told for e in p)
            found.append({"text": text, "linked": linked, "out": out(path), "suspect": suspect, "region": around[-1] if around else 0, "heading": any(e[0] in HEADINGS for e in path)})
        now = []
    return found, within


def density(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words))


def plain_decide(b, by_words):
    n = len(b["text"])
    if b["out"] or b["linked"] > n / 2:
        return False
    if b["suspect"]:
        if b["heading"] or n < 70:
            return None
        return (density(b["text"]) >= (0.2 if n < 200 else 0.1)) if by_words else n >= 200
    if not b["region"] and n < 200 and ("©" in b["text"] or "copyright" in b["text"].lower()):
        return False
    if b["heading"] or n < 70:
        return None
    if not by_words:
        return True
    d = density(b["text"])
    if d >= 0.2 or d >= 0.1 and n >= 200:
        return True
    return None if b["region"] or d >= 0.1 or n < 200 else False


def plain_extract(page):
    found, within = plain_blocks(page)
    labels = [plain_decide(b, True) for b in found]
    if not any(labels) and any(x is False and not b["out"] and not b["linked"] for x, b in zip(labels, found, strict=True)):
        labels = [plain_decide(b, False) for b in found]
    for i, b in enumerate(found[:-1]):
        if b["heading"] and b["region"] and found[i + 1]["out"] and found[i + 1]["region"] == b["region"]:
            labels[i] = False
    final = list(labels)
    for i, b in enumerate(found):
        if labels[i] is not None:
            continue
        same = [j for j, x in enumerate(found) if not x["out"] and (x["region"], x["suspect"]) == (b["region"], b["suspect"])]
        k = same.index(i)
        before = [(k - n, labels[j]) for n, j in enumerate(same[:k]) if labels[j] is not None][-1:]
        after = [(n, labels[j]) for n, j in enumerate(same[k:]) if labels[j] is not None][:1]
        near = sorted(before + after)
        if not near:
            final[i] = not b["suspect"]
        elif b["heading"] and after:
            final[i] = after[0][1]
        elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
            final[i] = b["region"] > 0 and not b["suspect"]
        else:
            final[i] = near[0][1]
    size = lambda r: sum(len(b["text"]) for b, x in zip(found, final, strict=True) if x and b["region"] == r)
    dropped = {m for m in within.values() if m and sum(size(r) for r in within if within[r] == m) >= size(m)}
    inside = any(size(r) for r in within if r not in dropped)
    return "\n".join(b["text"] for b, x in zip(found, final, strict=True) if x and b["region"] not in dropped and (b["region"] or not inside))


STOP = "the of and a to in is that it was for on with as".split()
NAMES = ["ad", "ad-slot", "sidebar", "social-policy", "cookie-recipe", "cookieBanner", "article-teaser", "side-by-side", "has-sidebar", "tag-banner", "main-menu", "comments", "post", "content", "header", "related-articles", "side", "x1"]


def words(rnd, n):
    return " ".join(rnd.choice(STOP) if rnd.random() < rnd.choice([0.05, 0.15, 0.4]) else "".join(rnd.choices("bcdfgaeiou", k=rnd.randint(3, 8))) for _ in range(n))


def inline(rnd, depth=0):
    parts = []
    for _ in range(rnd.randint(1, 3)):
        text = words(rnd, rnd.choice([1, 2, 8, 20, 45])) + rnd.choice(["", " &amp; ", " &eacute;&#65; ", "  \n ", " &copy; "])
        kind = rnd.random()
        if depth < 2 and kind < 0.45:
            tag = rnd.choice(["span", "b", "a", "em", "button", "i"])
            attrs = rnd.choice(["", "", "", " hidden", " style='display:none'", f' class="{rnd.choice(NAMES)}"', f" class={rnd.choice(NAMES)}"])
            close = "" if tag in ("span", "b", "i", "em") and rnd.random() < 0.25 else f"</{tag}>"
            text = f"<{tag}{attrs}>{inline(rnd, depth + 1)}{close}"
        elif kind < 0.5:
            text += rnd.choice(["<br>", "</i>", "</em>", "<!-- no -->", "<script>var a = '<p>x</p>';</script>", "< 3 "])
        parts.append(text)
    return rnd.choice(["", " "]).join(parts)


def some_blocks(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        name = rnd.choice(["", "", f' class="{rnd.choice(NAMES)}"', f' id="{rnd.choice(NAMES)} {rnd.choice(NAMES)}"', " aria-hidden=true"])
        if kind < 0.45 or depth > 3:
            out.append(f"<p{name}>{inline(rnd)}" + rnd.choice(["</p>", "</p>", ""]))
        elif kind < 0.55:
            out.append(f"<h2{name}>{words(rnd, 4)}</h2>")
        elif kind < 0.62:
            out.append("<ul>" + "".join(f"<li>{inline(rnd)}" + rnd.choice(["</li>", ""]) for _ in range(rnd.randint(1, 4))) + "</ul>")
        else:
            tag = rnd.choice(["div", "div", "div", "section", "article", "article", "main", "aside", "nav", "footer", "header", "form", "blockquote"])
            out.append(f"<{tag}{name}>{some_blocks(rnd, depth + 1)}</{tag}>")
    return rnd.choice(["", "\n"]).join(out)


@pytest.mark.parametrize("seed", range(6))
def test_generated_pages_against_the_plain_version(seed):
    rnd = random.Random(seed)
    some = 0
    for _ in range(250):
        page = f"<html><body>{some_blocks(rnd)}</body></html>"
        assert html_text.extract(page) == plain_extract(page), page
        some += bool(html_text.extract(page))
    assert some > 50


ARTICLE = "<h1>A title</h1><p>This is the story of a house that was built on the hill, and of all who lived there.</p><p>Short one.</p>"
TEXT = "A title\nThis is the story of a house that was built on the hill, and of all who lived there.\nShort one."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>This is it. <span class="ad">Buy now</span> And more.</p></article>', "This is it. And more."),
        ("<article><p>Yes <span hidden>no</span><i style='display:none'>no</i><button>Share this</button> it is</p></article>", "Yes it is"),
        ('<article><p>The first one <span class="ad">Buy now</p><p>The next one is here</p></article>', "The first one\nThe next one is here"),
        ('<div><p>The text of the first <span class="ad">Buy now<p>The next one is here</div>', "The text of the first\nThe next one is here"),
        (f'<article class="post social-policy">{ARTICLE}</article>', TEXT),
        (f'<article class="category-legal tag-banner">{ARTICLE}</article>', TEXT),
        ('<p id="cookie-recipe">This is the recipe of the best of all the cakes that were made in the town.</p>', "This is the recipe of the best of all the cakes that were made in the town."),
        (f'<div class="article-teaser side-by-side">{ARTICLE}</div>', TEXT),
        (f'<div class="ad-free">{ARTICLE}</div>', TEXT),
        (f"<main><article>{ARTICLE}</article><div>Read next: This is the other of the stories that was in the town today.</div></main>", TEXT),
        ("<article><p>İ one</p><SCRIPT>var x = '</p>'</SCRIPT ><p>the end of it</p></article>", "İ one\nthe end of it"),
    ],
)
def test_what_inline_parts_and_names_say(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize(
    "page",
    ["<span>x</i>" * 40_000, "</i>" * 200_000, "<span><div>" + "<i>" * 100_000 + "</span>" * 100_000, "<div>" * 100_000 + "x" + "</p>" * 100_000, "<p><b>x" * 100_000, "<li><p>x" * 50_000, "<span class=ad>x<div>" * 30_000, "<script>" * 100_000, "x " * 2_000_000],
)
def test_odd_markup_of_any_length_takes_seconds(page):
    began = time.monotonic()
    assert html_text.extract(page) is not None
    assert time.monotonic() - began < 10
