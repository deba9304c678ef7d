"""Tokens of one web page: tags with their path of containers, and texts with what holds them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import xxhash

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var""".split())
BOILERPLATE_TAGS = frozenset("head title nav header footer aside form menu dialog button select fieldset".split()) | RAW
# Words in class, id or role that name what is not the article.
BOILERPLATE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations comment comments disqus reply replies discussion respond
    widget toolbar pagination pager skip search""".split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}  # an opening tag that ends an open element
BOUNDS = frozenset("ul ol dl table tbody article section div body main blockquote".split())  # not searched past

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


class Token(NamedTuple):
    key: int        # of the tag in its path, or of the text in its path
    text: str       # of a text; "" for a tag
    path: str       # containers around it
    junk: bool      # inside an element that is not the article
    main: bool      # inside an article or main element
    link: bool      # inside a link
    breaks: bool    # a tag that ends a block
    parent: int = 0  # of a text: key of the tag around it


def tokens(page: str) -> list[Token]:
    """All tags and texts of a page in order; scripts, styles and comments are skipped."""
    out: list[Token] = []
    stack: list[tuple] = [("", "", False, False, False, 0)]  # tag, path, junk, main, link, key
    at, n = 0, len(page)

    def text(lo: int, hi: int) -> None:
        raw = page[lo:hi]
        if raw and not raw.isspace():
            _, path, junk, main, link, key = stack[-1]
            out.append(Token(xxhash.xxh3_64_intdigest(f"T|{path}|{' '.join(raw.split())}"), raw, path, junk, main, link, False, key))
        elif raw:
            out.append(Token(0, " ", *stack[-1][1:5], False))

    def drop(names: set[str] | frozenset, bounds: frozenset) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return True
            if stack[i][0] in bounds:
                return False
        return False

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(at, n)
            break
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if m[1]:
            _, path, junk, main, link, _ = stack[-1]
            out.append(Token(xxhash.xxh3_64_intdigest(f"C|{path}|{tag}"), "", path, junk, main, link, not inline))
            drop({tag}, BOUNDS - {tag} if inline or tag in CLOSES else frozenset())
            continue
        if tag in CLOSES:
            drop(CLOSES[tag], BOUNDS)
        elif not inline and tag not in VOID:
            drop({"p"}, BOUNDS)
        _, path, junk, main, link, _ = stack[-1]
        attrs = " ".join(v.strip("\"'").lower() for _, v in _ATTR.findall(m[3])) if m[3] else ""
        key = xxhash.xxh3_64_intdigest(f"O|{path}|{tag}|{_DIGITS.sub('', attrs)}")
        out.append(Token(key, "", path, junk, main, link, not inline))
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        junk = junk or tag in BOILERPLATE_TAGS or bool(attrs) and not BOILERPLATE_WORDS.isdisjoint(_WORD.split(attrs))
        if tag in ("html", "body"):
            junk = False  # a class of the whole page says nothing about its parts
        name = f"{tag}.{_DIGITS.sub('', attrs)}" if attrs else tag  # numbers in names differ from page to page
        stack.append((tag, path if inline or tag == "p" else f"{path}/{name}", junk,
                      main or tag in MAIN_TAGS or "role" in m[3].lower() and "main" in attrs.split(), link or tag == "a", key))
    return out


def blocks(kept: list[Token | None]) -> str:
    """Text of tokens (None where one was left out): white space in a block is one space, blocks are joined by one."""
    parts: list[str] = []
    for t in kept:
        parts.append(" " if t is None or t.breaks else t.text)
    return " ".join(html.unescape("".join(parts)).split())
