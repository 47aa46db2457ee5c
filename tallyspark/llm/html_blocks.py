"""Blocks of text of a web page, with the part of the page they stand in."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

ARTICLE, MAIN, LOOSE, CHROME = "article", "main", "loose", "chrome"

# Element names and the words that mark an element as page furniture.
_HIDDEN = frozenset("script style title noscript iframe template svg math object".split())
_FURNITURE = frozenset(
    "nav footer aside form button select textarea dialog menu datalist".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SELF_CLOSING = frozenset("p li dt dd td th tr option".split())
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "form".split()
)
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup comment comments commentlist disqus respond replies sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead related recommended share sharing social "
    "widget toolbar pagination".split()
)
_BESIDE = frozenset(  # marks of what may hold articles that are not the page's own
    "comment comments commentlist disqus respond replies related recommended".split()
)
_NEVER_MARKED = frozenset("html body article main".split())

_LAYOUT = frozenset(  # words that may stand beside a mark in a class or id
    "site page main global top bottom left right primary secondary header head box bar container "
    "wrapper wrap inner outer content links list section area block panel group item items".split()
)

_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)|[!?/])")
_OPEN_ENDED = re.compile(r"<(?:(?P<comment>!--)|[!?/])")  # where no > follows any more
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_OUTSIDE = re.compile(r"[^<>\"']*+")
_ATTRIBUTE = re.compile(
    r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.DOTALL
)
_MARK_WORD = re.compile(r"[a-z]+")
_HUGE_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{7,}+);?")
_LEADING_ZEROS = re.compile(r"(?<=&#)0{8,}+(?=[0-9])")


class Block(NamedTuple):
    part: str
    text: str


def _names(value: str, marks: frozenset[str]) -> bool:
    """Is one of the classes a mark, or made of marks and words of layout alone?"""
    for one in value.split():
        words = _MARK_WORD.findall(one)
        if not marks.isdisjoint(words) and all(word in _MARKS | _LAYOUT for word in words):
            return True
    return False


def _decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters become U+FFFD."""
    if "&#" in text:
        text = _LEADING_ZEROS.sub("", _HUGE_NUMBER.sub("\ufffd", text))
    return html.unescape(text)


def _marked(name: str, rest: str) -> bool:
    """Is the element furniture by its class, id, role or by being hidden?"""
    if not rest or rest.isspace() or name in _NEVER_MARKED:
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and _names(value, _MARKS):
            return True
        if key == "role" and value.strip() in _ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true"):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _beside(name: str, rest: str) -> bool:
    """Is the element a place of comments or of links to other pages?"""
    return name not in _NEVER_MARKED | _SELF_CLOSING | _VOID and any(
        key.lower() in ("class", "id")
        and _names("".join(values).lower(), _BESIDE)
        for key, *values in _ATTRIBUTE.findall(rest)
    )


def _tag_end(page: str, at: int, last: dict[str, int], failed: set[int]) -> int:
    """Where the tag ends whose attributes begin at ``at``, -1 if a quote in it never closes.

    ``failed`` remembers places outside quotes from which no end can be reached, so that many
    broken tags do not read the same text again and again.
    """
    passed = []
    while True:
        at = _OUTSIDE.match(page, at).end()
        sign = page[at] if at < len(page) else ""
        if sign == ">":
            return at
        if sign == "<" and at not in failed:
            passed.append(at)
        elif sign not in last or at >= last[sign]:
            failed.update(passed)
            return -1
        else:
            at = page.index(sign, at + 1)
        at += 1


def _markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, is it an end tag, and attributes of each piece of markup.

    A hidden element is one piece with all it holds. Comments and the like have no name. A
    tag with a quote that never closes ends at the next >. Time is linear in the page.
    """
    at, last_end = 0, page.rfind(">")
    last = {sign: page.rfind(sign) for sign in "\"'"}
    failed: set[int] = set()
    broken = False
    while found := (_OPEN if at <= last_end else _OPEN_ENDED).search(page, at):
        start, at = found.span()
        name = (found.groupdict().get("name") or "").lower()
        if name and at > last_end:  # no end can follow
            at = start + 1
            if found["end"]:
                yield start, len(page), "", False, ""
                return
            continue
        if found["comment"] or not name:
            closing = "-->" if found["comment"] else ">"
            stop = page.find(closing, at)
            at = len(page) if stop < 0 else stop + len(closing)
            yield start, at, "", False, ""
            continue
        whole = None if broken else _REST.match(page, at)
        if whole:
            stop = whole.end() - 1
        else:
            broken = True
            stop = _tag_end(page, at, last, failed)
            stop = page.index(">", at) if stop < 0 else stop
        rest, at, ends = page[at:stop], stop + 1, bool(found["end"])
        if name in _HIDDEN and not ends and not rest.endswith("/"):
            closing = re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else len(page)
        yield start, at, name, ends, rest


def _closings(page: str) -> dict[int, int]:
    """Where the elements that are closed begin, and where their end tags do."""
    opened: dict[str, list[int]] = {}
    closed = {}
    for start, _, name, ends, rest in _markup(page):
        if not ends and not rest.endswith("/"):
            opened.setdefault(name, []).append(start)
        elif ends and opened.get(name):
            closed[opened[name].pop()] = start
    return closed


def blocks(page: str | None) -> list[Block]:
    """Non-empty blocks in page order, references decoded, white space collapsed.

    Furniture (navigation, adverts, forms, comments and the like) is ``chrome`` wherever it
    stands, scripts and other invisible elements are left out. Unclosed elements are
    tolerated: furniture that is never closed ends at the next article. Articles inside
    comments or links to related pages are ``chrome`` as these are. A form around more than
    half of the page is no furniture.
    """
    made: list[Block] = []
    text: list[str] = []
    articles = mains = 0
    furniture: list[str] = []  # the open element that is furniture, and its likes within

    def part() -> str:
        if furniture:
            return CHROME
        return ARTICLE if articles else MAIN if mains else LOOSE

    def flush() -> None:
        whole = " ".join(_decoded("".join(text)).split())
        text.clear()
        if whole:
            made.append(Block(part(), whole))

    def around_page(start: int) -> bool:
        nonlocal closings
        closings = _closings(page) if closings is None else closings
        return 2 * (closings.get(start, len(page)) - start) > len(page)

    at, page = 0, page or ""
    closings: dict[int, int] | None = None
    beside, before = 0, (0, 0)  # end of the comments or links, articles and mains around them
    for start, end, name, ends, rest in _markup(page):
        text.append(page[at:start])
        at = end
        if not name or name in _HIDDEN:
            continue
        if name in _BLOCKS:
            flush()
        elif name in ("br", "img"):
            text.append(" ")
        if beside and start >= beside:
            beside, (articles, mains) = 0, before
        if ends:
            if furniture and name == furniture[0]:
                furniture.pop()
            if name == "article":
                articles = max(0, articles - 1)
            elif name == "main":
                mains = max(0, mains - 1)
            continue
        if not beside and (furniture or _marked(name, rest)) and _beside(name, rest):
            closings = _closings(page) if closings is None else closings
            beside, before = closings.get(start, 0), (articles, mains)
        if furniture and not beside:
            if name in ("article", "main") and not (articles or mains):
                furniture.clear()
            elif furniture[0] in _SELF_CLOSING and name in _BLOCKS:
                furniture.clear()
        if furniture:
            if name == furniture[0] and not rest.endswith("/"):
                furniture.append(name)
        elif name not in _VOID and (
            name in _FURNITURE
            and not (name == "form" and around_page(start))
            or (name == "header" and not (articles or mains))
            or _marked(name, rest)
        ):
            flush()
            furniture.append(name)
        if name == "article":
            articles += 1
        elif name == "main":
            mains += 1
    text.append(page[at:])
    flush()
    return made


def main_part(made: list[Block]) -> str:
    """The part that is a page's main text, ``LOOSE`` if its marks do not tell.

    Articles, or what is in main on a page without any, are the text if they hold more than
    half of the characters that are not furniture. Otherwise they may be teasers, and all
    blocks but furniture are candidates.
    """
    sizes = dict.fromkeys((ARTICLE, MAIN, LOOSE, CHROME), 0)
    for block in made:
        sizes[block.part] += len(block.text)
    part = ARTICLE if sizes[ARTICLE] else MAIN
    whole = sizes[ARTICLE] + sizes[MAIN] + sizes[LOOSE]
    return part if 2 * sizes[part] > whole else LOOSE
