"""Paragraph and section text of HTML, by one pass over its tags with a stack of open elements.

Rules: scripts, styles, comments and declarations have no text. A ``<`` that begins no tag is
text; quotes in a tag may hold ``>``. A ``span`` with the word ``error`` among its classes goes
with all that is in it, however deep. A paragraph ends at its end tag, at the end tag of an
element around it, or where the next one begins. An end tag without its element is skipped.
Character references are decoded as browsers do (``&amp b`` too); unknown ones stay. Text that is
not closed at the end of the page counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_REST = r"""(?:[^>"'/]++|"[^"]*+"|'[^']*+'|/)*+"""
# groups: raw-text element, end-tag slash, name, attributes
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_REST}>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s/>]*+)({_REST})>|<[!?][^>]*+>", re.S | re.I)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements without content, and headings of sections.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SECTION_LEVELS = {f"h{i}": i for i in range(2, 7)}


def _is_error(attributes: str) -> bool:
    found = _CLASS.search(attributes)
    return bool(found) and "error" in (found[1] or found[2] or found[3] or "").split()


def blocks(page: str, sections: bool) -> Iterator[tuple[int, str]]:
    """(0, text) of each paragraph; with ``sections`` also (level, text) of each heading of level 2 to 6,
    which ends an open paragraph."""
    stack: list[str] = []
    errors: list[int] = []             # heights of the stack below open error spans
    held: list[str] = []
    inside, height, at = -1, 0, 0      # level of the open block (-1: none), the stack below it

    def closed() -> tuple[int, str]:
        nonlocal inside
        level, inside = inside, -1
        text = html.unescape("".join(held)) if held else ""
        held.clear()
        return level, text

    def shrink(to: int) -> Iterator[tuple[int, str]]:
        del stack[to:]
        while errors and errors[-1] >= to:
            errors.pop()
        if inside >= 0 and to <= height:
            yield closed()

    for tag in _TAG.finditer(page):
        if inside >= 0 and not errors and tag.start() > at:
            held.append(page[at: tag.start()])
        at = tag.end()
        name = tag[3]
        if name is None:
            continue
        name = name.lower()
        if tag[2]:
            if name in stack:
                yield from shrink(len(stack) - 1 - stack[::-1].index(name))
            continue
        level = 0 if name == "p" else SECTION_LEVELS.get(name, -1) if sections else -1
        if level >= 0 and not errors:
            if inside == 0:
                yield from shrink(height)
            if inside < 0:
                inside, height = level, len(stack)
        if name not in VOID and not tag[4].endswith("/"):
            if name == "span" and _is_error(tag[4]):
                errors.append(len(stack))
            stack.append(name)
    if inside >= 0 and not errors and at < len(page):
        held.append(page[at:])
    if inside >= 0:
        yield closed()


def page_text(page: str) -> str:
    """Texts of all paragraphs, joined by newlines."""
    return "\n".join(text for _, text in blocks(page, False))


def section_text(page: str, prefixes: Sequence[str]) -> str | None:
    """Text of the first section whose heading begins with one of ``prefixes`` (case-folded), with its
    subsections; the text before the first heading when there is none; None for no text."""
    wanted, level, intro, texts = tuple(prefixes), None, [], []
    headed = False
    for kind, text in blocks(page, True):
        if kind:
            headed = True
            if level is not None and kind <= level:
                break
            if level is None and text.strip().casefold().startswith(wanted):
                level = kind
        elif level is not None:
            texts.append(text)
        elif not headed:
            intro.append(text)
    return "\n".join(texts if level is not None else intro) or None


def _each(f: Callable[[str], str | None]):
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else f(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def paragraph_text(html_col: Column) -> Column:
    return _each(page_text)(html_col)


def synopsis(html_col: Column, prefixes: Sequence[str]) -> Column:
    prefixes = tuple(prefixes)
    return _each(lambda page: section_text(page, prefixes))(html_col)
