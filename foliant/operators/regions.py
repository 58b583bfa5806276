"""What the regions of all formats have in common: kinds, how neighbours merge, and the table of a text's regions.

A region is (kind, body). Slots are made from regions by expressions, in foliant.operators.template.
"""

from __future__ import annotations

from collections.abc import Iterable

import regex

TEXT, ATOMIC, LOCKED, SYNTAX, OBJECT = range(5)
#: The role, whether it is editable, and how it is split, of each kind.
KINDS = {
    TEXT: ("editableText", True, "boundaryAware"),
    ATOMIC: ("editableText", True, "atomic"),
    LOCKED: ("lockedText", False, "atomic"),
    SYNTAX: ("syntaxToken", False, "atomic"),
    OBJECT: ("inlineObject", False, "atomic"),
}
Region = tuple[int, str]

_BREAK = r"(?>\r\n|\r|\n)"
SEPARATOR = regex.compile(rf"{_BREAK}(?:[ \t]*+{_BREAK})++")


def add(out: list[Region], kind: int, body: str) -> None:
    """Adds a region; one like the last is joined to it."""
    if body:
        if out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + body)
        else:
            out.append((kind, body))


def atomic(regions: Iterable[Region]) -> list[Region]:
    """The regions, texts not to be split."""
    return [(ATOMIC if kind == TEXT else kind, body) for kind, body in regions]


def parted(body: str) -> tuple[str, str]:
    """Text and the separator after it: a paragraph break if the first one ends the body, else its last white space."""
    found = SEPARATOR.search(body)
    if found and found.end() == len(body):
        return body[: found.start()], found[0]
    text = body.rstrip()
    return text, body[len(text) :]
