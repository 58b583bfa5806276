"""Blocks of Markdown texts by a plain line automaton, which the library's expressions are held against."""

from __future__ import annotations

import re
FRONT_MATTER_LINES = 200
LINES = re.compile(r"([^\r\n]*)(\r\n|\r|\n)|([^\r\n]+)\Z")
FENCE = re.compile(r"\s*(`{3,}|~{3,})")
TABLE_DELIMITER = re.compile(r"\s*(?=[^|]*\|)(?=(?:[^-]*-){3})[|:\s-]+\Z")
HEADING = re.compile(r"\s*#{1,6}(?:\Z|[ \t\n\r\f])")
SETEXT = re.compile(r"\s*(?:-+|=+)\s*\Z")
DEFINITION = re.compile(r"\s*\[(?!\]:)(?:(?!\]:).)+\]:\s*\S", re.S)
HTML = re.compile(r"\s*<[/!?A-Za-z]")
RULE = re.compile(r"\s*([-*_])(?:\s*\1){2,}\s*\Z")
LIST = re.compile(r"\s*(?:[-*+] |[0-9]+[.)][ \t\n\r\f])")


def _blank(line: str) -> bool:
    return not line.strip()


def _indented(line: str) -> bool:
    return line.startswith(("\t", "    ")) and not _blank(line)


def _item(line: str) -> bool:
    return line.lstrip().startswith(">") or bool(LIST.match(line))


def _indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return sum(4 if c == "\t" else 1 for c in lead)


class _Block:
    """An open block. `rest`: a function that tells whether the next line still belongs to it."""

    def __init__(self, kind: str, rest):
        self.kind, self.rest, self.closed = kind, rest, False

    def takes(self, line: str, after: str | None) -> bool:
        if not self.closed and self.rest(line, after):
            return True
        self.closed = True  # from here on, only blank lines
        return _blank(line) and self.kind != "blank"


def _until(is_end):
    """Takes lines up to and with the first that is an end, blank or not."""
    done = False

    def rest(line: str, after: str | None) -> bool:
        nonlocal done
        if done:
            return False
        done = is_end(line)
        return True

    return rest


def _first(n: int, test=lambda line: True):
    """Takes the next n lines, then those that pass the test."""
    left = n

    def rest(line: str, after: str | None) -> bool:
        nonlocal left
        left -= 1
        return left >= 0 or (test is not None and not _blank(line) and test(line))

    return rest


def _starts(line: str, after: str | None) -> bool:
    """Whether a line ends a paragraph or an item by starting something else."""
    return (
        any(p.match(line) for p in (FENCE, HEADING, DEFINITION, HTML, RULE)) or line.strip() == "$$" or _indented(line) or _item(line)
        or (after is not None and (("|" in line and bool(TABLE_DELIMITER.match(after))) or bool(SETEXT.match(after))))
    )


def _open(line: str, after: str | None) -> _Block:
    if _blank(line):
        return _Block("blank", lambda *_: False)
    if fence := FENCE.match(line):
        close = re.compile(rf"\s*{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*\Z")
        return _Block("locked_block", _until(lambda x: bool(close.match(x))))
    if line.strip() == "$$":
        return _Block("locked_block", _until(lambda x: x.strip() == "$$"))
    if "|" in line and after is not None and TABLE_DELIMITER.match(after):
        return _Block("locked_block", _first(1, lambda x: "|" in x))
    if HEADING.match(line):
        return _Block("heading", _first(0, None))
    if after is not None and SETEXT.match(after):
        return _Block("heading", _first(1, None))
    if DEFINITION.match(line) or HTML.match(line) or RULE.match(line) or _indented(line):
        return _Block("locked_block", _first(0, _indented if _indented(line) else None))
    if line.lstrip().startswith(">"):
        return _Block("quote", lambda x, a: not _blank(x) and (x.lstrip().startswith(">") or not _starts(x, a)))
    if LIST.match(line):
        deeper = lambda x: not _item(x) or _indent(x) > _indent(line)
        return _Block("list_item", lambda x, a: not _blank(x) and (deeper(x) or not _starts(x, a)))
    return _Block("paragraph", lambda x, a: not _blank(x) and not _starts(x, a))


def _front_matter(lines: list[str]) -> range:
    start = next((i for i, x in enumerate(lines) if not _blank(x)), len(lines))
    if start < len(lines) and lines[start].lstrip("﻿").strip() == "---":
        for i in range(start + 1, min(len(lines), start + FRONT_MATTER_LINES + 1)):
            if lines[i].strip() in ("---", "..."):
                return range(start, i + 1)
    return range(0)


def blocks_of(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each block; the texts joined are the text."""
    found = [(m[1] if m[3] is None else m[3], m[0]) for m in LINES.finditer(text)]
    lines = [x for x, _ in found]
    matter = _front_matter(lines)
    out: list[list] = []
    now: _Block | None = None
    for i, (line, whole) in enumerate(found):
        after = lines[i + 1] if i + 1 < len(lines) else None
        if now is None or i == matter.start < matter.stop or not now.takes(line, after):
            now = _Block("locked_block", _first(len(matter) - 1, None)) if i == matter.start < matter.stop else _open(line, after)
            out.append([now.kind, ""])
        out[-1][1] += whole
    return [(kind, x) for kind, x in out]
