"""Regions of a TeX block: text, and what a rewrite must not touch.

TOKENS matches a comment, formula, kept environment or command, and STARTS finds where one may begin; all between tokens is text. The arguments of
headings (if allowed), of text commands and of links are read in the same way, as texts that are not split.
"""

from __future__ import annotations

import regex

from foliant.operators.regions import LOCKED, OBJECT, SYNTAX, TEXT, Region, add, atomic
from foliant.operators.tex_blocks import GROUPS, MATH, RAW, one_of

# Commands whose argument is a heading, a text, or a link and its text.
HEADING_COMMANDS = ["section", "subsection", "subsubsection", "paragraph", "subparagraph", "chapter", "part", "title", "subtitle", "caption"]
TEXT_COMMANDS = ["footnote", "emph", "textbf", "textit", "underline", "textrm", "textsf", "textsc"]
LINK_COMMANDS = ["href"]
DEPTH = 100

TOKENS = regex.compile(
    rf"""
      (?P<comment> (?=%) (?&plain) % [^\r\n]*+ (?> \r\n | \r | \n | \Z ) )
    | (?P<object>
          (?=\$) (?&plain) \$\$ (?: \\. | \$(?!\$) | [^$\\] )*+ (?: \$\$ | \\?\$?\Z )
        | (?=\$) (?&plain) \$(?!\$) (?: \\. | [^$\\] )*+ \$
        | (?=\\\() (?&plain) \\\( .*? \\\)
        | (?=\\\[) (?&plain) \\\[ .*? \\\]
        | (?: (?<![^\r\n]) [^\S\r\n]++ )? \\begin\{{ (?P<name> {one_of(RAW + MATH)} ) \}} .*? (?: \\end\{{ (?P=name) \}} [^\r\n]*+ (?> \r\n | \r | \n | \Z ) | \Z )
        | \\verb \*? (?P<bar> \S ) .*? (?: (?P=bar) | \Z )
        | \\(?: lstinline | path ) \*? (?: (?&gap) (?&brackets) )*+ (?&gap) (?P<mark> [^\s{{}}] ) .*? (?: (?P=mark) | \Z )
      )
    | (?P<link> (?P<link_open> \\{one_of(LINK_COMMANDS)} (?![A-Za-z]) \*? (?: (?&gap) (?&brackets) )*+ (?&gap) ) (?P<target> (?&braces) ) (?P<between> (?&gap) ) (?P<label> (?&braces) ) )
    | (?P<heading> \\{one_of(HEADING_COMMANDS)} (?![A-Za-z]) \*? (?: (?&gap) (?&brackets) )*+ (?&gap) ) (?P<title> (?&braces) )
    | (?P<styled> \\{one_of(TEXT_COMMANDS)} (?![A-Za-z]) \*? (?: (?&gap) (?&brackets) )*+ (?&gap) ) (?P<words> (?&braces) )
    | (?P<command> \\[A-Za-z]++ \*? (?: (?&gap) (?: (?&brackets) | (?&braces) ) )*+ | \\\\ \*? (?&gap) (?&brackets)?+ | \\(?: . | \Z ) )
    (?(DEFINE) (?P<gap> [\ \t\r\n]*+ ) (?P<plain> (?<! (?<!\\) (?:\\\\)*+ \\ ) ) {GROUPS} )
    """,
    regex.X | regex.S | regex.V0,
)

#: Where a token may begin: trying the whole expression at every character costs a hundred times as much.
STARTS = regex.compile(r"[%$\\]|(?<![^\r\n])[^\S\r\n]++(?=\\begin\{)", regex.V0)


def _next_token(text: str, at: int) -> regex.Match | None:
    while start := STARTS.search(text, at):
        if found := TOKENS.match(text, start.start()):
            return found
        at = start.start() + 1
    return None


def _opened(group: str) -> tuple[str, str, str] | None:
    """Opening brace, content and last character of a group; None if it is a lone brace."""
    return (group[0], group[1:-1], group[-1]) if len(group) > 1 else None


def regions_of(text: str, headings: bool = False, depth: int = 0) -> list[Region]:
    """The regions of a text; the arguments of commands nested deeper than DEPTH are kept as they are."""
    if depth > DEPTH:
        return [(LOCKED, text)] if text else []
    out: list[Region] = []
    done = at = 0
    while found := _next_token(text, at):
        made = _token(found, headings, depth + 1)
        at = found.end()
        if made is None:  # a lone brace at the end: the command alone is kept
            made, at = [(LOCKED, found[0])], len(text)
        add(out, TEXT, text[done : found.start()])
        for kind, body in made:
            add(out, kind, body)
        done = at
        if at >= len(text):
            break
    add(out, TEXT, text[done:])
    return out


def _token(found: regex.Match, headings: bool, depth: int) -> list[Region] | None:
    if found["comment"] is not None or found["command"] is not None:
        return [(LOCKED, found[0])]
    if found["object"] is not None:
        return [(OBJECT, found[0])]
    if found["link"] is not None:
        target, label = _opened(found["target"]), _opened(found["label"])
        if not target or not label:
            return None
        return [
            (SYNTAX, found["link_open"] + target[0]), (OBJECT, target[1]), (SYNTAX, target[2] + found["between"] + label[0]),
            *atomic(regions_of(label[1], headings, depth)), (SYNTAX, label[2]),
        ]
    is_heading = found["heading"] is not None
    group = _opened(found["title" if is_heading else "words"])
    if not group:
        return None
    inner = [(LOCKED, group[1])] if is_heading and not headings else atomic(regions_of(group[1], headings, depth))
    return [(SYNTAX, found["heading" if is_heading else "styled"] + group[0]), *inner, (SYNTAX, group[2])]

