"""Regions of a Markdown block: text, and what a rewrite must not touch.

Lines are read one by one: what stands before their words, then protected spans, which TOKENS matches in order, and
between these the marks of emphasis. A link gives its label up for rewriting and keeps the rest.
"""

from __future__ import annotations

import regex

from foliant.operators.regions import LOCKED, OBJECT, SYNTAX, TEXT, Region, add, atomic, parted

# Characters that end a bare URL, and those that it does not end with.
URL_STOPS = "<>\"'[](){}（）【】「」『』《》〈〉“”‘’，。；：！？"
URL_TAILS = ".,;:!?，。；：！？)]}）】」』》〉\"'”’"

_BLANK = r"[ \t\n\r\f]"
PREFIX = regex.compile(rf"[ \t]*(?:\[\^[^\]]*\]:{_BLANK}*|\#{{1,6}}{_BLANK}+|>+{_BLANK}*|[-*+]{_BLANK}+(?:\[[ xX]\]{_BLANK}*)?|[0-9]+[.)]{_BLANK}+)")
LINES = regex.compile(r"([^\r\n]*)((?>\r\n|\r|\n))|([^\r\n]+)\Z")
_NESTED = r"""
    (?P<square> \[ (?: [^\[\]\\]++ | \\(?:.|\Z) | (?&square) )*+ \] )
    (?P<round> \( (?: [^()\\]++ | \\(?:.|\Z) | (?&round) )*+ \) )
    (?P<plain> (?<! (?<!\\) (?:\\\\)*+ \\ ) )
"""
TOKENS = regex.compile(
    rf"""
      (?<!`) (?P<ticks> `++ ) (?:.*?[^`])? (?P=ticks) (?!`)
    | !? (?&square) [ \t]* (?: (?&round) | (?&square) )
    | (?= \[ (?: \^ | -?@ ) ) (?&square)
    | <!-- .*? -->
    | < (?i: https?:// | mailto: ) [^>]* >
    | < (?=[/A-Za-z]) (?: [^>'"\r\n] | '[^'\r\n]*' | "[^"\r\n]*" )* >
    | (?P<url> (?: https?:// | www\. ) [^\s{regex.escape(URL_STOPS, special_only=False)}]* )
    | (?=\$) (?&plain) \$\$ (?!\$\$) (?: \\. | \$(?!\$) | [^$\\] )+ \$\$
    | (?=\$) (?&plain) \$ (?!\$) (?: \\. | [^$\\] )+ \$
    (?(DEFINE) {_NESTED} )
    """,
    regex.X | regex.S | regex.V0,
)
#: Where a token may begin.
STARTS = regex.compile(r"[`\[<$]|!\[|https?://|www\.", regex.V0)
LINK = regex.compile(
    rf"""
    (?P<open> \[ ) (?! \^ | -?@ ) (?P<label> (?: \\(?:.|\Z) | [^\[\]\\] | (?&square) )++ )
    (?P<middle> \] [ \t]* \( ) (?P<target> (?: \\(?:.|\Z) | [^()\\] | (?&round) )*+ ) (?P<close> \) )
    (?(DEFINE) {_NESTED} )
    """,
    regex.X | regex.S | regex.V0,
)
MARKS = regex.compile(r"(?<!(?<!\\)(?:\\\\)*+\\)(?:\*+|_+|~~+)")
WORD, BLANK = regex.compile(r"[\p{Alphabetic}\p{N}]"), regex.compile(r"\s")


def _sides(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a run of marks may open and may close."""
    before, after = text[start - 1 : start], text[end : end + 1]
    blank = lambda c: not c or bool(BLANK.match(c))
    punctuation = lambda c: bool(c) and not BLANK.match(c) and not WORD.match(c)
    left = not blank(after) and (not punctuation(after) or blank(before) or punctuation(before))
    right = not blank(before) and (not punctuation(before) or blank(after) or punctuation(after))
    if text[start] == "_":  # inside a word it is a letter
        return left and (not right or punctuation(before)), right and (not left or punctuation(after))
    return left, right


def _emphasis(out: list[Region], text: str) -> None:
    """Adds a text's words and its matching marks; what stands between two marks is read in the same way."""
    waiting: list[tuple[bool, int, str]] = [(False, TEXT, text)]
    while waiting:
        read, kind, body = waiting.pop()
        if read:
            add(out, kind, body)
        else:
            waiting += reversed(_pairs(body))


def _pairs(text: str) -> list[tuple[bool, int, str]]:
    """(whether it is read to the end, kind, body) of a text's pieces; marks without a partner are words."""
    runs = [(m.start(), m.end()) for m in MARKS.finditer(text)]
    sides = [_sides(text, *r) for r in runs]
    out: list[tuple[bool, int, str]] = []
    done = i = 0
    while i < len(runs):
        start, end = runs[i]
        i += 1
        if not sides[i - 1][0]:
            continue
        sizes = (2,) if text[start] == "~" or end - start == 2 else (1,) if end - start == 1 else (2, 1)
        pair = next(((n, j) for n in sizes for j in range(i, len(runs)) if text[runs[j][0]] == text[start] and sides[j][1] and runs[j][1] - runs[j][0] >= n), None)
        if not pair:
            continue
        n, j = pair
        a, b = runs[j]
        close = b - n if n == 2 else a
        out += [(True, TEXT, text[done:start]), (True, SYNTAX, text[start : start + n]), (False, TEXT, text[start + n : close]), (True, SYNTAX, text[close : close + n])]
        done, i = close + n, j + 1
        if b - done > (text[a] == "~"):  # the rest of the closing run may open again
            i, runs[j], sides[j] = j, (done, b), _sides(text, done, b)
    return [*out, (True, TEXT, text[done:])]


def _protected(span: str) -> int:
    if span.startswith("<") and not span.startswith(("<!--", "<http://", "<https://", "<mailto:")):
        return SYNTAX
    return OBJECT if span.startswith(("<", "`", "$", "![", "[", "http://", "https://", "www.")) else LOCKED


def _next_token(text: str, at: int) -> regex.Match | None:
    while start := STARTS.search(text, at):
        if found := TOKENS.match(text, start.start()):
            return found
        at = start.start() + 1
    return None


def _line(out: list[Region], line: str) -> None:
    found = PREFIX.match(line)
    done = at = found.end() if found else 0
    add(out, SYNTAX, line[:at])
    core = line[at:]
    done = at = 0
    while m := _next_token(core, at):
        end = m.start() + len(m[0].rstrip(URL_TAILS)) if m["url"] is not None else m.end()
        _emphasis(out, core[done : m.start()])
        add(out, _protected(core[m.start() : end]), core[m.start() : end])
        done = at = end
    _emphasis(out, core[done:])


def _lines(text: str) -> list[Region]:
    out: list[Region] = []
    for m in LINES.finditer(text):
        _line(out, m[1] if m[3] is None else m[3])
        ending = m[2] or ""
        if ending and out:
            out[-1] = (out[-1][0], out[-1][1] + ending)
        else:
            add(out, SYNTAX, ending)
    return out


def _link(body: str) -> list[Region] | None:
    """The regions of a kept region that is a link, perhaps with what stands before a line's words."""
    core, after = parted(body)
    lead = PREFIX.match(core)
    at = lead.end() if lead and core[lead.end() : lead.end() + 1] == "[" else 0
    found = LINK.fullmatch(core, at)
    if not found:
        return None
    out: list[Region] = [(SYNTAX, core[:at])] if at else []
    rest: list[Region] = []
    add(rest, SYNTAX, found["open"])
    for kind, text in atomic(_lines(found["label"])):
        add(rest, kind, text)
    out += rest + [(SYNTAX, found["middle"]), (OBJECT, found["target"]), (SYNTAX, found["close"] + after)]
    return [r for r in out if r[1]]


def regions_of(text: str, kind: str, headings: bool = False) -> list[Region]:
    """The regions of a block's text; those of locked blocks, blanks and (unless allowed) headings are kept whole."""
    if not text:
        return []
    if kind in ("locked_block", "blank") or (kind == "heading" and not headings):
        return [(LOCKED, text)]
    out: list[Region] = []
    for kind, body in _lines(text):
        found = None if kind == TEXT else _link(body)
        out += found or [(kind, body)]
    return out
