"""Office documents (docx): the blocks and regions of a file, new texts put into a file, and files made of texts.

The XML of one file at a time is read into a light tree whose elements know where in the bytes they stand, so new texts are
spliced into the runs they belong to and every other byte stays. Display order, slots and their ids are made from the
blocks by expressions, in foliant.operators.office. No step here shuffles; a file that cannot be read gives an error
in its row and does not end the job.
"""

from __future__ import annotations

import io
import zipfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.diff import DELETE, EQUAL, diff_texts

# What stands in the text for what is not text, and the kind that protects it.
TABLE = ("[表格]", "table")
SECTION = ("[分节符]", "section-break")
CONTROL = ("[内容控件]", "content-control")
FIELD = ("[字段]", "field")
PAGE = ("[分页符]", "page-break")
OBJECTS = (
    ({"txbxContent", "textbox"}, "[文本框]", "textbox"),
    ({"pic"}, "[图片]", "image"),
    ({"chart"}, "[图表]", "chart"),
    ({"wgp", "grpSp"}, "[组合图形]", "group-shape"),
    ({"wsp", "sp", "cxnSp", "graphicFrame", "relIds", "dataModelExt"}, "[图形]", "shape"),
)
VML_SHAPES = {"rect", "roundrect", "shape", "shapetype", "line", "oval"}
SPECIAL = {"drawing", "pict", "AlternateContent", "sdt", "fldSimple"}
SKIPPED = {
    "bookmarkStart", "bookmarkEnd", "proofErr", "permStart", "permEnd", "commentRangeStart", "commentRangeEnd", "moveFromRangeStart",
    "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "lastRenderedPageBreak",
}
CHARACTERS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "\u2011", "softHyphen": "\u00ad"}
OFF = {"0", "false", "off", "none"}
SUFFIXES = {"space": " ", "tab": "\t"}
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
URL_END = ".,;:!?)]}\"'。，；：！？）】」』、"

URL = regex.compile(rf"(?<![A-Za-z0-9/._@-])(?:https?://|www\.)[^ \t\n\f\r]*[^ \t\n\f\r{regex.escape(URL_END)}]")
UNDERLINED = regex.compile(r"(?s)(\s*)(.*\S)(\s*)")
TAG = regex.compile(rb"""<(?:[^<>"']|"[^"]*"|'[^']*')*+>""")
NO_XML = regex.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
SPLIT_ID = regex.compile(r":s[0-9]+\z")
BREAK = "\n\n"

REGION = pa.struct([
    ("text", pa.string()), ("editable", pa.bool_()), ("protect", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()),
    ("underline", pa.bool_()), ("href", pa.string()), ("after", pa.bool_()),
])
BLOCK = pa.struct([("kind", pa.string()), ("heading", pa.bool_()), ("regions", pa.list_(REGION))])
BLOCKS = (
    "array<struct<kind:string,heading:boolean,regions:array<struct<text:string,editable:boolean,protect:string,bold:boolean,"
    "italic:boolean,underline:boolean,href:string,after:boolean>>>>"
)


class OfficeError(ValueError):
    """Why a file cannot be read or written, as a short code."""


class Node:
    """An element: local name, attributes by local name, children (elements and texts), and its bytes' start and end."""

    __slots__ = ("attrs", "children", "end", "name", "prefix", "start")

    def __init__(self, name: str, attrs: dict[str, str], start: int, end: int | None):
        prefix, colon, local = name.rpartition(":")
        self.name, self.prefix = local, prefix + colon
        self.attrs = {k.rpartition(":")[2]: v for k, v in attrs.items()}
        self.children: list[Node | str] = []
        self.start, self.end = start, end

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def below(self) -> Iterator[Node | str]:
        """Itself and all elements and texts under it, in order."""
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.children))

    def first(self, name: str) -> Node | None:
        return next((x for x in self.below() if isinstance(x, Node) and x.name == name), None)

    def value(self, name: str) -> str | None:
        found = self.first(name)
        return found.attrs.get("val") if found else None


def tree(data: bytes) -> Node:
    root = Node("", {}, 0, len(data))
    stack = [root]
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def opened(name, attrs):
        at = parser.CurrentByteIndex
        end = TAG.match(data, at).end()
        node = Node(name, attrs, at, end if data[end - 2 : end] == b"/>" else None)
        stack[-1].children.append(node)
        stack.append(node)

    def closed(_):
        node = stack.pop()
        if node.end is None:
            node.end = data.index(b">", parser.CurrentByteIndex) + 1

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, lambda s: stack[-1].children.append(s)
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as error:
        raise OfficeError("invalid_xml") from error
    return root


def number(value: str | None) -> int | None:
    return int(value) if value and regex.fullmatch(r"[+-]?[0-9]+", value) else None


def counter(kind: str, n: int) -> str:
    """A number as a list shows it."""
    if kind == "none":
        return ""
    if n <= 0 or kind not in ("lowerLetter", "upperLetter", "lowerRoman", "upperRoman"):
        return str(n)
    out = ""
    if kind.endswith("Letter"):
        while n:
            n, digit = divmod(n - 1, 26)
            out = chr(ord("A") + digit) + out
    else:
        for unit, sign in ROMAN:
            times, n = divmod(n, unit)
            out += sign * times
    return out.lower() if kind.startswith("lower") else out


@dataclass
class Level:
    start: int
    kind: str
    text: str
    suffix: str
    style: str | None

    @staticmethod
    def of(node: Node) -> Level:
        start, suffix = number(node.value("start")), node.value("suff")
        kind, text = node.value("numFmt"), node.value("lvlText")
        return Level(1 if start is None else start, "decimal" if kind is None else kind, "%1." if text is None else text, SUFFIXES.get(suffix or "", ""), node.value("pStyle"))


class Numbering:
    """List levels by number and depth, the styles bound to them, and the counters of one pass over a document."""

    def __init__(self, root: Node | None):
        self.levels: dict[str, dict[int, Level]] = {}
        self.bound: dict[str, tuple[str, int]] = {}
        self.counts: dict[str, dict[int, int]] = {}
        everything = [x for x in root.below() if isinstance(x, Node)] if root else []
        shapes = {x.attrs.get("abstractNumId"): self._levels(x) for x in everything if x.name == "abstractNum"}
        for num in (x for x in everything if x.name == "num"):
            name, shape = num.attrs.get("numId"), shapes.get(num.value("abstractNumId"))
            if name is None or shape is None:
                raise OfficeError("broken_numbering")
            levels = dict(shape)
            for change in (x for x in num.elements() if x.name == "lvlOverride"):
                depth, start = number(change.attrs.get("ilvl")), number(change.value("startOverride"))
                levels |= {d: level for d, level in self._levels(change).items() if d == depth}
                if start is not None and depth in levels:
                    levels[depth] = Level(**{**vars(levels[depth]), "start": start})
            self.levels[name] = levels
            for depth, level in levels.items():
                if level.style is not None:
                    self.bound.setdefault(level.style, (name, depth))

    @staticmethod
    def _levels(node: Node) -> dict[int, Level]:
        found = ((number(x.attrs.get("ilvl")), x) for x in node.elements() if x.name == "lvl")
        return {depth: Level.of(x) for depth, x in found if depth is not None}

    def marker(self, name: str, depth: int) -> str | None:
        """The marker of the next paragraph of this list and depth; its deeper levels start again."""
        levels = self.levels.get(name, {})
        level = levels.get(depth)
        if level is None:
            return None
        counts = self.counts.setdefault(name, {})
        value = counts[depth] + 1 if depth in counts else level.start
        text = level.text
        if level.kind != "bullet":
            for other in range(9):
                if f"%{other + 1}" in text:
                    if other not in levels:
                        return None
                    shown = value if other == depth else counts.get(other, levels[other].start)
                    text = text.replace(f"%{other + 1}", counter(levels[other].kind, shown))
        self.counts[name] = {d: n for d, n in counts.items() if d < depth} | {depth: value}
        return text + level.suffix


class Styles:
    """Paragraph styles with what they take over from the styles they are based on."""

    def __init__(self, root: Node | None):
        self.own: dict[str | None, tuple[str | None, dict]] = {}
        for x in root.below() if root else ():
            if isinstance(x, Node) and x.name == "style" and x.attrs.get("type") == "paragraph":
                props = x.first("pPr") or Node("pPr", {}, 0, 0)
                self.own[x.attrs.get("styleId")] = (x.value("basedOn"), {"num": props.value("numId"), "depth": number(props.value("ilvl")), "outline": number(props.value("outlineLvl"))})

    def get(self, name: str | None, what: str):
        """The first value on the chain of styles; a chain that comes back to itself ends there."""
        seen = set()
        while name in self.own and name not in seen:
            seen.add(name)
            base, values = self.own[name]
            if values[what] is not None:
                return values[what]
            name = base
        return None


@dataclass
class Piece:
    """Part of a run: a text, or a child that is kept as its bytes."""

    run: Node | None
    text: str = ""
    raw: bytes | None = None


@dataclass
class Region:
    text: str
    editable: bool = False
    protect: str | None = None
    look: tuple[bool, bool, bool] = (False, False, False)
    href: str | None = None
    after: bool = False
    key: tuple = ()
    pieces: list[Piece] = field(default_factory=list)

    def joins(self, other: Region) -> bool:
        same = lambda r: (r.editable, r.protect, r.look, r.href, r.after, r.key)
        return same(self) == same(other)


@dataclass
class Block:
    kind: str
    heading: bool
    regions: list[Region]


class _Unsupported(Exception):
    """A link with something in it that is no text."""


def visible(text: str) -> bool:
    return bool(text.strip())


def locked_for(node: Node) -> Region:
    """The placeholder of an element that is no text."""
    if node.name not in SPECIAL:
        return Region(f"[复杂结构:{node.name}]", protect="unknown-structure")
    inside = {x.name for x in node.below() if isinstance(x, Node)}
    if "sdt" in inside:
        return Region(CONTROL[0], protect=CONTROL[1])
    if "fldSimple" in inside:
        return Region(_shown(node) or FIELD[0], protect=FIELD[1])
    for names, text, kind in OBJECTS:
        if names & inside or (kind == "shape" and "pict" in inside and VML_SHAPES & inside):
            return Region(text, protect=kind, after="anchor" in inside)
    raise OfficeError("unknown_graphic")


def _shown(node: Node) -> str:
    out = []
    for x in node.below():
        if isinstance(x, Node) and x.name == "t":
            out += [c for c in x.below() if isinstance(c, str)]
        elif isinstance(x, Node):
            out.append(CHARACTERS.get(x.name, ""))
    return "".join(out)


def segments(text: str, underlined: bool) -> Iterator[tuple[str, bool]]:
    """(part, whether it may be rewritten): bare addresses, white space at the ends of underlined texts, and blank parts may not."""
    if not visible(text):
        yield text, False
        return
    before, body, behind = UNDERLINED.fullmatch(text).groups() if underlined else ("", text, "")
    if before:
        yield before, False
    at = 0
    for url in URL.finditer(body):
        if at < url.start():
            yield body[at : url.start()], visible(body[at : url.start()])
        yield url[0], False
        at = url.end()
    if at < len(body):
        yield body[at:], visible(body[at:])
    if behind:
        yield behind, False


class Document:
    """A file's blocks, and its XML with new texts."""

    def __init__(self, content: bytes):
        if not content:
            raise OfficeError("empty_file")
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = set(archive.namelist())
                part = lambda name: archive.read(name) if name in names else None
                self.xml = part("word/document.xml")
                links, numbering, styles = part("word/_rels/document.xml.rels"), part("word/numbering.xml"), part("word/styles.xml")
        except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, OSError, ValueError) as error:
            raise OfficeError("not_a_zip") from error
        except Exception as error:  # a damaged entry, as the decompressor puts it
            raise OfficeError("damaged_entry") from error
        if self.xml is None:
            raise OfficeError("no_document")
        self.links = self._links(tree(links)) if links else {}
        self.numbering = Numbering(tree(numbering) if numbering else None)
        self.styles = Styles(tree(styles) if styles else None)
        body = tree(self.xml).first("body")
        self.blocks = [self._block(x) for x in body.elements() if x.name not in SKIPPED] if body else []
        for r in (self.blocks[0].regions[:1] if self.blocks else []):
            r.text = r.text.lstrip("\ufeff")
        for r in (self.blocks[-1].regions[-1:] if self.blocks else []):
            r.text = r.text.rstrip("\ufeff")

    @staticmethod
    def _links(root: Node) -> dict[str, str]:
        out = {}
        for x in root.below():
            if isinstance(x, Node) and x.name == "Relationship" and x.attrs.get("Type", "").endswith("/hyperlink"):
                if "Id" not in x.attrs or "Target" not in x.attrs:
                    raise OfficeError("broken_link")
                out[x.attrs["Id"]] = x.attrs["Target"]
        return out

    def _block(self, node: Node) -> Block:
        if node.name == "p":
            return self._paragraph(node)
        text, kind = {"tbl": TABLE, "sectPr": SECTION, "sdt": CONTROL}.get(node.name, (f"[复杂结构:{node.name}]", "unknown-structure"))
        return Block("block", False, [Region(text, protect=kind)])

    def _paragraph(self, node: Node) -> Block:
        props = next((x for x in node.elements() if x.name == "pPr"), None)
        style = props.value("pStyle") if props else None
        heading = bool(props) and (props.first("outlineLvl") is not None or self.styles.get(style, "outline") is not None)
        found: list[Region] = []
        for x in node.children:
            if isinstance(x, str):
                found += [Region(x)] if visible(x) else []
            elif x.name == "r":
                found += self._run(x, None)
            elif x.name == "hyperlink":
                found += self._link(x)
            elif x.name in ("oMath", "oMathPara"):
                found.append(Region("".join(t.strip() for e in x.below() if isinstance(e, Node) and e.name == "t" for t in e.below() if isinstance(t, str)), protect="formula"))
            elif x.name != "pPr" and x.name not in SKIPPED:
                found.append(locked_for(x))
        if any(visible(r.text) for r in found):
            marker = self._marker(props, style)
            found = found if marker is None else [Region(marker, protect="list-marker"), *found]
        regions: list[Region] = []
        for r in found:
            if regions and regions[-1].joins(r):
                regions[-1].text += r.text
                regions[-1].pieces += r.pieces
            else:
                regions.append(r)
        return Block("p", heading, regions)

    def _marker(self, props: Node | None, style: str | None) -> str | None:
        own = props.first("numPr") if props else None
        name = (own.value("numId") if own else None) or self.styles.get(style, "num")
        if name is None:
            bound = self.numbering.bound.get(style)
            return self.numbering.marker(*bound) if bound else None
        depth = number(own.value("ilvl")) if own else None
        if depth is None:
            depth = self.styles.get(style, "depth")
        return self.numbering.marker(name, depth or 0)

    def _link(self, node: Node) -> list[Region]:
        out: list[Region] = []
        try:
            for x in node.children:
                if isinstance(x, str):
                    if visible(x):
                        raise _Unsupported
                elif x.name == "r":
                    out += self._run(x, node)
                elif x.name not in SKIPPED:
                    raise _Unsupported
        except _Unsupported:
            return [locked_for(node)]
        return out

    def _run(self, run: Node, link: Node | None) -> list[Region]:
        props = next((x for x in run.elements() if x.name == "rPr"), None)
        look = self._look(props)
        raw = self.xml[props.start : props.end] if props else b""
        href, key = None, (raw,)
        if link is not None:
            anchor = link.attrs.get("anchor")
            href = self.links.get(link.attrs.get("id"), None if anchor is None else f"#{anchor}")
            key = (raw, self.xml[link.start : TAG.match(self.xml, link.start).end()])
        out: list[Region] = []
        text: list[str] = []

        def flush():
            whole = "".join(text)
            text.clear()
            if whole:
                for part, editable in segments(whole, look[2]):
                    out.append(Region(part, editable, None, look, href, False, (*key, editable), [Piece(run, part)]))

        def lock(region: Region, raw_child: bytes):
            if link is not None:
                raise _Unsupported
            flush()
            region.pieces = [Piece(run, raw=raw_child)]
            out.append(region)

        for x in run.children:
            if isinstance(x, str):
                if visible(x):
                    lock(Region(x, look=look, key=(raw, "stray")), escape(x).encode())
            elif x.name == "t":
                if any(isinstance(c, Node) for c in x.children):
                    raise OfficeError("nested_text")
                text += x.children
            elif x.name == "br" and x.attrs.get("type") == "page":
                lock(Region(PAGE[0], protect=PAGE[1]), self.xml[x.start : x.end])
            elif x.name in CHARACTERS:
                text.append(CHARACTERS[x.name])
            elif x.name != "rPr" and x.name not in SKIPPED:
                lock(locked_for(x), self.xml[x.start : x.end])
        flush()
        return out

    @staticmethod
    def _look(props: Node | None) -> tuple[bool, bool, bool]:
        bold = italic = underline = False
        for x in props.below() if props else ():
            if isinstance(x, Node) and x.name in ("b", "i", "u"):
                value = (x.attrs.get("val") or "").strip().lower()
                if x.name == "b":
                    bold = value not in OFF
                elif x.name == "i":
                    italic = value not in OFF
                else:
                    underline = value != "none"
        return bold, italic, underline

    def display(self) -> list[tuple[str, Region | None, bool, bool]]:
        """(anchor, region, whether it is a heading's, whether a paragraph break follows) in reading order."""
        out: list[tuple[str, Region | None, bool, bool]] = []
        for i, block in enumerate(self.blocks):
            named = [(f"docx:p{i}:r{j}", r) for j, r in enumerate(block.regions)]
            if block.kind != "p":
                out.append((f"docx:block:{i}", None, False, True))
            elif not named:
                out.append((f"docx:p{i}:break", None, False, True))
            else:
                inline = [x for x in named if not x[1].after]
                out += [(anchor, r, block.heading, k == len(inline) - 1) for k, (anchor, r) in enumerate(inline)]
                out += [(anchor, r, block.heading, True) for anchor, r in named if r.after]
        if out:
            out[-1] = (*out[-1][:3], False)
        return out

    def rewritten(self, slots: Iterable[tuple[str, str, bool]]) -> bytes:
        """The XML with the slots' texts; slots: (id, text with separator, editable) in order.

        What is locked keeps its bytes, whatever its slot says. Other ids than the document's, or a lost paragraph break,
        are an error.
        """
        groups: list[list] = []
        for slot_id, text, editable in slots:
            anchor = SPLIT_ID.sub("", slot_id)
            if groups and groups[-1][0] == anchor:
                groups[-1][1].append(text)
                groups[-1][2] |= editable
            else:
                groups.append([anchor, [text], editable])
        shown = self.display()
        if [g[0] for g in groups] != [x[0] for x in shown]:
            raise OfficeError("structure_changed")
        new: list[tuple[Region, str]] = []
        for (_, texts, editable), (_, region, _, broken) in zip(groups, shown, strict=True):
            if region is None or not region.editable or not editable:
                continue
            text = "".join(texts)
            if broken and not text.endswith(BREAK):
                raise OfficeError("separator_lost")
            new.append((region, text[: -len(BREAK)] if broken else text))
        return self._spliced(new)

    def edited(self, text: str) -> bytes:
        """The XML with a whole new text: the paragraphs as shown, each with its new text dealt to its regions.

        Another number of paragraphs, a locked text that is gone or that could be at more than one place, or text in an
        empty paragraph is an error. What was typed over a locked block is dropped.
        """
        paragraphs: list[list[Region | None]] = [[]]
        shown = self.display()
        for _, region, _, broken in shown:
            paragraphs[-1].append(region)
            if broken:
                paragraphs.append([])
        plain = text.replace("\r\n", "\n").replace("\r", "\n")
        parts = plain.split(BREAK) if shown or plain else []
        if len(parts) != (len(paragraphs) if shown else 0):
            raise OfficeError("paragraph_count")
        new: list[tuple[Region, str]] = []
        for (anchors, regions), part in zip(self._by_paragraph(shown, paragraphs), parts, strict=True):
            if anchors.endswith(":break") and part:
                raise OfficeError("empty_paragraph_changed")
            if regions:
                new += placed(regions, part)
        return self._spliced(new)

    @staticmethod
    def _by_paragraph(shown: list, paragraphs: list[list[Region | None]]) -> Iterator[tuple[str, list[Region]]]:
        """The first anchor and the regions of each display block; none for locked blocks and empty paragraphs."""
        at = 0
        for regions in paragraphs if shown else []:
            yield shown[at][0], [r for r in regions if r is not None]
            at += len(regions)

    def _spliced(self, new: list[tuple[Region, str]]) -> bytes:
        changed: dict[int, Node] = {}
        for region, text in new:
            if text != region.text:
                for k, piece in enumerate(region.pieces):
                    piece.text = text if k == 0 else ""
                    changed[piece.run.start] = piece.run
        inside: dict[int, list[Piece]] = {at: [] for at in changed}
        for block in self.blocks:
            for region in block.regions:
                for piece in region.pieces:
                    if piece.run is not None and piece.run.start in inside:
                        inside[piece.run.start].append(piece)
        out, at = [], 0
        for start in sorted(changed):
            run = changed[start]
            out += [self.xml[at:start], self._rendered(run, inside[start])]
            at = run.end
        return b"".join([*out, self.xml[at:]])

    def _rendered(self, run: Node, pieces: list[Piece]) -> bytes:
        props = next((x for x in run.elements() if x.name == "rPr"), None)
        parts = [self.xml[run.start : TAG.match(self.xml, run.start).end()], self.xml[props.start : props.end] if props else b""]
        for piece in pieces:
            parts.append(run_content(piece.text, run.prefix).encode() if piece.raw is None else piece.raw)
        return b"".join([*parts, f"</{run.prefix}r>".encode()])


def placed(regions: list[Region], text: str) -> list[tuple[Region, str]]:
    """The editable regions of a paragraph with their parts of its new text; locked texts must stand between them, at one place only."""
    gaps: list[list[Region]] = [[]]
    fixed: list[str] = []
    for region in regions:
        if region.editable:
            gaps[-1].append(region)
        elif fixed and not gaps[-1]:
            fixed[-1] += region.text
        else:
            fixed.append(region.text)
            gaps.append([])
    found: list[list[str]] = []
    # Open states: the number of the next literal, where it may begin, and the parts so far with the states they came from.
    # A state is left once it was tried, unless it led to the place that was found.
    stack: list[tuple[int, int, tuple]] = [(0, 0, ())]
    tried: set[tuple[int, int]] = set()
    while stack and len(found) < 2:
        k, at, parts = stack.pop()
        if k == len(fixed):
            if gaps[k] or at == len(text):
                found.append(_unrolled(parts, text[at:], tried))
        elif (k, at) not in tried:
            tried.add((k, at))
            stack += [(k + 1, place + len(fixed[k]), (parts, text[at:place], (k, at))) for place in _places(fixed[k], text, at, bool(gaps[k]))]
    if not found:
        raise OfficeError("crosses_boundary")
    if len(found) > 1:
        raise OfficeError("ambiguous")
    return [pair for gap, part in zip(gaps, found[0], strict=True) for pair in owned(gap, part)]


def _places(literal: str, text: str, at: int, free: bool) -> Iterator[int]:
    if not free:
        if text.startswith(literal, at):
            yield at
        return
    while literal and (at := text.find(literal, at)) >= 0:
        yield at
        at += len(literal)


def _unrolled(parts: tuple, last: str, tried: set[tuple[int, int]]) -> list[str]:
    out = [last]
    while parts:
        parts, part, state = parts
        out.append(part)
        tried.discard(state)
    return out[::-1]


def owned(gap: list[Region], text: str) -> list[tuple[Region, str]]:
    """Neighbouring editable regions with a new text: kept characters stay in theirs, an edit goes to the region it begins in."""
    if len(gap) < 2:
        return [(r, text) for r in gap]
    ends: list[int] = []
    for r in gap:
        ends.append(len(r.text) + (ends[-1] if ends else 0))
    out = [""] * len(gap)
    at, owner = 0, None
    for kind, part in diff_texts("".join(r.text for r in gap), text)[0]:
        if kind == EQUAL:
            owner = None
            for k, end in enumerate(ends):
                start = max(at, end - len(gap[k].text))
                out[k] += part[start - at : max(0, end - at)] if start < at + len(part) else ""
            at += len(part)
            continue
        if owner is None:
            # an insertion between two regions belongs to the one on its left
            owner = min(bisect_right(ends, at if kind == DELETE else max(at - 1, 0)), len(gap) - 1)
        if kind == DELETE:
            at += len(part)
        else:
            out[owner] += part
    return list(zip(gap, out, strict=True))


def run_content(text: str, prefix: str = "w:") -> str:
    """A text as the children of a run. Characters that XML cannot hold become U+FFFD."""
    clean = NO_XML.sub("\ufffd", text)
    signs = {"\t": "tab", "\n": "br", "\u2011": "noBreakHyphen", "\u00ad": "softHyphen"}
    out = []
    for part in regex.split("([\t\n\u2011\u00ad])", clean):
        if part in signs:
            out.append(f"<{prefix}{signs[part]}/>")
        elif part:
            space = ' xml:space="preserve"' if part != part.strip() else ""
            out.append(f"<{prefix}t{space}>{escape(part, {chr(13): '&#13;'})}</{prefix}t>")
    return "".join(out)


def with_document(content: bytes, xml: bytes) -> bytes:
    """The file with another word/document.xml, all other entries as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            new.writestr(info, xml if info.filename == "word/document.xml" else old.read(info))
    return out.getvalue()


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_FIXED = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_OFFICE}.document.main+xml"/>'
    f'<Override PartName="/word/styles.xml" ContentType="{_OFFICE}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{_OFFICE}.numbering+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
    '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="numbering.xml"/></Relationships>',
    "word/styles.xml": f'{_HEAD}<w:styles {_NS}><w:style w:type="paragraph" w:styleId="Title1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Title2"><w:name w:val="heading 2"/><w:basedOn w:val="Title1"/></w:style></w:styles>',
    "word/numbering.xml": f'{_HEAD}<w:numbering {_NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/><w:suff w:val="space"/></w:lvl>'
    '</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
}
_STYLES = {"heading": '<w:pPr><w:pStyle w:val="Title2"/></w:pPr>', "list": '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>'}


def exported(paragraphs: Iterable[tuple[str, str]]) -> bytes:
    """A file of (text, style) paragraphs; style: plain, heading, list, bold, or table (one cell)."""
    body = []
    for text, style in paragraphs:
        bold = "<w:rPr><w:b/></w:rPr>" if style == "bold" else ""
        run = f"<w:r>{bold}{run_content(text)}</w:r>" if text else ""
        paragraph = f"<w:p>{_STYLES.get(style, '')}{run}</w:p>"
        body.append(f"<w:tbl><w:tr><w:tc>{paragraph}</w:tc></w:tr></w:tbl>" if style == "table" else paragraph)
    parts = {**_FIXED, "word/document.xml": f"{_HEAD}<w:document {_NS}><w:body>{''.join(body)}</w:body></w:document>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _some(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _blocks(content: bytes) -> list[dict]:
    document = Document(content)
    if not any(visible(r.text) for b in document.blocks for r in b.regions):
        raise OfficeError("no_visible_text")
    one = lambda r: dict(zip(("bold", "italic", "underline"), r.look, strict=True)) | {"text": r.text, "editable": r.editable, "protect": r.protect, "href": r.href, "after": r.after}
    return [{"kind": b.kind, "heading": b.heading, "regions": [one(r) for r in b.regions]} for b in document.blocks]


def _tried(work, *args):
    try:
        return work(*args), None
    except OfficeError as error:
        return None, str(error)


def _read(batches):
    for batch in _some(batches):
        made = [_tried(_blocks, content or b"") for content in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array([m[0] for m in made], pa.list_(BLOCK)), pa.array([m[1] for m in made], pa.string())], ["doc_id", "content", "blocks", "error"])


def _rewrite_one(content: bytes, slots: list[dict]) -> bytes:
    document = Document(content)
    return with_document(content, document.rewritten((s["slot_id"], s["text"] + s["separator_after"], s["editable"]) for s in slots))


def _rewrite(batches):
    for batch in _some(batches):
        made = [_tried(_rewrite_one, content or b"", slots or []) for content, slots in zip(batch.column("content").to_pylist(), batch.column("slots").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["doc_id", "content", "error"])


def _edit_one(content: bytes, text: str) -> bytes:
    return with_document(content, Document(content).edited(text))


def _edit(batches):
    for batch in _some(batches):
        made = [_tried(_edit_one, content or b"", text or "") for content, text in zip(batch.column("content").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["doc_id", "content", "error"])


def _export(batches):
    for batch in _some(batches):
        made = [exported((p["text"] or "", p["style"]) for p in paragraphs or []) for paragraphs in batch.column("paragraphs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])


def _id_kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def read(files: DataFrame) -> DataFrame:
    """doc_id, content, blocks, error. files: doc_id, content (a whole docx; null counts as empty). No shuffle.

    The content goes along, so that rewriting needs no join; where it is not selected, only its passing through Python is paid.
    """
    return files.select("doc_id", "content").mapInArrow(_read, f"doc_id {_id_kind(files)}, content binary, blocks {BLOCKS}, error string")


def rewrite(files: DataFrame) -> DataFrame:
    """doc_id, content, error: the files with the texts of their slots. files: doc_id, content, slots (as of operators.office). No shuffle."""
    return files.select("doc_id", "content", "slots").mapInArrow(_rewrite, f"doc_id {_id_kind(files)}, content binary, error string")


def edit(files: DataFrame) -> DataFrame:
    """doc_id, content, error: the files with whole new texts. files: doc_id, content, text (null counts as empty). No shuffle."""
    return files.select("doc_id", "content", "text").mapInArrow(_edit, f"doc_id {_id_kind(files)}, content binary, error string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and content of the docx files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)
    return found.select(F.col("path").alias("doc_id"), "content")


def export(docs: DataFrame) -> DataFrame:
    """doc_id, content: a new docx of each row. docs: doc_id, paragraphs (array of text and style, see exported()). No shuffle."""
    return docs.select("doc_id", "paragraphs").mapInArrow(_export, f"doc_id {_id_kind(docs)}, content binary")
