"""Markdown and TeX for display: which parts of a text are shown as protected, and as what. Regular expressions, no Python, no shuffle.

An alternation has a branch for each kind of protected part; a branch is possessive wherever it repeats, so it neither recurses nor goes
over a part again. Plain text is what no branch begins in, so the segments of a text are the matches of one expression, and joined
they are the text. Brackets nest up to NESTED deep; a group that nests deeper is plain text. Where a line opens parts again and again and closes
none, each asks for the rest of the line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators.segment import struct

NESTED = 8
# The kinds of protected parts and their labels, where URLs stop, and what is no end of one.
LABELS = {
    "math-block": "数学块（$$ ... $$）", "code": "行内代码（`...`）", "footnote": "脚注引用（[^...]）", "citation": "引用标记（[@...]）", "link": "链接/图片语法",
    "html-comment": "HTML 注释", "autolink": "自动链接", "html-tag": "HTML 标签", "url": "URL", "math": "数学公式（$...$）",
}
URL_STOPS = r"""\s<>"'\[\](){}（）【】「」『』《》〈〉“”‘’，。；：！？"""
URL_TAILS = r".,;:!?，。；：！？"

_END = r"(?:\r\n|\r|\n)"
_BLANK = r"[^\S\r\n]*+"
_FENCE = rf"{_BLANK}\$\${_BLANK}"
#: From the beginning of a line that is only two dollars, up to the end of the next such line.
_BLOCK = rf"(?:^|(?<=[\r\n]))[ \t]*+\$\${_BLANK}{_END}(?:(?!{_FENCE}(?:[\r\n]|\z))[^\r\n]*+{_END})*+{_FENCE}(?:{_END}|\z)"
#: A run of backticks, up to a run as long in the same line.
_CODE = r"(?<ticks>`++)(?:[^`\r\n]++|(?!\k<ticks>(?!`))`++)*+\k<ticks>(?!`)"
_NOTE = r"\[[\^@](?:[^\]\\\r\n]++|\\[\s\S])*+\]"


def _nested(opening: str, closing: str) -> str:
    """A group in one line, with groups inside; a backslash takes the next character with it."""
    plain = rf"[^{opening}{closing}\\\r\n]++|\\[\s\S]"
    out = rf"{opening}(?:{plain})*+{closing}"
    for _ in range(NESTED - 1):
        out = rf"{opening}(?:{plain}|{out})*+{closing}"
    return out


_SQUARE, _ROUND = _nested(r"\[", r"\]"), _nested(r"\(", r"\)")
_LINK = rf"(?:!{_SQUARE}|(?!\[[\^@]){_SQUARE})[ \t]*+(?:{_ROUND}|{_SQUARE})"
_HTML = r"<!--[^\n]*?-->|<(?=\s*+(?i:https?://|mailto:))[^>\r\n]*+>|<[/A-Za-z][^>\r\n]*+>"
_URL = rf"(?=https?://|www\.)[^{URL_STOPS}]+(?<![{URL_TAILS}])"
#: A dollar after an even number of backslashes.
_FREE = r"(?:(?<!\\)|(?<=(?<!\\)(?:\\\\){1,40}))"
_INSIDE = r"(?:[^$\\]++|\\[\s\S])"
_MATH = rf"{_FREE}(?:(?<!(?:^|[\r\n])[ \t]{{0,100}})\$\${_INSIDE}*+\$\$|\$(?!\$){_INSIDE}++\$)"
_PARTS = "|".join((_CODE, _NOTE, _LINK, _HTML, _URL, _MATH))
#: Group 1 is a protected part, group 2 one that is a block.
SEGMENT = rf"((?<block>{_BLOCK})|{_PARTS})|(?:[^`\[!<hw$\r\n \t]++|(?!{_BLOCK.replace('?<ticks>', '')}|{_PARTS.replace('<ticks>', '<seen>')})[\s\S])++"


def _kind(part: Column, block: Column) -> Column:
    """The kind of a protected part, by the branch it can only have come from."""
    first = F.left(part, F.lit(1))
    return (
        F.when(block != "", "math-block").when(first == "`", "code").when(F.startswith(part, F.lit("[^")), "footnote").when(F.startswith(part, F.lit("[@")), "citation")
        .when(first.isin("[", "!"), "link").when(F.startswith(part, F.lit("<!--")), "html-comment").when(part.rlike("(?i)^<(?:https?://|mailto:)"), "autolink")
        .when(first == "<", "html-tag").when(first == "$", "math").otherwise("url")
    )


def markdown_segments(text: Column) -> Column:
    """Array of (kind, text, label, protect_kind) that joined is the text; kind is text or protected. An empty text is one empty segment."""
    found = lambda group: F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(group))
    blocks = F.when(F.contains(text, F.lit("$$")), found(2))
    none = F.lit(None).cast("string")
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))

    def segment(whole: Column, part: Column, block: Column) -> Column:
        kind = F.when(part != "", _kind(part, block))
        return let(kind, lambda k: struct(kind=F.when(k.isNull(), "text").otherwise("protected"), text=whole, label=F.when(k.isNotNull(), F.try_element_at(labels, k)), protect_kind=k))

    def zipped(parts: Column, marks: Column) -> Column:
        pairs = F.zip_with(parts, marks, lambda p, b: F.struct(p.alias("p"), F.coalesce(b, F.lit("")).alias("b")))
        return F.zip_with(found(0), pairs, lambda w, x: segment(w, x["p"], x["b"]))

    made = let(found(1), lambda parts: zipped(parts, F.coalesce(blocks, F.transform(parts, lambda p: F.lit("")))))
    return F.when(text == "", F.array(struct(kind=F.lit("text"), text=F.lit(""), label=none, protect_kind=none))).otherwise(made)


def segments(docs: DataFrame, kind: str = "markdown") -> DataFrame:
    """doc_id, segment (its place) and the columns of markdown_segments() or tex_segments() of every text."""
    made = {"markdown": markdown_segments, "tex": tex_segments}[kind]
    return docs.select("doc_id", F.posexplode(made(F.col("text"))).alias("segment", "s")).select("doc_id", "segment", "s.*")


# Environments shown as mathematics and as they are, and commands whose text is shown as text.
MATH_ENVIRONMENTS = [
    "equation", "equation*", "align", "align*", "alignat", "alignat*", "flalign", "flalign*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "math",
    "displaymath", "split", "cases", "matrix", "pmatrix", "bmatrix", "vmatrix", "Vmatrix",
]
RAW_ENVIRONMENTS = [
    "verbatim", "verbatim*", "Verbatim", "Verbatim*", "minted", "minted*", "lstlisting", "lstlisting*", "comment", "filecontents", "filecontents*", "tabular", "tabular*", "longtable", "tabu", "array",
    "tikzpicture", "tikzpicture*", "pgfpicture", "pgfpicture*", "forest", "forest*", "algorithm", "algorithm*", "algorithmic", "algorithmic*", "thebibliography", "thebibliography*", "bibliography", "references",
]
TEXT_COMMANDS = ["footnote", "emph", "textbf", "textit", "underline", "textrm", "textsf", "textsc"]
TEX_LABELS = {
    "tex-comment": "TeX 注释（% ...）", "tex-linebreak": "TeX 换行（\\\\ ...）", "tex-verbatim": "TeX 行内原样命令", "tex-inline-code": "TeX 行内代码命令", "tex-path": "TeX 路径命令", "tex-command": "TeX 命令",
}
#: How deep texts of text commands are looked into; what is deeper is plain text.
TEXT_DEPTH = 3

_WHITE = r"[\t\n\r ]*+"
_OPTIONS = rf"{_WHITE}(?:{_SQUARE}{_WHITE})*+"
_REST = r"[\s\S]*+"


def _braces() -> str:
    """A group over any lines; one that is never closed takes all that follows."""
    plain = r"[^{}\\]++|\\[\s\S]"
    out = rf"\{{(?:{plain})*+\}}"
    for _ in range(NESTED - 1):
        out = rf"\{{(?:{plain}|{out})*+\}}"
    return rf"(?:{out}|\{{{_REST})"


_BRACES = _braces()


def _environments(names: list[str], group: str) -> str:
    every = "|".join(n.replace("*", r"\*") for n in names)
    return rf"\\begin\{{(?<{group}>{every})\}}[\s\S]*?(?:\\end\{{\k<{group}>\}}|\z)"


_BREAK = rf"\\\\\*?+{_WHITE}(?:{_SQUARE}|\[{_REST})?+"
#: What a protected part of TeX can be, with its kind, in the order in which they are tried: where no backslash escapes it, and anywhere.
_TEX_FREE = [
    ("tex-comment", r"%[^\r\n]*+"), ("tex-linebreak", _BREAK), ("tex-math-block", _environments(MATH_ENVIRONMENTS, "m")), ("tex-raw-env", _environments(RAW_ENVIRONMENTS, "r")),
    ("tex-math-block", r"\$\$(?:[^$\\]++|\\[\s\S]|\$(?!\$))*+\$\$"), ("tex-math", r"\$(?!\$)(?:[^$\\\r\n]++|\\[^\r\n])++\$"),
    ("tex-math", r"\\\([^\r\n]*?\\\)"), ("tex-math-block", r"\\\[[\s\S]*?\\\]"),
]
_TEX_ANY = [
    ("tex-verbatim", r"\\verb\*?+(?<v>\S)[\s\S]*?(?:\k<v>|\z)"),
    ("tex-inline-code", rf"\\lstinline\*?+{_OPTIONS}(?!\[)(?<l>[^\s{{}}])[\s\S]*?(?:\k<l>|\z)"), ("tex-path", rf"\\path\*?+{_OPTIONS}(?!\[)(?<p>[^\s{{}}])[\s\S]*?(?:\k<p>|\z)"),
    ("tex-command", rf"\\[A-Za-z]++\*?+(?:{_OPTIONS}{_BRACES})*+{_OPTIONS}(?:\[{_REST})?+"), ("tex-command", _BREAK), ("tex-command", r"\\[\s\S]"),
]
_TEXT_OPEN = rf"\\(?:{'|'.join(TEXT_COMMANDS)})(?![A-Za-z])\*?+{_OPTIONS}"
_TEX_PARTS = rf"{_TEXT_OPEN}(?!\{{\z){_BRACES}|({_FREE}(?:{'|'.join(x for _, x in _TEX_FREE)}))|{'|'.join(x for _, x in _TEX_ANY)}"
#: Group 1 is a protected part, group 2 one that no backslash escapes. The names of groups must differ where the parts are looked ahead for.
_AHEAD = re.sub(r"<([mrvlp])>", r"<seen\1>", _TEX_PARTS)
TEX_SEGMENT = rf"({_TEX_PARTS})|(?:[^%$\\]++|(?!{_AHEAD})[\s\S])++"


def tex_segments(text: Column, depth: int = TEXT_DEPTH) -> Column:
    """Array of (kind, text, label, protect_kind) that joined is the text. What a text command holds is shown as text, and looked into."""
    kind = "array<struct<kind:string,text:string,label:string,protect_kind:string>>"
    none = F.lit(None).cast("string")
    plain = lambda x: struct(kind=F.lit("text"), text=x, label=none, protect_kind=none)
    part = lambda x, k, label: struct(kind=F.lit("protected"), text=x, label=label, protect_kind=k)
    labels = F.create_map(*(F.lit(x) for pair in TEX_LABELS.items() for x in pair))

    def command(x: Column) -> Column:
        def split(opening: Column) -> Column:
            inner = F.substr(x, F.length(opening) + 1, F.length(x) - F.length(opening) - 1)
            within = tex_segments(inner, depth - 1) if depth > 1 else F.array(plain(inner))
            command_ = F.lit("tex-command")
            return F.concat(F.array(part(opening, command_, F.lit("TeX 文本命令语法"))), within, F.array(part(F.right(x, F.lit(1)), command_, F.lit("TeX 文本命令闭合"))))

        return let(F.regexp_extract(x, rf"^{_TEXT_OPEN}\{{", 0), split)

    def first_of(x: Column, parts: list[tuple[str, str]]) -> Column:
        found = F.lit("tex-command")
        for k, pattern in reversed(parts):
            found = F.when(x.rlike(rf"^(?:{pattern})\z"), k).otherwise(found)
        return found

    def protected(x: Column, free: Column) -> Column:
        found = F.when(free != "", first_of(x, _TEX_FREE)).otherwise(first_of(x, _TEX_ANY))
        name = F.regexp_extract(x, r"^\\begin\{([^}]+)\}", 1)
        opens = F.left(x, F.lit(2))
        label = (
            lambda k: F.when((k == "tex-math-block") & (name != ""), F.concat(F.lit("TeX 数学环境（"), name, F.lit("）"))).when(k == "tex-raw-env", F.concat(F.lit("TeX 原样环境（"), name, F.lit("）")))
            .when(opens == "$$", "TeX 数学块（$$ ... $$）").when((k == "tex-math-block"), "TeX 数学公式（\\[ ... \\]）").when((k == "tex-math") & (opens == "\\("), "TeX 数学公式（\\( ... \\)）").when(k == "tex-math", "TeX 数学公式（$...$）")
            .otherwise(F.try_element_at(labels, k))
        )
        return let(found, lambda k: F.array(part(x, k, label(k))))

    def segment(whole: Column, token: Column, free: Column) -> Column:
        is_text = token.rlike(rf"^{_TEXT_OPEN}\{{[\s\S]")
        return F.when(token == "", F.array(plain(whole))).when(is_text, command(token)).otherwise(protected(token, free)).cast(kind)

    found = lambda group: F.regexp_extract_all(text, F.lit(TEX_SEGMENT), F.lit(group))
    return F.when(text == "", F.array(plain(F.lit(""))).cast(kind)).otherwise(F.flatten(F.zip_with(found(0), F.zip_with(found(1), found(2), lambda x, y: F.struct(x.alias("part"), y.alias("free"))), lambda w, p: segment(w, p["part"], p["free"]))))
