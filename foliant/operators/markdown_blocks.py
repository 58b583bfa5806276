"""Blocks of Markdown texts: a line automaton as native expressions, lossless.

What a line is by itself is told for all lines at once, by the predicates of functions.markdown. What it belongs to
depends on lines far before (fences, math, front matter), so a fold goes over the lines with the state of the open block; it runs in
stretches, as an array that grows inside a fold is copied at every step. No Python, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import markdown as m
from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators.segment import BLOCK, struct

FRONT_MATTER_LINES = 200
#: A line with its end.
LINES = r"[^\r\n]*+(?:\r\n|\r|\n)|[^\r\n]++"
#: What the next lines must be to belong to the open block.
NOTHING, FENCE, MATH, COUNTED, QUOTE, ITEM, PARAGRAPH = range(7)
#: After its counted lines, a block may go on with lines of a kind.
NO_MORE, PIPES, INDENTED = range(3)
STATE = "struct<starts:array<struct<at:int,kind:string>>,at:int,blank:boolean,rest:int,left:int,more:int,mark:string,run:int,indent:int,closed:boolean>"


def _item(line: Column) -> Column:
    return line.rlike(r"^(?U:\s)*+(?:[-*+] |[0-9]++[.)][ \t\n\r\f])")


def _described(whole: Column) -> Column:
    """All that the automaton asks of one line."""
    line = F.regexp_replace(whole, r"(?:\r\n|\r|\n)\z", "")

    def told(x: Column) -> Column:
        fence = m.fence_marker(x)
        # a line of fence characters only can close a fence
        closing = F.regexp_extract(x, r"^(?U:\s)*+(`++|~++)(?U:\s)*+\z", 1)
        lead = F.regexp_extract(x, r"^[ \t]*+", 0)
        return struct(
            blank=t.is_blank(x), fence=fence, closing=closing, math=m.is_math_delimiter(x), pipe=F.contains(x, F.lit("|")), delimiter=m.is_table_delimiter(x), heading=m.is_heading(x),
            underline=m.is_setext_underline(x), single=m.is_reference_definition(x) | m.is_html(x) | m.is_rule(x), indented=m.is_indented_code(x), quote=x.rlike(r"^(?U:\s)*+>"), item=_item(x),
            indent=F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))),
        )

    return let(line, told)


def _with_next(lines: Column) -> Column:
    """The lines' descriptions with table (a delimiter follows), setext (an underline follows) and starts (it ends a paragraph)."""

    def both(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)
        table, setext = x["pipe"] & F.coalesce(after["delimiter"], F.lit(False)), F.coalesce(after["underline"], F.lit(False))
        starts = (x["fence"] != "") | x["heading"] | x["single"] | x["math"] | x["indented"] | x["quote"] | x["item"] | table | setext
        return struct(**{f: x[f] for f in ("blank", "fence", "closing", "math", "pipe", "heading", "single", "indented", "quote", "item", "indent")}, table=table, setext=setext, starts=starts)

    return F.transform(lines, both)


def _front_matter(wholes: Column) -> Column:
    """Struct (start, size): the lines of front matter at the head of a text; size 0 if there is none."""
    start = F.array_position(F.transform(wholes, lambda w: ~t.is_blank(w)), True).cast("int") - 1

    def found(s: Column) -> Column:
        rows = F.slice(wholes, s + 2, F.lit(FRONT_MATTER_LINES))
        end = F.array_position(F.transform(rows, lambda w: m.is_front_matter_close(F.regexp_replace(w, r"[\r\n]++\z", ""))), True).cast("int")
        opened = m.is_front_matter_open(F.regexp_replace(F.get(wholes, s), r"[\r\n]++\z", ""))
        return F.when((s >= 0) & opened & (end > 0), struct(start=s, size=end + 1)).otherwise(struct(start=F.lit(-1), size=F.lit(0)))

    return let(start, found)


def _opened(x: Column) -> Column:
    """Struct (kind, rest, left, more, mark, run) of the block that a line opens."""
    cases = [
        (x["blank"], "blank", NOTHING, 0, NO_MORE), (x["fence"] != "", "locked_block", FENCE, 0, NO_MORE), (x["math"], "locked_block", MATH, 0, NO_MORE), (x["table"], "locked_block", COUNTED, 1, PIPES),
        (x["heading"], "heading", NOTHING, 0, NO_MORE), (x["setext"], "heading", COUNTED, 1, NO_MORE), (x["indented"], "locked_block", COUNTED, 0, INDENTED), (x["single"], "locked_block", NOTHING, 0, NO_MORE),
        (x["quote"], "quote", QUOTE, 0, NO_MORE), (x["item"], "list_item", ITEM, 0, NO_MORE),
    ]
    of = lambda kind, rest, left, more: struct(kind=F.lit(kind), rest=F.lit(rest), left=F.lit(left), more=F.lit(more), mark=F.left(x["fence"], F.lit(1)), run=F.length(x["fence"]))
    out = of("paragraph", PARAGRAPH, 0, NO_MORE)
    for test, *case in reversed(cases):
        out = F.when(test, of(*case)).otherwise(out)
    return out


def _step(a: Column, x: Column, matter: Column) -> Column:
    """The state after a line: it belongs to the open block, or opens one."""
    rest = a["rest"]
    counted = (a["left"] > 0) | (~x["blank"] & F.when(a["more"] == PIPES, x["pipe"]).when(a["more"] == INDENTED, x["indented"]).otherwise(F.lit(False)))
    own = (
        F.when(rest.isin(FENCE, MATH), F.lit(True)).when(rest == COUNTED, counted).when(rest == QUOTE, ~x["blank"] & (x["quote"] | ~x["starts"]))
        .when(rest == ITEM, ~x["blank"] & (~(x["item"] | x["quote"]) | (x["indent"] > a["indent"]) | ~x["starts"])).when(rest == PARAGRAPH, ~x["blank"] & ~x["starts"]).otherwise(F.lit(False))
    )
    taken = ~a["closed"] & own
    stays = (taken | (x["blank"] & ~a["blank"])) & (a["at"] != matter["start"]) & (a["at"] > 0)
    ends = ((rest == FENCE) & (F.left(x["closing"], F.lit(1)) == a["mark"]) & (F.length(x["closing"]) >= a["run"])) | ((rest == MATH) & x["math"])
    same = dict(mark=a["mark"], run=a["run"], indent=a["indent"], more=a["more"], blank=a["blank"])

    def opened(o: Column) -> Column:
        front = a["at"] == matter["start"]
        kind = F.when(front, "locked_block").otherwise(o["kind"])
        return struct(
            starts=F.concat(a["starts"], F.array(struct(at=a["at"], kind=kind))), at=a["at"] + 1, blank=kind == "blank", rest=F.when(front, COUNTED).otherwise(o["rest"]),
            left=F.when(front, matter["size"] - 1).otherwise(o["left"]), more=F.when(front, NO_MORE).otherwise(o["more"]), mark=o["mark"], run=o["run"], indent=x["indent"], closed=F.lit(False),
        )

    on = struct(starts=a["starts"], at=a["at"] + 1, blank=same["blank"], rest=rest, left=a["left"] - 1, more=same["more"], mark=same["mark"], run=same["run"], indent=same["indent"], closed=~taken | ends)
    return F.when(stays, on.cast(STATE)).otherwise(let(_opened(x), opened).cast(STATE))


def _starts(lines: Column, matter: Column) -> Column:
    """Array of (at, kind): the lines with which blocks begin."""
    none = F.array().cast("array<struct<at:int,kind:string>>")
    begin = struct(starts=none, at=F.lit(0), blank=F.lit(False), rest=F.lit(NOTHING), left=F.lit(0), more=F.lit(NO_MORE), mark=F.lit(""), run=F.lit(0), indent=F.lit(0), closed=F.lit(True)).cast(STATE)

    def stretch(a: Column, start: Column) -> Column:
        fresh = a["now"].withField("starts", none).cast(STATE)
        found = F.aggregate(F.slice(lines, start + 1, F.lit(BLOCK)), fresh, lambda s, x: _step(s, x, matter))
        return let(found, lambda f: struct(parts=F.concat(a["parts"], F.array(f["starts"])), now=f))

    state = struct(parts=F.array().cast("array<array<struct<at:int,kind:string>>>"), now=begin)
    return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(BLOCK)), state, stretch, lambda a: F.flatten(a["parts"]))


def block_array(text: Column) -> Column:
    """Array of (kind, text) of the blocks, which joined are the text; kind: blank, locked_block, heading, quote, list_item, paragraph."""

    def scanned(wholes: Column) -> Column:
        lines = let(F.transform(wholes, _described), _with_next)
        return let(_front_matter(wholes), lambda matter: let(lines, lambda x: let(_starts(x, matter), lambda at: cut(wholes, at))))

    def cut(wholes: Column, at: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1)["at"], F.size(wholes))
            return struct(kind=s["kind"], text=F.array_join(F.slice(wholes, s["at"] + 1, end - s["at"]), ""))

        return F.transform(at, one)

    made = let(F.regexp_extract_all(text, F.lit(LINES), F.lit(0)), scanned)
    return F.when(F.coalesce(text, F.lit("")) != "", made).otherwise(F.array()).cast("array<struct<kind:string,text:string>>")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, anchor, kind, text; null and empty texts have no blocks."""
    rows = docs.select("doc_id", F.posexplode(block_array(F.col("text"))).alias("block_idx", "b"))
    return rows.select("doc_id", "block_idx", F.concat(F.lit("md:b"), "block_idx").alias("anchor"), "b.kind", "b.text")
