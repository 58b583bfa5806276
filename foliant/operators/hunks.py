"""Diffs as hunks with some context, from arrays of spans; all in the row, no fold, so linear in the spans.

Spans are struct<type, text>, as diff.with_diffs() makes them: neighbours differ in type. Long unchanged spans are borders
between hunks, short ones are bridged. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators.diff import EQUAL, diff_stats
from foliant.operators.segment import struct

CONTEXT = 80
MAX_HUNKS = 120


def head_context(text: Column, context: int = CONTEXT) -> Column:
    """The first line with its end if that is within the context, else the first characters."""
    line = F.instr(text, "\n")
    return F.substr(text, F.lit(1), F.when((line > 0) & (line <= context), line).otherwise(F.lit(context)))


def tail_context(text: Column, context: int = CONTEXT) -> Column:
    """The end of the last line, at most the context."""
    return F.right(F.substring_index(text, "\n", -1), F.lit(context))


def _span(text: Column) -> Column:
    """An unchanged span, as an array, empty for an empty text."""
    return F.when(text != "", F.array(struct(type=F.lit(EQUAL), text=text))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))


def _borders(spans: Column, context: int) -> Column:
    """Places of the spans between hunks: a leading and a trailing unchanged one (-1 and the size if there is none), and long ones."""
    n = F.size(spans)
    unchanged = lambda i: F.get(spans, i)["type"] == EQUAL
    is_border = lambda s, i: (s["type"] == EQUAL) & ((i == 0) | (i == n - 1) | (F.length(s["text"]) > 2 * context))
    found = F.filter(F.transform(spans, lambda s, i: F.when(is_border(s, i), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    return F.concat(F.when(unchanged(F.lit(0)), none).otherwise(F.array(F.lit(-1))), found, F.when(unchanged(n - 1), none).otherwise(F.array(n)))


def hunk_array(spans: Column, context: int = CONTEXT, most: int = MAX_HUNKS) -> Column:
    """Array of hunks: hunk_id, sequence, spans, before, after, inserted, deleted (characters that are not white space).

    The first `most` hunks, as a report: that limit is part of what hunks are for. Without changes, or without spans, none.
    """

    def hunk(own: Column, k: Column) -> Column:
        text = lambda without: F.array_join(F.transform(F.filter(own, lambda s: s["type"] != without), lambda s: s["text"]), "")
        stats = diff_stats(own)
        return let(stats, lambda c: struct(hunk_id=F.concat(F.lit("hunk-"), (k + 1).cast("string")), sequence=k + 1, spans=own, before=text("insert"), after=text("delete"), inserted=c["inserted"], deleted=c["deleted"]))

    def between(s: Column, borders: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.get(borders, k)
            lead = F.when(start >= 0, F.get(s, start)["text"]).otherwise("")
            # what a long span gives to the hunk before it is not given again
            rest = F.when(start > 0, F.substr(lead, F.length(head_context(lead, context)) + 1)).otherwise(lead)
            tail = F.when(end < F.size(s), F.get(s, end)["text"]).otherwise("")
            own = F.concat(_span(tail_context(rest, context)), F.slice(s, start + 2, end - start - 1), _span(head_context(tail, context)))
            return let(own, lambda o: hunk(o, k))

        ends = F.slice(borders, F.lit(2), F.least(F.size(borders) - 1, F.lit(most)))
        return F.transform(ends, one)

    changed = F.exists(spans, lambda s: s["type"] != EQUAL)
    made = let(spans, lambda s: let(_borders(s, context), lambda b: between(s, b)))
    kind = "array<struct<hunk_id:string,sequence:int,spans:array<struct<type:string,text:string>>,before:string,after:string,inserted:int,deleted:int>>"
    return F.when(changed, made).otherwise(F.array()).cast(kind)


def hunks(diffs: DataFrame, context: int = CONTEXT, most: int = MAX_HUNKS) -> DataFrame:
    """diffs (any columns, and spans) as one row for each hunk: the other columns, and those of hunk_array()."""
    rest = [F.col(f"`{c}`") for c in diffs.columns if c != "spans"]
    return diffs.select(*rest, F.inline_outer(hunk_array(F.col("spans"), context, most))).filter("hunk_id IS NOT NULL")
