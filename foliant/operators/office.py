"""From the blocks of an office document to slots, as expressions inside its row.

Blocks come from foliant.sources.office. Objects that float stand after their paragraph; a paragraph break follows every
paragraph, floating object and locked block but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import boundaries as b
from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators import writeback
from foliant.operators.segment import SLOT, inlined, struct
from foliant.sources import office

BREAK = office.BREAK


def _piece(anchor: Column, region: Column | None, editable: Column, ends: Column, role: str | None = None) -> Column:
    text = F.lit("") if region is None else region["text"]
    protect = F.lit(None).cast("string") if region is None else region["protect"]
    locked = F.lit(role) if role else F.when(protect.isNotNull(), "inlineObject").otherwise("lockedText")
    return struct(anchor=anchor, text=text, editable=editable, ends=ends, locked_role=locked)


def pieces(blocks: Column, headings: bool = False) -> Column:
    """Array of (anchor, text, editable, ends, locked_role): the regions in reading order; ends: a display block's last."""

    def of_block(block: Column, i: Column) -> Column:
        name = i.cast("string")
        no, yes = F.lit(False), F.lit(True)

        def numbered(inline: Column, after: Column) -> Column:
            anchor = lambda x: F.concat(F.lit("docx:p"), name, F.lit(":r"), x["at"].cast("string"))
            free = lambda x: x["region"]["editable"] & (F.lit(headings) | ~block["heading"])
            return F.concat(
                F.transform(inline, lambda x, k: _piece(anchor(x), x["region"], free(x), k == F.size(inline) - 1)), F.transform(after, lambda x: _piece(anchor(x), x["region"], free(x), yes))
            )

        regions = F.transform(block["regions"], lambda r, j: struct(at=j, region=r))
        paragraph = let(F.filter(regions, lambda x: ~x["region"]["after"]), lambda inline: let(F.filter(regions, lambda x: x["region"]["after"]), lambda after: numbered(inline, after)))
        return (
            F.when(block["kind"] != "p", F.array(_piece(F.concat(F.lit("docx:block:"), name), F.get(block["regions"], F.lit(0)), no, yes)))
            .when(F.size(block["regions"]) == 0, F.array(_piece(F.concat(F.lit("docx:p"), name, F.lit(":break")), None, no, yes, "paragraphBreak")))
            .otherwise(paragraph)
        )

    return F.flatten(F.transform(blocks, of_block))


def _fragments(text: Column, editable: Column) -> Column:
    """Array of (text, separator_after): lines with the line breaks after them; of editable lines, their clauses."""
    lines = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(r"[^\n]+\n*|\n+"), F.lit(0)))

    def of_line(line: Column) -> Column:
        body = F.regexp_replace(line, r"\n+\z", "")
        return let(body, lambda x: of_body(x, F.substr(line, F.length(x) + 1)))

    def of_body(body: Column, separator: Column) -> Column:
        alone = F.array(struct(text=body, separator_after=separator))
        clauses = lambda found: F.transform(found, lambda c, k: struct(text=c, separator_after=F.when(k == F.size(found) - 1, separator).otherwise("")))
        return F.when(editable & ~t.is_blank(body), let(b.clauses(body), clauses)).otherwise(alone)

    return F.flatten(F.transform(lines, of_line))


def slots(blocks: Column, headings: bool = False) -> Column:
    """Array of slots of a document's blocks."""

    def of_piece(p: Column, last: Column) -> Column:
        follows = F.when(p["ends"] & ~last, BREAK).otherwise("")
        return let(_fragments(p["text"], p["editable"]), lambda found: F.transform(found, lambda f, k: slot(p, f, k, F.size(found), follows)))

    def slot(p: Column, f: Column, k: Column, n: Column, follows: Column) -> Column:
        editable = p["editable"] & ~t.is_blank(f["text"])
        return struct(
            slot_id=F.when(n == 1, p["anchor"]).otherwise(F.concat(p["anchor"], F.lit(":s"), k.cast("string"))), text=f["text"],
            separator_after=F.concat(f["separator_after"], F.when(k == n - 1, follows).otherwise("")), editable=editable,
            role=F.when(editable, "editableText").otherwise(p["locked_role"]),
        )

    def numbered(flat: Column) -> Column:
        return F.transform(flat, lambda s, i: struct(slot_order=i, slot_id=s["slot_id"], text=s["text"], separator_after=s["separator_after"], editable=s["editable"], role=s["role"]))

    made = let(pieces(blocks, headings), lambda ps: F.flatten(F.transform(ps, lambda p, i: of_piece(p, i == F.size(ps) - 1))))
    return F.when(F.size(blocks) == 0, F.array().cast(f"array<{SLOT}>")).otherwise(let(made, numbered))


def slot_arrays(files: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id, content, slots, error of docx files. files: doc_id, content. No shuffle."""
    return office.read(files).select("doc_id", "content", slots(F.col("blocks"), headings).alias("slots"), "error")


def slot_rows(files: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id and one row for each slot."""
    return inlined(slot_arrays(files, headings).filter("error IS NULL").select("doc_id", "slots"))


def source_text(made: Column) -> Column:
    """The text of an array of slots."""
    return F.array_join(F.transform(made, lambda s: F.concat(s["text"], s["separator_after"])), "")


def signed(files: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id, template_signature, structure_signature, error: of the blocks with their texts, and of the slots without. No shuffle."""
    made = office.read(files).select("doc_id", F.struct("blocks", F.lit(headings)).alias("template"), slots(F.col("blocks"), headings).alias("slots"), "error")
    known = F.col("error").isNull()
    template = F.when(known, writeback.template_signature(F.lit("docx"), F.col("template")))
    return made.select("doc_id", template.alias("template_signature"), F.when(known, writeback.slots_signature(F.col("slots"))).alias("structure_signature"), "error")
