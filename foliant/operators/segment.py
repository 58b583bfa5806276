"""Lossless segmentation of plain texts: slots, and units of slots.

Slots are made inside each row, from regular expressions over the text, so this needs no shuffle. Units are
folded from the slots of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import boundaries as b
from foliant.functions import text as t
from foliant.functions.text import let

PRESETS = ("clause", "sentence", "paragraph")
LEAST_UNIT_CHARS = 4
#: Steps of a fold whose result is gathered at once.
BLOCK = 256


SLOT = "struct<slot_order:int,slot_id:string,text:string,separator_after:string,editable:boolean,role:string>"


def struct(**fields: Column) -> Column:
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def paragraph_pieces(paragraph: Column) -> Column:
    """The (text, separator) slots of a paragraph with its separator."""
    return let(b.separator_of(paragraph), lambda separator: _pieces(paragraph, separator))


def _pieces(paragraph: Column, separator: Column) -> Column:
    body = F.substr(paragraph, F.lit(1), F.length(paragraph) - F.length(separator))
    return let(b.clauses(body), lambda found: _split(found, separator))


def _split(found: Column, separator: Column) -> Column:
    n = F.size(found)

    def split(x: Column, i: Column) -> Column:
        last = i == n - 1
        # an open clause before a separator keeps its trailing blanks, all others hand them on
        keep = last & (separator != "") & ~b.ends_at_boundary(x)
        tail = F.when(last, separator).otherwise(F.lit(""))
        return let(
            F.when(keep, x).otherwise(t.rtrim(x)),
            lambda text: struct(text=text, separator_after=F.concat(F.substr(x, F.length(text) + 1), tail)),
        )

    return F.when(n == 0, F.array(struct(text=F.lit(""), separator_after=separator))).otherwise(F.transform(found, split))


def slot_array(text: Column) -> Column:
    """Array of slots: slot_order, slot_id, text, separator_after, editable, role. An empty text has none."""
    parts = F.transform(
        b.paragraphs(text),
        lambda p, i: F.transform(
            paragraph_pieces(p),
            lambda s, k: struct(slot_id=F.concat(F.lit("txt:p"), i.cast("string"), F.lit(":r0:s"), k.cast("string")), text=s["text"], separator_after=s["separator_after"]),
        ),
    )
    empty = F.array().cast(f"array<{SLOT}>")
    return F.when(text == "", empty).otherwise(let(F.flatten(parts), _joined))


def _joined(flat: Column) -> Column:
    n = F.size(flat)
    # blanks after the last paragraph break belong to the slot before them
    loose = (n > 1) & (F.get(flat, n - 1)["text"] == "")
    tail = F.get(flat, n - 1)["separator_after"]
    merged = F.transform(
        F.slice(flat, F.lit(1), n - 1),
        lambda s, i: struct(slot_id=s["slot_id"], text=s["text"], separator_after=F.when(i == n - 2, F.concat(s["separator_after"], tail)).otherwise(s["separator_after"])),
    )
    slots = F.when(loose, merged).otherwise(flat)

    def finish(s: Column, i: Column) -> Column:
        editable = ~t.is_blank(s["text"])
        role = F.when(editable, "editableText").when(b.has_paragraph_break(s["separator_after"]), "paragraphBreak").when(s["text"] != "", "lockedText").otherwise("editableText")
        return struct(slot_order=i, slot_id=s["slot_id"], text=s["text"], separator_after=s["separator_after"], editable=editable, role=role)

    return F.transform(slots, finish)


def slots(docs: DataFrame) -> DataFrame:
    """doc_id and one row for each slot of the texts; null texts have none."""
    return inlined(docs.select("doc_id", slot_array(F.col("text")).alias("slots")))


def inlined(made: DataFrame) -> DataFrame:
    """doc_id, slots as one row for each slot. A plain inline would add a filter that makes all slots a second time."""
    return made.select("doc_id", F.inline_outer("slots")).filter("slot_order IS NOT NULL")


def closes_unit(slot: Column, preset: str) -> Column:
    """Whether a unit ends with this slot."""
    paragraph = (slot["role"] == "paragraphBreak") | b.has_paragraph_break(slot["separator_after"])
    if preset == "paragraph":
        return paragraph
    marks = b.CLAUSE_MARKS if preset == "clause" else b.SENTENCE_MARKS
    return paragraph | F.contains(slot["separator_after"], F.lit("\n")) | b.ends_with(F.concat(slot["text"], slot["separator_after"]), marks)


def unit_array(slots: Column, preset: str) -> Column:
    """Array of units: unit_order, unit_id, slot_ids, display_text, status.

    Slots are grouped up to one that closes a unit; groups without content are dropped; except for paragraphs, a
    group of fewer than four characters joins the next one.
    """
    return let(slots, lambda s: let(_ends(s, preset), lambda e: _units(s, e, preset)))


def _ends(slots: Column, preset: str) -> Column:
    return F.filter(F.transform(slots, lambda s, i: F.when(closes_unit(s, preset) | (i == F.size(slots) - 1), i)), lambda i: i.isNotNull())


def _units(slots: Column, ends: Column, preset: str) -> Column:
    def group(end: Column, k: Column) -> Column:
        start = F.coalesce(F.when(k > 0, F.get(ends, k - 1)), F.lit(-1)) + 1
        return let(F.slice(slots, start + 1, end - start + 1), described)

    def described(own: Column) -> Column:
        shown = F.array_join(F.transform(own, lambda s: F.concat(s["text"], s["separator_after"])), "")
        alone = (F.size(own) == 1) & (F.get(own, F.lit(0))["role"] == "paragraphBreak") & (F.get(own, F.lit(0))["text"] == "")
        return struct(ids=F.transform(own, lambda s: s["slot_id"]), shown=shown, editable=F.exists(own, lambda s: s["editable"]), alone=alone)

    groups = F.filter(F.transform(ends, group), lambda g: ~(g["alone"] | (~g["editable"] & t.is_blank(g["shown"]))))
    groups = F.transform(groups, lambda g: struct(ids=g["ids"], shown=g["shown"], editable=g["editable"]))
    if preset != "paragraph":
        groups = let(groups, lambda g: let(_full_ends(g), lambda e: _joined_groups(g, e)))
    return F.transform(
        groups,
        lambda g, i: struct(unit_order=i, unit_id=F.concat(F.lit("unit-"), i.cast("string")), slot_ids=g["ids"], display_text=g["shown"], status=F.when(g["editable"], "idle").otherwise("done")),
    )


def _full_ends(groups: Column) -> Column:
    """Where units end: the places of the groups with which a unit reaches its least length, and of the last group.

    A fold that carries numbers only: the length of the trimmed text so far, and of the white space after it. An array that
    grows inside a fold is copied at every step, so the fold runs over blocks, and each block has an array of its own.
    """

    def measured(shown: Column) -> Column:
        lead, core = F.length(shown) - F.length(t.ltrim(shown)), F.length(t.trim(shown))
        return struct(lead=lead, core=core, trail=F.length(shown) - lead - core)

    def step(a: Column, x: Column) -> Column:
        core = F.when(a["core"] == 0, x["core"]).otherwise(a["core"] + a["tail"] + x["lead"] + x["core"])
        return let(core, lambda c: closed(a, x, c))

    def closed(a: Column, x: Column, core: Column) -> Column:
        full = core >= LEAST_UNIT_CHARS
        ends = F.when(full, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"])
        return struct(ends=ends, at=a["at"] + 1, core=F.when(full, F.lit(0)).otherwise(core), tail=x["trail"])

    def fold(sizes: Column) -> Column:
        none = F.array().cast("array<int>")

        def block(a: Column, start: Column) -> Column:
            state = struct(ends=none, at=start, core=a["core"], tail=a["tail"])
            found = F.aggregate(F.slice(sizes, start + 1, F.lit(BLOCK)), state, step)
            return let(found, lambda f: struct(blocks=F.concat(a["blocks"], F.array(f["ends"])), core=f["core"], tail=f["tail"]))

        starts = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(BLOCK))
        begin = struct(blocks=F.array().cast("array<array<int>>"), core=F.lit(0), tail=F.lit(0))
        return F.aggregate(starts, begin, block, lambda a: F.concat(F.flatten(a["blocks"]), F.when(a["core"] > 0, F.array(F.size(sizes) - 1)).otherwise(none)))

    sizes = F.transform(groups, lambda g: measured(g["shown"]))
    return F.when(F.size(groups) == 0, F.array().cast("array<int>")).otherwise(let(sizes, fold))


def _joined_groups(groups: Column, ends: Column) -> Column:
    def own(end: Column, k: Column) -> Column:
        start = F.coalesce(F.when(k > 0, F.get(ends, k - 1)), F.lit(-1)) + 1
        return let(F.slice(groups, start + 1, end - start + 1), joined_group)

    def joined_group(some: Column) -> Column:
        return struct(
            ids=F.flatten(F.transform(some, lambda g: g["ids"])), shown=F.array_join(F.transform(some, lambda g: g["shown"]), ""), editable=F.exists(some, lambda g: g["editable"])
        )

    return F.transform(ends, own)


def units(docs: DataFrame, preset: str) -> DataFrame:
    """doc_id, preset and one row for each unit."""
    made = docs.select("doc_id", slot_array(F.col("text")).alias("slots")).withColumn("units", unit_array(F.col("slots"), preset))
    return made.select("doc_id", F.lit(preset).alias("preset"), F.inline("units"))


def joined(slots: Column) -> Column:
    """The text of an array of slots in order: their texts and separators."""
    return F.array_join(F.transform(slots, lambda s: F.concat(s["text"], s["separator_after"])), "")


def rebuild(slots: DataFrame) -> DataFrame:
    """doc_id, text of a table of slots. Where the slots of a text are an array, joined() needs no shuffle."""
    rows = F.array_sort(F.collect_list(F.struct("slot_order", "text", "separator_after")))
    return slots.groupBy("doc_id").agg(joined(rows).alias("text"))
