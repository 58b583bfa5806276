"""What a line of Markdown is, as Spark expressions over one line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as t

S = r"(?U:\s)"


def is_front_matter_open(line: Column) -> Column:
    return line.rlike(rf"^\x{{FEFF}}*{S}*---{S}*\z")


def is_front_matter_close(line: Column) -> Column:
    return line.rlike(rf"^{S}*(?:---|\.\.\.){S}*\z")


def fence_marker(line: Column) -> Column:
    """The run of three or more backticks or tildes that opens a fence, else an empty string."""
    return F.regexp_extract(line, rf"^{S}*(`{{3,}}|~{{3,}})", 1)


def is_table_delimiter(line: Column) -> Column:
    dashes = t.count(line, "-")
    return line.rlike(r"^(?U:[|:\s-]++)\z") & F.contains(line, F.lit("|")) & (dashes >= 3)


def is_reference_definition(line: Column) -> Column:
    return line.rlike(rf"^{S}*\[(?!\]:)(?:(?!\]:).)+\]:{S}*(?U:\S)")


def is_html(line: Column) -> Column:
    return line.rlike(rf"^{S}*<[/!?A-Za-z]")


def is_rule(line: Column) -> Column:
    return line.rlike(rf"^{S}*+([-*_])(?:{S}*+\1){{2,}}+{S}*+\z")


def is_heading(line: Column) -> Column:
    return line.rlike(rf"^{S}*#{{1,6}}(?:\z|[ \t\n\r\f])")


def is_setext_underline(line: Column) -> Column:
    return line.rlike(rf"^{S}*(?:-+|=+){S}*\z")


def is_indented_code(line: Column) -> Column:
    return ~t.is_blank(line) & line.rlike("^(?:\t|    )")


def is_math_delimiter(line: Column) -> Column:
    return line.rlike(rf"^{S}*\$\${S}*\z")


def is_list_or_quote(line: Column) -> Column:
    return line.rlike(rf"^{S}*(?:>|[-*+] |[0-9]+[.)][ \t\n\r\f])")


#: Which kind a line is, the first that fits; stateful kinds (inside a fence, front matter) need the whole text.
KINDS = [
    ("blank", t.is_blank),
    ("fence", lambda c: fence_marker(c) != ""),
    ("math", is_math_delimiter),
    ("table", is_table_delimiter),
    ("heading", is_heading),
    ("definition", is_reference_definition),
    ("html", is_html),
    ("rule", is_rule),
    ("code", is_indented_code),
    ("list", is_list_or_quote),
]


def line_kind(line: Column) -> Column:
    out = F.lit("text")
    for name, test in reversed(KINDS):
        out = F.when(test(line), name).otherwise(out)
    return out
