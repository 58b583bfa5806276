"""Text functions as Spark expressions. White space is Unicode White_Space unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
EOL = {"crlf": "\r\n", "lf": "\n", "cr": "\r"}
#: What may start a line before its own words.
MARKER = r"(?:#+|>+|[-*+•·]|[0-9]+[.．)）、]|\([^)]{0,11}\)|（[^）]{0,11}）)?"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def ltrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++", "")


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\s)\s++\z", "")


def trim_blanks(text: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.regexp_replace(text, r"^[ \t]++|(?<![ \t])[ \t]++\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def line_ending(text: Column) -> Column:
    """crlf, lf, cr or none: the most frequent, ties in this order."""
    def told(n: Column) -> Column:
        crlf, lf, cr = n["crlf"], n["lf"] - n["crlf"], n["cr"] - n["crlf"]
        return F.when((crlf >= lf) & (crlf >= cr), "crlf").when(lf >= cr, "lf").otherwise("cr")

    counts = F.struct(*(count(text, end).alias(kind) for kind, end in EOL.items()))
    return F.when(~text.rlike("[\r\n]"), "none").otherwise(let(counts, told))


def with_line_ending(text: Column, ending: Column) -> Column:
    def ended(lf: Column, kind: Column) -> Column:
        return F.when(kind == "crlf", F.replace(lf, F.lit("\n"), F.lit("\r\n"))).when(kind == "cr", F.replace(lf, F.lit("\n"), F.lit("\r"))).otherwise(lf)

    return let(to_lf(text), lambda lf: let(ending, lambda kind: ended(lf, kind)))


def normalize(text: Column) -> Column:
    """LF line ends, trimmed lines, at most one blank line in a row, trimmed."""
    lines = F.transform(F.split(to_lf(text), "\n"), trim)
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def strip_line_tails(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![ \t])[ \t]++(?=[\r\n]|\z)", "")


def has_line_tails(text: Column) -> Column:
    return text.rlike(r"[ \t](?:[\r\n]|\z)")


def collapse_lines(text: Column) -> Column:
    """Line breaks as single spaces, or as nothing after a space; texts without any stay as they are."""
    joined = F.regexp_replace(F.regexp_replace(to_lf(text), r"(?<= )\n+", ""), r"\n+", " ")
    return F.when(text.rlike("[\r\n]"), trim(joined)).otherwise(text)


def line_prefix(line: Column) -> Column:
    """Indent, marker and the blanks after it."""
    return F.regexp_extract(F.regexp_replace(line, r"(?<![ \t])[ \t]++\z", ""), rf"^[ \t]*{MARKER}[ \t]*", 0)


def line_suffix(line: Column) -> Column:
    return F.regexp_extract(line, r"(?<![ \t])[ \t]++\z", 0)


def line_core(line: Column) -> Column:
    base = F.regexp_replace(line, r"(?<![ \t])[ \t]++\z", "")
    return F.substr(base, F.length(line_prefix(line)) + 1)


def without_prefix(candidate: Column, prefix: Column) -> Column:
    """candidate trimmed of blanks, and of the prefix's marker if it repeats that."""
    body, marker = trim_blanks(candidate), F.regexp_replace(prefix, r"^[ \t]++", "")
    repeats = (marker != "") & F.startswith(body, marker)
    return F.when(repeats, trim_blanks(F.substr(body, F.length(marker) + 1))).otherwise(body)


def with_line_skeleton(source: Column, candidate: Column) -> Column:
    """candidate between the source line's prefix and suffix; the source where either has no words."""
    body = without_prefix(candidate, line_prefix(source))
    keep = is_blank(source) | is_blank(line_core(source)) | is_blank(body)
    return F.when(keep, source).otherwise(F.concat(line_prefix(source), body, line_suffix(source)))


def match_layout(text: Column, source: Column) -> Column:
    """text with the source's line ends, and without blanks before line ends unless the source has such."""
    tidy = F.when(has_line_tails(source), text).otherwise(strip_line_tails(text))
    return with_line_ending(tidy, line_ending(source))


def script_counts(text: Column) -> dict[str, Column]:
    out = {"cjk": count(text, CJK), "latin": count(text, "[A-Za-z]"), "digits": count(text, "[0-9]")}  # in this order
    return out | {"total": out["cjk"] + out["latin"] + out["digits"]}


def mostly_of(count: Column, total: Column, script: str) -> Column:
    """mostly() from columns that script_counts() has already given."""
    return (total >= 20) & (F.floor(count * 100 / F.greatest(total, F.lit(1))) >= {"cjk": 40, "latin": 60}[script])


def mostly(text: Column, script: str) -> Column:
    """At least 40 % CJK or 60 % Latin of 20 or more counted characters."""
    counts = F.array(*script_counts(text).values())
    share = lambda c: F.floor(F.get(c, F.lit(["cjk", "latin"].index(script))) * 100 / F.greatest(F.get(c, F.lit(3)), F.lit(1)))
    return let(counts, lambda c: (F.get(c, F.lit(3)) >= 20) & (share(c) >= {"cjk": 40, "latin": 60}[script]))


def count_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def preview(text: Column, limit: int = 320) -> Column:
    squeezed = trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return F.when(F.length(squeezed) > limit, F.concat(F.substr(squeezed, F.lit(1), F.lit(limit)), F.lit("…"))).otherwise(squeezed)


def split_lines(text: Column) -> Column:
    """Lines with their ends; an empty text is one empty line."""
    lines = F.regexp_extract_all(text, F.lit("[^\r\n]*(?>\r\n|\r|\n)|[^\r\n]+\\z"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(lines)
