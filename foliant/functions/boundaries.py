"""Paragraph and clause boundaries as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that end a clause or a sentence, and marks that may follow them.
CLAUSE_MARKS = "。！？；!?;.，,"
SENTENCE_MARKS = "。！？；!?;."
CLOSERS = "\"'”’）)】\\]}」』》〉"

BREAK = r"(?>\r\n|\r|\n)"
SEPARATOR = rf"{BREAK}(?:[ \t]*{BREAK})++"
_DOT = r"\.(?!\\)(?!(?<=[0-9]\.)(?U:\s*)[0-9])(?!(?<=[A-Za-z]\.)(?U:\s*)[A-Za-z])"
_COMMA = r",(?!(?<=[0-9],)(?U:\s*)[0-9])"
CLAUSE = rf"(?s).*?(?:[。！？；!?;，]|{_COMMA}|{_DOT})[{CLOSERS}]*(?U:\s*)|(?s).+\z"


def has_paragraph_break(text: Column) -> Column:
    return text.rlike(SEPARATOR)


def paragraphs(text: Column) -> Column:
    """Paragraphs with their separators; at least one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s).*?{SEPARATOR}|(?s).+\z"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def separator_of(paragraph: Column) -> Column:
    return F.regexp_extract(paragraph, rf"{SEPARATOR}\z", 0)


def clauses(body: Column) -> Column:
    """Clauses of a paragraph without its separator; closing marks and white space stay with the clause."""
    return F.regexp_extract_all(body, F.lit(CLAUSE), F.lit(0))


def ends_with(text: Column, marks: str) -> Column:
    """Whether the last character before closing marks and white space is one of the marks."""
    return text.rlike(rf"[{marks}][{CLOSERS}]*(?U:\s*)\z")


def ends_at_boundary(clause: Column) -> Column:
    return ends_with(clause, CLAUSE_MARKS)
