"""Checks of proposed rewrites, as expressions that give the first reason against one, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as t

# Phrases that a rewrite must not add. English ones are matched in lower case, Chinese ones as written.
META_EN = [
    "i am claude",
    "made by anthropic",
    "helpful, harmless, and honest",
    "i'm an ai assistant",
    "i am an ai assistant",
    "as an ai language model",
    "as an ai assistant",
    "happy to help you",
    "i don't have information about the specific model version",
    "i don't have information about the specific model version or id",
]
META_ZH = [
    "我是一个ai助手",
    "我是一名ai助手",
    "作为一个ai助手",
    "作为一名ai助手",
    "作为ai语言模型",
    "作为一个ai语言模型",
    "作为一名ai语言模型",
    "作为一个人工智能助手",
    "我无法访问",
    "我不能访问",
]
GREETINGS_ZH = ["你好", "您好", "嗨", "哈喽", "早上好", "下午好", "晚上好"]
GREETINGS_EN = ["hi", "hello", "hey"]
PREFACES_ZH = ["当然可以", "没问题", "好的", "可以的"]
REWRITE_LEADS = ["下面是", "以下是", "这里是"]
REWRITE_HINTS = ["改写", "润色", "降重", "优化"]
LABELS = ["修改后", "改写后", "润色后"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _starts_with(line: Column, phrases: list[str]) -> Column:
    return line.rlike(rf"^(?:{'|'.join(phrases)})(?:\z|(?U:\s)|[，,。.！!？?:：;；])")


def _holds(text: Column, phrases: list[str]) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases))


def opening(text: Column) -> Column:
    """The first line with words, without a list or heading marker."""
    line = F.regexp_replace(F.regexp_extract(t.ltrim(text), r"^[^\n]*", 0), r"\r\z", "")
    prefix, core = t.line_prefix(line), t.line_core(line)
    return F.when(prefix.rlike(r"[ \t]\z") & ~t.is_blank(core), t.ltrim(core)).otherwise(line)


def meta_phrase(candidate: Column) -> Column:
    return F.coalesce(_holds(ascii_lower(candidate), META_EN), _holds(candidate, META_ZH))


def rewrite_problem(source: Column, candidate: Column) -> Column:
    """empty, fence, meta, greeting, preface, lead, label or script; null for a good rewrite."""
    # each is worked out once; written out at every use, the generated code would be too large to compile
    return t.let(meta_phrase(candidate), lambda m: t.let(opening(source), lambda s: t.let(opening(candidate), lambda c: _problem(source, candidate, m, s, c))))


def _problem(source: Column, candidate: Column, meta: Column, s: Column, c: Column) -> Column:
    in_source = F.contains(source, meta) | F.contains(ascii_lower(source), meta)
    added = lambda phrases: _starts_with(c, phrases) & ~_starts_with(s, phrases)
    low_s, low_c = ascii_lower(s), ascii_lower(c)
    lead = c.rlike(f"^(?:{'|'.join(REWRITE_LEADS)})") & ~s.rlike(f"^(?:{'|'.join(REWRITE_LEADS)})") & c.rlike("|".join(REWRITE_HINTS))
    crossed = (t.mostly(source, "cjk") & t.mostly(candidate, "latin")) | (t.mostly(source, "latin") & t.mostly(candidate, "cjk"))
    return (
        F.when(t.is_blank(candidate), "empty")
        .when(F.startswith(t.ltrim(candidate), F.lit("```")), "fence")
        .when(meta.isNotNull() & ~in_source, "meta")
        .when(added(GREETINGS_ZH) | (_starts_with(low_c, GREETINGS_EN) & ~_starts_with(low_s, GREETINGS_EN)), "greeting")
        .when(added(PREFACES_ZH), "preface")
        .when(lead, "lead")
        .when(added(LABELS), "label")
        .when(crossed, "script")
    )


def _one_line(source: Column, candidate: Column) -> Column:
    body = t.without_prefix(t.collapse_lines(candidate), t.line_prefix(source))
    keep = t.is_blank(t.line_core(source)) | t.is_blank(body)
    return F.when(keep, source).otherwise(F.concat(t.line_prefix(source), body, t.line_suffix(source)))


def numbered_lines(output: Column, expected: Column) -> Column:
    """The lines of an answer in the form @@@n@@@text, in order of n; null unless each of 1..expected occurs once."""
    found = F.filter(F.split(t.to_lf(output), "\n"), lambda x: x.rlike("^@@@[0-9]{1,9}@@@"))
    parsed = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^@@@([0-9]+)@@@", 1).cast("int").alias("n"), F.regexp_replace(x, "^@@@[0-9]+@@@", "").alias("text")))
    parsed = F.array_sort(F.filter(parsed, lambda p: (p["n"] >= 1) & (p["n"] <= expected)))
    numbers = F.transform(parsed, lambda p: p["n"])
    return F.when((F.size(numbers) == expected) & (F.size(F.array_distinct(numbers)) == expected), F.transform(parsed, lambda p: p["text"]))


def finalize(source: Column, candidate: Column) -> Column:
    """Struct (text, problem): the candidate in the source's layout, or why it cannot be.

    A source of several lines must keep its lines: the candidate gives as many, blank in the same places, or
    numbers them. Problems are lines, blanks, or those of rewrite_problem().
    """
    several = source.rlike("[\r\n]") & ~t.is_blank(source)
    one = F.when(source.rlike("[\r\n]"), source).otherwise(_one_line(source, candidate))
    made = F.when(several, _many_lines(source, candidate)).otherwise(F.named_struct(F.lit("text"), one, F.lit("problem"), F.lit(None).cast("string")))
    checked = lambda m: F.coalesce(m["problem"], rewrite_problem(source, m["text"]))
    return t.let(made, lambda m: t.let(checked(m), lambda p: F.named_struct(F.lit("text"), F.when(p.isNull(), m["text"]), F.lit("problem"), p)))


def _many_lines(source: Column, candidate: Column) -> Column:
    def same(lines: Column, other: Column) -> Column:
        alike = F.zip_with(lines, other, lambda a, b: t.is_blank(a) == t.is_blank(b))
        return (F.size(other) == F.size(lines)) & F.forall(alike, lambda v: F.coalesce(v, F.lit(False)))

    def join(lines: Column, plain: Column, numbered: Column) -> Column:
        usable = same(lines, plain) & ~F.exists(plain, lambda x: x.rlike("^[ \t]*@@@"))
        problem = F.when(numbered.isNotNull() & ~same(lines, numbered), "blanks").when(numbered.isNull() & ~usable, "lines")
        text = F.array_join(F.zip_with(lines, F.coalesce(numbered, plain), t.with_line_skeleton), "\n")
        return F.named_struct(F.lit("text"), F.when(problem.isNull(), text), F.lit("problem"), problem)

    lines, plain = F.split(t.to_lf(source), "\n"), F.split(t.to_lf(candidate), "\n")
    return t.let(lines, lambda a: t.let(plain, lambda b: t.let(numbered_lines(candidate, F.size(a)), lambda c: join(a, b, c))))
