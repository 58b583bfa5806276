"""Segments for display against a plain scanner, on random markup and on long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import display


def group_end(x, at, opening, closing):
    if at >= len(x) or x[at] != opening:
        return None
    depth, k = 0, at
    while k < len(x) and x[k] not in "\r\n":
        if x[k] == "\\":
            k += 2
            continue
        depth += (x[k] == opening) - (x[k] == closing)
        k += 1
        if depth == 0:
            return k
    return None


def plain_segments(x):
    """(protect_kind or None, text), by trying every kind at every place."""
    out, k, text = [], 0, ""
    stops = set(" \n\r\t<>\"'[](){}（）【】「」『』《》〈〉“”‘’，。；：！？")

    def lines_from(k):
        while k < len(x):
            end = min([p for p in (x.find("\n", k), x.find("\r", k)) if p >= 0], default=len(x))
            after = end + (2 if x[end : end + 2] == "\r\n" else 1 if end < len(x) else 0)
            yield x[k:end], after
            k = after

    def part(k):
        starts = k == 0 or x[k - 1] in "\r\n"
        if starts and not (x[k - 1 : k + 1] == "\r\n"):
            lines = lines_from(k)
            first = next(lines, None)
            if first and first[0].strip() == "$$" and re.match(r"[ \t]*\$\$", first[0]) and x[k:][: len(first[0])] == first[0] and first[1] > k + len(first[0]):
                for line, after in lines:
                    if line.strip() == "$$":
                        return "math-block", after
        at_start = not x[:k].rsplit("\n", 1)[-1].rsplit("\r", 1)[-1].strip(" \t")
        c, two = x[k], x[k : k + 2]
        if c == "`":
            n = len(re.match("`+", x[k:])[0])
            line = re.match(r"[^\r\n]*", x[k + n :])[0]
            for m in re.finditer("`+", line):
                if len(m[0]) == n:
                    return "code", k + n + m.end()
        elif two in ("[^", "[@"):
            m = re.compile(r"\[[\^@](?:[^\]\\\r\n]|\\[\s\S])*\]").match(x, k)
            return ("footnote" if two == "[^" else "citation", m.end()) if m else None
        elif c in "![":
            close = group_end(x, k + (c == "!"), "[", "]")
            if close is not None:
                while x[close : close + 1] in (" ", "\t"):
                    close += 1
                end = group_end(x, close, "(", ")") or group_end(x, close, "[", "]")
                return ("link", end) if end else None
        elif c == "<":
            m = re.compile(r"<!--[^\n]*?-->").match(x, k)
            if m:
                return "html-comment", m.end()
            m = re.compile(r"<([^>\r\n]*)>").match(x, k)
            if m and re.match(r"https?://|mailto:", m[1].strip().lower()):
                return "autolink" if re.match(r"(?i)https?://|mailto:", m[1]) else "html-tag", m.end()
            if m and re.match(r"[/A-Za-z]", m[1]):
                return "html-tag", m.end()
        elif re.compile(r"https?://|www\.").match(x, k):
            end = k
            while end < len(x) and x[end] not in stops:
                end += 1
            while end > k and x[end - 1] in ".,;:!?，。；：！？":
                end -= 1
            return "url", end
        elif c == "$" and len(re.search(r"\\*\Z", x[:k])[0]) % 2 == 0:
            m = re.compile(r"\$\$(?:[^$\\]|\\[\s\S])*\$\$" if two == "$$" else r"\$(?:[^$\\]|\\[\s\S])+\$").match(x, k)
            if m and not (two == "$$" and at_start):
                return "math", m.end()
        return None

    while k < len(x):
        found = part(k)
        if found:
            if text:
                out.append((None, text))
            out.append((found[0], x[k : found[1]]))
            k, text = found[1], ""
        else:
            text += x[k]
            k += 1
    return out + ([(None, text)] if text or not out else [])


BITS = ["`", "``", "a", "b c", "[", "]", "(", ")", "!", "<", ">", "<!--", "-->", "$", "$$", "\\", "\n", "\n$$\n", " $$ \n", "\r\n", "^", "@", "https://e.org/a.", "www.", "http", "h", "w", "mailto:x", "</b>", "汉。", " ", "\t"]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    return ["", "plain", "`a``b`", "``a`b``", "[a](b(c)d) ![x] [y]", "[^n] [@c] [^\\]]", "$$\nx\n$$\n$a$ b$$c$$", "$$ a $$ b", *("".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))) for _ in range(800))]


def test_random_markup(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {}
    for r in display.segments(df).orderBy("doc_id", "segment").collect():
        assert (r["kind"] == "text") == (r["protect_kind"] is None) == (r["label"] is None)
        got.setdefault(r["doc_id"], []).append((r["protect_kind"], r["text"]))
    for k, text in enumerate(cases):
        assert "".join(t for _, t in got[k]) == text
        assert got[k] == plain_segments(text), repr(text)


def test_long_texts(spark):
    n, few = 50_000, 3000  # of what is opened again and again and never closed, each asks for the rest of its line
    texts = ["a" * n, "`" * few, "` " * few, "[" * n, "[a](b) " * (n // 7), "[a " * few, "$" * n, "$a " * few, "<" * n, "<a " * few, "<!-- " * few, "www." * (n // 4), "www." + "!" * n, "\\" * few + "$a$", "\n$$" * few, "$$\n" * few, "!" * n, " " * n, "\n" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    back = df.select("doc_id", F.aggregate(display.markdown_segments(F.col("text")), F.lit(0), lambda a, s: a + F.length(s["text"])).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in back} == {k: len(t) for k, t in enumerate(texts)}
    assert time.perf_counter() - began < 120


def plain_tex(x):
    """(protect_kind or None, text) by scanning; as the markup's own grammar reads it."""
    out, k, text = [], 0, ""

    def white(k):
        while k < len(x) and x[k] in "\t\n\r ":
            k += 1
        return k

    def braces(k):
        depth = 0
        while k < len(x):
            if x[k] == "\\":
                k += 2
                continue
            depth += (x[k] == "{") - (x[k] == "}")
            k += 1
            if depth == 0:
                return k
        return len(x)

    def options(k):
        k = white(k)
        while x[k : k + 1] == "[":
            end = group_end(x, k, "[", "]")
            if end is None:
                return len(x)
            k = white(end)
        return k

    def name(k):
        m = re.compile(r"\\([A-Za-z]+)(\*?)").match(x, k)
        return (m[1], m.end()) if m else (None, k + 2)

    def line_break(k):
        k = white(k + 2 + (x[k + 2 : k + 3] == "*"))
        return k if x[k : k + 1] != "[" else group_end(x, k, "[", "]") or len(x)

    def part(k):
        free = len(re.search(r"\\*\Z", x[:k])[0]) % 2 == 0
        if free and x[k] == "%":
            return "tex-comment", re.compile(r"[^\r\n]*").match(x, k).end()
        if free and x.startswith("\\\\", k):
            return "tex-linebreak", line_break(k)
        m = re.compile(r"\\begin\{([^}]+)\}").match(x, k)
        if free and m and m[1] in display.MATH_ENVIRONMENTS + display.RAW_ENVIRONMENTS:
            end = x.find(f"\\end{{{m[1]}}}", m.end())
            return "tex-math-block" if m[1] in display.MATH_ENVIRONMENTS else "tex-raw-env", len(x) if end < 0 else end + len(m[1]) + 6
        if free and x.startswith("$$", k):
            for e in range(k + 2, len(x) - 1):
                if x[e : e + 2] == "$$" and len(re.search(r"\\*\Z", x[:e])[0]) % 2 == 0:
                    return "tex-math-block", e + 2
        elif free and x[k] == "$":
            m = re.compile(r"\$(?:[^$\\\r\n]|\\[^\r\n])+\$").match(x, k)
            if m:
                return "tex-math", m.end()
        for opening, closing, kind, line in (("\\(", "\\)", "tex-math", True), ("\\[", "\\]", "tex-math-block", False)):
            if free and x.startswith(opening, k):
                end = x.find(closing, k + 2)
                if end >= 0 and not (line and re.search(r"[\r\n]", x[k:end])):
                    return kind, end + 2
        for command, kind in (("\\verb", "tex-verbatim"), ("\\lstinline", "tex-inline-code"), ("\\path", "tex-path")):
            if x.startswith(command, k):
                at = k + len(command)
                at += x[at : at + 1] == "*"
                at = at if kind == "tex-verbatim" else options(at)
                if at < len(x) and not x[at].isspace() and (kind == "tex-verbatim" or x[at] not in "{}"):
                    end = x.find(x[at], at + 1)
                    return kind, len(x) if end < 0 else end + 1
        if x[k] == "\\" and k + 1 < len(x):
            own, at = name(k)
            if own is None:
                return "tex-command", line_break(k) if x.startswith("\\\\", k) else at
            while True:
                at = options(at)
                if x[at : at + 1] != "{":
                    return "tex-command", at
                at = braces(at)
        return None

    def text_command(k):
        if x[k] != "\\":
            return None
        own, at = name(k)
        if own not in display.TEXT_COMMANDS:
            return None
        at = options(at)
        return (at, braces(at)) if x[at : at + 1] == "{" and braces(at) > at + 1 else None

    while k < len(x):
        inner, found = text_command(k), part(k)
        if (inner or found) and text:
            out.append((None, text))
            text = ""
        if inner:
            at, end = inner
            out += [("tex-command", x[k : at + 1]), *plain_tex(x[at + 1 : end - 1]), ("tex-command", x[end - 1 : end])]
            k = end
        elif found:
            out.append((found[0], x[k : found[1]]))
            k = found[1]
        else:
            text += x[k]
            k += 1
    return out + ([(None, text)] if text or not out else [])


TEX_BITS = ["\\emph", "\\textbf*", "\\cite", "\\verb", "\\verb*", "\\lstinline", "\\path", "\\begin{align}", "\\end{align}", "\\begin{verbatim}", "\\end{verbatim}", "\\begin{x}", "{", "}", "{", "}", "[", "]", "a", "b c", "%", "\\%", "$", "$$", "\\$", "\\\\", "\\", "\\(", "\\)", "\\[", "\\]", "|", "\n", " ", "*", "汉"]


def test_random_tex(spark):
    rng = random.Random(10)
    cases = ["", "\\emph{a \\textbf{b $c$} d} e", "\\footnote[1]{x", "\\emph", "\\cite [a] {b} c", "a % b\nc", *("".join(rng.choice(TEX_BITS) for _ in range(rng.randint(1, 14))) for _ in range(800))]
    got = {}
    for r in display.segments(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), "tex").orderBy("doc_id", "segment").collect():
        got.setdefault(r["doc_id"], []).append((r["protect_kind"], r["text"]))
    deep = 0
    for k, text in enumerate(cases):
        assert "".join(t for _, t in got[k]) == text
        if len(re.findall(r"\\emph|\\textbf", text)) > display.TEXT_DEPTH:
            deep += 1
        else:
            assert got[k] == plain_tex(text), repr(text)
    assert deep < 100
