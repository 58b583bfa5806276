"""Segmentation against a plain scan of the rules, on random texts and on cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import segment

WHITE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
CLAUSE, SENTENCE, CLOSERS = "。！？；!?;.，,", "。！？；!?;.", "\"'”’）)】]}」』》〉"
DIGITS = "0123456789"


def line_break(t, i):
    return i + 2 if t[i : i + 2] == "\r\n" else i + 1 if t[i : i + 1] in ("\r", "\n") else None


def separator(t, start=0):
    for i in range(start, len(t)):
        if (i and t[i - 1 : i + 1] == "\r\n" and i > start) or not (end := line_break(t, i)):
            continue
        last = None
        while True:
            k = end
            while t[k : k + 1] in (" ", "\t"):
                k += 1
            if not (end := line_break(t, k)):
                break
            last = end
        if last:
            return i, last
    return None


def letter(c):
    return c.isascii() and c.isalpha()


def boundary(body, i):
    c, before = body[i], body[i - 1 : i] if i else ""
    after = next((x for x in body[i + 1 :] if x not in WHITE), "")
    if c not in CLAUSE:
        return False
    if c in ".," and before and after and before in DIGITS and after in DIGITS:
        return False
    return not (c == "." and (body[i + 1 : i + 2] == "\\" or (before and after and letter(before) and letter(after))))


def plain_slots(t):
    out = []
    pos = number = 0
    while t and pos < len(t):
        found = separator(t, pos)
        body, tail = (t[pos : found[0]], t[found[0] : found[1]]) if found else (t[pos:], "")
        pieces, start = [], 0
        for i in range(len(body)):
            if i >= start and boundary(body, i):
                end = i + 1
                while end < len(body) and body[end] in CLOSERS:
                    end += 1
                while end < len(body) and body[end] in WHITE:
                    end += 1
                pieces.append((body[start:end], True))
                start = end
        if start < len(body):
            pieces.append((body[start:], False))
        for k, (piece, closed) in enumerate(pieces or [("", True)]):
            mine = tail if k == max(len(pieces) - 1, 0) else ""
            text = piece if mine and not closed else piece.rstrip("".join(WHITE))
            after = piece[len(text) :] + mine
            if not text and out:
                out[-1][2] += after
                continue
            blank = all(c in WHITE for c in text)
            role = "editableText" if not blank else "paragraphBreak" if separator(after) else "lockedText" if text else "editableText"
            out.append([f"txt:p{number}:r0:s{k}", text, after, not blank, role])
        pos, number = pos + len(body) + len(tail), number + 1
    return out


def plain_units(slots, preset):
    shown = lambda g: "".join(s[1] + s[2] for s in g)
    bare = lambda g: shown(g).strip("".join(WHITE))
    groups, now = [], []
    for n, s in enumerate(slots):
        now.append(s)
        end = shown(now).rstrip("".join(WHITE)).rstrip(CLOSERS)[-1:]
        marks = {"clause": CLAUSE, "sentence": SENTENCE, "paragraph": ""}[preset]
        close = s[4] == "paragraphBreak" or separator(s[2]) or (preset != "paragraph" and ("\n" in s[2] or (end and end in marks)))
        if close or n == len(slots) - 1:
            alone = len(now) == 1 and s[4] == "paragraphBreak" and not s[1]
            if not alone and (any(x[3] for x in now) or bare(now)):
                groups.append(now)
            now = []
    out = []
    for g in groups:
        if preset != "paragraph" and out and len(bare(out[-1])) < 4:
            out[-1] = out[-1] + g
        else:
            out.append(g)
    return [([s[0] for s in g], shown(g), "idle" if any(s[3] for s in g) else "done") for g in out]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    bits = [*"ab1 .,;\n\r\t\\)\"。，！é  \n", "\r\n", "\n\n", "　", "AB. ", "3.14", "x.y", "\xa0"]
    made = ["", "\n\n", "   ", "\n\nabc", "a.\n\n", "abc  \n\n  def", "  \n\n \n\nx"]
    made += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    return spark.createDataFrame(list(enumerate(made)), "doc_id int, text string").cache()


def test_slots(texts):
    for r in texts.select("text", segment.slot_array(F.col("text")).alias("s")).collect():
        got = [[s["slot_id"], s["text"], s["separator_after"], s["editable"], s["role"]] for s in r["s"]]
        assert got == plain_slots(r["text"]), repr(r["text"])
        assert "".join(s[1] + s[2] for s in got) == r["text"]


@pytest.mark.parametrize("preset", segment.PRESETS)
def test_units(texts, preset):
    made = texts.select("text", segment.unit_array(segment.slot_array(F.col("text")), preset).alias("u"))
    for r in made.collect():
        assert [(u["slot_ids"], u["display_text"], u["status"]) for u in r["u"]] == plain_units(plain_slots(r["text"]), preset), repr(r["text"])


def units_of(spark, text, preset):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r["display_text"] for r in segment.units(df, preset).orderBy("unit_order").collect()]


def test_known_units(spark):
    assert units_of(spark, "短。这是第二句。", "sentence") == ["短。这是第二句。"]
    assert units_of(spark, "短段\n\n下一段", "paragraph") == ["短段\n\n", "下一段"]
    assert units_of(spark, "　　\n\n正文。", "sentence") == ["正文。"]
    assert units_of(spark, "一。二。三。四五六。", "clause") == ["一。二。", "三。四五六。"]


def test_known_boundaries(spark):
    clauses = lambda x: [s[1] for s in plain_slots(x)]
    for text, want in [("3.14 and 1,000", ["3.14 and 1,000"]), ("1.2.3", ["1.2.3"]), ("a. B", ["a. B"]), ("é. B", ["é.", "B"]), ("x.\\y", ["x.\\y"])]:
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        assert [r["text"] for r in segment.slots(df).orderBy("slot_order").collect()] == want == clauses(text)
