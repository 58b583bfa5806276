import random

import pytest

from foliant.operators.markdown_blocks import markdown_blocks
from tests.plain_markdown import blocks_of


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("", []),
        ("\n\n# a\n\nb\nc\n\n", ["blank", "blank", "heading", "paragraph"]),
        ("---\nk: v\n---\n\ntext", ["locked_block", "paragraph"]),
        ("---\ntext", ["locked_block", "paragraph"]),
        ("```py\n# a\n\n```\nb", ["locked_block", "paragraph"]),
        ("~~~\nopen\n\nstill", ["locked_block"]),
        ("````\n```\n````\nx", ["locked_block", "paragraph"]),
        ("$$\nx\n$$\ny", ["locked_block", "paragraph"]),
        ("a | b\n--- | ---\n1 | 2\n\nx", ["locked_block", "paragraph"]),
        ("title\n===\nbody", ["heading", "paragraph"]),
        ("[a]: http://x\n<div>\n* * *\n    code\n    more\nx", ["locked_block", "locked_block", "locked_block", "locked_block", "paragraph"]),
        ("- a\n  more\n  - b\n- c\n> q\n> r\nlazy\n# h", ["list_item", "list_item", "quote", "heading"]),
        ("text\n- item", ["paragraph", "list_item"]),
        ("#nospace", ["paragraph"]),
    ],
)
def test_kinds(text, kinds):
    found = blocks_of(text)
    assert [k for k, _ in found] == kinds
    assert "".join(x for _, x in found) == text


def test_lossless(spark):
    rng = random.Random(8)
    bits = ["# a", "\n", "\r\n", "```", "$$", "- x", "> y", "|", "---", "    c", "text", " ", "\r", "===", "[a]: b", "<p>"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(999, None)]
    got = {}
    for r in markdown_blocks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "block_idx").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["text"]
    assert got == {k: x for k, x in rows if x}


def test_automaton_is_the_plain_one(spark):
    """Random lines of all kinds, texts over several stretches of the fold, front matter early and late."""
    rng = random.Random(9)
    bits = ["# a", "#b", "```", "````", "```py", "~~~", "$$", " $$ ", "- x", "  - y", "12. z", "> y", "  > w", "a | b", "--- | ---", "|---|", "---", "===", "...", "    c", "\tc", "text", "", " ", "[a]: b", "<p>", "* * *", "\ufeff---", "   "]
    ends = ["\n", "\n", "\n", "\r\n", "\r"]
    lines = lambda n: "".join(rng.choice(bits) + rng.choice(ends) for _ in range(n))
    texts = [lines(rng.randint(0, 30)) + rng.choice(bits) for _ in range(500)] + [lines(1000) for _ in range(5)] + ["---\n" + "k\n" * n + "---\nx" for n in (0, 198, 199, 200, 201)] + ["\n \n\ufeff---\na\n...\n\n# h", "---"]
    got = {}
    for r in markdown_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "block_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["text"]))
    for k, text in enumerate(texts):
        assert got.get(k, []) == blocks_of(text), repr(text)[:300]
