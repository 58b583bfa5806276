"""Chunks and pieces of conversations whose turn numbers say nothing about their size."""

import random

from foliant.llm import chat_repair


def test_chunks_are_bounded_by_rows(spark, monkeypatch):
    """Turns without a number, repeated numbers and no conv_id: no chunk has over `chunk` rows, and all is rendered."""
    seen = []
    keep = chat_repair.stored
    monkeypatch.setattr(chat_repair, "stored", lambda df, label: seen.append(keep(df, label)) or seen[-1])
    rng = random.Random(1)
    rows = [(None, None, "user", f"<a{i}>") for i in range(300)] + [(None, 5, "assistant", "<same>") for _ in range(300)]
    rows += [(c, i, rng.choice(["user", "assistant", "system", None]), f"<{c}.{i}>") for c in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat_repair.repair_chats(df, chunk=16).collect()}
    sizes = [len(r["turns"]) for r in seen[0].collect()]
    assert max(sizes) <= 16 and sum(sizes) == len(rows)
    assert len(got) == 21 and got[None]["n_turns"] == 600 and got[None]["rendered"].count("<same>") == 300
    assert all(got[None]["rendered"].count(f"<a{i}>") == 1 for i in range(300))
    assert got[None]["rendered"].rindex("<same>") < got[None]["rendered"].index("<a0>")


def test_long_conversations_come_in_pieces(spark):
    rows = [(c, i, ["user", "assistant", "tool"][i % 3], f"{c}.{i} " + "x" * (50 if c else 1)) for c in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r for r in chat_repair.repair_chats(df).collect()}
    assert {r["part"] for r in whole.values()} == {0}
    parts: dict = {}
    for r in chat_repair.repair_chats(df, chunk=7, chunk_bytes=400, joined=1000).collect():
        parts.setdefault(r["conv_id"], []).append(r)
    assert len(parts[0]) == 1 and len(parts[1]) > 3
    for c, pieces in parts.items():
        pieces.sort(key=lambda r: r["part"])
        assert [r["part"] for r in pieces] == list(range(len(pieces)))
        assert all(len(r["rendered"]) < 1000 + 400 + 100 * 30 for r in pieces)
        assert sum(r["n_turns"] for r in pieces) == 100 and sum(r["cost"] for r in pieces) == whole[c]["cost"]
        text = "".join(r["rendered"] for r in pieces)
        assert [t for t in text.split() if "." in t] == [f"{c}.{i}" for i in range(100)] and text.endswith("<|end|>\n")
