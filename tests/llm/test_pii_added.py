"""What the trees add to the base patterns: planted data in other forms, and nothing plain."""

import random
import re

from foliant.llm import pii

PLANTED = {
    "write to jane.doe (at) mail7.example (dot) com today": ("email", "jane.doe (at) mail7.example (dot) com"),
    "contact bob_1[at]example[dot]org now": ("email", "bob_1[at]example[dot]org"),
    "host 10[.]20[.]30[.]44 is down": ("ip", "10[.]20[.]30[.]44"),
    "pay with 4111.1111.1111.1111 please": ("card", "4111.1111.1111.1111"),
    "call 0044 (20) 7946 0958 tonight": ("phone", "0044 (20) 7946 0958"),
}
PLAIN = ["on 2024-01-31 12 people met at noon. They left", "about 1 234 567 of 9 876 543 units", "release 4.12.1 came at 3.5 percent", "row 17 | 22 | 2 000 100 000 000", "look at chapter two. It is long"]


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        total = sum(d if i % 2 else (d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    made = {
        "email": lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.example.com",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
    }
    lead = {"email": "mail", "ip": "host", "card": "card", "phone": "call"}
    rows = [f"{words(9)} {lead[k]} {make()} {words(5)}" for k, make in made.items() for _ in range(60)]
    rows += [f"{words(6)} {rng.choice(PLAIN)} {words(6)}" for _ in range(300)]
    rows += [f"{words(5)} {digits(rng.randint(9, 16))} {words(5)} {digits(4)}-{digits(2)}-{digits(2)} {digits(2)}" for _ in range(100)]
    return rows


def test_disguised_data_is_added_and_plain_numbers_are_not(spark):
    rows = corpus()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    chooser = pii.Chooser(docs)
    assert set(chooser.thresholds) == set(pii.KINDS)
    planted = spark.createDataFrame([(i, t) for i, t in enumerate([*PLANTED, *PLAIN])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(planted, chooser).collect()}
    for i, (text, (kind, body)) in enumerate(PLANTED.items()):
        start = text.index(body)
        assert got[i]["spans"] == f"{kind}:{start}:{start + len(body)}" and got[i]["n_added"] == 1, text
    for i, text in enumerate(PLAIN, len(PLANTED)):
        assert got[i]["spans"] == "" and got[i]["n_added"] == 0, text
    clean = pii.redacted(planted, chooser).collect()
    assert {r["doc_id"]: r["text"] for r in clean}[0] == "write to [EMAIL] today"
    added = pii.personal_data(docs, chooser).agg({"n_added": "sum"}).first()[0]
    assert added <= 0.01 * len(rows)


def test_positions_over_many_matches(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["é ", "a.b@c-d.org", " ", "x", "\n", "q@r.st,"]) for _ in range(3000))
    found = spark.createDataFrame([(text,), ("",), ("none",)], "text string").select(pii.find(pii.F.col("text"), pii.PATTERNS["email"], "@").alias("f"))
    plain = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    rows = found.collect()
    assert len(plain) > 500 and [(s["start"], s["end"], s["text"]) for s in rows[0]["f"]] == plain
    assert rows[1]["f"] == [] == rows[2]["f"]


def test_no_confirmed_data_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "write to jane (at) example (dot) org"), (1, "write to jane (at) example (dot) org"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["spans"] for r in pii.personal_data(docs).collect()} == {""}
