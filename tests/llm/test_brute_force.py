"""Operators against plain versions of their contracts, on small made-up tables and on the supplied ones."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

from foliant.llm import chat_repair, exact_dedup, jaccard_join, license_scan, mixing, pii, queries
from foliant.llm.decontaminate import WordAutomaton, merge_spans
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    check(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_automaton():
    rng = random.Random(1)
    for _ in range(300):
        word = lambda: rng.choice([b"a", b"b", b"c"])
        items = [(str(i), [word() for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 4))]
        text = [word() for _ in range(rng.randint(0, 20))]
        hit, names = set(), set()
        for name, words in items:
            size = min(4, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                for i in range(len(text) - size + 1):
                    if text[i : i + size] == words[k : k + size]:
                        hit |= set(range(i, i + size))
                        names.add(name)
        auto = WordAutomaton(items, 4)
        spans, found = auto.hits(text) if auto.has_anchor(text) else ([], set())
        assert {p for s, e in merge_spans(spans) for p in range(s, e)} == hit
        assert found == names


def test_quotient_filters():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 1 << 64, 500, np.uint64) for _ in range(4)]
    parts = [np.concatenate([p, parts[0][:50], p[:5]]) for p in parts]
    merged = exact_dedup.merge_filters([exact_dedup.build_filter(p) for p in parts])
    whole = exact_dedup.build_filter(np.concatenate(parts))
    assert all((a == b).all() for a, b in zip(merged, whole, strict=True))


def near_copies(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60)) for _ in range(rng.choice([2, 5, 30, 60, 90]))]
        for _ in range(rng.randint(0, 6)):
            out.append(list(words))
            words = list(words)
            words[rng.randrange(len(words))] = "X" + str(rng.randint(0, 3))
            if rng.random() < 0.3:
                words.append("tail")
        out.append(words)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def test_jaccard(spark):
    rows = near_copies(3, 80)
    sets = {}
    for k, text in rows:
        w = text.lower().split()
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in product(sets, sets):
        if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, star_rounds=rounds).collect()}
        assert got == {k: (len(sets[k]), top(k)) for k in sets}


def test_frequency_bitmaps(spark):
    rows = [(k, f"one two three w{k % 7} x{k}") for k in range(700)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("cast(text as binary) AS bytes")
    maps = jaccard_join.frequency_bitmaps(texts, 3)
    found = lambda t: list(jaccard_join.frequency_class(jaccard_join.shingles(t), maps))
    assert found(b"one two three") == [4]  # in all 700
    assert found(b"two three w1") == [3]  # in 100
    assert found(b"three w5 x5") == [0]


def test_mixing_targets_and_splits(spark):
    rows = [(i, " ".join(["w"] * (i % 40 + 1)), f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    totals = {}
    for r in got:
        totals[r["source"]] = totals.get(r["source"], 0) + r["size"]
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(totals.values())), set(order)
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * totals[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        open_ -= full
    target |= {s: share * weight[s] for s in open_}
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == totals[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    root = spark.createDataFrame([([7, 0, 300, 12, 1000],)], "counts array<long>")
    leaves = mixing.split_blocks(root, 6).collect()
    assert sorted(r["shard"] for r in leaves) == list(range(6))
    assert np.array([r["counts"] for r in leaves]).sum(0).tolist() == [7, 0, 300, 12, 1000]
    sums = [sum(r["counts"]) for r in leaves]
    assert max(sums) - min(sums) <= 3 and min(min(r["counts"]) for r in leaves) >= 0


def test_hypergeometric_law(spark):
    from math import comb

    from pyspark.sql import functions as F

    n, k, d = 40, 15, 12
    draws = spark.range(20_000).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), (F.col("id") + 0.5) / 20_000).alias("x"))
    got = {r["x"]: r["count"] / 20_000 for r in draws.groupBy("x").count().collect()}
    for x in range(d + 1):
        want = comb(k, x) * comb(n - k, d - x) / comb(n, d)
        assert abs(got.get(x, 0) - want) < 2e-4


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def confirmed(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_personal_data(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "x-y", ".", "1", "22", "255", "256", "0007", "+4", " ", "-", "(", ")", "_", "é", "4111111111111111", "\n", "9" * 14]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(3000)]
    texts = dict(rows)
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans, counts = [], []
        for kind, pattern in PII.items():
            found = [m for m in re.finditer(pattern, texts[r["doc_id"]]) if confirmed(kind, m[0])]
            counts.append(len(found))
            spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_licenses(spark):
    rng = random.Random(5)
    bits = "under the mit license apache version 2 cc by nc x".split()
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(2000)]
    texts = dict(rows)
    for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]])
        found = [(i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert {x for _, x in found} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_chats_are_cheapest(spark):
    def cheapest(roles):
        best, todo = None, {(chat_repair.START, 0): 0}
        for _ in range(4 * len(roles) + 8):  # relax over (state, turns used); inserting uses none
            new = dict(todo)
            for (state, used), cost in todo.items():
                steps = [((to, used), cost + chat_repair.INSERT) for to in chat_repair.NEXT[state]]
                if used < len(roles):
                    role = chat_repair.role_number(roles[used])
                    steps += [((to, used + 1), cost + chat_repair.RELABEL * (role != to)) for to in chat_repair.NEXT[state]]
                    if state:
                        steps.append(((state, used + 1), cost + chat_repair.MERGE + chat_repair.RELABEL * (role != state)))
                for key, c in steps:
                    if c < new.get(key, 1 << 40):
                        new[key] = c
            todo = new
        return min(c for (s, used), c in todo.items() if used == len(roles) and s in chat_repair.END)

    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(150):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randint(1, 9))]
        want[conv] = cheapest(roles)
        rows += [(conv, i, r, f"t{i}") for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk in (2, 512):
        for r in chat_repair.repair_chats(df, chunk=chunk).collect():
            assert r["cost"] == want[r["conv_id"]]
            roles = re.findall(r"<\|(system|user|assistant)\|>", r["rendered"])
            assert len(roles) == r["n_messages"] and re.fullmatch("(system )?(user assistant )*(user assistant )", " ".join(roles) + " ")
            assert re.findall(r"t[0-9]+", r["rendered"]) == [f"t{i}" for i in range(r["n_turns"])]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lang = [r for r in queries.op1_language_id(spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in lang)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in lang) >= 0.97 * len(lang)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = [r for r in queries.op6_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in scored) >= 0.93 * len(scored)


def test_url_verdicts(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op5_url_filter(spark, SF).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]])
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(rule), rule, v) for v, rule in rules if ("." + host).endswith("." + rule.split("/")[0]) and path.startswith(rule[rule.index("/") :])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(p.STAGES):
        before = {r["doc_id"] for r in now.collect()}
        now = stage(spark, now, SF)
        after = now.collect()
        assert {r["doc_id"] for r in after} <= before and after
        if k < len(p.STAGES) - 1:
            assert now.columns == docs.columns
    assert sorted((r["doc_id"], r["taken"]) for r in after) == sorted((r["doc_id"], r["taken"]) for r in p.run(spark, SF).collect())


def test_pipeline_keeps_rows_by_row(spark, tmp_path):
    """run() against a plain version, row by row, where ids are missing and repeated; one source, so each row is drawn once."""
    import corpus_pipeline as p

    rng = random.Random(9)
    text = lambda n=40: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    shared, lone, far, near, item = text(), text(), text(), text(60), text(20)
    rows = [(i, text()) for i in range(10, 30)]
    rows += [(1, shared), (1, shared), (2, shared.replace(" ", "  ", 1)), (None, shared)]  # the longest of four stays
    rows += [(None, lone), (None, lone), (None, text()), (None, text())]  # one of two copies, and two of their own
    rows += [(3, text()), (3, text()), (3, text())]  # one id, three texts
    rows += [(4, far), (4, far)]
    rows += [(5, near), (6, near + " tail"), (6, text()), (None, near + " other")]  # 6's second text is no copy
    rows += [(7, item), (None, item + " more"), (8, "12 34"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    last = lambda i: (i is None, i or 0)
    kept = [r for r in rows if r[1] and re.search("[A-Za-z]", r[1])]
    groups: dict = {}
    for r in kept:
        groups.setdefault(re.sub(r"\s", "", r[1]), []).append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), last(r[0]))) for g in groups.values()]
    words = [r[1].split() for r in kept]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    root = list(range(len(kept)))
    for a, b in product(range(len(kept)), repeat=2):
        if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]):
            root = [root[a] if x == root[b] else x for x in root]
    kept = [min((r for r, x in zip(kept, root, strict=True) if x == k), key=lambda r: last(r[0])) for k in set(root)]
    windows = lambda t: {tuple(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)}
    kept = [r for r in kept if not windows(item) & windows(r[1])]
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((repr(r["doc_id"]), r["text"], r["taken"]) for r in got) == sorted((repr(i), t, len(t.split())) for i, t in kept)
    assert len(kept) == 20 + 1 + 3 + 3 + 1 + 2


def test_levels_go_up_with_the_corpus():
    assert [x for x, _ in jaccard_join.levels_of(1000, 8)] == [2, 8, 64, 512]
    for total in (10**3, 10**8, 10**10, 10**13):
        for k, (level, bits) in enumerate(jaccard_join.levels_of(total, 20)):
            assert 23 <= bits <= jaccard_join.LEVEL_BITS and (k == 0 or total / level <= 1 << (bits - 1))
