import random

import pytest

from foliant.operators import review


@pytest.mark.parametrize("least", [1000, 0])
def test_unit_summary(spark, monkeypatch, least):
    """Against a plain count, with missing ids and a unit that has a third of all rows, split off or not."""
    monkeypatch.setattr(review, "HEAVY_LEAST", least)
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["u", "v", None]), i, rng.choice(["proposed", "applied", "dismissed", "dismissed"])) for i in range(300)]
    rows += [(7, "w", i, "dismissed" if i % 50 else rng.choice(["applied", "proposed"])) for i in range(300, 450)] + [(8, "u", 1, "dismissed")]
    df = spark.createDataFrame(rows, "doc_id long, unit_id string, sequence long, decision string")
    out = review.unit_summary(df)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()  # no unit is held as one array
    got = {(r["doc_id"], r["unit_id"]): (r["n_suggestions"], r["latest"], r["n_dismissed"]) for r in out.collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        mine = [r[2:] for r in rows if r[:2] == key]
        last = {d: max((s for s, x in mine if x == d), default=None) for d in ("applied", "proposed")}
        cut = None if None in last.values() else min(last.values())
        want[key] = (len(mine), max(s for s, _ in mine), sum(x == "dismissed" and (cut is None or s >= cut) for s, x in mine))
    assert got == want
