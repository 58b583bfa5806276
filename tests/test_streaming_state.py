"""Decisions by keyed state against the replay of the whole log, over restarts, late actions and forgotten units."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.operators import review
from foliant.streaming import suggestions

LOG = "doc_id long, unit_id string, suggestion_id string, at long, action string, ts timestamp"


def stream(spark, path):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)


def add(spark, path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def test_equals_replay_over_restarts(spark, tmp_path):
    rng, rows = random.Random(3), []
    for at in range(600):
        action = rng.choices(["propose", "apply", "dismiss", "delete", None], [5, 4, 2, 1, 0.2])[0]
        rows.append((rng.choice([1, 2, None]), f"u{rng.randrange(3)}", f"s{rng.randrange(6)}", at, action, datetime(2024, 1, 1) + timedelta(minutes=at)))
    path, out = str(tmp_path / "log"), str(tmp_path / "run")
    changed = None
    for lo, hi in ((0, 100), (100, 101), (101, 600)):
        for k in range(lo, hi, 250):
            part = rows[k : min(k + 250, hi)]
            rng.shuffle(part)
            add(spark, path, part)
        changed = suggestions.follow(stream(spark, path), out)
    assert suggestions.follow(stream(spark, path), out).count() == changed.count()
    got = sorted(map(repr, suggestions.standing(changed).filter("doc_id IS NOT NULL").collect()))
    log = spark.createDataFrame([r for r in rows if r[4] and r[0]], LOG)
    want = review.replayed(log.drop("ts"))
    assert got == sorted(map(repr, want.collect())) and len(got) > 10
    lost = changed.filter("decision = 'unknown_suggestion' AND doc_id IS NOT NULL").select("doc_id", "unit_id", "suggestion_id", "at")
    errors = review.action_errors(log.drop("ts")).filter("action <> 'propose'").select("doc_id", "unit_id", "suggestion_id", "at")
    assert sorted(lost.filter(F.col("at").isin([r[3] for r in rows if r[4] != "propose"])).collect()) == sorted(errors.collect())


def test_late_and_forgotten(spark, tmp_path):
    path, out, start = str(tmp_path / "log"), str(tmp_path / "run"), datetime(2024, 1, 1)
    day = lambda d: start + timedelta(days=d)
    add(spark, path, [(1, "u", "a", 10, "propose", day(0)), (1, "u", "a", 11, "apply", day(0))])
    add(spark, path, [(1, "u", "a", 5, "dismiss", day(1)), (1, "u", "b", 12, "propose", day(1)), (1, "u", "b", 13, "apply", day(1))])
    add(spark, path, [(2, "u", "x", 20, "propose", day(60))])
    add(spark, path, [(2, "u", "x", 21, "apply", day(61))])  # the watermark has passed: unit 1 goes
    add(spark, path, [(1, "u", "b", 22, "dismiss", day(62))])
    changed = suggestions.follow(stream(spark, path), out, idle="30 days")
    rows = sorted((r["doc_id"], r["at"], r["suggestion_id"] or "", r["decision"]) for r in changed.collect())
    assert rows == [
        (1, 5, "a", "late"), (1, 10, "a", "proposed"), (1, 11, "a", "applied"), (1, 12, "b", "proposed"), (1, 13, "", "expired"), (1, 13, "a", "dismissed"), (1, 13, "b", "applied"),
        (1, 22, "b", "unknown_suggestion"), (2, 20, "x", "proposed"), (2, 21, "x", "applied"),
    ]
