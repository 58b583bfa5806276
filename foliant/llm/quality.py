"""Quality scores from preference pairs: a Bradley-Terry model.

Every pair of a good and a bad labelled document is a comparison that the good one wins. The probability of
that is the logistic function of the difference of two linear scores, so the weights are learned by logistic
loss on feature differences. The cut between good and bad is the quantile of the labelled scores at the
labels' own share of bad documents; the reported score is a logistic function that is CUT_SCORE there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small, stored

#: Bounds of the fit: labelled documents, and pairs drawn from them.
SAMPLE_ROWS = 20_000
PAIRS = 60_000
SEED = 6
CUT_SCORE = 0.3

LETTERS = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SPACE = b"\t\n\x0b\x0c\r "
MARKS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
PLAIN_MARKS = b".,;:'\"()-"

FEATURES = [
    "log_words", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "once_words", "repeats_next",
    "letters", "upper", "digits", "marks", "odd_marks", "words_with_odd_mark", "words_with_digit", "upper_words", "title_words", "bars",
    "words_per_line", "repeated_lines", "short_lines", "lines_end_in_stop", "stops_per_word", "commas_per_word", "compressed", "distinct_pairs",
]


def features(text: bytes | None) -> list[float]:
    """Of a whole text; all 0 for null, empty and blank ones."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    part = lambda chars: (size - len(text.translate(None, chars))) / size
    joined = text.translate(None, bytes(c for c in range(256) if c not in SPACE and c not in MARKS) + PLAIN_MARKS)
    odd = sum(map(len, joined.split()))
    odd_words = len(joined.split())
    digit_words = sum(1 for w in counts.elements() if w.isdigit()) if part(DIGITS) else 0
    return [
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / n, max(counts.values()) / n,
        sum(1 for c in counts.values() if c == 1) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        part(LETTERS), part(UPPER), part(DIGITS), part(MARKS), odd / size, odd_words / n, digit_words / n,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n, sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        counts[b"|"] / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        sum(x[-1:] in b".!?" for x in lines) / len(lines), text.count(b".") / n, text.count(b",") / n,
        len(zlib.compress(text, 1)) / size, len(set(zip(words, words[1:], strict=False))) / n,
    ]


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def utility(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.center) / self.scale, -6, 6)
        return np.hstack([z, z * z]) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        at_cut = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.utility(rows) - self.cut) + at_cut, -40, 40)))


def _logistic(x: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights that make x @ w positive, by Newton steps on the logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (1 - p) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """rows: features of labelled documents; good: booleans. With one label only, all scores are alike."""
    width = len(FEATURES)
    if not len(rows) or good.all() or not good.any():
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), cut=0.0 if not len(rows) or good.all() else 1.0)
    model = Model(rows.mean(0), np.maximum(rows.std(0), 1e-9), np.zeros(2 * width))
    z = np.clip((rows - model.center) / model.scale, -6, 6)
    z = np.hstack([z, z * z])
    rng = np.random.default_rng(seed)
    winners, losers = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    model.weights = _logistic(z[winners] - z[losers], ridge=pairs / 2000)
    utility = model.utility(rows)
    model.cut = float(np.quantile(utility, 1 - good.mean()))
    signed = np.where(good, 1.0, -1.0)[:, None] * np.stack([utility - model.cut, np.ones(len(rows))], 1)
    model.slope = max(float(_logistic(signed, ridge=1.0)[0]), 0.05)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column("bytes")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("good")], ["features", "good"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about sample_rows labelled documents, chosen by a hash of the id; all of them if there are fewer.

    A document with unlike labels is left out, and of several texts with one id one counts, so neither repeated
    labels nor repeated documents enlarge the sample.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    known = known.filter("lo = hi").select("doc_id", (F.col("lo") == 1).alias("good"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    sample = stored(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample) if small(sample) else sample, "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("good").alias("good"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select(F.col("text").cast("binary").alias("bytes"), "good")
    table = rows.mapInArrow(_features, "features array<double>, good boolean").toArrow().to_pylist()
    table.sort(key=lambda r: (r["features"], r["good"]))  # the order of arrival must not matter
    return fit(np.array([r["features"] for r in table]).reshape(-1, len(FEATURES)), np.array([r["good"] for r in table], bool))


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(x.as_py()) for x in batch.column("bytes")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(rows), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs; null and empty texts score as texts without words.

    Whole texts of any length are scored, one by one: repeated rows each get a row, an empty table gives none, and
    texts with equal features tie. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    out = slim.mapInArrow(_scores(shared), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))
