"""Text diffs: shortest edit scripts by lines, refined by characters, with a memory budget.

Python gets only the pairs that differ; equal texts are answered by an expression. When several shortest
scripts exist, a deletion is taken before an insertion where both reach as far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

TRACE_BYTES = 64 << 20
REFINE_CHARS = 8000
#: Sequences up to this length are compared by bit rows: 8 MB at most.
BIT_SIZE = 8192
EQUAL, INSERT, DELETE = "unchanged", "insert", "delete"
SPANS = "array<struct<type:string,text:string>>"


def by_affixes(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """Common start, deletion, insertion, common end, as (kind, from, to) over a or b."""
    start, n, m = 0, len(a), len(b)
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    return [x for x in ((EQUAL, 0, start), (DELETE, start, n), (INSERT, start, m), (EQUAL, n, len(a))) if x[1] < x[2]]


def _numbered(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    numbers: dict = {}
    return tuple(np.array([numbers.setdefault(v, len(numbers)) for v in x], np.int64) for x in (a, b))


def _least_edits(left: np.ndarray, right: np.ndarray) -> int:
    """A lower bound of the edits: one changes at most 2q - 1 of the counts of runs of q elements."""
    best = abs(len(left) - len(right))
    base = np.int64(max(left.max(initial=0), right.max(initial=0)) + 1)
    a, b = left, right
    for q in range(1, 5):
        if q > 1:
            if len(left) < q or len(right) < q or float(base) ** q >= 2.0**62:
                break
            a, b = a[: len(left) - q + 1] * base + left[q - 1 :], b[: len(right) - q + 1] * base + right[q - 1 :]
        values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts = np.bincount(inverse[: len(a)], minlength=len(values)) - np.bincount(inverse[len(a) :], minlength=len(values))
        best = max(best, -(-int(np.abs(counts).sum()) // (2 * q - 1)))
    return best


def shortest(a: Sequence, b: Sequence, budget: int = TRACE_BYTES) -> tuple[list[tuple[str, int, int]], str | None]:
    """Edits (kind, from, to), and why a plainer answer was given, if so. What both begin with is one entry, all else one element each.

    The budget counts the furthest points of all diagonals in every round of Myers' search: four bytes for each diagonal there
    could be. Up to BIT_SIZE elements, the same edits are read from bit rows, without rounds.
    """
    n, m = len(a), len(b)
    if not n + m:
        return [], None
    cost = 4 * (2 * (n + m) + 1)
    if cost > budget:
        return by_affixes(a, b), "trace_budget_exceeded"
    start = common(a, b)
    rest = (_by_bits if max(n, m) - start <= BIT_SIZE else _by_rounds)(a[start:], b[start:], cost, budget)
    if rest is None:
        return by_affixes(a, b), "trace_growth_budget_exceeded"
    return [(EQUAL, 0, start)] * (start > 0) + [(kind, i + start, j + start) for kind, i, j in rest], None


def common(a: Sequence, b: Sequence) -> int:
    """How long the common start is."""
    start, end = 0, min(len(a), len(b))
    while start < end:
        middle = (start + end + 1) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle - 1
    return start


def _by_bits(a: Sequence, b: Sequence, cost: int, budget: int) -> list[tuple[str, int, int]] | None:
    """The edits by rows of bits: a place of b is 0 in the row of a start of a where the longest common subsequence grows.

    Read from the end, an insertion goes before a deletion and that before a kept element, which is what comes of the furthest
    points of the rounds. None where the rounds would exceed the budget.
    """
    places: dict = {}
    for j, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    rows = [row]
    for v in a:
        at = row & places.get(v, 0)
        row = ((row + at) | (row - at)) & full
        rows.append(row)
    edits = len(a) - len(b) + 2 * row.bit_count()
    if cost * (edits + 1) > budget:
        return None
    x, y, out = len(a), len(b), []
    while x or y:
        if y and rows[x] >> y - 1 & 1:
            y -= 1
            out.append((INSERT, y, y + 1))
        else:
            x -= 1
            if y and rows[x] >> y - 1 & 1:
                y -= 1
                out.append((EQUAL, x, x + 1))
            else:
                out.append((DELETE, x, x + 1))
    return out[::-1]


def _by_rounds(a: Sequence, b: Sequence, cost: int, budget: int) -> list[tuple[str, int, int]] | None:
    """The edits by Myers' rounds, which store reached diagonals only; None where they exceed the budget."""
    n, m = len(a), len(b)
    left, right = _numbered(a, b)
    if _least_edits(left, right) >= budget // cost:  # the round that exceeds the budget comes before the last
        return None
    at = n + m + 1  # where diagonal 0 is
    reach, rounds = np.zeros(2 * at + 1, np.int64), []
    for d in range(n + m + 1):
        k = np.arange(-d, d + 1, 2)
        less, more = reach[at + k - 1], reach[at + k + 1]
        x = np.where((k == -d) | ((k != d) & (less < more)), more, less + 1)
        y = x - k
        on = np.flatnonzero((x < n) & (y < m))
        while len(on):
            on = on[left[x[on]] == right[y[on]]]
            x[on] += 1
            y[on] += 1
            on = on[(x[on] < n) & (y[on] < m)]
        reach[at + k] = x
        if cost * (d + 1) > budget:
            return None
        if ((x >= n) & (y >= m)).any():
            break
        rounds.append(reach[at - d - 2 : at + d + 3].copy())
    x, y, out = n, m, []
    for d in range(len(rounds), 0, -1):
        before, k, zero = rounds[d - 1], x - y, d + 1
        insert = k == -d or (k != d and before[zero + k - 1] < before[zero + k + 1])
        k = k + 1 if insert else k - 1
        px = int(before[zero + k])
        while x > px and y > px - k:
            x, y = x - 1, y - 1
            out.append((EQUAL, x, x + 1))
        out.append((INSERT, px - k, px - k + 1) if x == px else (DELETE, px, px + 1))
        x, y = px, px - k
    out += [(EQUAL, i, i + 1) for i in range(x - 1, -1, -1)]
    return out[::-1]


def lines_of(text: str) -> list[str]:
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text) or [""]


def _add(spans: list[list[str]], kind: str, text: str) -> None:
    if text:
        if spans and spans[-1][0] == kind:
            spans[-1][1] += text
        else:
            spans.append([kind, text])


def diff_chars(before: str, after: str, budget: int = TRACE_BYTES) -> tuple[list[list[str]], str | None]:
    edits, reason = shortest(before, after, budget)
    spans: list[list[str]] = []
    for kind, own in groupby(edits, lambda e: e[0]):
        places = list(own)
        spans.append([kind, (after if kind == INSERT else before)[places[0][1] : places[-1][2]]])
    return spans, reason


def diff_texts(before: str, after: str, budget: int = TRACE_BYTES) -> tuple[list[list[str]], str | None]:
    """Spans [kind, text] and the reason of a plainer answer. Changed lines of up to 8,000 characters are refined."""
    if before == after:
        return [[EQUAL, after]], None
    a, b = lines_of(before), lines_of(after)
    edits, reason = shortest(a, b, budget)
    spans: list[list[str]] = []
    gone = came = ""

    def settle() -> None:
        nonlocal gone, came, reason
        if gone and came and len(gone) + len(came) <= REFINE_CHARS:
            fine, why = diff_chars(gone, came, budget)
            reason = reason or why
            for kind, text in fine:
                _add(spans, kind, text)
        else:
            _add(spans, DELETE, gone)
            _add(spans, INSERT, came)
        gone = came = ""

    for kind, i, j in edits:
        if kind == EQUAL:
            settle()
            _add(spans, EQUAL, "".join(a[i:j]))
        elif kind == DELETE:
            gone += "".join(a[i:j])
        else:
            came += "".join(b[i:j])
    settle()
    return spans, reason


def _diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, reasons = [], []
        for before, after in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True):
            found, reason = diff_texts(before or "", after or "")
            spans.append([{"type": k, "text": x} for k, x in found])
            reasons.append(reason)
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind), pa.array(reasons, pa.string())], ["key", "spans", "degraded_reason"])


def with_diffs(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with spans and degraded_reason. Null texts count as empty.

    Pairs that differ are dealt anew by their texts' hash, as a diff costs far more than a shuffled pair and the pairs
    of a join may stand in a few partitions.
    """
    both = pairs.select(F.struct("*").alias("key"), F.coalesce(before, F.lit("")).alias("before"), F.coalesce(after, F.lit("")).alias("after"))
    same, other = both.filter("before = after"), both.filter("before <> after")
    equal = F.array(F.named_struct(F.lit("type"), F.lit(EQUAL), F.lit("text"), F.col("after")))
    same = same.select("key", equal.alias("spans"), F.lit(None).cast("string").alias("degraded_reason"))
    kind = both.schema["key"].dataType.simpleString()
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = other.repartition(parts, F.xxhash64("before", "after")).mapInArrow(_diffs, f"key {kind}, spans {SPANS}, degraded_reason string")
    return same.union(other).select("key.*", "spans", "degraded_reason")


def affix_spans(before: Column, after: Column) -> Column:
    """The diff by common start and end, as an expression."""
    def chars(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))

    def common(x: Column, y: Column) -> Column:
        """How long the common start of two arrays is."""
        size = F.least(F.size(x), F.size(y))
        return t.let(F.array_position(F.zip_with(F.slice(x, F.lit(1), size), F.slice(y, F.lit(1), size), lambda a, b: a != b), True), lambda p: F.when(p > 0, p - 1).otherwise(size).cast("int"))

    def spans(x: Column, y: Column, start: Column, end: Column) -> Column:
        n, m = F.size(x), F.size(y)
        part = lambda kind, z, i, j: F.named_struct(F.lit("type"), F.lit(kind), F.lit("text"), F.array_join(F.slice(z, i + 1, j - i), ""))
        every = F.array(part(EQUAL, x, F.lit(0), start), part(DELETE, x, start, n - end), part(INSERT, y, start, m - end), part(EQUAL, x, n - end, n))
        return F.filter(every, lambda s: s["text"] != "")

    def ends(x: Column, y: Column, start: Column) -> Column:
        rest = lambda z: F.reverse(F.slice(z, start + 1, F.size(z) - start))
        return t.let(common(rest(x), rest(y)), lambda end: spans(x, y, start, end))

    return t.let(chars(before), lambda x: t.let(chars(after), lambda y: t.let(common(x, y), lambda start: ends(x, y, start))))


def diff_stats(spans: Column) -> Column:
    """Struct (inserted, deleted): characters that are not white space."""
    total = lambda kind: F.aggregate(spans, F.lit(0), lambda a, s: a + F.when(s["type"] == kind, F.length(F.regexp_replace(s["text"], r"(?U)\s+", ""))).otherwise(0))
    return F.named_struct(F.lit("inserted"), total(INSERT), F.lit("deleted"), total(DELETE))
