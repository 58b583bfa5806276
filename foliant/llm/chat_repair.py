"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of an automaton over roles: an optional system message, then user and assistant
in turn, ending with the assistant. Each turn may be kept, relabelled, or merged into the message before it;
empty messages may be inserted. Dynamic programming finds the cheapest combination, which is then rendered.
A text cannot forge a marker: rendering puts a backslash after the "<" of every "<|" in it, and one more where
backslashes stand between the two, so taking one out again gives the text.

The state between turns is the role of the last message, so the cheapest ways through a stretch of turns are a
small matrix, and stretches combine by min-plus products. The turns are dealt by ranges of their whole order, with
a row number last, so that neither a large conversation nor a repeated turn number is one group; runs of a
conversation inside a range are cut into chunks of at most `chunk` rows and about CHUNK_BYTES. Each chunk becomes
a matrix, a conversation's matrices give the states at the cuts, and each chunk is then decoded by itself. What is
held for a whole conversation is sixteen numbers for each chunk. Rendered pieces are joined up to about `joined`
bytes; a longer conversation is given in several rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stored

ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
END = (ASSISTANT,)
MERGE, RELABEL, INSERT = 1, 2, 3
CHUNK = 512
CHUNK_BYTES = 1 << 22
#: Of a conversation's rendered text, one value holds about so many bytes, and one chunk more at most.
JOINED_BYTES = 1 << 26
#: Characters of a text that turns with equal number and role are ordered by; then its hash.
PREFIX = 200
FAR = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """For (state, role): the shortest run of inserted roles after which the role is legal."""
    out: dict = {}
    for state in range(4):
        todo = [(state, ())]
        while todo:
            at, path = todo.pop(0)
            for role in NEXT[at]:
                if (state, role) not in out:
                    out[state, role] = path
                    todo.append((role, (*path, role)))
    return out


BEFORE = _paths()
#: For a last state: the inserted roles that end the conversation.
AFTER = {s: () if s in END else min(((*BEFORE[s, e], e) for e in END if (s, e) in BEFORE), key=len) for s in range(4)}


def moves(state: int, role: int | None) -> list[tuple[int, int, tuple]]:
    """(cost, next state, move) of a turn; a move is (inserted roles or None for a merge, role of the message)."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        if (state, to) in BEFORE:
            path = BEFORE[state, to]
            out.append((INSERT * len(path) + (RELABEL if role != to else 0), to, (path, to)))
    if state != START:
        out.append((MERGE + (RELABEL if role != state else 0), state, (None, state)))
    return out


MOVES = {(s, r): moves(s, r) for s, r in product(range(4), (None, SYSTEM, USER, ASSISTANT))}


def role_number(name: str | None) -> int | None:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


def matrix(roles: list[int | None]) -> list[int]:
    """Sixteen costs: the cheapest way from each state to each through the turns."""
    out = []
    for first in range(4):
        cost = [FAR] * 4
        cost[first] = 0
        for role in roles:
            new = [FAR] * 4
            for state in range(4):
                if cost[state] < FAR:
                    for c, to, _ in MOVES[state, role]:
                        new[to] = min(new[to], cost[state] + c)
            cost = new
        out += cost
    return out


def ends(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """The states at the start and end of each stretch of a cheapest whole repair; ties go to the lowest state."""
    cost, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        best = [min((cost[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
        cost = [b[0] for b in best]
        back.append([b[1] for b in best])
    state = min(range(4), key=lambda s: (cost[s] + INSERT * len(AFTER[s]) if s != START else FAR, s))
    out = []
    for b in reversed(back):
        out.append((b[state], state))
        state = b[state]
    return out[::-1]


def decode(roles: list[int | None], first: int, last: int) -> list[tuple]:
    """The moves of a cheapest way from first to last through the turns."""
    tail = [[FAR] * 4 for _ in range(len(roles) + 1)]
    tail[-1][last] = 0
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            tail[i][s] = min(c + tail[i + 1][to] for c, to, _ in MOVES[s, roles[i]])
    out, state = [], first
    for i, role in enumerate(roles):
        _, state, move = min(((c + tail[i + 1][to], to, m) for c, to, m in MOVES[state, role]), key=lambda x: x[0])
        out.append(move)
    return out


def _open(role: int, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{ROLES[role - 1]}|>\n"


def escaped(text: str | None) -> str:
    """text with no marker in it: "<", any backslashes and "|" get one backslash more after the "<"."""
    return re.sub(r"<(?=\\*\|)", r"<\\", text or "")


def render(turns: list[tuple[str | None, str | None]], first: int, last: int, final: bool) -> tuple[str, int, int, int, int]:
    """A chunk's text, and its messages, merges, relabels and insertions."""
    roles = [role_number(r) for r, _ in turns]
    parts: list[str] = []
    messages = merged = relabelled = inserted = 0
    opened = first != START
    for (_, text), role, (path, to) in zip(turns, roles, decode(roles, first, last), strict=True):
        relabelled += role != to
        if path is None:
            merged += 1
            parts.append("\n" + escaped(text))
            continue
        for r in (*path, to):
            parts.append(_open(r, not opened))
            opened = True
        inserted += len(path)
        messages += len(path) + 1
        parts.append(escaped(text))
    if final:
        for r in AFTER[last]:
            parts.append(_open(r, False))
        inserted += len(AFTER[last])
        messages += len(AFTER[last])
        parts.append("<|end|>\n")
    return "".join(parts), messages, merged, relabelled, inserted


def _chunks(chunk: int, chunk_bytes: int):
    """Cuts an ordered partition's turns into chunks: conv_id, part, n_bytes, costs, turns. part goes up with the order."""
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        conv = top = None
        size = seq = 0

        def made(kind: pa.DataType) -> pa.RecordBatch:
            costs = [matrix([role_number(t["role"]) for t in held])]
            arrays = [pa.array([conv], kind), pa.array([(top << 33) + seq], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(costs, pa.list_(pa.int64())), pa.array([held], pa.list_(turn))], ["conv_id", "part", "n_bytes", "costs", "turns"]
            )

        kind, done = None, []
        for batch in batches:
            kind = batch.column("conv_id").type
            columns = (batch.column(c) for c in ("conv_id", "role", "text", "size", "range"))
            for c, role, text, n, at in zip(*columns, strict=True):
                c, n, top = c.as_py(), n.as_py(), at.as_py()
                if held and (c != conv or len(held) >= chunk or size + n > chunk_bytes):
                    done.append(made(kind))
                    held, size, seq = [], 0, seq + 1
                    if len(done) >= 500 or sum(x.nbytes for x in done[-1:]) > chunk_bytes // 2:
                        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                        done = []
                conv = c
                held.append({"role": role.as_py(), "text": text.as_py()})
                size += n
        if held:
            done.append(made(kind))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    return run


def _ends(joined: int):
    """The states at each chunk's ends, whether it is the last, and the output row that its text goes to."""
    kind = pa.list_(pa.struct([("part", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("final", pa.bool_()), ("piece", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("parts").to_pylist():
                found, piece, size = [], 0, 0
                for k, (p, (a, b)) in enumerate(zip(x, ends([p["costs"] for p in x]), strict=True)):
                    if size and size + p["n_bytes"] > joined:
                        piece, size = piece + 1, 0
                    size += p["n_bytes"]
                    found.append({"part": p["part"], "first": a, "last": b, "final": k == len(x) - 1, "piece": piece})
                rows.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["ends"])

    return run


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["conv_id", "piece", "part"]
    for batch in batches:
        for k in range(batch.num_rows):  # one chunk at a time bounds the memory
            r = batch.slice(k, 1).select(["turns", "first", "last", "final"]).to_pylist()[0]
            text, *counts = render([(t["role"], t["text"]) for t in r["turns"]], r["first"], r["last"], r["final"])
            arrays = [pa.array([len(r["turns"])], pa.int64()), pa.array([text], pa.string()), *(pa.array([c], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in keep), *arrays], [*keep, "n", "text", "messages", "merged", "relabelled", "inserted"])


def repair_chats(turns: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES, joined: int = JOINED_BYTES) -> DataFrame:
    """conv_id, part, n_turns, n_messages, n_merged, n_relabelled, n_inserted, cost, rendered.

    One row per conv_id, with part 0. Only a conversation of over about joined bytes has more rows, with part 0, 1
    and so on: rendered is then a piece of its text, to be put together in that order, and counts and cost are those
    of the piece, to be added up.

    Turns go by number, then role, then by the text's first PREFIX characters and its hash; those without a number
    come last. Repeated rows are turns of their own. A role that is null or unknown fits nothing and is relabelled
    or merged; a null text is empty; markers in a text are escaped, see the module. Rows without conv_id are one conversation. An empty table gives an empty
    result; other columns are ignored.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    slim = turns.select(
        "conv_id", F.col("turn").isNull().alias("none"), "turn", "role", "text", F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("hash"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "none", "turn", "role", "prefix", "hash", "row"]
    ranges = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "role", "text", "size", F.spark_partition_id().cast("long").alias("range"))
    made = dealt.mapInArrow(_chunks(chunk, chunk_bytes), f"conv_id {kind}, part long, n_bytes long, costs array<long>, turns array<struct<role:string,text:string>>")
    chunks = stored(made, "chunks")
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n_bytes", "costs"))).alias("parts")).select("parts")
    cuts = whole.mapInArrow(_ends(joined), "ends array<struct<part:long,first:int,last:int,final:boolean,piece:int>>").select(F.inline("ends"))
    both = chunks.join(cuts, "part").select("conv_id", "piece", "part", "turns", "first", "last", "final")
    done = both.mapInArrow(_rendered, f"conv_id {kind}, piece int, part long, n long, text string, messages long, merged long, relabelled long, inserted long")
    texts = F.sort_array(F.collect_list(F.struct("part", "text")))
    out = done.groupBy("conv_id", "piece").agg(
        F.sum("n").alias("n_turns"), F.sum("messages").alias("n_messages"), F.sum("merged").alias("n_merged"),
        F.sum("relabelled").alias("n_relabelled"), F.sum("inserted").alias("n_inserted"), texts.alias("texts"),
    )
    cost = MERGE * F.col("n_merged") + RELABEL * F.col("n_relabelled") + INSERT * F.col("n_inserted")
    counts = ["n_turns", "n_messages", "n_merged", "n_relabelled", "n_inserted"]
    return out.select("conv_id", F.col("piece").alias("part"), *counts, cost.alias("cost"), F.array_join(F.col("texts.text"), "").alias("rendered"))
