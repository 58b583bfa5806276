"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of the normalised test items. Documents stream through it word by
word; at each word it knows the longest run ending there that some item contains. Where that run is at
least `window` words long, or holds a whole shorter item, its words are hit. Documents whose hit words pass
the coverage limit are contaminated.

Before streaming, a document is probed at every stride-th word for a short run ("anchor") of any item. The
stride is chosen so that every window covers an anchor position, so the probe loses nothing; documents
without any anchor hit need no streaming.

Test items are dealt into automata of about `max_words` words; an item that is longer is cut into pieces that
overlap by a window less a word. One automaton is in memory at a time, on the driver and in a worker: if there are
several, each has a pass of its own over the documents and leaves only the rows that it hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ROW, ascii_lower, packed, stored, with_row_key

#: Keeps 0-9, a-z and all bytes of non-ASCII characters, lower-cases A-Z, turns the rest into spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WINDOW = 13
#: Words of items in one automaton (about 1 kB of driver and worker memory each).
MAX_WORDS = 200_000
ANCHOR = 6


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WordAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of each item at its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: items whose window of full length is in a state; whole short items as (length, item)
        self.window_items: dict[int, set] = {}
        self.short_items: dict[int, set] = {}
        #: for each state, the state of its last `window` words, and the nearest one up with short items; 0 if none
        self.windowed = self._up(lambda s: self.length[self.link[s]] < window <= self.length[s])
        for item, words in items:
            self._enter(item, words)
        self.short = self._up(lambda s: s in self.short_items)
        self.least = min((min(window, len(w)) for _, w in items), default=0)
        self.anchor = min(ANCHOR, self.least)
        self.stride = self.least - self.anchor + 1
        self.anchors = {tuple(w[i : i + self.anchor]) for _, w in items for i in range(len(w) - self.anchor + 1)}

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def _up(self, test) -> list[int]:
        out = [0] * len(self.next)
        for s in sorted(range(1, len(out)), key=self.length.__getitem__):
            out[s] = s if test(s) else out[self.link[s]]
        return out

    def _enter(self, item: str | None, words: list[bytes]) -> None:
        state = 0
        for i, word in enumerate(words):
            state = self.next[state][word]
            if i + 1 >= self.window:
                self.window_items.setdefault(self.windowed[state], set()).add(item)
        if len(words) < self.window:
            self.short_items.setdefault(state, set()).add((len(words), item))

    def has_anchor(self, words: list[bytes]) -> bool:
        k, anchors = self.anchor, self.anchors
        return bool(anchors) and any(tuple(words[i : i + k]) in anchors for i in range(0, len(words) - k + 1, self.stride))

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans [start, end) of hit words, merged and in order, and the items with occurring windows."""
        nxt, link, length = self.next, self.link, self.length
        spans: list[list[int]] = []
        items: set = set()
        seen: set = set()
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            run = 0
            if matched >= self.window:
                run = self.window
                if (w := self.windowed[state]) not in seen:
                    seen.add(w)
                    items |= self.window_items[w]
            s = self.short[state]
            while s:
                for size, item in self.short_items[s]:
                    if size <= matched:
                        run = max(run, size)
                        items.add(item)
                s = self.short[link[s]]
            if run:
                start = i + 1 - run
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, items


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


SCHEMA = "n_words long, spans array<array<int>>, items array<string>"


def _scan(automaton):
    """Adds the hits of one automaton to a batch's n_words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: WordAutomaton = automaton.value
        for batch in batches:
            at = batch.schema.get_field_index
            n_words, all_spans, all_items = [], [], []
            for text, spans, items in zip(
                batch.column("bytes"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True
            ):
                words = words_of(text.as_py())
                if auto.has_anchor(words):
                    found, names = auto.hits(words)
                    spans = merge_spans(spans + found)
                    items = sorted({*items, *(x for x in names if x is not None)})
                n_words.append(len(words))
                all_spans.append(spans)
                all_items.append(items)
            out = list(batch.columns)
            out[at("n_words")] = pa.array(n_words, pa.int64())
            out[at("spans")] = pa.array(all_spans, pa.list_(pa.list_(pa.int32())))
            out[at("items")] = pa.array(all_items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return run


def item_pieces(items: DataFrame, window: int, max_words: int) -> tuple[DataFrame, int]:
    """A stored table of ids, words and grp, and the number of groups; a group has about max_words words.

    Equal texts are one item with several ids. Pieces of a longer item overlap so that each window is in one.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    texts = items.groupBy(words.alias("words")).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("nameless"))
    step = max_words - window + 1
    if step < 1:
        raise ValueError("max_words must be at least window")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - window, F.lit(0)) / step).cast("int"))
    pieces = texts.filter("size(words) > 0").select("ids", "nameless", "words", F.explode(starts).alias("k"))
    pieces = stored(pieces.select("ids", "nameless", F.slice("words", F.col("k") * step + 1, F.lit(max_words)).alias("words")), "pieces")
    n = -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // max_words)
    return pieces.withColumn("grp", F.pmod(F.xxhash64("words"), F.lit(max(n, 1)))), n


def automata(items: DataFrame, window: int, max_words: int) -> Iterator[WordAutomaton]:
    """The automata of all items, one after the other; each has less than twice max_words words."""
    pieces, n = item_pieces(items, window, max_words)
    for g in range(n):
        held, size = [], 0
        for r in sorted(pieces.filter(F.col("grp") == g).collect(), key=lambda r: r["words"]):
            words = [w.encode() for w in r["words"]]
            if size + len(words) > max_words and held:
                yield WordAutomaton(held, window)
                held, size = [], 0
            held += [(i, words) for i in sorted(r["ids"])] + ([(None, words)] if r["nameless"] else [])
            size += len(words)
        if held:
            yield WordAutomaton(held, window)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merge_spans([s for part in x for s in part]) for x in batch.column("spans").to_pylist()]
        names = [sorted({i for part in x for i in part}) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))], [ROW, "spans", "items"])


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, carry: tuple = ("doc_id",)) -> DataFrame:
    """carry columns, bytes, n_words, spans (word positions) and items (ids as strings, sorted) per row of docs."""
    nothing = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    rows = docs.select(*carry, F.col("text").cast("binary").alias("bytes"))
    share = docs.sparkSession.sparkContext.broadcast
    made = automata(items, window, max_words)
    first, second = next(made, None), next(made, None)
    if second is None:
        rows = rows.select("*", *nothing)
        return rows.mapInArrow(_scan(share(first or WordAutomaton([], window))), rows.schema)
    rows = with_row_key(rows)
    slim = rows.select(ROW, "bytes", *nothing)
    found = None
    for automaton in chain([first, second], made):
        shared = share(automaton)
        hits = stored(slim.mapInArrow(_scan(shared), slim.schema).filter("size(spans) > 0").select(ROW, "spans", "items"), "hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy(ROW).agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    found = stored(found.mapInArrow(_merged, f"{ROW} long, spans array<array<int>>, items array<string>"), "hits")
    n_words = F.coalesce(F.regexp_count(ascii_lower(F.col("bytes").cast("string")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    both = rows.join(found, ROW, "left")
    return both.select(
        *(c for c in rows.columns if c not in (ROW, "bytes")), "bytes", n_words.alias("n_words"),
        F.coalesce("spans", nothing[1]).alias("spans"), F.coalesce("items", nothing[2]).alias("items"),
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [sum(e - s for s, e in spans) for spans in batch.column("spans").to_pylist()]
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. A null text has no words, is clean and has the digest
    of the empty string. Items without words match nothing; several items with one id count once; an item
    without id is searched for, but not listed. Texts of any length stream through word by word. Repeated rows each
    get a row, an empty table gives none, and without items nothing is hit. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = match_items(docs, items, window, max_words).drop("bytes")
    found = found.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the contaminated rows; same columns, and no shuffle with one automaton.

    Each row is judged by itself, so repeated rows and rows without id stay or go alike; null texts stay. Columns
    of any name are carried; an empty table stays empty.
    """
    found = match_items(docs, items, window, max_words, carry=(packed(docs.drop("text")).alias("rest"),))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    kept = found.filter(~((hit > 0) & (20 * hit >= F.col("n_words"))))
    return kept.select(
        *(F.col("bytes").cast("string").alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns)
    )


def cut_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, text, n_cut: the texts with hit words taken out, from the first to the last byte of each span."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            texts, counts = [], []
            for text, spans in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans:
                    at = [m.span() for m in word.finditer(text)]
                    for start, end in reversed(spans):
                        text = text[: at[start][0]] + text[at[end - 1][1] :]
                texts.append(None if text is None else text.decode())
                counts.append(sum(e - s for s, e in spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return match_items(docs, items, window, max_words).mapInArrow(cut, f"doc_id {kind}, text string, n_cut long")
