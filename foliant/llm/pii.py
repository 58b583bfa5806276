"""Personal data: base patterns, and further candidates chosen by boosted trees.

Base patterns find plain addresses and numbers. What they cannot see is the same data in another dress:
spelled-out or bracketed addresses, phone numbers without a plus, cards and IP numbers with other separators.
One generator for each kind proposes such spans with high recall, and so also much that is no personal data: dates,
counts, versions, prose with "at". Trees score each candidate by its format and its context.

Nobody labels such spans, so the labels are made: every confirmed base span is rewritten in the forms of its kind
and, with its own context, is a positive; what the generators find in the texts away from base spans is taken
as negative. Features never tell whether a base pattern would match. A real but unconfirmed span among the
negatives makes the trees and the thresholds more careful, never less: the precision at a threshold is a lower bound.
All texts count, copies of one text once. The trees are fitted on the candidates of all texts. Each kind has a
threshold of its own, calibrated on all of them too: each half of the texts is scored by trees that were fitted on the
other half. A kind without enough confirmed spans is left to its base pattern.

Only DataFrame operations. For the fit, the features of the candidates are shuffled, never a text, and equal ones become
one weighted row. For the result every text is one row from first to last: the candidates are arrays in the row, the
trees are expressions over them, and nothing is exploded, joined or shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import boosting
from foliant.llm.common import let, stored

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, written so that Java's engine needs no backtracking: a match can only start
# where the last one ended or at the start of a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

_AT = r"(?: ?[(\[{<] ?(?:at|AT|@) ?[)\]}>] ?| (?:at|AT|@) )"
_DOT = r"(?: ?[(\[{<] ?(?:dot|DOT|\.) ?[)\]}>] ?| (?:dot|DOT) |\.)"
_POINT = r"(?: ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?| (?:dot|DOT|\.) )"
#: The generators: kind, hint, pattern.
GENERATORS = {
    "email": (rf"{_AT}[A-Za-z0-9-]++{_DOT}[A-Za-z0-9]", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    "ip": (rf"[0-9]{_POINT}[0-9]", rf"(?<![0-9.])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    "card": (r"[0-9](?:[ ._/–-]{0,3}[0-9]){12}", r"(?<![0-9A-Za-z+])[0-9](?:[ ._/–-]{0,3}[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": (r"[0-9][0-9 ().-]{7,}[0-9]", r"(?<![0-9A-Za-z+,/:-])(?<!\+ )(?<!\+\()\(?[0-9][0-9 ().-]{7,}[0-9](?![0-9A-Za-z])"),
}
#: Rows of unlike candidates in a partition of the fit.
FIT_ROWS = 50_000
PRECISION = 0.95
LEAST_SUPPORT = 20
LEAST_THRESHOLD = 0.5
CONTEXT = 16
#: Matches of one text are placed in blocks of so many, so that no array is copied at every match.
BLOCK = 64

FEATURES = [
    "kind", "length", "digits", "letters", "groups", "longest_group", "shortest_group", "joints", "wide_joints", "bracketed", "spelled", "last_letters", "luhn",
    "after_letter", "after_space", "before_letter", "before_space", "word_mail", "word_call", "word_card", "word_net",
]

SPAN = "struct<start:int,end:int,text:string,left:string,right:string>"


def _struct(**fields: Column) -> Column:
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def find(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of all leftmost non-overlapping matches: start and end in code points, end exclusive, text, and its context.

    left is the end of what stands between the match and the one before, right the character after it.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def pieces(g: Column, h: Column) -> Column:
        return F.transform(h, lambda x, i: _struct(gap=F.get(g, i), hit=x, right=F.substr(F.get(g, i + 1), F.lit(1), F.lit(1))))

    def placed(p: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda c: let(F.slice(p, c * BLOCK + 1, F.lit(BLOCK)), block))
        start = _struct(at=F.lit(0), out=F.array().cast(f"array<array<{SPAN}>>"))
        shifted = lambda s, by: _struct(start=s["start"] + by, end=s["end"] + by, text=s["text"], left=s["left"], right=s["right"])
        add = lambda a, b: _struct(at=a["at"] + b["size"], out=F.concat(a["out"], F.array(F.transform(b["spans"], lambda s: shifted(s, a["at"])))))
        return F.when(F.size(p) > 0, F.flatten(F.aggregate(blocks, start, add, lambda a: a["out"]))).otherwise(none)

    def block(b: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            at = a["at"] + F.length(x["gap"])
            end = at + F.length(x["hit"])
            span = _struct(start=at, end=end, text=x["hit"], left=F.right(x["gap"], F.lit(CONTEXT)), right=x["right"])
            return _struct(at=end, out=F.concat(a["out"], F.array(span)))

        return F.aggregate(b, _struct(at=F.lit(0), out=none), step, lambda a: _struct(size=a["at"], spans=a["out"]))

    found = let(gaps, lambda g: let(hits, lambda h: let(pieces(g, h), placed)))
    return F.when(text.rlike(hint), found).otherwise(none) if hint else found


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(text, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def proposable(kind: str, text: Column) -> Column:
    """Whether a generator's match is a candidate at all."""
    if kind == "ip":
        return F.forall(F.split(text, "[^0-9]+"), lambda p: (p == "") | (p.cast("int") <= 255))
    if kind == "phone":
        return F.length(F.regexp_replace(_digits(text), "^00", "")).between(9, 15)
    return F.lit(True)


def disguises(kind: str, text: Column) -> Column:
    """Array of the forms in which a confirmed span of the kind may also be written."""
    if kind == "email":
        user, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
        ways = [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" [at] ", "."), (" AT ", " DOT ")]
        return F.array(*(F.concat(user, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in ways))
    if kind == "ip":
        return F.array(*(F.replace(text, F.lit("."), F.lit(x)) for x in ("[.]", "(.)", " . ", " dot ", "[dot]", " (dot) ")))
    if kind == "card":
        return F.array(*(F.regexp_replace(_digits(text), "([0-9]{4})(?=[0-9])", f"$1{x}") for x in (".", "/", "_", "  ", " - ", "–")))
    bare = F.substr(text, F.lit(2))
    respaced = [F.regexp_replace(bare, "[ ().-]+", x) for x in ("-", " ", ".", "")]
    return F.array(bare, F.concat(F.lit("00"), bare), F.concat(F.lit("00 "), bare), *respaced)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with an array base_<kind> of the valid pattern matches of each kind."""
    return docs.withColumns({f"base_{k}": F.filter(find(F.col("text"), PATTERNS[k], HINTS[k]), lambda s: valid(k, s["text"])) for k in KINDS})


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _on_base(s: Column) -> Column:
    """Whether a span overlaps any base span of its row."""
    out = F.lit(False)
    for k in KINDS:
        out = out | F.exists(f"base_{k}", lambda b: _overlaps(s, b))
    return out


def described(kind: str, s: Column, body: Column | None = None) -> Column:
    """A candidate with its features; body stands in for its text."""
    body = s["text"] if body is None else body
    left, right = F.lower(s["left"]), s["right"]
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    digit_runs = F.filter(F.transform(F.split(body, "[^0-9]+"), lambda g: F.length(g)), lambda n: n > 0)
    values = {
        "kind": F.lit(float(KINDS.index(kind))),
        "length": F.length(body).cast("double"),
        "digits": count(body, "[0-9]"),
        "letters": count(body, "[A-Za-z]"),
        "groups": count(body, "[0-9]+"),
        "longest_group": F.coalesce(F.array_max(digit_runs), F.lit(0)).cast("double"),
        "shortest_group": F.coalesce(F.array_min(digit_runs), F.lit(0)).cast("double"),
        "joints": count(body, "[^0-9A-Za-z]+"),
        "wide_joints": count(body, "[^0-9A-Za-z]{2,}"),
        "bracketed": count(body, r"[(\[{<]"),
        "spelled": count(body, r"(?i)\b(?:at|dot)\b"),
        "last_letters": F.length(F.regexp_extract(body, r"([A-Za-z]*)\z", 1)).cast("double"),
        "luhn": F.when(F.length(_digits(body)).between(13, 19), luhn(_digits(body)).cast("double")).otherwise(0.0) if kind == "card" else F.lit(0.0),
        "after_letter": left.rlike(r"[a-z]\z").cast("double"),
        "after_space": left.rlike(r"(?:^|\s)\z").cast("double"),
        "before_letter": right.rlike("^[A-Za-z]").cast("double"),
        "before_space": right.rlike(r"^(?:\s|\z)").cast("double"),
        "word_mail": left.rlike("mail|contact|write").cast("double"),
        "word_call": left.rlike("tel|phone|call|fax|mobil").cast("double"),
        "word_card": left.rlike("card|visa|account|iban|pay").cast("double"),
        "word_net": left.rlike(r"\bip|host|server|addr").cast("double"),
    }
    return _struct(start=s["start"], end=s["end"], **{name: F.coalesce(value, F.lit(0.0)) for name, value in values.items()})


def candidates(kind: str) -> Column:
    """Array of the spans that the kind's generator proposes in text."""
    hint, pattern = GENERATORS[kind]
    return F.filter(find(F.col("text"), pattern, hint), lambda s: proposable(kind, s["text"]))


class Chooser:
    """Trees, and a threshold for each kind, fitted on the candidates of all texts."""

    def __init__(self, docs: DataFrame, precision: float = PRECISION):
        texts = with_spans(docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), "text"))
        # an outer explode: a plain one would add a filter that works all candidates out a second time
        rows = texts.select("key", F.posexplode_outer(self._labelled()).alias("place", "c")).filter("c IS NOT NULL")
        # copies of a text say nothing new, and one text may be a third of all rows
        rows = rows.select("key", "place", F.col("c.label").alias("label"), *(F.col(f"c.c.{f}").alias(f) for f in FEATURES)).distinct()
        half = F.pmod(F.shiftrightunsigned("key", 32), F.lit(2)).alias("half")
        rows = stored(rows.groupBy(half, "label", *FEATURES).agg(F.count("*").alias("n")), "candidates")
        parts = max(2, -(-rows.count() // FIT_ROWS))
        fit = lambda chosen: boosting.fit(chosen, FEATURES, weight="n", parts=parts)
        self.trees = fit(rows.groupBy("label", *FEATURES).agg(F.sum("n").alias("n")))
        self.thresholds = self._calibrated(rows, [fit(rows.filter(F.col("half") != h)) for h in (0, 1)] if self.trees else [], precision)

    @staticmethod
    def _labelled() -> Column:
        """Array of (label, candidate): the confirmed spans in other forms, and what the generators find elsewhere."""
        out = []
        for k in KINDS:
            positive = F.flatten(F.transform(f"base_{k}", lambda s: F.transform(disguises(k, s["text"]), lambda x: _struct(label=F.lit(1), c=described(k, s, x)))))
            elsewhere = F.filter(candidates(k), lambda s: ~_on_base(s))
            out += [positive, F.transform(elsewhere, lambda s: _struct(label=F.lit(0), c=described(k, s)))]
        return F.concat(*out)

    @staticmethod
    def _calibrated(rows: DataFrame, others: list[list], precision: float) -> dict[str, float]:
        """For each kind the least hundredth from which up the candidates have the precision.

        others: for each half, trees fitted on the other one. Kinds without such a hundredth, or with too few positives, are left out.
        """
        # a half is not scored where the other one has a single label
        halves = [rows.filter(F.col("half") == h).withColumn("score", boosting.probability(t, {f: F.col(f) for f in FEATURES})) for h, t in enumerate(others) if t]
        if not halves:
            return {}
        scored = functools.reduce(DataFrame.unionByName, halves)
        bins = scored.groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
        out: dict[str, float] = {}
        for number, kind in enumerate(KINDS):
            n = good = 0
            for r in sorted((r for r in bins if r["kind"] == number), key=lambda r: -r["bin"]):
                n, good = n + r["n"], good + r["good"]
                if good >= LEAST_SUPPORT and good >= precision * n and r["bin"] >= 100 * LEAST_THRESHOLD:
                    out[kind] = r["bin"] / 100
        return out

    def added(self, kind: str) -> Column:
        """Array of the spans of a kind to add to base_<kind>: none overlaps a base span of any kind."""
        if kind not in self.thresholds:
            return F.array().cast("array<struct<start:int,end:int>>")
        scored = F.transform(candidates(kind), lambda s: described(kind, s))
        passed = F.filter(scored, lambda c: boosting.probability(self.trees, c) >= self.thresholds[kind])
        return F.transform(F.filter(passed, lambda s: ~_on_base(s)), lambda s: _struct(start=s["start"], end=s["end"]))

    def chosen(self, docs: DataFrame) -> DataFrame:
        """docs with base_<kind> and more_<kind>, the spans to add."""
        return with_spans(docs).withColumns({f"more_{k}": self.added(k) for k in KINDS})


def _every(kind: str) -> Column:
    """The base and added spans of a kind, in order."""
    plain = F.transform(f"base_{kind}", lambda s: _struct(start=s["start"], end=s["end"]))
    return F.array_sort(F.concat(plain, F.col(f"more_{kind}")))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def personal_data(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are those of the base patterns; spans has the added ones too, as kind:start:end
    in the order of KINDS, then start. Added spans of one kind do not overlap each other, those of two kinds may. A
    null text counts as empty and has none. Rows that share a doc_id each get a row; texts of any length are read
    whole; an empty table, or one in which no base span is confirmed, adds nothing. Other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = (chooser or Chooser(docs)).chosen(texts)
    base = F.array_join(F.concat(*(_named(k, F.col(f"base_{k}")) for k in KINDS)), ",")
    spans = F.array_join(F.concat(*(_named(k, _every(k)) for k in KINDS)), ",")
    n_added = sum((F.size(f"more_{k}") for k in KINDS[1:]), F.size(f"more_{KINDS[0]}")).cast("long")
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), n_added.alias("n_added"))


def redacted(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """doc_id, text with every span replaced by its kind in square brackets; overlapping spans become one, named after the first.

    A null text stays null; rows that share a doc_id each get a row.
    """
    rows = (chooser or Chooser(docs)).chosen(docs.select("doc_id", "text"))
    named = lambda k: F.transform(_every(k), lambda s: _struct(start=s["start"], end=s["end"], kind=F.lit(k)))
    spans = F.array_sort(F.concat(*(named(k) for k in KINDS)))
    state = _struct(at=F.lit(0), out=F.array().cast("array<string>"))

    def step(a: Column, s: Column) -> Column:
        piece = F.substr("text", a["at"] + 1, s["start"] - a["at"])
        done = _struct(at=s["end"], out=F.concat(a["out"], F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
        return F.when(s["start"] < a["at"], _struct(at=F.greatest(a["at"], s["end"]), out=a["out"])).otherwise(done)

    tail = lambda a: F.concat(F.array_join(a["out"], ""), F.substr("text", a["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), F.aggregate(spans, state, step, tail)).alias("text"))
