"""URL filters: rules by host and path, and boosted trees on lexical features for all other URLs.

Only DataFrame operations. The part of blocked URLs is counted for every host suffix and domain over all labelled
rows; these rates join the URLs to score: broadcast while they are few, with heavy keys split off beyond. The trees
are fitted by Spark ML on a bounded sample of distinct labelled URLs, weighted by how often each occurs, and applied
as SQL expressions. A URL of the sample gets its rates from the other folds of the labelled URLs, so that
its own label is no feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import boosting
from foliant.llm.common import ascii_lower, join_weighted, small, stored

#: Fixed values: (verdict, rule). The longest rule that fits decides.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Bound of the training sample: distinct URLs.
SAMPLE_ROWS = 20_000
RATE_PRIOR = 20.0
FOLDS = 5
RATED = ("suffix", "domain")
THRESHOLD = 0.5

FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "host_labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy",
    "parameters", "has_fragment", "has_extension", "is_https", "suffix_rate", "domain_rate",
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. Equal lengths: the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.coalesce(F.when((c != "") & (share(c) > 0), share(c) / n * F.log2(share(c) / n)), F.lit(0.0))
    )


def lexical(pages: DataFrame) -> DataFrame:
    """pages with url parts and the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.withColumns(
        {
            "suffix": suffix_of(F.col("host")),
            "domain": domain_of(F.col("host")),
            "url_length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "query_length": F.length(query),
            "host_labels": count(F.col("host"), r"[^.]+"),
            "depth": count(F.col("path"), r"/[^/]"),
            "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "host_digits": count(F.col("host"), "[0-9]"),
            "hyphens": count(F.col("host"), "-"),
            "entropy": _entropy(url),
            "parameters": count(query, r"[^&]+"),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"),
            "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
            "is_https": F.startswith(url, F.lit("https:")).cast("int"),
        }
    )


class UrlModel:
    """Fitted on url, label (1: block), one row or more for each URL. Takes about sample_rows URLs, chosen by a hash."""

    def __init__(self, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS):
        known = labelled.filter(F.col("label").isNotNull() & F.col("url").isNotNull())
        counted = known.groupBy("url", F.col("label").cast("double").alias("label")).agg(F.count("*").cast("double").alias("n"))
        host = host_of(F.col("url"))
        fold = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int")
        counted = stored(counted.select("url", "label", "n", suffix_of(host).alias("suffix"), domain_of(host).alias("domain"), fold.alias("fold")), "urls")
        every = counted.agg(F.sum("n"), F.sum(F.col("n") * F.col("label")), F.count("*")).first()
        self.prior = every[1] / every[0] if every[0] else 0.0
        self.rates = {x: self._rates(counted, x) for x in RATED}
        share = min(1.0, sample_rows / max(every[2], 1))
        rows = counted.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30)))
        for x in RATED:
            table = self.rates[x].select(x, F.col("n").alias("_n"), "bad", "folds", "bads")
            rows = join_weighted(rows, stored(table, "rates"), [x], "_n", "inner")
            left = lambda c, parts: F.col(c) - F.get(parts, F.col("fold"))
            rows = rows.withColumn(f"{x}_rate", self._smoothed(left("_n", "folds"), left("bad", "bads"))).drop("_n", "bad", "folds", "bads")
        self.trees = boosting.fit(lexical(rows.drop(*RATED)), FEATURES, weight="n")

    def _smoothed(self, n: Column, bad: Column) -> Column:
        return (bad + self.prior * RATE_PRIOR) / (n + RATE_PRIOR)

    @staticmethod
    def _rates(counted: DataFrame, name: str) -> DataFrame:
        """For each value: rows and bad rows, in all and in each fold."""
        bad = F.col("n") * F.col("label")
        per = lambda v: F.array(*(F.sum(F.when(F.col("fold") == k, v).otherwise(0.0)) for k in range(FOLDS)))
        return stored(counted.groupBy(name).agg(F.sum("n").alias("n"), F.sum(bad).alias("bad"), per(F.col("n")).alias("folds"), per(bad).alias("bads")), "rates")

    def with_rates(self, rows: DataFrame) -> DataFrame:
        """rows with suffix_rate and domain_rate, counted over all labelled rows; the prior for values without any."""
        for x in RATED:
            table = self.rates[x].select(x, self._smoothed(F.col("n"), F.col("bad")).alias("_rate"))
            if small(self.rates[x]):
                rows = rows.join(F.broadcast(table), x, "left")
            else:
                counts = rows.groupBy(x).agg(F.count("*").alias("_weight"))
                rows = join_weighted(rows, stored(table.join(counts, x), "rates"), [x], "_weight").drop("_weight")
            rows = rows.withColumn(f"{x}_rate", F.coalesce("_rate", F.lit(self.prior))).drop("_rate")
        return rows

    def score(self, rows: DataFrame) -> DataFrame:
        """rows of lexical() with score: the probability of block."""
        values = {f: F.col(f).cast("double") for f in FEATURES}
        return self.with_rates(rows).withColumn("score", boosting.probability(self.trees, values, self.prior))


def held_out(labelled: DataFrame, part: Column, threshold: float = THRESHOLD) -> dict[str, float]:
    """Accuracy and log loss on the labelled URLs where part is true, by a model that is fitted on the others."""
    known = labelled.filter("label IS NOT NULL AND url IS NOT NULL").withColumn("part", part)
    scored = UrlModel(known.filter("NOT part")).score(lexical(known.filter("part")))
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    n, right, total = scored.agg(F.count("*"), F.count_if((F.col("score") > threshold) == (F.col("label") == 1)), F.sum(loss)).first()
    return {"rows": n, "accuracy": right / n if n else 0.0, "log_loss": total / n if n else 0.0}


def ruled(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """url, label and rule of the pages that a rule decides."""
    found = pages.select("url", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("found")).filter("found IS NOT NULL")
    return found.select("url", (F.col("found.verdict") == "block").cast("int").alias("label"), "found.rule")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    Rules come first. All other URLs are blocked if the model's score is over the threshold. Without labelled
    (url, label) rows, the URLs that a rule decides are the labelled ones, counted by rows, so a URL that occurs
    often weighs more. A null url, or one without ://, has an empty host and path, fits no rule and is left to
    the model; so does an empty table, whose model is a constant. Very long URLs are read whole, repeated rows each
    get a row. Other columns are ignored.
    """
    slim = pages.select("page_id", "url")
    model = UrlModel(ruled(slim, rules) if labelled is None else labelled)
    scored = model.score(lexical(slim)).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    guess = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", guess).alias("verdict"), "score")
