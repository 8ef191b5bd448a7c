"""Quality rules with verdicts by host (DataFrame functions only).

Each document gets counts and rule failures. Failures are summed by host, each host's failure
rates are shrunk by a beta prior that is fitted to all hosts by the moments of beta-binomial counts
(so hosts of few documents don't count as spread), and the host verdicts are joined back: a host is strict when a shrunk rate passes ``strict_rate``. A strict host's documents
stay only with no failure at all; other hosts' documents may fail ``tolerated`` soft rules. A
document that fails a base rule always goes.

Defined cases: a null text has no words (base failure); a null host counts as the host ""; a rate of
just ``strict_rate`` is not strict; hosts that agree get the strongest prior; repeated rows count as
often as they occur; very long texts take memory in proportion to their words; an empty table gives
an empty result; further columns are carried or ignored and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm._shared import NOT_SPACE, materialize, words

WINDOW = 8
SOFT_RULES = ("symbols", "dup_lines", "word_length")
RULES = ("base", *SOFT_RULES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _pair_hashes(h: Column, width: int) -> Column:
    """Hashes of runs of twice ``width`` words from those of ``width``; the last ones reach beyond the end."""
    return F.zip_with(h, F.slice(h, F.lit(width + 1), F.greatest(F.size(h) - width, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _sorted_if_repeated(h: Column) -> Column:
    """(hash, start) of the windows, sorted; null if no hash occurs twice, as in most texts."""
    s = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), s)


def _equal_neighbours(s: Column) -> Column:
    """Sorted starts of the windows whose hash occurs twice or more."""
    pairs = F.zip_with(
        s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    return F.when(F.size(s) > 1, starts)


def _covered(r: Column) -> Column:
    """Words in windows that start at r: each start covers up to the next, the last a whole window."""
    steps = F.zip_with(r, F.slice(r, F.lit(2), F.size(r)), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return F.when(F.size(r) > 0, F.aggregate(steps, F.lit(0), lambda total, x: total + x)).otherwise(0).cast("long")


def rule_features(docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the carried columns), ``host`` and the counts and rule failures of each document."""
    carry = docs.columns if carry is None else carry
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        text.alias("_t"),
    )
    d = d.select(
        "row",
        "host",
        words(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(NOT_SPACE)).alias("_l"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "row",
        "host",
        "n_symbols",
        "_w",
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    kept = ["row", "host", "n_symbols", "word_chars", "n_lines", "n_dup_lines", "_n"]
    # one select for each step: a column that the next step uses more than once is computed once
    h, width = F.col("_w"), 1
    while width < WINDOW:
        d = d.select(*kept, _pair_hashes(h, width).alias("_h"))
        h, width = F.col("_h"), 2 * width
    d = d.select(*kept, F.slice("_h", F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))).alias("_h"))
    d = d.select(*kept, _sorted_if_repeated(F.col("_h")).alias("_s"))
    d = d.select(*kept, _equal_neighbours(F.col("_s")).alias("_r"))
    d = d.select(*kept, _covered(F.col("_r")).alias("_repeat"))
    d = d.select(
        "row",
        "host",
        F.col("_n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.col("_repeat").alias("n_repeat_words"),
    )
    n = F.col("n_words")
    failed = [
        ((n < 20) | (100 * F.col("n_repeat_words") > 30 * n)).alias("base_failed"),
        (10 * F.col("n_symbols") > n).alias("symbols_failed"),
        (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")).alias("dup_lines_failed"),
        ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)).alias("word_length_failed"),
    ]
    # a generator, through which no later filter is pushed: one would compute the steps above many times
    return d.select("row", "host", F.inline(F.array(F.struct(*COUNTS, *failed))))


def beta_prior(hosts: int, n: int, nn: float, k: int, kk: float, least: float = 2.0, most: float = 1000.0) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior of hosts' failure rates, by the moments of beta-binomial counts.

    n, nn: sums of the hosts' documents and of their squares; k: of failures; kk: of failures squared
    over documents. With rho = 1 / (a + b + 1) the weighted spread of the rates, kk - k * k / n, is
    expected to be m * (1 - m) * ((hosts - 1) * (1 - rho) + rho * (n - nn / n)): what binomial counts
    scatter by themselves is no spread of the hosts.
    """
    m = k / n if n else 0.0
    beyond = n - nn / n - (hosts - 1) if n else 0.0
    if not 0 < m < 1 or beyond <= 0:
        return m, most
    rho = ((kk - k * m) / (m * (1 - m)) - (hosts - 1)) / beyond
    return m, min(max(1 / rho - 1, least), most) if rho > 0 else most


def host_verdicts(features: DataFrame, strict_rate: float = 0.5) -> DataFrame:
    """``host``, ``n_docs``, a shrunk failure rate for each rule, ``strict``."""
    counts = materialize(
        features.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_fails") for r in RULES],
        ),
        "hosts",
    )
    rate = {r: F.col(f"{r}_fails") / F.col("n_docs") for r in RULES}
    # the prior is one row: sums over hosts for the moments of beta-binomial counts
    prior = counts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("n"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
        *[F.sum(f"{r}_fails").alias(f"{r}_k") for r in RULES],
        *[F.sum(F.col(f"{r}_fails") * rate[r]).alias(f"{r}_kk") for r in RULES],
    ).first()
    shrunk = {}
    for r in RULES:
        m, strength = beta_prior(prior["hosts"], prior["n"] or 0, prior["nn"] or 0.0, prior[f"{r}_k"] or 0, prior[f"{r}_kk"] or 0.0)
        shrunk[r] = (F.col(f"{r}_fails") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    strict = F.lit(False)
    for r in RULES:
        strict = strict | (shrunk[r] > strict_rate)
    return counts.select("host", "n_docs", *[shrunk[r].alias(f"{r}_rate") for r in RULES], strict.alias("strict"))


def host_quality(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    carry: list[str] | None = None,
    strict_rate: float = 0.5,
    tolerated: int = 1,
    store_features: bool = False,
) -> DataFrame:
    """Features of each document with ``strict`` (its host's verdict) and ``kept``.

    ``row`` holds the carried columns. ``store_features`` writes the rows and features once instead
    of computing the features for the hosts and again for the documents.
    """
    features = rule_features(docs, text_col, host_col, carry)
    if store_features:
        features = materialize(features, "rules")
    verdicts = host_verdicts(features, strict_rate).select("host", "strict")
    failures = sum((F.col(f"{r}_failed").cast("int") for r in SOFT_RULES), F.lit(0))
    allowed = F.when(F.col("strict"), 0).otherwise(tolerated)
    return features.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & (failures <= allowed))
