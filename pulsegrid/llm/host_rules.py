"""Host-level quality rules with an empirical beta prior."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD_RE, materialize, others, shielded

SYMBOLS = re.compile(r"[#*$%&|<>]")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words in windows of `width` words that are found twice or more in the text, the first one included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + width - max(at, upto)
            upto = at + width
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    kept = [x for x in lines if WORD_RE.search(x)]
    return len(kept) - len(set(kept))


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD_RE.findall(text)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), repeated_lines(text), repeated_words(words)


def features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


#: Rules on a text; a host's failures are counted for each.
RULES = ("base_failed", "symbols_failed", "lines_failed")


FEATURE_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_rules(df: DataFrame, text: str = "text", min_words: int = 10, max_repeat_percent: int = 20, max_symbol_percent: int = 10, max_dup_lines: int = 2) -> DataFrame:
    """Adds the five text features and the three RULES; columns of df with these names are replaced. Null text is empty.

    base_failed: too few words, or too many of them in repeated windows. symbols_failed: too many symbols to a hundred words.
    lines_failed: too many lines that repeat an earlier one.
    """
    added = list(FEATURE_NAMES)
    rows = df.withColumn("_f", F.pandas_udf(features, FEATURES)(F.col(text)))
    rows = rows.select(*others(df, *added, *RULES), *[F.col("_f")[c].alias(c) for c in added])
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return rows.withColumns({"base_failed": base, "symbols_failed": F.col("n_symbols") * 100 > F.col("n_words") * max_symbol_percent, "lines_failed": F.col("n_dup_lines") > max_dup_lines})


def host_verdicts(rows: DataFrame, host: str = "source", max_rate: float = 0.5, spread: float = 3.0, excess: float = 0.1, most_weight: float = 1e6) -> DataFrame:
    """One row for each host: host, host_rows, for each of RULES its failures and shrunk rate (<rule>_rate), host_rate (that of base_failed), host_rejected.

    For each rule a beta prior is fitted to the hosts' failure rates by moments: its mean is the failure rate of all
    rows, its weight mean * (1 - mean) / variance - 1, the variance of the rates weighted by rows (1 to most_weight;
    most_weight without variance). A host's rate is shrunk towards it: (failed + weight * mean) / (rows + weight), so that a host with few rows
    isn't judged on these alone. A host is rejected if a shrunk rate is above max_rate, or far above what the other hosts have: with
    m and v the mean and variance of their rates, above twice m, above m + excess, and above m + spread * sqrt(v + m * (1 - m) / rows). The other
    hosts' sums are those of all (three numbers a rule) without the host's own, so a hot bad host can't hide in the mean.
    Rows without a host are in none.
    """
    known = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    hosts = known.agg(F.count("*").alias("host_rows"), *[F.sum(F.col(r).cast("long")).alias(f"_{r}") for r in RULES])
    squares = [F.sum(F.col(f"_{r}") * F.col(f"_{r}") / F.col("host_rows")) for r in RULES]
    totals = hosts.agg(F.sum("host_rows"), *[F.sum(f"_{r}") for r in RULES], *squares).first()
    n, fails, squared = totals[0] or 0, [x or 0 for x in totals[1:4]], [x or 0.0 for x in totals[4:7]]
    rejected = F.lit(False)
    for r, all_failed, all_squares in zip(RULES, fails, squared):
        mean = all_failed / n if n else 0.0
        var = all_squares / n - mean * mean if n else 0.0
        weight = min(most_weight, max(1.0, mean * (1 - mean) / var - 1)) if var > 1e-12 else most_weight
        own = F.col(f"_{r}")
        rate = F.round((own + F.lit(weight * mean)) / (F.col("host_rows") + F.lit(weight)), 6)
        left = (F.lit(n) - F.col("host_rows")).cast("double")
        m = (F.lit(all_failed) - own) / left
        v = F.greatest(F.lit(0.0), (F.lit(float(all_squares)) - own * own / F.col("host_rows")) / left - m * m)
        far = (rate > 2 * m) & (rate > m + F.greatest(F.lit(excess), spread * F.sqrt(v + m * (1 - m) / F.col("host_rows"))))
        hosts = hosts.withColumn(f"{r}_rate", rate)
        rejected = rejected | (rate > max_rate) | F.when(left > 0, far).otherwise(False)
    return hosts.withColumn("host_rejected", rejected).withColumn("host_rate", F.col("base_failed_rate"))


def apply_verdicts(rows: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Joins host_rate, host_rejected back to the rows and adds kept. A row without a host is judged by its text alone."""
    verdicts = hosts.select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    joined = rows.select(*others(rows, "host_rate", "host_rejected", "kept")).join(verdicts, F.col(host) == F.col("_host"), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def host_quality(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, spread: float = 3.0) -> DataFrame:
    """Base rules on each text, host verdicts from all of them, joined back to each row of df without its text.

    Null or empty texts fail for want of words; repeated rows each count; an empty table gives no rows. Columns of df with
    the added names are replaced, all others come back under their own.
    """
    df, back = shielded(df, [text, host], *FEATURE_NAMES, *RULES, "host_rate", "host_rejected", "kept")
    rows = materialize(base_rules(df, text).drop(text), "rules")
    hosts = materialize(host_verdicts(rows, host, max_rate, spread), "hosts")  # its size is known then: while it is small it is sent to the rows, not the rows to it
    return back(apply_verdicts(rows, hosts, host))
