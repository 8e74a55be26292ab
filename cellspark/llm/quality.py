"""Quality rules by host, in DataFrame operations only.

Every document is measured by itself; the failures are summed by host, the host's failure rates are
shrunk towards the corpus by a beta prior that is fitted to all hosts, and the verdict on the host is
joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small, text_of

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when the shrunken share of its documents that fail one rule reaches this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0
RULES = ("short", "repetitive", "symbols", "dup_lines")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _part(words: Column, start: int) -> Column:
    return F.slice(words, F.lit(start), F.greatest(F.size(words) - 2, F.lit(0)))


def with_features(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` as one struct column ``doc``, its ``host``, the base columns and a boolean for each rule.

    Words are runs without white space (space, tab to carriage return). ``n_repeat_words`` counts the
    words that lie in a three-word window found twice or more in the same text, the first included;
    windows are compared by their 64-bit hash. A null text has no words. The columns of ``docs`` may
    have any names, as they are held inside ``doc``.
    """
    at = docs.select(F.struct("*").alias("doc"), F.col(host).alias("host"), text_of(text).alias("t"))
    at = at.withColumns({"w": F.array_remove(F.split("t", SPACE), ""), "lines": F.split("t", "\n")})
    worded = F.filter("lines", lambda x: F.trim(F.translate(x, "\t\v\f\r", "    ")) != "")
    at = at.select(
        "doc",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        worded.alias("worded"),
        F.transform(
            F.arrays_zip(_part(F.col("w"), 1).alias("a"), _part(F.col("w"), 2).alias("b"), _part(F.col("w"), 3).alias("c")),
            lambda x: F.xxhash64(x["a"], x["b"], x["c"]),
        ).alias("h"),
    )
    ordered = F.array_sort(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("p")))
    at = at.select(
        "doc",
        "host",
        *BASE[:3],
        F.size("worded").cast("long").alias("n_lines"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered).alias("s"),
    )
    # Neighbours in hash order that are equal give the places of repeated windows.
    n = F.size("s") - 1
    same = F.zip_with(F.slice("s", F.lit(1), n), F.slice("s", F.lit(2), n), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
    at = at.withColumn("p", F.when(F.col("s").isNotNull(), F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("p", lambda x: F.array(x, x + 1, x + 2)))))
    at = at.withColumn("n_repeat_words", F.when(F.col("p").isNull(), 0).otherwise(covered).cast("long"))
    return at.select(
        "doc",
        "host",
        *BASE,
        (F.col("n_words") < MIN_WORDS).alias("short"),
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")).alias("repetitive"),
        (10 * F.col("n_symbols") > F.col("n_words")).alias("symbols"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).alias("dup_lines"),
    )


def host_rates(features: DataFrame) -> DataFrame:
    """Documents and failures of each rule by host. Documents without a host belong to none."""
    return (
        features.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), *(F.count_if(F.col(r)).alias(f"f_{r}") for r in RULES))
    )


def host_verdicts(rates: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Add the shrunken rate of each rule and ``host_bad`` to the output of :func:`host_rates`.

    With m the share of all documents that fail and v the variance of the hosts' rates (each weighted by
    its documents), the prior is Beta(M m, M (1 - m)), M = m (1 - m) / v - 1 within PRIOR_MIN and
    PRIOR_MAX. No hosts: an empty result.
    """
    x = rates.agg(
        F.sum("n").alias("n"),
        *(F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES),
        *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"s_{r}") for r in RULES),
    ).first()
    out, bad = rates, F.lit(False)
    for r in RULES:
        m = x[f"f_{r}"] / x["n"] if x["n"] else 0.0
        v = x[f"s_{r}"] / x["n"] - m * m if x["n"] else 0.0
        strength = PRIOR_MAX if v <= 1e-12 else min(max(m * (1 - m) / v - 1, PRIOR_MIN), PRIOR_MAX)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.lit(strength * m)) / (F.col("n") + F.lit(strength)))
        bad = bad | (F.col(f"rate_{r}") >= limit)
    return out.withColumn("host_bad", bad)


def judge(features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``. Only rejected hosts are joined, broadcast if few by count."""
    bad = small(verdicts.where("host_bad").select(F.col("host").alias("bad_host")))
    return (
        features.join(bad, F.col("host") == F.col("bad_host"), "left")
        .withColumn("base_failed", F.col("short") | F.col("repetitive"))
        .withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull())
        .drop("bad_host")
    )


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its key, the base columns, ``base_failed`` and ``kept``.

    Repeated rows are judged each by itself; a null key stays null; a null or empty text fails the base
    rules; a null host is never rejected. The measures are written once and read twice, so no text
    is parsed again.
    """
    narrow = docs.select(F.col(key), F.col(text), F.col(host).cast("string").alias(host))
    features = with_features(narrow, text, host).select(F.col("doc")[key].alias(key), "host", *BASE, *RULES)
    features = materialise(features, "quality")
    verdicts = host_verdicts(host_rates(features))
    return judge(features, verdicts).select(key, *BASE, "base_failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that both their own rules and their host's verdict keep, with all their columns."""
    # Written once with the documents: as one plan, the filter would be pushed below the measures and repeat them all.
    features = materialise(with_features(docs, text, host), "quality")
    rates = materialise(host_rates(features), "hosts")
    return judge(features, host_verdicts(rates)).where("kept").select("doc.*")
