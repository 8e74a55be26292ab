"""URL filters: rules for known hosts, and for the rest naive Bayes over segmented host and path tokens.

Unigram counts from all page titles drive a Viterbi split of concatenated host names; the URLs that rules
decide train a multinomial naive Bayes model, which judges those that no rule fits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .common import materialise, small

#: (rule, verdict); a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words and tokens that go to every task; where a model has more, those met most often, and the rest is joined.
MAX_WORDS, MAX_TOKENS = 50_000, 100_000
#: A host's names have 63 characters at most by the rules of DNS, so no word in them is longer.
LONGEST_WORD = 63
#: Hosts whose words a worker remembers.
HOST_CACHE = 100_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (struct of rule and verdict) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Words:
    """All title words with their counts (``w``, ``count``), and the sum of these."""

    counts: DataFrame
    total: int

    def cost(self, count: int) -> float:
        return word_cost(count, self.total)


def word_cost(count: int, total: int) -> float:
    return -math.log(count / total)


def word_costs(pages: DataFrame, html: str = "html") -> tuple[Words, float]:
    """The table of title words, whose costs are negative log probabilities, and the cost of one unseen letter."""
    title = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    found = pages.select(F.explode(F.split(F.lower(title), r"[^\p{L}]+")).alias("w")).where((F.col("w") != "") & (F.length("w") <= LONGEST_WORD))
    counts = materialise(found.groupBy("w").count(), "title_words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return Words(counts, total), math.log(10) + math.log(max(total, 1)) / 4


def tiers(table: DataFrame, terms, key: str, size: int) -> tuple[list, DataFrame | None]:
    """Rows of ``table`` (``w`` and values) for every task, and for each key of ``terms()`` (``key``, ``w``) the rest of those it needs.

    A table of at most ``size`` rows goes to every task. Of a larger one, the ``size`` words that terms name most often
    do (known or not), so none that is joined is hot; ``more`` holds an array of the rest's rows by key.
    """
    values = [c for c in table.columns if c != "w"]
    if table.limit(size + 1).count() <= size:
        return table.collect(), None
    named = terms()
    top = materialise(named.groupBy("w").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "w").limit(size), "named_most").select("w")
    held = table.join(F.broadcast(top), "w", "left_semi").collect()
    rest = named.join(F.broadcast(top), "w", "left_anti").join(table, "w")
    return held, rest.groupBy(key).agg(F.collect_list(F.struct("w", *values)).alias("more"))


def segment(name: str, costs: Mapping[str, float], letter: float) -> list[str]:
    """The likeliest split of ``name`` into words; an unknown word costs ``letter`` for each letter and once more."""
    best, cut = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - LONGEST_WORD), j):
            cost = costs.get(name[i:j])
            if (c := best[i] + (letter * (j - i + 1) if cost is None else cost)) < best[j]:
                best[j], cut[j] = c, i
    out, j = [], len(name)
    while j:
        out.append(name[cut[j] : j])
        j = cut[j]
    return out[::-1]


def host_parts(host: str) -> list[str]:
    """The runs of letters of a host's names but the last."""
    return [part for name in host.split(".")[:-1] for part in re.findall(r"[^\W\d_]+", name)]


def host_tokens(host: str, split) -> list[str]:
    """``t:`` the host's last name, ``h:`` the words of its other names."""
    last = host.rpartition(".")[2]
    return ([f"t:{last}"] if last else []) + [f"h:{w}" for part in host_parts(host) for w in split(part)]


def path_tokens(path: str) -> list[str]:
    """``p:`` tokens of the path; digits become one sign each."""
    return [f"p:{re.sub(r'[0-9]', '0', w)}" for w in re.findall(r"\w+", path.lower())]


def substrings(hosts: DataFrame) -> DataFrame:
    """``host``, ``w``: whatever may be a word of it, once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "host", 1 << 16):
            own = batch.column("host").to_pylist()
            made = [sorted({p[i:j] for p in host_parts(h) for i in range(len(p)) for j in range(i + 1, min(len(p), i + LONGEST_WORD) + 1)}) for h in own]
            at = pa.array([i for i, x in enumerate(made) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("host").take(at), pa.array(list(chain.from_iterable(made)), pa.string())], names=["host", "w"])

    return hosts.mapInArrow(work, "host string, w string")


def tokenised(pages: DataFrame, costs: Words, letter: float, rules=RULES, key: str = "page_id", url: str = "url", size: int = MAX_WORDS) -> DataFrame:
    """``k`` (key), host, path, ``rule`` (struct) and the URL's ``tokens``."""
    at = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    at = at.select("*", best_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    schema = T.StructType([*at.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))])
    held, more = tiers(costs.counts, lambda: materialise(substrings(at.select("host").distinct()), "substrings"), "host", size)
    if more is not None:
        at = at.join(small(materialise(more, "host_words")), "host", "left").select(*at.columns, "more")
    total, joined = costs.total, more is not None
    shared = pages.sparkSession.sparkContext.broadcast({r.w: costs.cost(r["count"]) for r in held})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        @lru_cache(HOST_CACHE)
        def split(name: str) -> list[str]:
            return segment(name, known, letter)

        def of(host: str, path: str, rest: list[dict] | None) -> list[str]:
            if not rest:
                return host_tokens(host, split) + path_tokens(path)
            own = {x["w"]: word_cost(x["count"], total) for x in rest}
            for p in host_parts(host):
                own |= {w: known[w] for i in range(len(p)) for j in range(i + 1, min(len(p), i + LONGEST_WORD) + 1) if (w := p[i:j]) in known}
            return host_tokens(host, lambda name: segment(name, own, letter)) + path_tokens(path)

        for batch in pieces(batches, "path"):
            rest = batch.column("more").to_pylist() if joined else [None] * batch.num_rows
            made = [of(*x) for x in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), rest, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.list_(pa.string()))], names=schema.names)

    return at.mapInArrow(work, schema)


@dataclass(frozen=True)
class Model:
    """All tokens with their counts by verdict (``w``, ``a``, ``b``), the smoothed sums of these, and the prior's log odds."""

    counts: DataFrame
    a: int
    b: int
    prior: float


def log_odds(a: int, b: int, all_a: int, all_b: int) -> float:
    return math.log((a + 1) / all_a) - math.log((b + 1) / all_b)


def train(labelled: DataFrame) -> Model | None:
    """Naive Bayes from rows with ``tokens`` and ``verdict``. None if a verdict has no rows. Add-one smoothing over all tokens."""
    classes = {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    if not classes.get("allow") or not classes.get("block"):
        return None
    allow = F.col("verdict") == "allow"
    counts = labelled.select(allow.alias("a"), F.explode("tokens").alias("w")).groupBy("w").agg(F.count_if("a").alias("a"), F.count_if(~F.col("a")).alias("b"))
    counts = materialise(counts, "token_counts")
    sums = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return Model(counts, sums.a + sums.n + 1, sums.b + sums.n + 1, math.log(classes["allow"] / classes["block"]))


def score(tokens: DataFrame, model: Model | None, size: int = MAX_TOKENS) -> DataFrame:
    """Add ``score``, the log odds of allow; 0 without a model. Tokens not in the model do not count."""
    if model is None:
        return tokens.withColumn("score", F.lit(0.0))
    schema = T.StructType([*tokens.schema.fields, T.StructField("score", T.DoubleType())])
    rows = []

    def terms() -> DataFrame:
        rows.append(materialise(tokens.withColumn("__id", F.monotonically_increasing_id()), "numbered_urls"))
        return rows[0].select("__id", F.explode("tokens").alias("w"))

    held, more = tiers(model.counts, terms, "__id", size)
    at = tokens if more is None else rows[0].join(more, "__id", "left").select(*tokens.columns, "more")
    sums, prior, width, joined = (model.a, model.b), model.prior, len(tokens.columns), more is not None
    shared = tokens.sparkSession.sparkContext.broadcast({r.w: log_odds(r.a, r.b, *sums) for r in held})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in pieces(batches, "path"):
            rest = batch.column("more").to_pylist() if joined else [None] * batch.num_rows
            # The sum is rounded once, so it does not depend on where a token's odds came from.
            made = [
                math.fsum([prior, *(odds.get(w, 0.0) for w in own or ()), *(log_odds(x["a"], x["b"], *sums) for x in far or ())])
                for own, far in zip(batch.column("tokens").to_pylist(), rest, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(made, pa.float64())], names=schema.names)

    return at.mapInArrow(work, schema)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, max_words: int = MAX_WORDS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Per page: key, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and the model's ``score``.

    The longest rule that fits decides; else a score of at least 0 allows. A null URL or one without
    ``://`` has empty host and path and is judged by the prior alone. Repeated rows get equal verdicts, null keys stay null, an
    empty table gives an empty result, and further columns are not read. Of words of equal cost the split takes the one that ends last and
    is longest; of rules, the longest (two of equal length cannot both fit unless they are equal).
    If rules leave no row of a verdict to learn from, what no rule decides is allowed. Both models hold all words
    and tokens. One of at most ``max_words`` or ``max_tokens`` is broadcast and shuffles no row; of a larger one the part
    met most often is, and the rest is joined to the hosts' substrings and the URLs' tokens.
    """
    costs, letter = word_costs(pages, html)
    rows = materialise(tokenised(pages, costs, letter, rules, key, url, max_words), "url_tokens")
    model = train(rows.where("rule IS NOT NULL").select("tokens", "rule.verdict"))
    return score(rows, model, max_tokens).select(
        F.col("k").alias(key),
        "host",
        "path",
        F.col("rule.rule").alias("rule"),
        F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"),
        "score",
    )
