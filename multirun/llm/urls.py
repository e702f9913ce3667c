"""URL filter: longest matching rule, else gradient-boosted trees on lexical features.

Only built-in column functions are used. Features are small integers: length, path depth, share of digits,
character entropy, parameters, hyphens and labels of the host, and how often the host's suffix (last two
labels) was blocked among labelled URLs. The trees, the suffix rates and the threshold come from all labelled URLs.

Cases: a null URL, or one without ``://``, has an empty host and path and is judged by the trees alone;
rules match a host and its subdomains and paths that start with the rule's; of equally long matching rules
the first given wins; repeated rows agree; an empty table gives no rows, and an empty labelled table a model
that allows everything.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multirun.llm import gbt
from multirun.llm.common import own_columns, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRECISION = 0.8
#: Parts of the labelled URLs, by hash: a URL meets the block rate that its suffix has in the other parts, and part 0 sets the threshold.
FOLDS = 5
#: Rows of suffix rates up to which they are sent to every task (about 50 bytes each); more are joined.
BROADCAST_RATES = 100_000
FEATURES = ["length", "depth", "digits", "entropy", "params", "hyphens", "labels", "host_length", "suffix_rate"]
#: Host words that mark a labelled URL as unwanted (fixed values, for labels only; the trees never see words).
UNWANTED_WORDS = ["adult", "ads-", "bets", "casino", "pills", "spam"]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    which = verdict = None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        which = F.when(fits, r) if which is None else which.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return which if which is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string")


def entropy(s: Column) -> Column:
    """Bits per character, in tenths."""
    n = F.length(s)
    chars = F.array_distinct(F.split(s, ""))
    bits = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(_share(s, c, n) * F.log2(_share(s, c, n))))
    return F.when(n == 0, 0).otherwise(F.round(bits * 10)).cast("int")


def _share(s: Column, c: Column, n: Column) -> Column:
    return F.greatest((n - F.length(F.replace(s, c, F.lit("")))) / n, F.lit(1e-9))


def suffix(h: Column) -> Column:
    return F.regexp_extract(h, r"([^.]*\.?[^.]*)$", 1)


def lexical(url: Column, rate: Column) -> dict[str, Column]:
    """The features as integer columns; ``rate`` is the block rate of the URL's suffix in twentieths."""
    u = F.coalesce(url, F.lit(""))
    h, n = host(url), F.length(F.coalesce(url, F.lit("")))
    count = lambda s, p: (F.length(s) - F.length(F.regexp_replace(s, p, ""))).cast("int")
    return {
        "length": F.least(n, F.lit(400)).cast("int"), "depth": F.least(count(path(url), "/"), F.lit(20)),
        "digits": F.when(n == 0, 0).otherwise(F.floor(count(u, "[0-9]") * 50 / n)).cast("int"), "entropy": entropy(h),
        "params": F.least(count(u, "[?&]"), F.lit(20)), "hyphens": F.least(count(h, "-"), F.lit(9)), "labels": F.least(count(h, r"\."), F.lit(9)),
        "host_length": F.least(F.length(h), F.lit(100)).cast("int"), "suffix_rate": rate.cast("int"),
    }


def seed_labels(urls: DataFrame, url: str = "url") -> DataFrame:
    """Labelled URLs from host words: ``(url, blocked)``."""
    h = host(F.col(url))
    return urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), reduce(lambda a, w: a | h.contains(w), UNWANTED_WORDS, F.lit(False)).alias("blocked"))


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, int]:
    """Block rates in twentieths of all suffixes ``_s`` of ``(_s, _fold, blocked)``, and that of all rows.

    ``(_s, _fold, _rate)``: the rate in the rows of other folds, or where ``_fold`` is -1 in all rows, both drawn towards that of all rows.
    """
    bad, n = F.sum(F.col("blocked").cast("bigint")).alias("b"), F.count("*").alias("n")
    folds = stored(labelled.groupBy("_s", "_fold").agg(bad, n), "suffixes")
    all_ = folds.groupBy("_s").agg(F.sum("b").alias("_b"), F.sum("n").alias("_m"))
    total = folds.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("b", "n"))).first()
    share = (total["b"] + 1) / (total["n"] + 2)
    rate = lambda b, n: F.round(20 * (b + 5 * share) / (n + 5)).cast("int").alias("_rate")
    others = folds.join(all_, "_s").select("_s", "_fold", rate(F.col("_b") - F.col("b"), F.col("_m") - F.col("n")))
    return stored(others.unionByName(all_.select("_s", F.lit(-1).alias("_fold"), rate(F.col("_b"), F.col("_m")))), "rates"), round(20 * share)


def rated(df: DataFrame, rates: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the rate of their suffix ``key``; null where none is known. ``rates`` has one row of ``(_s, _rate)`` per suffix, or of ``(_s, _fold, _rate)``."""
    rates = rates.withColumnsRenamed({"_s": key, "_rate": name})
    if rates.count() <= BROADCAST_RATES:
        rates = F.broadcast(rates)
    return df.join(rates, [key, *(c for c in rates.columns if c == "_fold")], "left")


def fit(labelled: DataFrame, precision: float = PRECISION) -> tuple[gbt.Boosted, DataFrame, int]:
    """Trees, suffix rates and the overall rate, from all labelled URLs, repeated rows once; a fifth of them set the threshold."""
    u = F.col("url")
    rows = labelled.where("url is not null and blocked is not null").select("url", "blocked").distinct()
    rows = rows.select("*", suffix(host(u)).alias("_s"), F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int").alias("_fold"))
    rates, whole = suffix_rates(rows)
    rows = rated(rows, rates.where("_fold >= 0"), "_s", "_rate")
    f = lexical(u, F.coalesce("_rate", F.lit(whole)))
    table = gbt.vectors(rows.select("blocked", (F.col("_fold") == 0).alias("_held"), *(c.alias(k) for k, c in f.items())), ["_held", *FEATURES], "blocked")
    model = gbt.fit_rows(table.where("not _held"), FEATURES)
    model.thresholds["block"] = gbt.thresholds(table.where("_held"), model, FEATURES, F.lit(0), precision).get(0, float("inf"))
    return model, rates.where("_fold < 0").select("_s", "_rate"), whole


def judge(pages: DataFrame, rules: list[tuple[str, str]], fitted: tuple, url: str = "url") -> DataFrame:
    """The input with ``host, path, rule, verdict`` and ``score`` (log odds of block)."""
    model, rates, whole = fitted
    u = F.col(url)
    which, verdict = rule(host(u), path(u), rules)
    # longer names than any column of the input has
    key, rate = ("_" * max(map(len, pages.columns)) + c for c in ("_s", "_rate"))
    s = model.column(lexical(u, F.coalesce(rate, F.lit(whole))))
    limit = model.thresholds.get("block", float("inf"))
    by_trees = F.when(s >= F.lit(limit), "block").otherwise("allow") if np.isfinite(limit) else F.lit("allow")
    return rated(pages.withColumn(key, suffix(host(u))), rates, key, rate).select(
        *own_columns(pages, "host", "path", "rule", "verdict", "score"),
        host(u).alias("host"), path(u).alias("path"), which.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), F.round(s, 4).alias("score"),
    )
