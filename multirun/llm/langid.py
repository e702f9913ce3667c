"""Language identification by fusing evidence: text, declared language, address suffix and host.

Text likelihoods come from byte trigrams counted per language on all labelled rows. They
are tempered, since trigrams of a text are not independent. The declared language and the suffix of the
address add log likelihoods of a fixed trust. Host priors are smoothed in steps, all rows to the host's
registered domain to the host, from one grouped aggregate of the texts' own verdicts; a row's own verdict is
taken out of all three steps before it meets them, so that no row is evidence for itself.

Texts are scored once: scores are stored with the other evidence under the row's key, and texts do not travel.
A label that the model was fitted on is no evidence for its own row: rows are counted in folds by the hash of their
text, and a text is scored by the counts of all other folds, so neither itself nor a copy speaks for it. Where a caller
asks for a fit on a sample, there are no folds, and ``unfitted`` tells its rows apart.

A class "und" stands for text of no known language: its trigrams are all equally likely. A document is
rejected if that class wins, if the best language has less than ``least`` of the posterior, or if the
language is not among the accepted ones.

Cases: a null or empty text, or one without letters, gives no text evidence and is rejected; null declared
languages, addresses and hosts add no evidence; rows are judged one by one, so repeated ones agree; an
empty table gives no rows. Output columns are named by the operator, so clashing input columns do not meet them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multirun.llm.common import GROUP_BYTES, bounded_sample, fresh, groups, hash_share, own_columns, row_keys, small_batches, stored

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BUCKETS = 1 << 15
#: Parts of the labelled rows; a text is scored by the counts of the parts that it is not in.
FOLDS = 5
#: Share of a trigram's evidence that counts, trust in a declaration and in a suffix, and pseudo-rows of each prior step.
TEMPER, DECLARED, SUFFIX, PSEUDO = 0.25, 0.9, 0.8, 20.0
LEAST = 0.5
#: Hosts up to which priors are sent to every task (about 100 bytes each); more are joined.
BROADCAST_HOSTS = 100_000
#: Address suffixes that name a language (fixed values, country codes and path marks alike).
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "es": "es", "mx": "es", "fr": "fr"}

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte; all but letters are spaces, and trigrams that start with two spaces count as bucket 0."""
    c = _CLEAN[data].astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.uint16)
    code = c[:-2] << 16 | c[1:-1] << 8 | c[2:]
    out = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.uint16)
    out[(c[:-2] == 32) & (c[1:-1] == 32)] = 0
    return out


@dataclass
class Model:
    languages: tuple[str, ...]
    #: (classes + 1, BUCKETS) log likelihoods; the last class is UNKNOWN.
    table: np.ndarray
    #: Of a model that was fitted on a sample: rows with a lower text hash (of a million) were drawn.
    share: int = 0
    #: (FOLDS, classes + 1, BUCKETS) log likelihoods from all rows but those of each fold; none where the model was fitted on a sample.
    folds: np.ndarray | None = None

    def scores(self, texts: list[str | None], folds: np.ndarray | None = None) -> np.ndarray:
        """Tempered log likelihoods per text and class; rows of zeros where there is no letter. ``folds`` are those that the texts are in."""
        tables = self.table[None] if folds is None or self.folds is None else self.folds
        fold = np.zeros(len(texts), np.int64) if folds is None or self.folds is None else np.asarray(folds, np.int64)
        raw = [b" " + (t or "").encode() + b"  " for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        out = np.zeros((len(raw), len(self.table)))
        for i, j in groups(off, GROUP_BYTES):
            data = np.frombuffer(b"".join(raw[i:j]), np.uint8)
            tri, cut = trigrams(data), off[i : j + 1] - off[i]
            used = np.concatenate([[0], np.cumsum(tri != 0)])
            a, z = cut[:-1], np.maximum(cut[1:] - 2, cut[:-1])
            any_ = used[z] > used[a]
            at = np.repeat(fold[i:j] * BUCKETS, np.diff(cut))[: len(tri)] + tri
            for c in range(len(self.table)):
                s = np.concatenate([[0.0], np.cumsum(tables[:, c].reshape(-1)[at], dtype=np.float64)])
                out[i:j, c] = np.where(any_, (s[z] - s[a]) * TEMPER, 0.0)
        return out


def fold_of(text: Column) -> Column:
    """A text's fold; copies are in one."""
    return F.pmod(F.xxhash64(text, F.lit(1)), F.lit(FOLDS)).cast("int")


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", languages: tuple[str, ...] = LANGUAGES, rows: int | None = None) -> Model:
    """Counts trigrams on all labelled rows, each as often as it stands there; with ``rows``, on at most so many, drawn by the hash of their text.

    Texts are counted in tasks and the counts summed before they go to the driver, which gets a row per fold, language and bucket
    at most, however many rows and tasks there are.
    """
    small_batches(labelled.sparkSession)
    pick = labelled.where(F.col(label).isin(*languages) & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"))

    def count(batches):
        fresh("language")
        own = np.zeros((FOLDS, len(languages), BUCKETS), np.int64)
        for b in batches:
            for t, lang, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tri = trigrams(np.frombuffer(b" " + t.as_py().encode() + b"  ", np.uint8))
                np.add.at(own[fold, languages.index(lang)], tri, 1)
        each = np.nonzero(own)
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in each), pa.array(own[each])], names=["fold", "l", "bucket", "n"])

    def logs(counts: np.ndarray) -> np.ndarray:
        counts = np.vstack([counts, np.zeros(BUCKETS)])
        counts[:, 0] = 0
        out = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
        out[-1] = np.log(1.0 / BUCKETS)
        out[:, 0] = 0
        return out

    counts = np.zeros((FOLDS, len(languages), BUCKETS))
    pick, share = (pick, 0) if rows is None else bounded_sample(pick, "t", rows)
    got = pick.select("t", "l", fold_of(F.col("t"))).mapInArrow(count, "fold int, l int, bucket int, n bigint")
    got = got.groupBy("fold", "l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[tuple(got[c].to_numpy() for c in ("fold", "l", "bucket"))] = got["n"].to_numpy()
    whole = counts.sum(axis=0)
    return Model(tuple(languages), logs(whole), share, None if rows is not None else np.stack([logs(whole - c) for c in counts]))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#:]*)", 1))


def declared_in(html: Column) -> Column:
    """The language tag of a page's html element; null where it has none."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(tag != "", tag)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def unfitted(model: Model, text: Column) -> Column:
    """Whether a row with this text stood outside the sample that the model was fitted on; always so where it was fitted on all rows, in folds."""
    return hash_share(text) >= model.share


def score_udf(model: Model):
    @F.pandas_udf("array<double>")
    def f(t: pd.Series, fold: pd.Series) -> pd.Series:
        fresh("language")
        return pd.Series(list(model.scores(t.tolist(), fold.to_numpy())))

    return f


def host_votes(rows: DataFrame, n: int) -> DataFrame:
    """``(host, votes, around)``: texts of each host, and of its domain, by the language their trigrams favour; texts without evidence count for none."""
    best = F.array_position("s", F.array_max("s"))
    one = [F.sum(((best == i + 1) & (F.array_max("s") < 0)).cast("double")).alias(f"n{i}") for i in range(n)]
    names = [f"n{i}" for i in range(n)]
    hosts = rows.where("host is not null").groupBy("host").agg(*one).withColumn("_domain", domain_of(F.col("host")))
    domains = hosts.groupBy("_domain").agg(F.array(*(F.sum(c) for c in names)).alias("around"))
    return hosts.join(domains, "_domain").select("host", F.array(*names).alias("votes"), "around")


def smoothed(votes: np.ndarray, around: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Priors of hosts: votes (rows, languages) towards those of the domain, and these towards those of all rows."""
    size = lambda a: a.sum(axis=1, keepdims=True)
    whole = (total + 1) / (size(total) + total.shape[1])
    domain = (around + PSEUDO * whole) / (size(around) + PSEUDO)
    return (votes + PSEUDO * domain) / (size(votes) + PSEUDO)


def fused(model: Model, total: np.ndarray, s: np.ndarray, tags: list, suffixes: list, votes: list, around: list) -> tuple[np.ndarray, np.ndarray]:
    """Language and posterior of rows: text scores, evidence of tags and suffixes, and priors less each row's own vote."""
    langs, n = model.languages, len(model.languages)
    has = (s < 0).any(axis=1)
    hosted = np.asarray([v is not None for v in votes], bool)
    stack = lambda a: np.asarray([np.zeros(n) if v is None else v for v in a], float).reshape(len(s), n)
    own = np.zeros((len(s), n))
    best = s.argmax(axis=1)
    voted = np.flatnonzero(has & hosted & (best < n))
    own[voted, best[voted]] = 1
    prior = smoothed(stack(votes) - own, stack(around) - own, total[None, :] - own)
    s = s + np.log(np.hstack([prior * 0.98, np.full((len(s), 1), 0.02)]))
    for values, trust, names in ((tags, DECLARED, {x: x for x in langs}), (suffixes, SUFFIX, SUFFIXES)):
        for r, v in enumerate(values):
            lang = names.get(v)
            if lang in langs:
                e = np.full(n + 1, np.log((1 - trust) / n))
                e[langs.index(lang)] = np.log(trust)
                s[r] += e
    s = np.exp(s - s.max(axis=1, keepdims=True))
    s /= s.sum(axis=1, keepdims=True)
    best = s.argmax(axis=1)
    return np.where(has, np.asarray([*langs, UNKNOWN], object)[best], UNKNOWN), np.where(has, s[np.arange(len(s)), best], 0.0)


def verdicts(
    df: DataFrame, model: Model, key: str, text: str = "text", declared: Column | None = None, url: Column | None = None, host: Column | None = None,
    accepted: tuple[str, ...] | None = None, least: float = LEAST,
) -> DataFrame:
    """``key, lang, confidence, rejected`` of every row; ``key`` is carried along and need not be unique.

    ``declared`` is a language tag as markup gives it; ``url`` gives the suffix, and the host where ``host`` is not given.
    """
    small_batches(df.sparkSession)
    accepted = model.languages if accepted is None else accepted
    none = F.lit(None).cast("string")
    host = host if host is not None else host_of(url) if url is not None else none
    suffix = F.regexp_extract(host_of(url), r"([^.]+)$", 1) if url is not None else none
    tag = F.lower(F.regexp_extract(declared, r"^([A-Za-z]+)", 1)) if declared is not None else none
    rows = df.select(
        F.col(key).alias("key"), F.when(host != "", host).alias("host"), tag.alias("tag"), suffix.alias("suffix"), score_udf(model)(F.col(text), fold_of(F.col(text))).alias("s")
    )
    rows = stored(rows, "scores")
    n = len(model.languages)
    table = stored(host_votes(rows, n), "hosts")
    known = table.agg(F.count("*").alias("hosts"), *(F.coalesce(F.sum(F.col("votes")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(n))).collect()[0]
    total = np.asarray([known[f"n{i}"] for i in range(n)], float)
    if known["hosts"] <= BROADCAST_HOSTS:
        table = F.broadcast(table)

    @F.pandas_udf("lang string, confidence double")
    def fuse(s: pd.Series, tags: pd.Series, suffixes: pd.Series, votes: pd.Series, around: pd.Series) -> pd.DataFrame:
        fresh("language")
        lang, confidence = fused(model, total, np.stack(s.to_numpy()), tags.tolist(), suffixes.tolist(), votes.tolist(), around.tolist())
        return pd.DataFrame({"lang": lang, "confidence": confidence})

    out = rows.join(table, "host", "left").select("key", fuse("s", "tag", "suffix", "votes", "around").alias("r"))
    return out.select("key", "r.lang", "r.confidence", (~F.col("r.lang").isin(*accepted) | (F.col("r.confidence") < least)).alias("rejected"))


def identify(df: DataFrame, model: Model, *args, id_col: str | None = None, prefix: str = "lid_", **kwargs) -> DataFrame:
    """The input with ``{prefix}lang``, ``{prefix}confidence`` and ``{prefix}rejected``; further arguments as in ``verdicts``.

    Rows meet their verdicts by ``id_col``; without one, or where it does not name rows, they are numbered and stored first.
    """
    key = f"{prefix}row"
    rows, _ = row_keys(df, key, id_col)
    found = verdicts(rows, model, key, *args, **kwargs)
    found = found.select(F.col("key").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in ("lang", "confidence", "rejected")))
    own = own_columns(df, f"{prefix}lang", f"{prefix}confidence", f"{prefix}rejected")
    rows = rows.select(key, *own)
    return rows.join(found, key).drop(key)
