"""The contract's queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from multirun.llm import audio, decontaminate, forest, html_text, langid, packing, pii, suffix_dedup, token_files, urls
from multirun.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 wins AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM b, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
 ks AS (SELECT DISTINCT k FROM wins), firsts AS (SELECT DISTINCT k, split_part(s, ' ', 1) AS f FROM wins),
 pos AS (SELECT doc_id, w, i FROM d, range(1, len(w) + 1) r(i)),
 hit AS (SELECT p.doc_id, p.i, w.k, w.item FROM pos p JOIN firsts f ON f.f = p.w[p.i] JOIN wins w ON w.k = f.k AND w.s = array_to_string(p.w[p.i : p.i + f.k - 1], ' ')),
 cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
)
def op3_decontamination(spark, d):
    return decontaminate.digest(decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")))


@query()
def op6_token_files(spark, d):
    return token_files.tokenized(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op9_language_id(spark, d):
    """Documents carry no address: their source stands for the host and their declared language for the markup's; no row is scored by counts that hold its label."""
    docs = table(spark, d, "documents")
    found = langid.verdicts(docs, langid.fit(docs), "doc_id", declared=F.col("lang"), host=F.col("source"))
    return found.select(F.col("key").alias("doc_id"), F.col("lang").alias("language"), F.round("confidence", 4).alias("confidence"), "rejected")


@query()
def op10_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op8_jaccard_join(spark, d):
    return forest.join(table(spark, d, "documents"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query()
def op1_url_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return urls.judge(pages, RULES, urls.fit(urls.seed_labels(pages))).drop("url")


@query()
def op2_pii(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.digest(pii.detect(docs, pii.fit(docs)))


@query()
def op5_suffix_dedup(spark, d):
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, d, "documents")))


@query()
def op4_audio_features(spark, d):
    return audio.media_features(table(spark, d, "documents"))


@query()
def op7_html_text(spark, d):
    return html_text.extract(table(spark, d, "pages"))
