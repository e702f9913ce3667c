"""The registered queries: each applies one operator to whole tables, with the same result in SQL beside it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multirun.functions import generators
from multirun.functions.bytesfn import digits16
from multirun.operators import aggregates as A
from multirun.operators import merge as M
from multirun.operators import reads as R
from multirun.operators import resolve as V
from multirun.operators import sets as S
from multirun.plans import ranges, suite
from multirun.session import table
from multirun.sources import segment
from multirun.sources.store import Store
from multirun.streaming import live as stream_live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql:
            SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return add


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder; a local one only where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="multirun-")
    return f"{base}/multirun/{name}-{uuid.uuid4().hex[:10]}"


# --- inputs in the shape of the operators

LOG = """log AS (
 SELECT user_id AS key, event_id AS seq, 0 AS idx, 'D' AS op, CAST(NULL AS VARCHAR) AS value FROM events WHERE event_type IN ('purchase','signup')
 UNION ALL SELECT user_id, event_id, CASE WHEN event_type='signup' THEN 1 ELSE 0 END, 'A', event_type || ':' || CAST(event_id AS VARCHAR) FROM events WHERE event_type <> 'purchase')"""
LIVE = LOG + """, dels AS (SELECT key, max(seq*2+idx) AS d FROM log WHERE op='D' GROUP BY key),
 live AS (SELECT l.key, l.seq, l.idx, l.value FROM log l LEFT JOIN dels USING (key) WHERE l.op='A' AND (d IS NULL OR l.seq*2+l.idx > d))"""
ORD = "runs AS (SELECT o_custkey AS key, o_orderkey AS pos, o_orderpriority AS value FROM orders)"
PART = "runs AS (SELECT p_brand AS key, p_partkey AS pos, p_name AS value FROM part)"
DICT = """runs AS (SELECT 'brand=' || p_brand AS key, p_partkey AS value FROM part UNION ALL SELECT 'size=' || lpad(CAST(p_size AS VARCHAR),2,'0'), p_partkey FROM part
 UNION ALL SELECT 'type=' || p_type, p_partkey FROM part)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Purchases delete, signups replace, everything else appends; one scan, exploded."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    value = F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string"))
    kind = F.col("event_type")
    op = lambda i, o, v: F.struct(F.lit(i).alias("idx"), F.lit(o).alias("op"), v.alias("value"))
    none = F.lit(None).cast("string")
    ops = F.when(kind == "purchase", F.array(op(0, "D", none))).when(kind == "signup", F.array(op(0, "D", none), op(1, "A", value))).otherwise(F.array(op(0, "A", value)))
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.explode(ops).alias("o")).select("key", "seq", "o.idx", "o.op", "o.value")


def order_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))


def part_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("value"))


def dict_runs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    names = F.array(
        F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("size="), F.lpad(F.col("p_size").cast("string"), 2, "0")), F.concat(F.lit("type="), "p_type")
    )
    return p.select(F.explode(names).alias("key"), F.col("p_partkey").alias("value"))


def staged_orders(orders: DataFrame) -> DataFrame:
    """Orders as uncommitted operations, after all of the log: each seventh key deletes, the others append."""
    gone = F.col("o_orderkey") % 7 == 0
    return orders.select(
        F.col("o_custkey").alias("key"), (F.col("o_orderkey") + 100000000).alias("seq"), F.lit(0).alias("idx"),
        F.when(gone, "D").otherwise("A").alias("op"), F.when(~gone, F.col("o_orderpriority")).alias("value"),
    )


def live(spark: SparkSession, d: str, **k) -> DataFrame:
    return V.resolve(event_log(spark, d), **k)


# --- resolve and isolation


@query(f"WITH {LIVE} SELECT key, seq, idx, value FROM live")
def q_resolve_live(spark, d):
    return live(spark, d)


@query(f"WITH {LIVE} SELECT key, count(*) AS n, min(seq) AS first_seq FROM live GROUP BY key")
def q_resolve_put(spark, d):
    return live(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {LIVE} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY seq, idx) - 1 AS INTEGER) AS pos, value FROM live")
def q_run_positions(spark, d):
    return V.positions(live(spark, d)).select("key", "pos", "value")


SNAP = 5000


@query(f"WITH {LIVE.replace('FROM log WHERE op', f'FROM log WHERE seq <= {SNAP} AND op').replace('WHERE l.op', f'WHERE l.seq <= {SNAP} AND l.op')} SELECT key, seq, value FROM live")
def q_snapshot_read(spark, d):
    return live(spark, d, upto=SNAP).select("key", "seq", "value")


@query(
    f"WITH {LIVE.replace('UNION ALL SELECT user_id', 'UNION ALL SELECT o_custkey, 100000000 + o_orderkey, 0, CASE WHEN o_orderkey % 7 = 0 THEN $$D$$ ELSE $$A$$ END, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END FROM orders UNION ALL SELECT user_id', 1)} SELECT key, seq, value FROM live"
)
def q_dirty_read(spark, d):
    return live(spark, d, staged=staged_orders(table(spark, d, "orders"))).select("key", "seq", "value")


@query(f"WITH {LOG} SELECT key, seq, idx, op, value FROM log WHERE key = 7")
def q_debug_key(spark, d):
    return R.debug_key(event_log(spark, d), 7)


# --- reads


@query(f"WITH {ORD} SELECT key, pos, value FROM runs WHERE key = 10")
def q_point_read(spark, d):
    return R.point_read(order_runs(spark, d), 10)


MANY = [1, 7, 7, 10, 22, 46, 100, 101, 103, 99999999]


@query(f"WITH {ORD} SELECT key, pos, value FROM runs WHERE key IN ({','.join(map(str, MANY))})")
def q_multi_get(spark, d):
    return R.multi_get(order_runs(spark, d), MANY)


@query("SELECT o_custkey AS key, count(*) AS n, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS concat FROM orders GROUP BY o_custkey")
def q_read_concat(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("value"))
    return R.read_concat(runs, ["pos"])


@query("SELECT o_custkey AS key, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS run, count(*) AS n FROM orders GROUP BY o_custkey")
def q_framed_lookup(spark, d):
    return R.framed(order_runs(spark, d), ["pos"]).select("key", F.array_join("values", "|").alias("run"), F.size("values").cast("bigint").alias("n"))


@query(f"WITH {DICT} SELECT count(DISTINCT key) AS rank FROM runs WHERE key < 'size='")
def q_seek_rank(spark, d):
    return R.seek_rank(dict_runs(spark, d), "size=")


@query(f"WITH {DICT} SELECT key, CAST(12 AS BIGINT) AS rank FROM (SELECT DISTINCT key FROM runs) ORDER BY key LIMIT 1 OFFSET 12")
def q_key_at_rank(spark, d):
    return R.key_at(dict_runs(spark, d), 12)


@query(f"WITH {DICT} SELECT key, value, CAST(12 AS BIGINT) AS rank FROM runs WHERE key = (SELECT key FROM (SELECT DISTINCT key FROM runs) ORDER BY key LIMIT 1 OFFSET 12)")
def q_values_at_rank(spark, d):
    return R.values_at(dict_runs(spark, d), 12)


@query(f"WITH {ORD} SELECT key, pos, value FROM runs WHERE key IN (SELECT DISTINCT key FROM runs WHERE key >= 50 ORDER BY key LIMIT 100)")
def q_scan_from_limit(spark, d):
    return R.scan(order_runs(spark, d), 100, 50)


@query(f"WITH {ORD} SELECT key, pos, value FROM runs WHERE key IN (SELECT DISTINCT key FROM runs ORDER BY key LIMIT 50 OFFSET 20)")
def q_scan_at_rank(spark, d):
    return R.scan_at(order_runs(spark, d), 20, 50)


@query(
    f"WITH {LIVE}, vis AS (SELECT DISTINCT key FROM (SELECT key FROM live UNION ALL SELECT key FROM log WHERE seq > 2000) WHERE key >= 10 ORDER BY key LIMIT 60) "
    "SELECT vis.key, count(live.key) AS n FROM vis LEFT JOIN live ON vis.key = live.key GROUP BY vis.key"
)
def q_scan_visited_limit(spark, d):
    log = event_log(spark, d)
    return R.scan_visited(V.resolve(log), V.touched_keys(log, 2000), 60, 10)


@query(f"WITH {DICT} SELECT key, value FROM runs WHERE key >= 'brand=' AND key < 'size=20'")
def q_dict_range(spark, d):
    return R.dict_range(dict_runs(spark, d), "brand=", "size=20")


@query(f"WITH {DICT} SELECT key, value FROM runs WHERE starts_with(key, 'type=')")
def q_dict_prefix(spark, d):
    return R.dict_prefix(dict_runs(spark, d), "type=")


@query(f"WITH {ORD} SELECT key, pos, value FROM runs WHERE false")
def q_dict_range_inverted(spark, d):
    return R.dict_range(order_runs(spark, d), 20, 10)


# --- aggregates


@query(f"WITH {ORD} SELECT count(*) AS n FROM runs WHERE key = 10")
def q_count_key(spark, d):
    return A.count_key(order_runs(spark, d), 10)


@query(f"WITH {ORD} SELECT key, count(*) AS n FROM runs WHERE key >= 20 GROUP BY key ORDER BY key LIMIT 500")
def q_scan_counts(spark, d):
    return A.scan_counts(order_runs(spark, d), 20, 500)


@query(f"WITH {DICT} SELECT key, count(*) AS n FROM runs WHERE key >= 'size=' AND key < 'type=' GROUP BY key")
def q_dict_counts(spark, d):
    return A.scan_counts(R.dict_range(dict_runs(spark, d), "size=", "type="))


@query(f"WITH {ORD} SELECT count(DISTINCT key) AS keys FROM runs")
def q_keys_distinct(spark, d):
    return A.keys(order_runs(spark, d))


#: Types with sizes, all of one width, and brands with names of several.
WIDTHS = "runs AS (SELECT p_brand AS key, p_name AS value FROM part UNION ALL SELECT p_type, lpad(CAST(p_size AS VARCHAR),2,'0') FROM part)"


@query(f"WITH {WIDTHS} SELECT key, CASE WHEN min(strlen(value)) = 2 AND max(strlen(value)) = 2 THEN count(*) END AS n_fixed FROM runs GROUP BY key")
def q_count_fixed(spark, d):
    kinds = table(spark, d, "part").select(F.col("p_type").alias("key"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("value"))
    return A.scan_counts_fixed(part_runs(spark, d).select("key", "value").unionByName(kinds), 2)


@query("SELECT o_orderpriority AS key, CASE WHEN min(strlen(o_orderstatus)) = 1 AND max(strlen(o_orderstatus)) = 1 THEN count(*) END AS n_fixed FROM orders GROUP BY 1")
def q_scan_counts_fixed(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("value"))
    return A.scan_counts_fixed(runs, 1)


VARINT = "(strlen(value) + CASE WHEN strlen(value) < 128 THEN 1 WHEN strlen(value) < 16384 THEN 2 WHEN strlen(value) < 2097152 THEN 3 WHEN strlen(value) < 268435456 THEN 4 ELSE 5 END)"
STORED = f"CAST(CASE WHEN min(strlen(value)) = max(strlen(value)) AND min(strlen(value)) > 0 THEN sum(strlen(value)) ELSE sum({VARINT}) END AS BIGINT)"


@query(f"WITH {PART} SELECT key, {STORED} AS stored_bytes FROM runs GROUP BY key")
def q_stored_bytes(spark, d):
    return A.stored_bytes(part_runs(spark, d))


@query(f"WITH runs AS (SELECT source AS key, text AS value FROM documents) SELECT key, {STORED} AS stored_bytes FROM runs GROUP BY key")
def q_stored_bytes_documents(spark, d):
    return A.stored_bytes(table(spark, d, "documents").select(F.col("source").alias("key"), F.col("text").alias("value")))


@query(f"WITH {PART}, k AS (SELECT key, sum(strlen(value)) AS v FROM runs GROUP BY key) SELECT CAST(sum(v + strlen(key)) AS BIGINT) AS payload_bytes FROM k")
def q_payload_bytes(spark, d):
    return A.payload_bytes(part_runs(spark, d))


@query(f"WITH {PART} SELECT key, count(*) AS n, {STORED} AS stored_bytes, CAST(CASE WHEN min(strlen(value)) = max(strlen(value)) THEN min(strlen(value)) END AS INTEGER) AS width, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM runs GROUP BY key")
def q_dictionary(spark, d):
    return A.dictionary(part_runs(spark, d))


@query(
    f"WITH {PART} SELECT key, count(*) AS n, {STORED} AS stored_bytes, CAST(CASE WHEN min(strlen(value)) = max(strlen(value)) THEN min(strlen(value)) END AS INTEGER) AS width, "
    "CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM runs GROUP BY key ORDER BY key LIMIT 1 OFFSET 7"
)
def q_record_at_rank(spark, d):
    return R.record_at(A.dictionary(part_runs(spark, d)), 7)


@query("SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def q_top_n_panel(spark, d):
    runs = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("key"))
    return A.top_n(A.scan_counts(runs), 10)


@query(f"WITH {LIVE} SELECT key, arg_max(value, seq*2+idx) AS newest FROM live GROUP BY key")
def q_newest_value(spark, d):
    return A.newest_value(live(spark, d))


# --- posting lists

WORDS = "SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text,'')), '[^\\p{L}\\p{N}]+')) AS w FROM documents"


@query(f"WITH p AS ({WORDS}) SELECT a.doc_id AS value, CAST(1 AS BIGINT) AS times FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.w = 'the' AND b.w = 'ing'")
def q_intersect_postings(spark, d):
    return S.intersect(S.postings(table(spark, d, "documents")), "the", "ing")


@query(
    "WITH r AS (SELECT o_custkey AS key, o_orderpriority AS value FROM orders WHERE o_custkey IN (10, 11)), c AS (SELECT value, count(*) FILTER (key=10) AS a, count(*) FILTER (key=11) AS b FROM r GROUP BY value) "
    "SELECT CAST(coalesce(sum(least(a,b)),0) AS BIGINT) AS n FROM c"
)
def q_intersect_multiset(spark, d):
    return S.intersect_count(order_runs(spark, d), 10, 11)


@query(f"WITH p AS ({WORDS}) SELECT w AS key, count(*) AS n FROM p WHERE w <> '' GROUP BY w ORDER BY n DESC, key LIMIT 25")
def q_top_terms(spark, d):
    return A.top_n(A.scan_counts(S.postings(table(spark, d, "documents"))), 25)


# --- merge, fences, ranges


@query(f"WITH {LIVE} SELECT key, seq, idx, value FROM live")
def q_merge_pieces(spark, d):
    log = event_log(spark, d)
    return M.merge_pieces([log.where(F.col("seq") % 3 == r) for r in (2, 0, 1)])


CUTS = [100, 500, 1000]


@query(f"WITH {ORD} SELECT CAST((key >= 100)::INT + (key >= 500)::INT + (key >= 1000)::INT AS INTEGER) AS part, count(*) AS n, min(key) AS lo, max(key) AS hi FROM runs GROUP BY 1")
def q_partition_fences(spark, d):
    return M.range_stats(order_runs(spark, d), CUTS)


@query(
    "WITH r AS (SELECT source, doc_id * 1500 AS s, doc_id * 1500 + n_chars AS e FROM documents), o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM r), "
    'i AS (SELECT *, sum(f) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM o) SELECT source, min(s) AS "start", max(e) AS "end", count(*) AS n_ranges FROM i GROUP BY source, isl'
)
def q_range_union(spark, d):
    r = table(spark, d, "documents").select("source", (F.col("doc_id") * 1500).alias("start"), (F.col("doc_id") * 1500 + F.col("n_chars")).alias("end"))
    return ranges.merge_ranges(r, "source")


# --- suite analytics


def sample_rows(spark, d):
    """Benchmark-shaped rows: one per (return flag, line status, month), with the quartiles of a price as its interval."""
    li = table(spark, d, "lineitem").withColumn("utc", F.date_format("l_shipdate", "yyyy-MM"))
    g = li.groupBy("l_returnflag", "l_linestatus", "utc").agg(
        suite.quantile("l_quantity", 0.25).alias("lo"), suite.quantile("l_quantity", 0.75).alias("hi"), suite.quantile("l_quantity", 0.5).alias("median")
    )
    return g.withColumn("higher", F.lit(True))


ROWS = """rows AS (SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS utc, quantile_cont(l_quantity, 0.25) AS lo, quantile_cont(l_quantity, 0.75) AS hi,
 quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1,2,3), ranked AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY utc DESC) AS r FROM rows)"""


@query("SELECT event_type, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY 1")
def q_quantiles(spark, d):
    s = suite.summary(table(spark, d, "events"), "value", "event_type")
    return s.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75")})


@query("SELECT event_type, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / quantile_cont(value, 0.5), 9) AS rel_iqr FROM events GROUP BY 1")
def q_rel_iqr(spark, d):
    return suite.rel_iqr(table(spark, d, "events"), "value", "event_type").withColumn("rel_iqr", F.round("rel_iqr", 9))


HIST = """h AS (SELECT event_type, greatest(CASE WHEN value < 128 THEN 0 ELSE floor(log2(greatest(value,1)/128)) + 1 END - 1, 0) AS e, value FROM events WHERE value >= 0),
 b AS (SELECT event_type, floor(value / pow(2, e)) * pow(2, e) AS bucket, pow(2, e) AS step, count(*) AS n FROM h GROUP BY 1,2,3)"""


@query(f"WITH {HIST} SELECT event_type, bucket, step, n FROM b")
def q_histogram(spark, d):
    return suite.histogram(table(spark, d, "events"), "value", "event_type")


@query(
    f"WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM b) SELECT event_type, "
    + ", ".join(f"min(bucket + step - 1) FILTER (c >= greatest(ceil(t * {q} / 100), 1)) AS p{q:g}".replace(f"p{q:g}", f"p{q:g}".replace('.', '_')) for q in (50, 90, 99))
    + " FROM c GROUP BY event_type"
)
def q_hist_percentiles(spark, d):
    return suite.hist_percentiles(suite.histogram(table(spark, d, "events"), "value", "event_type"), [50, 90, 99], "event_type")


@query(
    f"WITH {ROWS}, g AS (SELECT l_returnflag, l_linestatus, count(*) AS n_rows, max(lo) FILTER (r=1) AS lo, max(hi) FILTER (r=1) AS hi, min(lo) FILTER (r>1) AS minlo, max(hi) FILTER (r>1) AS maxhi FROM ranked WHERE r <= 10 GROUP BY 1,2) "
    "SELECT l_returnflag, l_linestatus, n_rows, CASE WHEN n_rows < 3 THEN 'insufficient' WHEN hi < minlo THEN 'regressed' WHEN lo > maxhi THEN 'improved' ELSE 'level' END AS verdict FROM g"
)
def q_gate_verdict(spark, d):
    return suite.gate(sample_rows(spark, d), "l_returnflag", "l_linestatus")


@query(
    f"WITH {ROWS}, g AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (r>1) AS n_prior, max(median) FILTER (r=1) AS m, min(median) FILTER (r>1) AS lo, max(median) FILTER (r>1) AS hi FROM ranked WHERE r <= 10 GROUP BY 1,2) "
    "SELECT l_returnflag, l_linestatus, n_prior, CASE WHEN n_prior < 3 THEN 'insufficient' WHEN m < lo THEN 'worse' WHEN m > hi THEN 'better' ELSE 'in_band' END AS verdict FROM g"
)
def q_floor_verdict(spark, d):
    return suite.floor_verdict(sample_rows(spark, d), "l_returnflag", "l_linestatus")


PAIRS = """pairs AS (SELECT p_brand, ps.a AS a, ps.b AS b FROM (SELECT p_brand, p_size, avg(p_retailprice) FILTER (p_partkey % 2 = 0) AS a, avg(p_retailprice) FILTER (p_partkey % 2 = 1) AS b FROM part GROUP BY 1,2) ps WHERE a IS NOT NULL AND b IS NOT NULL),
 w AS (SELECT p_brand, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM pairs GROUP BY 1)"""
SIGN = """LEAST(1.0, 2 * list_sum([exp(lgamma(CAST(n+1 AS DOUBLE)) - lgamma(CAST(i+1 AS DOUBLE)) - lgamma(CAST(n-i+1 AS DOUBLE))) * pow(0.5, n) for i in range(0, k+1)]))"""


def _wins(spark, d):
    arm = F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b")
    rows = table(spark, d, "part").withColumn("arm", arm).groupBy("p_brand", "p_size", "arm").agg(F.avg("p_retailprice").alias("v"))
    return suite.paired(rows, "p_size", "arm", "v", "a", "b", "p_brand")


@query(f"WITH {PAIRS} SELECT * FROM w")
def q_paired_ab(spark, d):
    return _wins(spark, d)


@query(f"WITH {PAIRS}, s AS (SELECT p_brand, wins + losses AS n, least(wins, losses) AS k FROM w) SELECT p_brand, round(CASE WHEN n = 0 THEN 1.0 ELSE {SIGN} END, 6) AS p FROM s")
def q_sign_test(spark, d):
    return _wins(spark, d).select("p_brand", F.round(suite.sign_p(F.col("wins"), F.col("wins") + F.col("losses")), 6).alias("p"))


@query(
    "WITH p AS (SELECT p_brand, p_size, min(p_retailprice) / 100000 AS p FROM part GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM p) "
    "SELECT p_brand, p_size, max(CASE WHEN p > 0.5/(m-k+1) THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p ROWS UNBOUNDED PRECEDING) = 0 AS rejected FROM r"
)
def q_holm(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", "p_size").agg((F.min("p_retailprice") / 100000).alias("p"))
    return suite.holm(p, "p", "p_brand", 0.5).select("p_brand", "p_size", "rejected")


@query()
def q_median_bootstrap(spark, d):
    return suite.median_ci(sample_rows(spark, d), "median", "l_returnflag", "l_linestatus")


@query("SELECT l_returnflag, round(max(q) FILTER (l_linestatus='O') / max(q) FILTER (l_linestatus='F'), 9) AS factor FROM (SELECT l_returnflag, l_linestatus, arg_max(s, l_linenumber) AS q FROM (SELECT l_returnflag, l_linestatus, l_linenumber, CAST(count(*) AS DOUBLE) AS s FROM lineitem GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1")
def q_figure_factors(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("size")).agg(F.count("*").cast("double").alias("median"))
    return suite.factors(rows, "O", "F", "l_returnflag").withColumn("factor", F.round("factor", 9))


# --- workloads: batched equivalents of the read and write mixes


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS key, o_orderpriority AS value FROM orders")
def q_load(spark, d):
    return table(spark, d, "orders").select(digits16(F.col("o_orderkey")).alias("key"), F.col("o_orderpriority").alias("value"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def q_load_shuffled(spark, d):
    """A shuffled load written as key-ordered ranges and read back."""
    path = work_dir(spark, "load")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("pos"), F.col("o_orderpriority").alias("value"))
    segment.write_sorted(o, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def _mix(spark, d, read_pct: int):
    """A read/update mix over order keys: every 100-block of keys updates those past the read share."""
    o = table(spark, d, "orders")
    base = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("idx"), F.lit("A").alias("op"), F.col("o_orderpriority").alias("value"))
    upd = o.where(F.col("o_orderkey") % 100 >= read_pct)
    return base, V.puts(upd, F.col("o_custkey"), F.col("o_orderkey") + 100000000, F.concat(F.lit("u"), "o_orderpriority"))


def _mix_sql(read_pct: int, tail: str) -> str:
    return f"""WITH log AS (SELECT o_custkey AS key, o_orderkey AS seq, 0 AS idx, 'A' AS op, o_orderpriority AS value FROM orders
 UNION ALL SELECT o_custkey, o_orderkey + 100000000, 0, 'D', NULL FROM orders WHERE o_orderkey % 100 >= {read_pct} UNION ALL SELECT o_custkey, o_orderkey + 100000000, 1, 'A', 'u' || o_orderpriority FROM orders WHERE o_orderkey % 100 >= {read_pct}),
 dels AS (SELECT key, max(seq*2+idx) AS d FROM log WHERE op='D' GROUP BY key), live AS (SELECT l.* FROM log l LEFT JOIN dels USING (key) WHERE l.op='A' AND (d IS NULL OR l.seq*2+l.idx > d)) {tail}"""


def _ycsb(name: str, read_pct: int):
    def f(spark, d):
        base, upd = _mix(spark, d, read_pct)
        return V.resolve(base.unionByName(upd)).groupBy("key").agg(F.count("*").alias("n"), F.max("value").alias("last"))

    f.__name__ = f"q_ycsb_{name}"
    query(_mix_sql(read_pct, "SELECT key, count(*) AS n, max(value) AS last FROM live GROUP BY key"))(f)


for _name, _pct in (("a", 50), ("b", 95), ("c", 100)):
    _ycsb(_name, _pct)


@query(_mix_sql(95, "SELECT key, arg_max(value, seq*2+idx) AS newest FROM live GROUP BY key"))
def q_ycsb_d(spark, d):
    base, upd = _mix(spark, d, 95)
    return A.newest_value(V.resolve(base.unionByName(upd)))


@query(_mix_sql(95, ", starts AS (SELECT DISTINCT (key // 50) * 50 AS s FROM live) SELECT s AS scan_start, count(*) AS n FROM live JOIN starts ON (key // 50) * 50 = s GROUP BY s"))
def q_ycsb_e(spark, d):
    """Short scans of 50 keys, batched: one aggregate instead of a seek each."""
    base, upd = _mix(spark, d, 95)
    return V.resolve(base.unionByName(upd)).groupBy((F.floor(F.col("key") / 50) * 50).cast("bigint").alias("scan_start")).agg(F.count("*").alias("n"))


@query(_mix_sql(50, "SELECT key, 'm' || arg_max(value, seq*2+idx) AS modified FROM live GROUP BY key"))
def q_ycsb_f(spark, d):
    base, upd = _mix(spark, d, 50)
    return A.newest_value(V.resolve(base.unionByName(upd))).select("key", F.concat(F.lit("m"), "newest").alias("modified"))


def _lag(pct: int):
    def f(spark, d):
        base, upd = _mix(spark, d, 100 - pct)
        return R.scan_visited(V.resolve(base.unionByName(upd)), upd.select("key").distinct(), 1000)

    f.__name__ = f"q_scan_lag_{pct}"
    tail = (
        f", vis AS (SELECT DISTINCT key FROM (SELECT key FROM live UNION ALL SELECT o_custkey FROM orders WHERE o_orderkey % 100 >= {100 - pct}) ORDER BY key LIMIT 1000) "
        "SELECT vis.key, count(live.key) AS n FROM vis LEFT JOIN live ON vis.key = live.key GROUP BY vis.key"
    )
    query(_mix_sql(100 - pct, tail))(f)


for _pct in (0, 1, 10, 100):
    _lag(_pct)


@query("SELECT CAST(range AS BIGINT) AS k FROM range(10000)")
def q_permutation(spark, d):
    """A permutation of 10,000 keys: sorted, it is the identity."""
    return spark.range(10000).select(generators.permute(F.col("id"), 10000).alias("k"))


@query()
def q_zipf_keys(spark, d):
    return generators.zipf_keys(spark, 100000, 3000).groupBy("k").agg(F.count("*").alias("n"))


# --- store and streaming


@query(f"WITH {LIVE} SELECT key, count(*) AS n FROM live GROUP BY key")
def q_store_compacted(spark, d):
    """Two commits, a seal, compaction, one commit on top, then a reopen and a count of live values."""
    root = work_dir(spark, "store")
    log = event_log(spark, d).select(
        F.encode(digits16(F.col("key")), "UTF-8").alias("key"), "seq", (F.col("seq") * 2 + F.col("idx")).cast("int").alias("idx"), "op", F.encode("value", "UTF-8").alias("value")
    )
    store = Store.create(spark, root)
    store.commit_frame(log.where("seq < 4000"))
    store.commit_frame(log.where("seq >= 4000 and seq < 7000"))
    store.settle()
    store.commit_frame(log.where("seq >= 7000"))
    again = Store.open(spark, root)
    return again.live().groupBy(F.decode("key", "UTF-8").cast("bigint").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {LIVE} SELECT key, count(*) AS n FROM live GROUP BY key")
def q_store_incremental(spark, d):
    """Compaction by turns under a byte cap, twice: the second touches the ranges that new commits touch and leaves the others' files."""
    log = event_log(spark, d).select(
        F.encode(digits16(F.col("key")), "UTF-8").alias("key"), "seq", (F.col("seq") * 2 + F.col("idx")).cast("int").alias("idx"), "op", F.encode("value", "UTF-8").alias("value")
    )
    store = Store.create(spark, work_dir(spark, "store"))
    store.commit_frame(log.where("seq < 6000"))
    store.flush(ranges=8)
    store.commit_frame(log.where("seq >= 6000"))
    store.flush(cap=1 << 16)
    return Store.open(spark, store.root).live().groupBy(F.decode("key", "UTF-8").cast("bigint").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key, count(*) AS n, CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS value_bytes FROM orders GROUP BY 1")
def q_store_promoted(spark, d):
    """Pieces that meet no other become partitions by name, ordered ingest goes straight into one, and counts come from the dictionary."""
    o = table(spark, d, "orders").select(
        F.encode(digits16(F.col("o_custkey")), "UTF-8").alias("key"), F.col("o_orderkey").cast("int").alias("idx"), F.lit("A").alias("op"), F.encode("o_orderpriority", "UTF-8").alias("value"), "o_custkey"
    )
    store = Store.create(spark, work_dir(spark, "store"))
    store.commit_frame(o.where("o_custkey < 500"))
    store.seal()
    store.flush()
    store.write_ordered(o.where("o_custkey >= 500"))
    return store.dictionary().select(F.decode("key", "UTF-8").cast("bigint").alias("key"), "n", "value_bytes")


@query(f"WITH {LIVE} SELECT key, count(*) AS n FROM live GROUP BY key")
def q_stream_live_state(spark, d):
    """The event log as a stream, committed in micro-batches, then resolved."""
    root = work_dir(spark, "stream")
    src = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    kind = F.col("event_type")
    value = F.concat(kind, F.lit(":"), F.col("event_id").cast("string"))
    ops = F.when(kind == "purchase", F.array(F.lit("D"))).when(kind == "signup", F.array(F.lit("D"), F.lit("A"))).otherwise(F.array(F.lit("A")))
    log = src.select(
        F.encode(digits16(F.col("user_id")), "UTF-8").alias("key"), "event_id", F.encode(value, "UTF-8").alias("v"), F.posexplode(ops).alias("i", "op")
    ).select("key", (F.col("event_id") * 2 + F.col("i")).cast("int").alias("idx"), "op", F.when(F.col("op") == "A", F.col("v")).alias("value"))
    store = Store.create(spark, f"{root}/store")
    stream_live.ingest(log, store, f"{root}/checkpoint").awaitTermination()
    return store.live().groupBy(F.decode("key", "UTF-8").cast("bigint").alias("key")).agg(F.count("*").alias("n"))
