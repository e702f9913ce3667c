"""Operators against plain-Python models."""

import random

import pytest
from pyspark.sql import functions as F

from multirun import queries
from multirun.functions import bytesfn, generators
from multirun.operators import aggregates, merge, reads, resolve, sets
from multirun.plans import ranges, suite
from multirun.sources.segment import OrderError, SegmentWriter, read_segment, segment_keys, write_sorted
from multirun.sources.store import Store


def random_log(seed, steps=120):
    rng, log, model = random.Random(seed), [], {}
    snaps = {}
    for seq in range(1, steps):
        k = rng.choice([b"", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff\xff", b"user%d" % rng.randrange(9)])
        v = b"" if rng.random() < 0.1 else b"v%d" % seq
        x = rng.random()
        if x < 0.65:
            log.append((k, seq, 0, "A", v))
            model.setdefault(k, []).append(v)
        elif x < 0.85:
            log.append((k, seq, 0, "D", None))
            model.pop(k, None)
        else:
            log += [(k, seq, 0, "D", None), (k, seq, 1, "A", v)]
            model[k] = [v]
        snaps[seq] = {a: list(b) for a, b in model.items()}
    return log, model, snaps


def runs_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (bytes(r.key), r.seq, r.idx)):
        out.setdefault(bytes(r.key), []).append(bytes(r.value))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_resolve_matches_the_model_at_every_snapshot(spark, seed):
    log, model, snaps = random_log(seed)
    df = spark.createDataFrame(log, resolve.LOG_SCHEMA)
    assert runs_of(resolve.resolve(df)) == model
    assert runs_of(resolve.resolve(df, upto=50)) == snaps[50]
    staged = df.where("seq > 80")
    assert runs_of(resolve.resolve(df.where("seq <= 80"), staged=staged)) == model
    assert runs_of(merge.merge_pieces([df.where("seq % 2 = 0"), df.where("seq % 2 = 1")])) == model


def test_reads_and_limits(spark):
    rows = [(k, p, "x" * k) for k in range(5) for p in range(k + 1)]
    runs = spark.createDataFrame(rows, "key int, pos int, value string")
    assert reads.point_read(runs, 3).count() == 4 and reads.point_read(runs, 77).count() == 0
    assert {r.key for r in reads.scan(runs, 2, 1).collect()} == {1, 2}
    assert {r.key for r in reads.scan_at(runs, 3, 9).collect()} == {3, 4} and reads.scan_at(runs, 9, 3).count() == 0
    assert reads.key_at(runs, 4).collect()[0].key == 4 and reads.key_at(runs, 5).count() == 0
    assert reads.seek_rank(runs, 99).collect()[0].rank == 5
    assert reads.dict_range(runs, 3, 1).count() == 0 and reads.dict_range(runs, 3).count() == 9
    assert reads.multi_get(runs, list(range(2000))).count() == 15
    live = runs.where("key <> 2")
    assert [tuple(r) for r in reads.scan_visited(live, runs.select("key"), 3).orderBy("key").collect()] == [(0, 1), (1, 2), (2, 0)]


def test_prefix_bump():
    assert reads.bump(b"ab") == b"ac" and reads.bump(b"a\xff") == b"b" and reads.bump(b"\xff") is None


def test_counts_and_sizes(spark):
    runs = spark.createDataFrame([("a", "xx"), ("a", "yy"), ("b", "x"), ("b", ""), ("c", ""), ("d", "z" * 200)], "key string, value string")
    got = {r.key: r.stored_bytes for r in aggregates.stored_bytes(runs).collect()}
    assert got == {"a": 4, "b": 3, "c": 1, "d": 200}
    fixed = {r.key: r.n_fixed for r in aggregates.scan_counts_fixed(runs, 2).collect()}
    assert fixed == {"a": 2, "b": None, "c": None, "d": None}
    assert aggregates.count_fixed(runs, "none", 2).collect()[0].n_fixed == 0
    assert aggregates.payload_bytes(runs).collect()[0].payload_bytes == 4 + 4 + 1 + 0 + 200
    assert aggregates.payload_bytes(runs.limit(0)).collect()[0].payload_bytes == 0
    for values in ([b"xx", b"yy"], [b"x", b""], [b""], [b"z" * 200]):
        data, one = bytesfn.encode_run(values)
        assert bytesfn.decode_run(data, len(values), one) == values


def test_intersection_is_a_multiset(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 1), ("b", 3)], "key string, value int")
    assert sets.intersect_count(runs, "a", "b").collect()[0].n == 2
    assert sets.intersect_count(runs, "a", "zz").collect()[0].n == 0


def test_crc32c_and_varints():
    assert bytesfn.crc32c(b"123456789") == 0xE3069283
    assert bytesfn.crc32c(b"6789", bytesfn.crc32c(b"12345")) == 0xE3069283
    for k in range(10):
        a, b = b"123456789"[:k], b"123456789"[k:]
        assert bytesfn.crc32c_combine(bytesfn.crc32c(a), bytesfn.crc32c(b), len(b)) == 0xE3069283
    for n in (0, 127, 128, 16383, 16384, 2**31):
        assert bytesfn.decode_varint(bytesfn.encode_varint(n)) == (n, len(bytesfn.encode_varint(n)))
    with pytest.raises(ValueError):
        bytesfn.decode_varint(b"\x80")


def test_crc32c_of_columns(spark):
    rng = random.Random(8)
    values = [rng.randbytes(rng.choice([0, 1, 7, 40, 300])) for _ in range(60)] + [b"", b"x" * 5000, b"123456789"]
    want = [bytesfn.crc32c(v) for v in values]
    assert bytesfn.crc32c_each(values) == want and bytesfn.crc32c_each([]) == [] and bytesfn.crc32c_each([b""] * 20) == [0] * 20
    rows = list(enumerate([*values, None]))
    df = spark.createDataFrame(rows, "i int, v binary").select("i", bytesfn.crc32c_udf()("v").alias("c"))
    assert dict(df.collect()) == dict(enumerate([*want, None]))


def test_permutation_is_a_bijection(spark):
    got = [r[0] for r in spark.range(1000).select(generators.permute(F.col("id"), 1000).alias("k")).collect()]
    assert sorted(got) == list(range(1000)) and got != sorted(got)


def test_merge_ranges(spark):
    df = spark.createDataFrame([("g", 0, 5), ("g", 5, 7), ("g", 9, 10), ("g", 1, 2), ("h", 3, 4)], "grp string, start int, end int")
    got = sorted(tuple(r)[:3] for r in ranges.merge_ranges(df, "grp").collect())
    assert got == [("g", 0, 7), ("g", 9, 10), ("h", 3, 4)]


def test_sign_and_holm(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (0, 6), (10, 10)], "up long, n long")
    got = [round(r[0], 6) for r in df.select(suite.sign_p(F.col("up"), F.col("n"))).collect()]
    assert got == [1.0, 1.0, 0.03125, round(2 / 1024, 6)]
    ps = spark.createDataFrame([("f", 0.001), ("f", 0.04), ("f", 0.02)], "fam string, p double")
    assert {r.p: r.rejected for r in suite.holm(ps, "p", "fam").collect()} == {0.001: True, 0.02: True, 0.04: True}


def test_gate_needs_rows_and_direction(spark):
    rows = [("q", f"t{i}", 10.0, 11.0, True) for i in range(4)] + [("q", "t9", 5.0, 6.0, True), ("r", "t0", 1.0, 2.0, True)]
    df = spark.createDataFrame(rows, "k string, utc string, lo double, hi double, higher boolean")
    assert {r.k: r.verdict for r in suite.gate(df, "k").collect()} == {"q": "regressed", "r": "insufficient"}
    v = spark.createDataFrame([("w", "regressed")], "k string, verdict string")
    assert suite.withhold(v, v, ["k"]).collect()[0].verdict == "withheld"


def test_store_commits_crash_snapshot_and_compaction(spark, tmp_path):
    root = str(tmp_path / "s")
    s = Store.create(spark, root)
    with pytest.raises(FileExistsError):
        Store.create(spark, root)
    s.append(b"a", b"1")
    s.append_batch([(b"a", b"2"), (b"b", b"")])
    s.commit()
    snap = s.snapshot()
    s.put(b"a", b"3")
    assert runs_of(s.live(dirty=True))[b"a"] == [b"3"] and runs_of(s.live())[b"a"] == [b"1", b"2"]
    s.commit()
    t = s.begin()
    t.delete(b"b")
    lost = Store.open(spark, root)
    assert runs_of(lost.live()) == {b"a": [b"3"], b"b": [b""]}
    t.commit()
    s.flush()
    assert runs_of(s.live()) == {b"a": [b"3"]} and runs_of(snap.live()) == {b"a": [b"1", b"2"], b"b": [b""]}
    assert [tuple(r)[1:3] for r in s.dictionary().collect()] == [(1, 1)]
    s.collect_garbage()
    assert runs_of(snap.live())[b"a"] == [b"1", b"2"]
    snap.release()
    assert s.collect_garbage()
    s.append(b"c", b"9")
    s.close()
    assert runs_of(Store.open(spark, root).live()) == {b"a": [b"3"], b"c": [b"9"]}
    assert s.read_all(b"a").count() == 1 and s.read_all(b"zz").count() == 0
    s.append(b"lost", b"1")
    assert b"lost" not in runs_of(Store.open(spark, root).live())


def commit(store, log):
    for k, _, _, op, v in log:
        store.append(k, v) if op == "A" else store.delete(k)
    store.commit()


@pytest.mark.parametrize("seed", range(2))
def test_compaction_by_turns_keeps_every_reader_right(spark, tmp_path, seed):
    """Random commits with capped and whole compactions between them: live rows, dictionary, ranges and a held snapshot agree with the model."""
    log, _, _ = random_log(seed, 90)
    s, done, held = Store.create(spark, str(tmp_path / "s")), [], None
    for i in range(0, len(log), 30):
        commit(s, log[i : i + 30])
        done += log[i : i + 30]
        model = {}
        for k, _, _, op, v in done:
            model[k] = [*model.get(k, []), v] if op == "A" else []
        model = {k: v for k, v in model.items() if v}
        s.flush(ranges=3, cap=(1 if i % 60 else None))
        assert runs_of(s.live()) == model and s.m.pieces == []
        ends = [(p["lo"], p["hi"]) for p in s.m.partitions]
        assert ends[0][0] == "" and ends[-1][1] is None and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
        assert {bytes(r.key): (r.n, r.value_bytes) for r in s.dictionary().collect()} == {k: (len(v), sum(map(len, v))) for k, v in model.items()}
        assert s.facts()["keys"] == len(model) and s.facts()["payload"] == sum(len(x) for v in model.values() for x in v)
        for rank, k in enumerate(sorted(model)):
            assert rank > 1 or bytes(s.record_at(rank).collect()[0].key) == k
        assert s.record_at(len(model)).count() == 0
        if held is None:
            held, before = s.snapshot(), model
    assert runs_of(held.live()) == before


def test_compaction_leaves_untouched_ranges_and_keeps_empty_ones(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    for k in range(40):
        s.append(b"%02d" % k, b"v")
    s.commit()
    assert s.flush(ranges=4)["rewritten"] == 1 and len(s.m.partitions) == 4
    files = {p["lo"]: p["path"] for p in s.m.partitions}
    last = s.m.partitions[-1]
    lo = int(bytes.fromhex(last["lo"]))
    for k in range(lo, 40):
        s.delete(b"%02d" % k)
    s.commit()
    # counts of keys that no commit names come from the stored tables
    assert {bytes(r.key) for r in s.dictionary().collect()} == {b"%02d" % k for k in range(lo)}
    assert s.flush() == {"rewritten": 1, "promoted": 0, "left": 3, "turns": 1}
    assert all(files[p["lo"]] == p["path"] for p in s.m.partitions[:-1]) and s.m.partitions[-1]["path"] is None and s.m.partitions[-1]["hi"] is None
    assert len(runs_of(s.live())) == lo and s.facts()["empty"] == 1
    s.append(b"00", b"w")
    s.append(b"30", b"w")
    s.commit()
    assert s.flush(cap=1)["turns"] == 2 and runs_of(s.live())[b"00"] == [b"v", b"w"]


def test_promotion_and_ordered_ingest(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    commit(s, [(b"m%d" % k, 0, 0, "A", b"1") for k in range(5)])
    s.seal()
    assert s.flush()["promoted"] == 1 and s.m.partitions[0]["path"].count("/piece/") == 1
    commit(s, [(b"z", 0, 0, "A", b"2")])
    s.seal()
    assert s.flush()["promoted"] == 1 and [bytes.fromhex(p["lo"]) for p in s.m.partitions] == [b"", b"z"]
    commit(s, [(b"a", 0, 0, "A", b"0")])
    s.seal()
    assert s.flush()["promoted"] == 1 and len(s.m.partitions) == 3
    rows = spark.createDataFrame([(b"zz", 0, b"3"), (b"zz", 1, b"4")], "key binary, idx int, value binary")
    commit(s, [(b"m0", 0, 0, "D", None)])
    s.write_ordered(rows)
    want = {b"a": [b"0"], b"z": [b"2"], b"zz": [b"3", b"4"], **{b"m%d" % k: [b"1"] for k in range(1, 5)}}
    assert runs_of(s.live()) == want
    with pytest.raises(OrderError):
        s.write_ordered(rows)
    commit(s, [(b"zz", 0, 0, "D", None)])
    s.seal()
    assert s.flush()["promoted"] == 0 and runs_of(Store.open(spark, s.root).live()) == {k: v for k, v in want.items() if k != b"zz"}
    s.collect_garbage()
    assert len(runs_of(s.live())) == 6


def test_a_commit_that_fails_keeps_its_batch(spark, tmp_path, monkeypatch):
    s = Store.create(spark, str(tmp_path / "s"))
    s.append(b"a", b"1")
    monkeypatch.setattr(s, "commit_frame", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        s.commit()
    monkeypatch.undo()
    s.commit()
    assert runs_of(s.live()) == {b"a": [b"1"]} and s.staged == []


def test_reads_are_one_epoch_while_a_stream_commits(spark, tmp_path):
    """Each commit writes its number under every key: a read of any version sees one number's runs, complete, in order and never going back."""
    s = Store.create(spark, str(tmp_path / "s"))
    seen = {k: 0 for k in (b"a", b"b", b"c")}
    for epoch in range(1, 6):
        for k in seen:
            s.append(k, b"%d" % epoch)
        dirty = runs_of(s.live(dirty=True))
        s.commit()
        if epoch % 2:
            s.flush(cap=1)
        got = runs_of(Store.open(spark, s.root).live())
        for k in seen:
            assert got[k] == [b"%d" % e for e in range(1, epoch + 1)] == dirty[k] and len(got[k]) > seen[k]
            seen[k] = len(got[k])


def test_batch_writer_refuses_repeats(spark, tmp_path):
    df = spark.createDataFrame([(b"a", 0, b"x"), (b"a", 0, b"y")], "key binary, pos int, value binary")
    with pytest.raises(OrderError):
        write_sorted(df, str(tmp_path / "x"))
    w = SegmentWriter(spark, str(tmp_path / "w"), batch_bytes=200)
    for k in range(9):
        w.put_one(b"%d" % k, b"v" * 90)
    w.finish()
    assert [bytes(r.key) for r in read_segment(spark, str(tmp_path / "w")).orderBy("key").collect()] == [b"%d" % k for k in range(9)]


def test_bootstrap_and_zipf_against_brute_force(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 7.0)]
    got = {r.k: r.asDict() for r in suite.median_ci(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    a, b = ([x for n, x in got[k].items() if n != "k" and isinstance(x, float)] for k in "ab")
    assert all(1 <= x <= 100 for x in a) and min(a) <= 3 <= max(a) and set(b) == {7.0}
    n = [r.n for r in generators.zipf_keys(spark, 20000, 100).groupBy("k").count().withColumnRenamed("count", "n").orderBy(F.desc("n")).collect()]
    assert sum(n) == 20000 and len(n) <= 100 and n[0] > 3 * n[9] > 3 * n[40] / 2


def test_segments(spark, tmp_path):
    w = SegmentWriter(spark, str(tmp_path / "w"))
    w.put_one(b"a", b"1")
    w.begin(b"b")
    with pytest.raises(OrderError):
        w.begin(b"c")
    w.end()
    with pytest.raises(OrderError):
        w.begin(b"a")
    w.finish()
    assert {bytes(r.key): r.n for r in segment_keys(spark, str(tmp_path / "w")).collect()} == {b"a": 1, b"b": 0}
    df = spark.createDataFrame([(b"z", 0, b"q"), (b"a", 1, b"r"), (b"a", 0, b"s")], "key binary, pos int, value binary")
    write_sorted(df, str(tmp_path / "b"), 1)
    assert [bytes(r.value) for r in read_segment(spark, str(tmp_path / "b")).collect()] == [b"s", b"r", b"q"]


def test_live_counts_stream(spark, tmp_path):
    from multirun.streaming.live import live_counts

    log, model, _ = random_log(5)
    spark.createDataFrame(log, resolve.LOG_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(resolve.LOG_SCHEMA).parquet(str(tmp_path / "in"))
    q = live_counts(src).writeStream.outputMode("update").format("memory").queryName("lc").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {bytes(r.key): r.n for r in spark.table("lc").collect() if r.n}
    assert got == {k: len(v) for k, v in model.items()}


def test_dirty_read_stages_every_order(spark):
    d = "/root/testdata/sf0.001"
    log = [tuple(r) for r in queries.event_log(spark, d).collect()]
    log += [(r.o_custkey, 100000000 + r.o_orderkey, 0, *(("A", r.o_orderpriority) if r.o_orderkey % 7 else ("D", None))) for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    dels = {}
    for key, seq, idx, op, _ in log:
        if op == "D":
            dels[key] = max(dels.get(key, (-1, 0)), (seq, idx))
    want = sorted((key, seq, value) for key, seq, idx, op, value in log if op == "A" and (seq, idx) > dels.get(key, (-1, 0)))
    assert sorted(map(tuple, queries.QUERIES["dirty_read"](spark, d).collect())) == want and any(k > 100 and s > 100000000 for k, s, _ in want)


def test_fixed_counts_of_every_key(spark):
    d, runs = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{d}/part.parquet").collect():
        runs.setdefault(r.p_brand, []).append(len(r.p_name.encode()))
        runs.setdefault(r.p_type, []).append(len(f"{r.p_size:02}"))
    want = {k: len(v) if set(v) == {2} else None for k, v in runs.items()}
    assert {r.key: r.n_fixed for r in queries.QUERIES["count_fixed"](spark, d).collect()} == want
    assert None in want.values() and any(want.values())
    keyed = spark.createDataFrame([("a", "xx"), ("a", "yy"), ("b", "xx"), ("b", "y")], "key string, value string")
    assert [aggregates.count_fixed(keyed, k, 2).collect()[0].n_fixed for k in ("a", "b", "absent")] == [2, None, 0]
    orders = spark.read.parquet(f"{d}/orders.parquet")
    assert queries.QUERIES["scan_counts_fixed"](spark, d).count() == orders.select("o_orderpriority").distinct().count() > 3
