"""Readers, writers, streams over several batches, replays, privacy."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import business as bz
from tidemark.operators import observe as ob
from tidemark.operators import privacy as pv
from tidemark.operators import rules as rl
from tidemark.sources import tables as src
from tidemark.streaming import streams as ss


def test_csv_with_bom_and_delimiter(spark, folder):
    path = f"{folder}/a.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('id;name\n1;"x;y"\n2;\n3\n')
    df = src.read_table(spark, path, sep=";")
    assert df.columns == ["id", "name"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "x;y"), ("2", None), ("3", None)]
    assert src.detect_format("t.PQ") == "parquet" and src.detect_format("t.txt") == "csv" and src.detect_format("x", "json") == "json"
    with pytest.raises(ValueError, match="order_by"):
        src.read_table(spark, path, limit=1)


def test_all_timestamp_layouts(spark):
    texts = ["2024-03-05 06:07:08", "2024-03-05T06:07:08", "2024-03-05T06:07:08Z", "2024-03-05T06:07:08.000000", "2024-03-05", "03/05/2024", "25/03/2024", "junk", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.p for r in df.select("i", fx.parse_ts("t").alias("p")).orderBy("i").collect()]
    full, day = dt.datetime(2024, 3, 5, 6, 7, 8), dt.datetime(2024, 3, 5)
    assert got == [full, full, full, full, day, day, dt.datetime(2024, 3, 25), None, None]


def test_corrupt_json_is_kept(spark, folder):
    with open(f"{folder}/x.json", "w") as f:
        f.write('{"a": 1}\n{broken\n')
    df = src.read_table(spark, f"{folder}/x.json", "json", schema="a int, _corrupt_record string").cache()
    assert df.filter("_corrupt_record IS NOT NULL").count() == 1


def test_sample_is_stable_and_whole_per_key(spark):
    df = spark.range(20000).select((F.col("id") % 500).alias("k"), "id")
    a, b = src.sample(df, 0.3, ["k"]), src.sample(df.repartition(7), 0.3, ["k"])
    assert a.count() == b.count() and abs(a.select("k").distinct().count() / 500 - 0.3) < 0.08
    assert a.groupBy("k").count().filter("count <> 40").count() == 0


def test_dst_day_and_null_policies(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 06:30:00' AS a, TIMESTAMP_NTZ '2024-03-10 03:59:00' AS b, CAST(NULL AS STRING) AS n")
    r = df.select(fx.local_period("a", "America/New_York", "day").alias("x"), fx.local_period("b", "America/New_York", "day").alias("y"),
                  fx.concat_strict(F.lit("p"), "n").alias("s"), fx.concat_skip(F.lit("p"), "n", sep="-").alias("k"),
                  fx.hash_key(["n"]).alias("h1"), fx.hash_key([F.lit("")]).alias("h2")).first()
    assert r.x == dt.date(2024, 3, 10) and r.y == dt.date(2024, 3, 9)
    assert r.s is None and r.k == "p" and r.h1 != r.h2


EVENTS = "id long, k long, t timestamp_ntz, w string"


def write_batches(spark, folder, rows, n):
    """``n`` files in time order, so that one file is one micro-batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], EVENTS).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")


def event_rows(n=400):
    rows, state = [], 12345
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        k = 0 if state % 3 == 0 else state % 5
        rows.append((i, k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "s" if (state >> 8) % 2 else "e"))
    return rows


def test_streaming_cycles_over_batches_match_batch_result(spark, folder):
    rows = event_rows()
    write_batches(spark, folder, rows, 4)
    stream = ss.read_events_stream(spark, f"{folder}/in", EVENTS, files_per_batch=1)
    path = ss.cycles_stream(stream, "k", "t", "w", "s", "e", ["id"], f"{folder}/out")
    got = {tuple(r) for r in spark.read.parquet(path).select("k", "cycle_no", "started_at", "ended_at").collect()}
    batch = bz.build_cycles(spark.createDataFrame(rows, EVENTS), "k", "t", "w", "s", "e", ["id"]).filter("ended_at IS NOT NULL")
    assert got == {tuple(r) for r in batch.select("k", "cycle_no", "started_at", "ended_at").collect()} and got
    assert len({r.batch for r in spark.read.parquet(path).select("batch").distinct().collect()}) == 4


def test_stream_upsert_and_replay(spark, folder):
    rows = event_rows(100)
    write_batches(spark, folder, rows, 3)
    stream = ss.read_events_stream(spark, f"{folder}/in", EVENTS, files_per_batch=1)
    ss.upsert_stream(stream, f"{folder}/t", ["k"], ["t", "id"])
    ss._write_batch(spark.read.parquet(f"{folder}/t/log/batch=2").select("id", "k", "t", "w").cache(), f"{folder}/t/replayed", 2)
    ss.upsert_stream(stream, f"{folder}/t", ["k"], ["t", "id"])  # restart: nothing new
    got = {r.k: r.id for r in ss.read_upserted(spark, f"{folder}/t", ["k"], ["t", "id"]).collect()}
    want = {}
    for i, k, *_ in rows:
        want[k] = i
    assert got == want


def test_stream_rules_equal_batch_rules(spark, folder):
    rows = event_rows(60)
    write_batches(spark, folder, rows, 2)
    rules = [rl.accepted("w", ["s"]), rl.in_range("k", 0, 2)]
    stream = ss.read_events_stream(spark, f"{folder}/in", EVENTS, files_per_batch=1)
    good, bad = ss.validate_stream(stream, rules, f"{folder}/v")
    g, b = rl.quarantine(spark.createDataFrame(rows, EVENTS), rules)
    assert spark.read.parquet(good).count() == g.count() and spark.read.parquet(bad).count() == b.count()


def test_duplicates_in_later_batches_are_dropped(spark, folder):
    rows = event_rows(40)
    write_batches(spark, folder, rows + rows, 4)
    stream = ss.read_events_stream(spark, f"{folder}/in", EVENTS, files_per_batch=1)
    assert ss.run_to_table(ss.dedup_stream(stream, ["id"], "t", "2 days"), "d").count() == 40


def test_monitor_and_run_ledger(spark, folder):
    write_batches(spark, folder, event_rows(30), 3)
    stream = ss.read_events_stream(spark, f"{folder}/in", EVENTS, files_per_batch=1)
    ledger = spark.read.parquet(ss.monitor_stream(stream, "t", f"{folder}/m"))
    assert [r.n_rows for r in ledger.orderBy("batch_id").collect()] == [10, 10, 10]
    clock = lambda: dt.datetime(2024, 1, 1)
    ob.record_run(spark, f"{folder}/l", "ok", lambda: spark.range(7), f"{folder}/ok", clock)
    with pytest.raises(Exception, match="boom|DIVIDE"):
        ob.record_run(spark, f"{folder}/l", "bad", lambda: spark.range(2).selectExpr("raise_error('boom')"), f"{folder}/bad", clock)
    runs = {r.model: (r.status, r.n_rows) for r in spark.read.parquet(f"{folder}/l").collect()}
    assert runs == {"ok": ("success", 7), "bad": ("failed", None)}


def test_keyed_hash_vectors(spark):
    vectors = [(b"\x0b" * 20, "Hi There"), (b"Jefe", "what do ya want for nothing?"), (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First"), (b"k", "")]
    for key, text in vectors:
        got = spark.createDataFrame([(text,)], "v string").select(pv.hmac_sha256("v", key)).first()[0]
        assert got == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    assert spark.createDataFrame([(None,)], "v string").select(pv.hmac_sha256("v", b"k")).first()[0] is None


def test_suppression_and_cycles_in_graphs(spark):
    df = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 2.0)] * 4 + [(None, 3.0)] * 2, "g string, v double")
    out = {r.g: r.s for r in pv.suppress_small(df, ["g"], {"s": F.sum("v")}).collect()}
    assert out == {"a": 6.0, "b": None, None: None}
    assert pv.k_anonymous(df, ["g"], 4).count() == 10
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "s int, d int")
    got = {r.node: r.depth for r in pv.reachable(edges, spark.createDataFrame([(1,)], "node int"), "s", "d").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    path = spark.createDataFrame([(i, i + 1) for i in range(55)], "s int, d int").coalesce(1)
    assert pv.reachable(path, spark.createDataFrame([(0,)], "node int"), "s", "d").agg(F.max("depth")).first()[0] == 55


def test_pii_patterns(spark):
    df = spark.createDataFrame([("mail a.b@c.org or +49 170 1234567",), ("10.0.0.1 and 123-45-6789",), (None,)], "t string")
    got = {r.pattern: r.n_matches for r in pv.pii_scan(df, ["t"]).collect()}
    assert got == {"email": 1, "ipv4": 1, "phone": 1, "card": 0, "national_id": 1}


def test_repeated_alerts_are_one_page(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(hours=h), False) for h in (0, 5, 20, 60)] + [("r", t0 + dt.timedelta(hours=30), True)]
    out = ob.alerts(spark.createDataFrame(rows, "rule string, at timestamp_ntz, passed boolean"), ["rule"], "at")
    assert [r.is_suppressed for r in out.orderBy("at").collect()] == [False, True, True, False]


def test_stream_queries_over_a_folder_of_part_files(spark, data, folder):
    import duckdb
    from compare import compare

    import __spark_entry__ as entry

    spark.read.parquet(f"{data}/events.parquet").repartitionByRange(5, "ts").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    for name in ("a12_stream_source", "s1_dedup_stream", "s2_windowed_kpi", "s7_stateful_cycles", "s8_upsert_stream"):
        got = entry.queries()[name](spark, folder).toArrow()
        assert not compare(got, con.sql(entry.oracle_sql()[name]).to_arrow_table()), name
