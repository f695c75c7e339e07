"""Cleaning, rules, contracts, gates: every rule has rows that pass and rows that fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators import aggregate as ag
from tidemark.operators import business as bz
from tidemark.operators import contract
from tidemark.operators import profile as pf
from tidemark.operators import project as pr
from tidemark.operators import reconcile as rc
from tidemark.operators import rules as r

RAW = [
    (1, 101, "2024-01-01", "completed", 100.0, 1),
    (2, 102, "2024-01-02", "completed", 200.5, 2),
    (3, 103, "2024-01-02", "cancelled", -50.0, 3),
    (3, 103, "2024-01-02", "cancelled", 50.0, 4),
    (4, 104, "bad-date", "completed", 75.0, 5),
    (5, 105, "2024-01-03", "made-up-status", 25.0, 6),
]
VALID = ["pending", "completed", "cancelled", "refunded"]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, "order_id int, customer_id int, order_date string, status string, amount double, ingest_seq int")


def test_clean_orders(raw):
    out = pr.clean_orders(raw, "order_id", "order_date", "status", "amount", VALID, ["ingest_seq"])
    assert {x.order_id: x.amount for x in out.collect()} == {1: 100.0, 2: 200.5, 3: 50.0}
    late = pr.clean_orders(raw, "order_id", "order_date", "status", "amount", VALID, ["ingest_seq"], start="2024-01-02")
    assert {x.order_id for x in late.collect()} == {2, 3}


def test_missing_column_is_an_error(raw):
    with pytest.raises(ValueError, match="missing columns"):
        pr.clean_orders(raw.drop("status"), "order_id", "order_date", "status", "amount", VALID, ["ingest_seq"])


def test_conditional_counts(spark):
    df = spark.createDataFrame([(1, "completed", 100), (2, "completed", 200), (3, "cancelled", 50), (4, None, 10)], "id int, status string, amount int")
    out = ag.cond_agg(df, [], {"n": ("count", None, F.lit(True)), "done": ("count", None, F.col("status") == "completed"), "total": ("sum", "amount", F.lit(True))})
    assert out.first().asDict() == {"n": 4, "done": 2, "total": 360}


def verdicts(df, rules, **tables):
    out = r.run_suite({"t": df, **tables}, {"t": rules}).collect()
    return {x["rule"]: x["passed"] for x in out}


def test_rules_pass_and_fail(spark, raw):
    parents = spark.createDataFrame([(i,) for i in (101, 102, 103)], "id int")
    good = raw.filter("order_id < 3")
    rules = [
        r.accepted("status", VALID), r.in_range("amount", 0, 1000), r.pattern("order_date", r"^\d{4}-\d\d-\d\d$"), r.max_length("status", 9),
        *r.not_null(["order_id"]), r.unique(["order_id"]), r.foreign_key("customer_id", "p", "id"), r.row_count(1, 3),
        r.invariant("positive", F.col("amount") > 0), r.group_mean_range("amount", "status", {"completed": (100, 300, 2)}),
        r.expression_match("same", F.col("amount"), F.col("amount"), 0.0), r.custom_sql("none", "SELECT count(*) AS n FROM {t} WHERE amount < 0", 0),
    ]
    assert all(verdicts(good, rules, p=parents).values())
    bad = verdicts(raw.withColumn("order_id", F.when(F.col("ingest_seq") != 6, F.col("order_id"))), rules, p=parents)
    still_fine = {"group_mean:amount", "same"}
    assert {k for k, v in bad.items() if v} == still_fine, bad


def test_null_fails_an_invariant_and_ordering_skips_gaps(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 3), (3, None, 1), (None, None, None)], "a int, b int, c int")
    assert [x.ok for x in df.select(r.in_order(["a", "b", "c"]).alias("ok")).collect()] == [True, True, False, True]
    assert verdicts(df, [r.invariant("x", F.col("b") > 0)]) == {"x": False}


def test_cycle_rows(spark):
    rows = [(1, 10.0, 30.0, 38.83, 78.83, 1.0, False), (2, 90.0, 100.0, 90.83, 280.83, 0.875, True)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, total double, completeness double, fallback boolean")
    rules = [r.expression_match("sum", F.col("total"), F.col("a") + F.col("b") + F.col("c"), 0.083), r.in_range("completeness", 0.8, 1)]
    assert all(verdicts(df, rules).values())
    assert not verdicts(df, [r.in_range("completeness", 0.9, 1)])["range:completeness"]


def test_quarantine_keeps_every_row(raw):
    rules = [r.accepted("status", VALID), r.in_range("amount", 0, 1000)]
    good, bad = r.quarantine(raw, rules)
    assert good.count() + bad.count() == len(RAW)
    assert {tuple(x.failed_rules) for x in bad.collect()} == {("range:amount",), ("accepted:status",)}


def test_publish_gate(spark, raw, folder):
    fail = r.run_suite({"t": raw}, {"t": [r.unique(["order_id"])]})
    assert r.publish_if_ok(raw, f"{folder}/a", fail, {"critical": "block"}) == "blocked"
    assert r.publish_if_ok(raw, f"{folder}/b", fail, {"critical": "warn"}) == "published_with_warnings"
    assert spark.read.parquet(f"{folder}/b").count() == len(RAW)


def test_contract_loader_covers_all_kinds():
    text = """
name: t
columns: [{name: a, type: VARCHAR(3), required: true, primaryKey: true, pattern: "^x", allowedValues: [x]}, {name: n, type: INTEGER, minimum: 1}]
quality:
  all:
    - {id: 1, type: freshness, params: {timestampColumn: ts, loadedAtColumn: l, toleranceMinutes: 90, percentagePass: 99}}
    - {id: 2, type: partition_availability, params: {partitionColumn: ts, lookbackDays: 3, expectedMinRowsPerPartition: 5}}
    - {id: 3, type: ordered, params: {columns: [a, b]}, checks: {failed_rows_max: 5}}
    - {id: 4, type: expression_match, params: {leftExpression: a, rightExpression: b, toleranceAbsolute: 0.1}}
"""
    found = contract.rules_from_contract(text, as_of="2024-01-01")["t"]
    kinds = [x.check_type for x in found]
    assert kinds == [
        "not_null", "uniqueness", "pattern", "accepted_values", "max_length", "range",
        "freshness", "partition_availability", "event_order", "expression_match",
    ]
    with pytest.raises(ValueError, match="unknown rule type"):
        contract.quality_rule({"id": "z", "type": "nope"})


def test_schema_diff(spark):
    locked = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.LongType()), T.StructField("gone", T.StringType())])
    df = spark.createDataFrame([(1, 2, 3)], "a long, b int, extra int")
    got = {(x.column, x.change, x.severity) for x in r.schema_diff(df, locked).collect()}
    assert got == {("a", "widened", "warn"), ("a", "became_nullable", "fail"), ("b", "narrowed", "fail"), ("gone", "removed", "fail"), ("extra", "added", "warn")}


def test_profile_blanks_and_inference(spark):
    n = 100
    rows = [(f" {'' if i < 30 else i}", str(i) if i < 94 else "x", str(i) if i < 96 else "x", "2024-01-01" if i < 60 else "?") for i in range(n)]
    df = spark.createDataFrame(rows, "blank string, n94 string, n96 string, due_date string")
    prof = {x["column"]: x for x in pf.profile(df).collect()}
    assert prof["blank"].nulls == 30 and prof["blank"].completeness == 0.7
    assert {x["column"]: x["inferred"] for x in pf.infer_types(df).collect()} == {"blank": "numeric", "n94": "text", "n96": "numeric", "due_date": "datetime"}


def test_profile_edge_menu(spark):
    schema = "k int, v double, s string, ts timestamp_ntz"
    empty = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, schema)
    assert pf.duplicate_rows(empty).first().n_rows == 0
    assert {x.completeness for x in pf.profile(nulls).collect()} == {0.0}
    assert pf.duplicate_rows(nulls).first().n_duplicates == 2
    assert pf.histogram(nulls, "v").count() == 0
    assert pf.ts_gaps(nulls, "ts").count() == 0
    one = spark.createDataFrame([(1, 2.0, "a", dt.datetime(2024, 2, 29))], schema)
    assert pf.describe_numeric(one, ["v"]).first().q50 == 2.0
    assert pf.histogram(one, "v").first().n == 1
    assert pf.volume_by_period(one, "ts", "day").count() == 1


def test_row_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (2, None), (3, "y"), (4, "q"), (None, "n")], "k int, v string")
    got = {(x.k, x.status) for x in rc.row_diff(a, b, ["k"]).collect()}
    assert got == {(1, "changed"), (2, "changed"), (4, "extra")}


def test_not_idempotent_is_caught(spark):
    n = iter(range(1, 10))
    with pytest.raises(ValueError, match="changed the result"):
        rc.assert_idempotent(lambda: spark.range(next(n)))


def test_change_contribution(spark):
    before, after = [9.1, 4.8, 6.2, 28.4, 5.7], [16.4, 6.7, 7.8, 29.8, 6.3]
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(0, *before), (1, *after)], "p int, " + ", ".join(f"{c} double" for c in cols))
    got = {x.component: x for x in bz.change_contribution(df, F.col("p") == 1, cols).collect()}
    assert got["c0"].pct_of_change == pytest.approx(100 * 7.3 / 12.8)
    assert sum(x.pct_of_change for x in got.values()) == pytest.approx(100)


def test_contract_keys_that_no_rule_takes_raise():
    head = "tables: [{name: t, quality: {a: [{id: X, type: "
    for body in (
        "uniqueness, params: {columns: [k], filterClause: 'k > 0'}}]}}]",
        "not_null, params: {columns: [k]}, checks: {duplicate_count_max: 3}}]}}]",
        "partition_availability, params: {partitionColumn: d, readyByTime: '06:30:00', lookbackDays: 1, expectedMinRowsPerPartition: 1}}]}}]",
    ):
        with pytest.raises(ValueError):
            contract.rules_from_contract(head + body, "2024-01-01")


def test_partition_ready_by_time(spark):
    rows = [("2024-01-01 10:00:00", "2024-01-02 06:00:00"), ("2024-01-02 10:00:00", "2024-01-03 06:31:00")]
    df = spark.createDataFrame(rows, "d string, l string").select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in "dl"])
    for ready, want in ((None, 0.0), ("06:30:00", 1.0), ("07:00:00", 0.0)):
        rule = r.partition_ready("d", 1, "2024-01-01", 2, loaded="l", ready_by=ready)
        assert rule.build({}, df).first()["observed_value"] == want


def test_custom_sql_over_plain_and_qualified_names(spark):
    t = spark.createDataFrame([(1, 5), (2, 50), (2, 60)], "k int, v int")
    for sql in ("SELECT count(*) FROM t WHERE t.v > 10", "WITH x AS (SELECT * FROM gold.t) SELECT count(*) FROM x WHERE v > 10", "SELECT count(*) FROM {t} WHERE v > 10"):
        assert r.custom_sql("q", sql, 1).build({"t": t, "other": t}, t).first()["observed_value"] == 2.0
    share = r.custom_sql("q", "SELECT count(DISTINCT k) FROM t WHERE v > 10", max_pct=50.0, entity="k").build({"t": t}, t).first()
    assert share["observed_value"] == 50.0 and share["passed"]


def test_contract_columns_are_checked(spark):
    with pytest.raises(ValueError, match="requird"):
        contract.column_rules([{"name": "a", "requird": True}])
    spec = [
        {"name": "id", "type": "BIGINT", "required": True, "description": "key"}, {"name": "code", "type": "VARCHAR(5)", "references": "gold.dim.code"},
        {"name": "share", "type": "DECIMAL(5,4)"}, {"name": "n", "type": "INTEGER"}, {"name": "free"}, {"name": "gone", "type": "TIMESTAMP"},
    ]
    assert [x.check_type for x in contract.column_rules(spec)] == ["not_null", "max_length", "foreign_key"]
    assert [x.check_type for x in contract.column_rules(spec, linked=["code"])] == ["not_null", "max_length"]
    df = spark.createDataFrame([(1, "x", 0.5, 3)], "id long, code string, share double, n long")
    got = {(x.column, x.change, x.severity) for x in contract.schema_changes(df, spec).collect()}
    assert got == {("share", "widened", "warn"), ("n", "widened", "warn"), ("gone", "removed", "fail")}
