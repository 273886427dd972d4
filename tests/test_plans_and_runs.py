"""Matrix statistics by hand; published runs, upserts and rule tables at their edges."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelwave.operators import evaluate, reliability, views
from panelwave.operators import xsection as xs
from panelwave.plans import planted, run
from panelwave.streaming.bars import read_bars, read_rejected, upsert_bars

D0 = dt.date(2020, 1, 1)


def test_matrix_statistics_by_hand():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(23, 6)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 4], x[:, 5] = 1.5, np.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        rank, z = xs.matrix_pct_rank(x), xs.matrix_robust_z(x)
    for i in range(5):
        col = pd.Series(x[:, i])
        np.testing.assert_allclose(rank[:, i], col.rank(pct=True), rtol=1e-12)
        mad = (col - col.median()).abs().median()
        want = (col - col.median()) / (1.4826 * mad) if mad > 1e-8 else col * 0.0
        np.testing.assert_allclose(z[:, i], want, rtol=1e-12)
    assert np.isnan(rank[:, 5]).all() and np.isnan(z[:, 5]).all()


def test_matrix_columns_groups_across_batches(spark):
    df = spark.range(60).selectExpr("cast(id % 3 as int) as g", "case when id % 7 = 0 then null else cast(id as double) end as x").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = xs.matrix_columns(df, ["g"], ["x"], ["r"], xs.matrix_pct_rank).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    np.testing.assert_allclose(got.r, got.groupby("g").x.rank(pct=True), rtol=1e-12)
    assert xs.matrix_columns(df.limit(0), ["g"], ["x"], ["r"], xs.matrix_pct_rank).count() == 0


def test_a_failed_run_leaves_the_last_good_one(spark, tmp_path):
    root = str(tmp_path)
    t = spark.createDataFrame([("a", D0, 1.0)], "entity string, date date, score double")
    none = spark.createDataFrame([], "entity string, check string, severity string")
    error = spark.createDataFrame([("a", "E_x", "ERROR")], none.schema)
    assert run.published(spark, root).count() == 0
    assert not run.publish(spark, root, "r1", 1, {"scored": t, "findings": error})
    assert run.published(spark, root).count() == 0
    assert run.publish(spark, root, "r2", 2, {"scored": t, "findings": none})
    assert not run.publish(spark, root, "r3", 3, {"scored": t.withColumn("score", F.lit(9.0)), "findings": error})
    assert run.read_published(spark, root, "scored").collect() == t.collect()
    assert run.publish(spark, root, "r3", 3, {"scored": t.withColumn("score", F.lit(9.0)), "findings": error}, frozenset({"E_x"}))
    assert run.read_published(spark, root, "scored").head().score == 9.0
    assert {(r.run_id, r.table, r.n_rows) for r in run.published(spark, root).collect()} == {("r3", "scored", 1), ("r3", "findings", 1)}
    run.archive(spark, root)
    assert spark.read.parquet(f"{root}/archive/scored").head().snapshot_date == D0


def test_an_archived_table_without_rows_reads_as_empty(spark, tmp_path):
    root, none = str(tmp_path), spark.createDataFrame([], "entity string, date date, check string, severity string")
    scored = spark.createDataFrame([("a", D0, 1.0)], "entity string, date date, score double")
    assert run.publish(spark, root, "r1", 1, {"scored": scored, "findings": none, "anomalies": none})
    run.archive(spark, root)
    assert run.read_archive(spark, root, "anomalies").columns == [*none.columns, "snapshot_date"]
    assert run.read_archive(spark, root, "anomalies").count() == 0
    assert run.read_archive(spark, root, "scored").collect() == [("a", D0, 1.0, D0)]


def test_upsert_bars_merge_reject_and_replay(spark, tmp_path):
    root, schema = str(tmp_path), "u string, ts timestamp, p double"
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    batches = [
        [("a", at(1, 9), 5.0), ("a", at(1, 12), 7.0), ("b", at(2, 9), 1.0), (None, at(2, 9), 1.0), ("a", None, 1.0), ("a", at(2, 9), None)],
        [("a", at(1, 8), 4.0), ("a", at(5, 9), 9.0)],  # the first comes late, but in time
        [("a", at(1, 7), 3.0), ("b", at(5, 8), 2.0)],  # the first comes too late
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        writer = upsert_bars(stream, f"{root}/t", F.col("u"), "ts", F.col("p"), F.lit(1.0), F.struct("ts"), "2 days")
        writer.trigger(availableNow=True).start().awaitTermination()
    want = {("a", 1): (4.0, 7.0, 4.0, 7.0, 3.0), ("b", 2): (1.0, 1.0, 1.0, 1.0, 1.0), ("a", 5): (9.0,) * 4 + (1.0,), ("b", 5): (2.0,) * 4 + (1.0,)}
    got = lambda: {(r.entity, r.date.day): (r.open, r.high, r.low, r.close, r.volume) for r in read_bars(spark, f"{root}/t").collect()}
    assert got() == want
    assert sorted(r.reason for r in read_rejected(spark, f"{root}/t").collect()) == ["late", "missing_entity", "missing_price", "missing_time"]


def test_rules_are_rows(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 7.0, -3.0)], "entity string, x double, y double")
    rules = spark.createDataFrame([("x_high", "x", 0.0, 5.0, "WARN"), ("y_low", "y", -1.0, 1.0, "ERROR"), ("absent", "z", 0.0, 1.0, "ERROR")], reliability.RULE_SCHEMA)
    got = {(r.entity, r.check, r.severity, r.observed) for r in reliability.range_findings(df, rules).collect()}
    assert got == {("b", "x_high", "WARN", 7.0), ("b", "y_low", "ERROR", -3.0)}
    assert reliability.range_findings(df.limit(0), rules).count() == 0


def test_reconcile_reports_one_sided_keys(spark):
    rows = lambda ks: spark.createDataFrame([(f"e{k}", D0, "G", float(v)) for k, v in ks], "entity string, date date, grp string, close double")
    every = spark.createDataFrame([("G", 1.0)], "grp string, share double")
    got = {r.entity: (r.side, r.discrepant) for r in reliability.reconcile_keys(rows([(1, 10), (2, 10), (3, 10)]), rows([(2, 10), (3, 11), (4, 5)]), every).collect()}
    assert got == {"e1": ("only_a", True), "e2": ("both", False), "e3": ("both", True), "e4": ("only_b", True)}
    some = spark.createDataFrame([("G", 0.5)], "grp string, share double")
    a, b = rows([(k, 1) for k in range(200)]), rows([(k, 1) for k in range(200)])
    kept = reliability.reconcile_keys(a, b, some)
    assert 60 < kept.count() < 140 and kept.where("side != 'both'").count() == 0


def test_planted_faults_reach_their_columns(spark):
    df = spark.createDataFrame([(f"Brand#{k}", 1.0, "A") for k in range(1, 6)], "entity string, score double, grade string")
    faults = [(planted.number() == 3, "score", 130.0), (planted.number() == 4, "score", None), (planted.number() == 5, "grade", "Q")]
    got = {r.entity: (r.score, r.grade) for r in planted._put(df, faults).collect()}
    assert got == {"Brand#1": (1.0, "A"), "Brand#2": (1.0, "A"), "Brand#3": (130.0, "A"), "Brand#4": (None, "A"), "Brand#5": (1.0, "Q")}


def test_member_lists_split_groups_and_ties(spark):
    rows = [("hot", f"m{k:03d}", float(k % 2)) for k in range(300)] + [("small", "z", 1.0), ("small", "a", 1.0), ("small", "n", None), (None, "q", 1.0)]
    df = spark.createDataFrame(rows, "basket string, entity string, score double")
    got = views.member_lists(df, size=7, task_rows=40).collect()
    for group in ("hot", "small"):
        want = [m for _, m in sorted((-v, m) for g, m, v in rows if g == group and v is not None)]
        parts = sorted((r.part, r.n, r.members.split(", ")) for r in got if r.basket == group)
        assert [p for p, _, _ in parts] == list(range(-(-len(want) // 7))) and sum((m for _, _, m in parts), []) == want
        assert all(n == len(m) <= 7 for _, n, m in parts)
    assert {r.basket for r in got} == {"hot", "small"}
    assert {(r.basket, r.top_member, r.n) for r in views.top_members(df.where("basket is not null")).collect()} == {("hot", "m001", 300), ("small", "a", 2)}
    assert views.member_lists(df.limit(0)).count() == 0


def test_ic_gate_pins(spark):
    found = spark.createDataFrame([("s", 1, 0.011), ("s", 5, 0.05), ("s", 20, None)], "score_name string, horizon int, ic_mean double")
    pinned = spark.createDataFrame([("s", h, 0.01, 0.002) for h in (1, 5, 20, 60)], "score_name string, horizon int, expected double, tolerance double")
    got = {r.horizon: r.passed for r in evaluate.ic_gate(found, pinned, ("score_name", "horizon")).collect()}
    assert got == {1: True, 5: False, 20: False, 60: False}
