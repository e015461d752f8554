import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import features as ft

ASOF = "2025-04-01"
CUTOFF = dt.datetime(2025, 3, 31)
ATTENDANCE = "student_id long, class_date timestamp_ntz, present int"
PAYMENTS = "payment_id long, student_id long, payment_date timestamp_ntz, amount long, status string"
STUDENTS = "student_id long, signup_date string, plan string, price_usd string"


def day(back, hour=0):
    return CUTOFF - dt.timedelta(days=back) + dt.timedelta(hours=hour)


def one(df):
    return df.first().asDict()


def test_window_edges_and_midnight_rule(spark):
    dates = [day(0), day(0, 10), day(29), day(30), day(59), day(60), day(89), day(90)]
    rows = spark.createDataFrame([(1, d, 1) for d in dates], ATTENDANCE)
    got = one(ft.attendance_features(rows, ASOF))
    # 10:00 on the cutoff day is after its midnight and does not count.
    assert got == {
        "student_id": 1, "last_class": day(0), "total_classes_30d": 2, "total_classes_60d": 4, "total_classes_90d": 6,
    }


def test_absence_counts_as_last_class(spark):
    rows = spark.createDataFrame([(1, day(5), 0), (1, day(9), None)], ATTENDANCE)
    assert one(ft.attendance_features(rows, ASOF))["last_class"] == day(5)
    assert one(ft.attendance_features(rows, ASOF))["total_classes_30d"] == 1
    assert one(ft.attendance_features(rows, ASOF, present_only=True))["last_class"] == day(9)


def test_paid_statuses(spark):
    states = [None, "PAID", "Completed", "success", "approved", "ok", "pending", "failed", ""]
    rows = spark.createDataFrame([(i, 1, day(1), 10, s) for i, s in enumerate(states)], PAYMENTS)
    got = one(ft.payment_features(rows, ASOF))
    assert got["n_payments_90d"] == 6 and float(got["payments_90d_usd"]) == 60.0


def test_null_payment_ids_are_not_counted(spark):
    rows = spark.createDataFrame([(None, 1, day(1), 10, None), (5, 1, day(2), None, None)], PAYMENTS)
    got = one(ft.payment_features(rows, ASOF))
    assert got["n_payments_90d"] == 1 and float(got["payments_90d_usd"]) == 10.0


def test_never_and_dirty_students(spark):
    students = spark.createDataFrame(
        [(1, "unknown", None, "n/a"), (2, "2025-03-30 12:00:00", "A", "NaN"), (3, "2026-01-01", "B", "5")], STUDENTS
    )
    rows = ft.student_features(
        students, spark.createDataFrame([], ATTENDANCE), spark.createDataFrame([], PAYMENTS), ASOF
    ).orderBy("student_id")
    first, second, third = [r.asDict() for r in rows.collect()]
    assert first == {
        "student_id": 1, "plan": "None", "price_usd": 0.0, "tenure_days": 0, "days_since_last_attendance": 9999,
        "total_classes_30d": 0, "total_classes_60d": 0, "total_classes_90d": 0, "months_since_last_payment": 9999.0,
        "payments_90d_usd": 0.0, "n_payments_90d": 0,
    }
    assert second["tenure_days"] == 0 and second["price_usd"] == 0.0
    assert third["tenure_days"] == 0


def test_duplicate_students_are_kept(spark):
    students = spark.createDataFrame([(1, None, "A", "1"), (1, None, "B", "2")], STUDENTS)
    attendance = spark.createDataFrame([(1, day(3), 1)], ATTENDANCE)
    rows = ft.student_features(students, attendance, spark.createDataFrame([], PAYMENTS), ASOF).collect()
    assert len(rows) == 2 and all(r["days_since_last_attendance"] == 3 for r in rows)


def test_infer_asof(spark):
    att = spark.createDataFrame([(1, day(3), 1)], ATTENDANCE)
    pay = spark.createDataFrame([(1, 1, day(0), 1, "failed")], PAYMENTS)
    none_att, none_pay = spark.createDataFrame([], ATTENDANCE), spark.createDataFrame([], PAYMENTS)
    assert ft.infer_asof(att, pay).first()[0] == CUTOFF.date()
    assert ft.infer_asof(att, none_pay).first()[0] == day(3).date()
    assert ft.infer_asof(none_att, pay).first()[0] == CUTOFF.date()
    with pytest.raises(Exception, match="no dates"):
        ft.infer_asof(none_att, none_pay).collect()


def test_chosen_students_match_the_full_build(spark):
    rng = random.Random(3)
    students = spark.createDataFrame([(i, "2024-01-01", "A", "1") for i in range(20)], STUDENTS)
    attendance = spark.createDataFrame([(rng.randrange(20), day(rng.randrange(120)), rng.choice([0, 1, None])) for _ in range(300)], ATTENDANCE)
    payments = spark.createDataFrame([(i, rng.randrange(20), day(rng.randrange(120)), i, rng.choice([None, "paid", "no"])) for i in range(100)], PAYMENTS)
    full = {r["student_id"]: r for r in ft.student_features(students, attendance, payments, ASOF).collect()}
    wanted = [3, 7, 99]
    by_list = ft.features_of(wanted, students, attendance, payments, ASOF).collect()
    ids = spark.createDataFrame([(i,) for i in wanted], "student_id long")
    by_table = ft.features_of(ids, students, attendance, payments, ASOF).collect()
    assert sorted(by_list) == sorted(by_table) == sorted([full[3], full[7]])
    assert [r[0] for r in ft.unknown_students(ids, students).collect()] == [99]


def test_one_aggregation_equals_one_per_window(spark):
    rng = random.Random(11)
    history = [(rng.choice([1, 1, 1, 2, 3]), day(rng.randrange(-5, 130), rng.choice([0, 10])), rng.choice([0, 1, None])) for _ in range(500)]
    got = {r["student_id"]: r for r in ft.attendance_features(spark.createDataFrame(history, ATTENDANCE), ASOF).collect()}
    for s in (1, 2, 3):
        mine = [(d, 1 if p is None else p) for i, d, p in history if i == s and d <= CUTOFF]
        assert got[s]["last_class"] == max(d for d, _ in mine)
        for n in ft.WINDOWS:
            assert got[s][f"total_classes_{n}d"] == sum(p for d, p in mine if d >= CUTOFF - dt.timedelta(days=n - 1))


def test_history_is_scanned_and_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "att")
    spark.createDataFrame([(1, day(3), 1)], ATTENDANCE).write.parquet(path)
    plan = ft.attendance_features(spark.read.parquet(path), ASOF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "LessThanOrEqual(class_date" in plan


def test_align(spark):
    rows = spark.createDataFrame([(1, None, "x", float("nan"))], "student_id long, plan string, price_usd string, t double")
    got = ft.align_features(rows, ["t", "price_usd", "plan", "extra"], ["plan"], ["t", "price_usd", "extra"])
    assert got.columns == ["student_id", "t", "price_usd", "plan", "extra"]
    assert tuple(got.first()) == (1, 0.0, 0.0, "None", 0.0)
    assert ft.align_features(rows, ["student_id"], [], ["student_id"]).columns == ["student_id"]
