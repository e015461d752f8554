"""Staff reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import reports, search
from holdfast.session import work_path
from workload.oracle import PAID, statement
from workload.tables import ASOF, core, view


def kpi_month_revenue(spark, sf_dir):
    return reports.month_revenue(view(spark, sf_dir, "payments"), ASOF)


def income_by_month(spark, sf_dir):
    return reports.income_by_month(view(spark, sf_dir, "payments"))


def delinquents(spark, sf_dir):
    _, _, payments = core(spark, sf_dir)
    late = reports.delinquents(view(spark, sf_dir, "contacts"), payments, "2000-10-01", ASOF)
    return late.select("student_id", "name")


def active_students(spark, sf_dir):
    return reports.active_students(view(spark, sf_dir, "enrollments"), view(spark, sf_dir, "contacts"))


def active_students_of_course(spark, sf_dir):
    return reports.active_students(view(spark, sf_dir, "enrollments"), view(spark, sf_dir, "contacts"), course="C3")


def course_calendar(spark, sf_dir):
    days = reports.course_calendar(view(spark, sf_dir, "sessions"))
    return days.withColumn("class_date", F.col("class_date").cast("date").cast("string"))


def course_calendar_of_course(spark, sf_dir):
    days = reports.course_calendar(view(spark, sf_dir, "sessions"), course_id=7)
    return days.withColumn("class_date", F.col("class_date").cast("date").cast("string"))


def attendance_by_class(spark, sf_dir):
    return reports.attendance_by_class(view(spark, sf_dir, "attendance"))


def duplicate_emails(spark, sf_dir):
    """Students of the same plan share an address here, written in different ways."""
    shared = F.concat(F.lit(" "), F.when(F.col("student_id") % 2 == 0, F.upper("plan")).otherwise(F.lower("plan")), F.lit("@Example.com"))
    rows = view(spark, sf_dir, "contacts").withColumn("email", F.when(F.col("student_id") % 5 == 0, shared).otherwise(F.col("email")))
    return reports.duplicate_emails(rows)


# A name that one student has, a part of every e-mail, a part of some names, one too short for the index, and one of nobody.
SEARCHED = ("R#000000012", ".COM", "#00000001", "r#", "nobody here")


def student_search(spark, sf_dir):
    """Each text looked up in one index, with the number of results beside the rows."""
    students = view(spark, sf_dir, "contacts").select("student_id", "name", "email")
    index = search.write_index(students, work_path(spark, "search"))
    out = None
    for text in SEARCHED:
        rows = search.with_result_count(search.search(spark, index, students, text))
        rows = rows.select(F.lit(text).alias("searched"), "student_id", "name", "results")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "kpi_month_revenue": kpi_month_revenue,
    "income_by_month": income_by_month,
    "delinquents": delinquents,
    "active_students": active_students,
    "active_students_of_course": active_students_of_course,
    "course_calendar": course_calendar,
    "course_calendar_of_course": course_calendar_of_course,
    "attendance_by_class": attendance_by_class,
    "duplicate_emails": duplicate_emails,
    "student_search": student_search,
}

ORACLES = {
    "kpi_month_revenue": statement(
        f"""SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) AS month_revenue, count(*) AS payments FROM payments
WHERE {PAID} AND date_trunc('month', payment_date) = DATE '2001-01-01'""",
        "payments",
    ),
    "income_by_month": statement(
        f"""SELECT strftime(payment_date, '%Y-%m') AS month, CAST(sum(amount) AS DOUBLE) AS income, count(*) AS payments
FROM payments WHERE {PAID} GROUP BY 1""",
        "payments",
    ),
    "delinquents": statement(
        f"""SELECT student_id, name FROM contacts WHERE student_id NOT IN (SELECT student_id FROM payments
WHERE {PAID} AND payment_date >= DATE '2000-10-01' AND payment_date < DATE '{ASOF}')""",
        "contacts",
        "payments",
    ),
    "active_students": statement(
        """SELECT e.student_id, e.course, c.name, c.plan FROM enrollments e JOIN contacts c USING (student_id) WHERE e.is_active""",
        "enrollments",
        "contacts",
    ),
    "course_calendar": statement("SELECT course_id, CAST(CAST(class_date AS DATE) AS VARCHAR) AS class_date FROM sessions", "sessions"),
    "active_students_of_course": statement(
        """SELECT e.student_id, e.course, c.name, c.plan FROM enrollments e JOIN contacts c USING (student_id) WHERE e.is_active AND e.course = 'C3'""",
        "enrollments",
        "contacts",
    ),
    "course_calendar_of_course": statement(
        "SELECT course_id, CAST(CAST(class_date AS DATE) AS VARCHAR) AS class_date FROM sessions WHERE course_id = 7", "sessions"
    ),
    "attendance_by_class": statement(
        """SELECT session_id, count(*) AS students, count(*) FILTER (WHERE coalesce(present, 1) = 1) AS present,
count(*) FILTER (WHERE present = 0) AS absent FROM attendance GROUP BY session_id""",
        "attendance",
    ),
    "duplicate_emails": statement(
        """SELECT email, count(*) AS n FROM (SELECT lower(trim(CASE WHEN student_id % 5 = 0 THEN plan || '@example.com' ELSE email END)) AS email FROM contacts)
WHERE email <> '' GROUP BY email HAVING count(*) > 1""",
        "contacts",
    ),
    "student_search": statement(
        f"""SELECT searched, student_id, name, count(*) OVER (PARTITION BY searched) AS results
FROM contacts, (SELECT unnest([{", ".join(f"'{t}'" for t in SEARCHED)}]) AS searched)
WHERE contains(lower(name), lower(searched)) OR contains(lower(email), lower(searched))""",
        "contacts",
    ),
}
