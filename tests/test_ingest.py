import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holdfast.operators import typing as ty
from holdfast.plans.ingest import ingest_files
from holdfast.sources import files, tables


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def labels(spark, columns, rows):
    return ty.schema_of(ty.infer_types(frame(spark, columns, rows)))


def test_csv_edge_cases(spark, tmp_path):
    path = tmp_path / "a.csv"
    text = 'id,name,note\r\n1,"Ana ""A""","two\nlines"\r\n2,short\r\n3,long,x,extra\r\n'
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    rows = files.csv_scan(spark, str(path), multi_line=True)
    assert rows.columns == ["id", "name", "note"]
    got = [tuple(r) for r in rows.orderBy("id").collect()]
    assert got == [("1", 'Ana "A"', "two\nlines"), ("2", "short", None), ("3", "long", "x")]


def test_inference_order(spark):
    got = labels(
        spark,
        ["bits", "ints", "bigs", "huge", "decs", "iso", "dmy", "mixed", "empty", "text", "long"],
        [
            ("0", "1", "3000000000", "9" * 30, "1.5", "2025-10-14", "1/2/2025", "1", None, "x", "y" * 256),
            ("1", " 2 ", "1", "1", "2", "2025-10-14T10:00", "14/10/2025", "a", " ", "z", "z"),
        ],
    )
    assert got == {
        "bits": "TINYINT(1)", "ints": "INT", "bigs": "BIGINT", "huge": "BIGINT", "decs": "DECIMAL(18,6)",
        "iso": "DATETIME", "dmy": "DATE", "mixed": "VARCHAR(255)", "empty": "VARCHAR(255)",
        "text": "VARCHAR(255)", "long": "TEXT",
    }
    assert labels(spark, ["a", "b"], []) == {"a": "VARCHAR(255)", "b": "VARCHAR(255)"}


def test_coercion_and_rescue(spark):
    rows = frame(spark, ["b", "i", "d", "t", "s"], [("Yes", "7", "1.25", "1/2/2025", " x "), ("maybe", "n/a", "x", "bad", "")])
    schema = {"b": "TINYINT(1)", "i": "INT", "d": "DECIMAL(18,6)", "t": "DATE", "s": "VARCHAR(255)"}
    good, bad = [r.asDict() for r in ty.coerce_rows(rows, schema).orderBy(F.col("i").asc_nulls_last()).collect()]
    assert good == {"b": 1, "i": 7, "d": Decimal("1.250000"), "t": dt.date(2025, 2, 1), "s": "x", "_rescued": None}
    assert bad == {"b": None, "i": None, "d": None, "t": None, "s": None, "_rescued": {"b": "maybe", "i": "n/a", "d": "x"}}


def test_coercion_twice_is_the_same(spark):
    rows = frame(spark, ["i", "t"], [("5", "2025-10-14"), ("x", "14/10/2025 1:02:03")])
    schema = {"i": "INT", "t": "DATETIME"}
    once = ty.coerce_rows(rows, schema).drop("_rescued")
    twice = ty.coerce_rows(once.select(*[F.col(c).cast("string") for c in once.columns]), schema).drop("_rescued")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_append_overwrite_and_evolution(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.write_table(spark.range(3).toDF("a"), path) == 3
    assert tables.write_table(spark.range(2).select(F.col("id").alias("a"), F.lit("x").alias("b")), path) == 2
    rows = tables.read_table(spark, path)
    assert rows.columns == ["a", "b"] and rows.filter("b is null").count() == 3
    assert tables.write_table(spark.range(1).toDF("a"), path, overwrite=True) == 1
    assert tables.read_table(spark, path).count() == 1


def test_dense_row_ids(spark):
    rows = spark.range(0, 1000, 1, 7).filter("id % 3 <> 1 or id > 500")
    numbered = ty.with_dense_row_id(rows)
    ids = sorted(r[0] for r in numbered.select("_row_id").collect())
    assert ids == list(range(1, len(ids) + 1)) and len(ids) == rows.count()
    assert ty.with_dense_row_id(spark.range(0)).count() == 0


def test_ingest_report(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,when\n1,2025-10-14\n2,\n")
    report = ingest_files(spark, [(str(tmp_path / "s.csv"), "s"), (str(tmp_path / "no.csv"), "n")], str(tmp_path / "w"))
    assert [tuple(r) for r in report.collect()] == [("s", "loaded", 2), ("n", "missing", 0)]
    assert dict(tables.read_table(spark, str(tmp_path / "w/s")).dtypes)["when"] == "timestamp_ntz"


def test_json_top_level_must_be_an_array(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('\n [\n {"customer_id": 1, "prob_churn": 0.5, "top_reasons": []},\n {"customer_id": 2}]')
    bad.write_text('{"customer_id": 1}')
    assert files.json_records_scan(spark, str(good)).count() == 2
    with pytest.raises(ValueError):
        files.json_records_scan(spark, str(bad))


def test_json_array_is_read_by_splits(spark, tmp_path):
    """One line, with braces, brackets, quotes and escapes inside of strings, cut at places of every kind."""
    texts = ['}', '{"a": [', '\\"}{', 'x\\\\', 'é}é', "", "],[", "\n}"]
    rows = [{"customer_id": str(i), "name": texts[i % 8] * (i % 5), "top_reasons": [{"feature": texts[(i + j) % 8]} for j in range(i % 4)]} for i in range(400)]
    (tmp_path / "in").mkdir()
    for name, indent in (("line.json", None), ("pretty.json", 1)):
        text = json.dumps([{**r, "email": name} for r in rows], ensure_ascii=name == "line.json", indent=indent)
        (tmp_path / "in" / name).write_text(text, "utf-8")
    (tmp_path / "in" / "empty.json").write_text(" [ ]\n")
    (tmp_path / "in" / "blank.json").write_text("\n")
    conf = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        found = files.json_records_scan(spark, str(tmp_path / "in"))
        assert found.rdd.getNumPartitions() > 20
        got = found.select("email", "customer_id", "name", F.transform("top_reasons", lambda r: r["feature"]).alias("f")).collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    wanted = [(e, r["customer_id"], r["name"], [x["feature"] for x in r["top_reasons"]]) for e in ("line.json", "pretty.json") for r in rows]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_json_record_over_many_splits_and_broken_array(spark, tmp_path):
    long, broken = tmp_path / "long.json", tmp_path / "broken.json"
    long.write_text(json.dumps([{"name": "a"}, {"name": "b}" * 3000}, {}, {"name": "c"}]))
    broken.write_text('[{"name": "a"}, {"name": "b"')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = files.json_records_scan(spark, str(long)).collect()
        same = files.json_records_scan(spark, str(broken)).collect()
        before = spark.read.schema(files.RECORD).json(str(broken), multiLine=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["name"] or "" for r in got) == ["", "a", "b}" * 3000, "c"]
    assert same == before


def test_label_count(spark):
    rows = frame(spark, ["abandono"], [("1",), ("0",), ("x",), (None,), ("1",)])
    assert ty.label_count(rows).first()[0] == 2
