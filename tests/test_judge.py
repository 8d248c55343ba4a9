import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import accounts, judge, master, reports
from docloom.sources import converters, files
from docloom.streaming import intake


def test_receipt_dates(spark):
    want = {"Date: 2018-03-05 10:20": "2018-03-05", "31/01/70": "1970-01-31", "1.2.69": "2069-02-01", "12/25/2017": "2017-12-25", "25 Dec 2017": "2017-12-25", "DEC 5, 2017": "2017-12-05", "5-September-17": "2017-09-05", "31/02/2018": None, "no date": None, None: None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", converters.receipt_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == want
    totals = spark.createDataFrame([("RM -1,234.50",), ("",), ("1.2.3",)], "t string").select(converters.receipt_total(F.col("t")))
    assert [r[0] for r in totals.collect()] == [1234.5, None, None]


def test_checks_of_a_document(spark):
    kind = "doc_id long, pos long, vendor string, account string, gstin string, address string, total double, invoice_date string"
    history = spark.createDataFrame([(k, k, "a", "x1", "g1", "12 Market Road, Pune", 100.0 + k, "2026-01-01") for k in (1, 2)], kind)
    docs = spark.createDataFrame(
        [
            (10, 0, "a", "x1", "g1", "Pune, 12 Market Rd", 500.0, "2026-01-01", "exact_name"),
            (11, 0, "a", "x2", "g2", "Elsewhere 7", 102.0, "2026-02-01", "conflict"),
            (12, 0, None, "x2", "g2", "Elsewhere 7", 102.0, "2026-02-01", "unresolved"),
            (13, 0, "new", "x2", None, " ", 102.0, None, "exact_name"),
        ],
        kind + ", method string",
    )
    priced = spark.createDataFrame([(10, "REVIEW"), (10, "PASS"), (12, "FAIL")], "doc_id long, verdict string")
    checks = judge.validate_against_master(docs, history, priced)
    got = {}
    for r in checks.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.code)
    assert got == {10: ["price_deviation"], 11: ["gstin_conflict", "bank_account_changed", "gstin_mismatch", "address_mismatch", "possible_duplicate_payment"], 12: ["unknown_vendor"]}
    assert {r.doc_id: r.verdict for r in judge.verdicts(docs, checks).collect()} == {10: "REVIEW", 11: "FAIL", 12: "REVIEW", 13: "PASS"}


def test_master_is_what_was_saved(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A Ltd", 10.0, 1, " x "), (2, "trade", 20.0, 2, "y"), (3, None, 1.0, 3, "z")], "doc_id long, vendor string, total double, pos long, account string")
    lines = spark.createDataFrame([("A Ltd", "Paper, A4", 5.0), ("trade", "paper a4", 7.0)], "vendor string, description string, unit_price double")
    aliases = spark.createDataFrame([("trade", "A Ltd")], "alias string, legal string")
    master.build_master(docs, lines, ["account"], aliases).save(str(tmp_path))
    read = master.SupplierMaster.load(spark, str(tmp_path))
    r = read.record("A Ltd").first()
    assert (r.invoices, r.first_seen, r.mean, r["values"]) == (2, 1, 15.0, {"account": ["x", "y"]}) and read.record("trade").count() == 0
    assert [(r.item_key, r.median) for r in read.market.collect()] == [("papera4", 6.0)]


def test_accounts_of_documents(spark):
    lines = spark.createDataFrame([(1, 1, 100), (1, 2, 101)], "doc_id long, line_no int, query_id long")
    near = spark.createDataFrame([(100, 1, 0.9, "5010"), (100, 2, 0.8, "5010"), (101, 1, 0.1, "5020")], "query_id long, rank int, score double, category string")
    got = {r.line_no: (r.category, r.explanation) for r in accounts.categorize_documents(lines, near).collect()}
    assert got[1] == ("5010", "5010 with 1.00 of the votes") and got[2][0] is None and got[2][1].startswith("abstained: ")


def test_reports(spark):
    row = spark.createDataFrame([("r", 0.5, 0)], "run string, tax double, n int")
    assert json.loads(reports.serialized(row, {"tax": "n"}).first()[0]) == {"run": "r", "tax": None, "n": 0}
    assert row.select(reports.markdown([F.col("run"), F.lit(None)])).first()[0] == "| r | n/a |"
    odd = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0)] + [("b", 3.0), ("b", None)], "g string, x double")
    assert {r.g: r.upper_median for r in reports.upper_median(odd, ["g"], "x").collect()} == {"a": 2.0, "b": 3.0}


def test_manifests_and_documents(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"doc_id": d, "profile": "p"}) for d in "cab"))
    splits = spark.createDataFrame([("a", "test"), ("b", "train"), ("c", "train")], "doc_id string, split string")
    assert [r.doc_id for r in files.select_slice(files.read_manifest(spark, str(tmp_path / "m.jsonl"), "p"), splits, 2).collect()] == ["a", "c"]
    (tmp_path / "d.jsonl").write_text('{"doc_id": "x"}\n\n{"doc_id": "x", "document_type": "receipt"}\n')
    assert [(r.doc_id, r.document_type) for r in files.read_documents(spark, str(tmp_path / "d.jsonl")).collect()] == [("x", "receipt")]
    (tmp_path / "e.jsonl").write_text('{"doc_id": "x"}\noops\n')
    with pytest.raises(Exception, match="not a document"):
        files.read_documents(spark, str(tmp_path / "e.jsonl")).collect()


def test_a_batch_sees_what_was_accepted_before_it(spark, tmp_path):
    for batch in (0, 1):
        spark.createDataFrame([(str(batch), "accepted")], "doc_id string, status string").withColumn("batch", F.lit(batch)).write.parquet(f"{tmp_path}/batch={batch}")
    assert [r.doc_id for r in intake.accepted(spark, str(tmp_path), 1).collect()] == ["0"]
    assert intake.accepted(spark, str(tmp_path)).count() == 2
