import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluate, extract, knowledge, quality, resolve, retrieval, review, rules
from docloom.sources import converters, files
from docloom.streaming import intake

PAGE = """TAX INVOICE  Meera & Co
12 Market Road, Pune
GSTIN: 27ABCDE1234F1Z0
Email: a@meera.in
Invoice No: INV-2026-001
Invoice Date: 05-01-2026
Due Date: 20-01-2026
Bill To
Arjun Traders
Description Qty Rate Amount
1 A4 Paper (500 sheets) 20 250.00 18% 5,000.00
2 Wireless Mouse 3 400.00 18% 1,200.00
Subtotal 6,200.00
CGST @ 9% 558.00
SGST @ 9% 558.00
Grand Total 7,316.00
Bank: State Bank
IFSC: SBIN0001234"""


def test_page_to_raw_document(spark):
    r = extract.extract(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    a = r[0]
    assert a.parties["vendor_name"] == "Meera & Co" and a.parties["vendor_gstin"] == "27ABCDE1234F1Z0" and a.parties["buyer_name"] == "Arjun Traders"
    assert a.invoice_meta["invoice_number"] == "INV-2026-001" and a.invoice_meta["due_date"] == "20-01-2026"
    assert a.totals["grand_total"] == 7316.0 and [t["type"] for t in a.tax_lines] == ["CGST", "SGST"] and a.tax_lines[0]["rate"] == 9.0
    assert [(i["description"], i["quantity"], i["unit_price"], i["line_total"]) for i in a.line_items] == [("A4 Paper (500 sheets)", 20.0, 250.0, 5000.0), ("Wireless Mouse", 3.0, 400.0, 1200.0)]
    assert a.payment_info["ifsc_or_swift"] == "SBIN0001234"
    assert r[1].totals == {} and r[2].line_items == []


def test_damaged_labels():
    assert extract.near_label("lnvoice N0: 77") == ("invoice_number", "77")
    assert extract.near_label("Invoice total: 77") is None
    assert extract.meta(["Due Date: 2026-01-20"])["invoice_date"] == "2026-01-20"  # a due date also fills an empty date


def test_reading_order(spark):
    words = spark.createDataFrame([(1, "b", [5.0, 0.0, 9.0, 2.0]), (1, "a", [0.0, 0.2, 4.0, 2.2]), (1, "c", [0.0, 5.0, 4.0, 7.0])], "doc_id long, text string, bbox array<double>")
    assert extract.reading_lines(words).first()["text"] == "a b\nc"


def test_resolution(spark):
    master = spark.createDataFrame([("Krishna Textiles", "29AAAAA0000A1ZY", 1), ("Arjun & Co", "27ABCDE1234F1Z0", 2)], "vendor string, gstin string, first_seen int")
    names = spark.createDataFrame([("Krishna Textiles", "Krishna Textiles", False, 1), ("Arjun & Co", "Arjun & Co", False, 2), ("KT Traders", "Krishna Textiles", True, 3)], "name string, legal string, is_alias boolean, pos int")
    docs = spark.createDataFrame(
        [(1, "Krishna Textiles", "29 AAAAA0000A1ZY"), (2, "Krishna Textile", None), (3, "Arjun & Co", "29AAAAA0000A1ZY"), (4, "Nobody", None), (5, "KT Traders", None), (6, None, None), (7, "Arjun & Co", None)],
        "doc_id long, name string, gstin string",
    )
    got = {r.doc_id: (r.method, r.vendor) for r in resolve.resolve(docs, master, names).collect()}
    assert got == {1: ("gstin", "Krishna Textiles"), 2: ("fuzzy_name", "Krishna Textiles"), 3: ("conflict", "Arjun & Co"), 4: ("unresolved", None), 5: ("fuzzy_name", "Krishna Textiles"), 6: ("unresolved", None), 7: ("exact_name", "Arjun & Co")}


def test_duplicate_payment_at_the_edges(spark):
    kind = "doc_id long, vendor string, total double, invoice_date string, pos int"
    past = spark.createDataFrame([(10, "v", 100.0, "2026-01-01", 1), (11, "v", 100.01, "2026-02-15", 2), (12, "w", 100.0, "2026-01-01", 3)], kind)
    now = spark.createDataFrame([(1, "v", 100.0, "2026-02-15", 9), (2, "v", 100.0, "2026-02-16", 9), (3, "v", 100.03, "2026-01-01", 9), (4, None, 100.0, "2026-01-01", 9)], kind)
    assert {r.doc_id: r.other_doc for r in rules.duplicate_payments(now, past).collect()} == {1: 10, 2: 11}


def test_duplicate_payments_without_nine_copies(spark):
    rng = random.Random(5)
    at = lambda: (rng.choice("vw"), round(rng.choice([rng.uniform(-60, 60), float(rng.randrange(-60, 60))]), 2), rng.randrange(20_000, 20_400))
    docs = [(i, *at()) for i in range(400)] + [(400, "v", None, 20_000), (401, "v", float("nan"), 20_000), (402, "w", 1e15, 20_000), (403, "w", 1e15 + 1, 20_003), (405, "w", 1e18, 20_000), (406, "w", 1e18, 20_003), (407, "w", 1e300, 20_000), (404, "v", 3.0, None)]
    iso = lambda d: None if d is None else str(datetime.date(1970, 1, 1) + datetime.timedelta(d))
    table = spark.createDataFrame([(i, v, t, iso(d), -i) for i, v, t, d in docs], "doc_id long, vendor string, total double, invoice_date string, pos int")
    whole = [x for x in docs if x[2] is not None and x[2] == x[2] and x[3] is not None]
    want = {}
    for i, v, t, d in whole:
        near = [j for j, w, u, e in whole if i != j and v == w and abs(t - u) <= 1.5 + 1e-9 and abs(d - e) <= 45]
        if near:
            want[i] = max(near)
    found = rules.duplicate_payments(table, table, cents=1.5)
    assert {r.doc_id: r.other_doc for r in found.collect()} == want and len(want) > 100 and want[402] == 403
    moved = spark.range(20_000).selectExpr("id AS doc_id", "'v' AS vendor", "double(hash(id) % 1000000) / 7 AS total", "date_format(date_add('2020-01-01', cast(id % 2000 AS int)), 'yyyy-MM-dd') AS invoice_date", "id AS pos")
    far = rules.duplicate_cells(moved.select(F.col("doc_id").alias("other_doc"), "total", "pos", F.to_date("invoice_date").alias("date")), 45, 1.5)
    assert 20_000 <= far.count() < 2 * 20_000


def test_checks_need_history(spark):
    past = spark.createDataFrame([("v", "A1", None), ("v", "A1", "G1"), ("new", "B1", None)], "vendor string, account string, gstin string")
    known = knowledge.identities(past, ["account", "gstin"])
    counts = past.groupBy("vendor").agg(F.count("*").alias("invoices"))
    docs = spark.createDataFrame([(1, "v", " A1 ", "G1"), (2, "v", "A2", "G2"), (3, "new", "B2", None), (4, None, "A2", None)], "doc_id long, vendor string, account string, gstin string")
    assert {(r.doc_id, r.code) for r in rules.identity_checks(docs, known, counts).collect()} == {(2, "bank_account_changed"), (2, "gstin_mismatch")}


def test_zscore_without_spread(spark):
    rows = spark.createDataFrame([("a", 5.0)] * 4 + [("b", 1.0)], "vendor string, total double")
    s = knowledge.vendor_amounts(rows)
    z = spark.createDataFrame([("a", 5.0), ("a", 6.0), ("b", 1.0)], "vendor string, total double").join(s, "vendor")
    got = z.select("vendor", "total", knowledge.amount_zscore(*(F.col(c) for c in ("total", "n", "mean", "std"))).alias("z")).collect()
    assert {(r.vendor, r.total): r.z for r in got} == {("a", 5.0): 0.0, ("a", 6.0): float("inf"), ("b", 1.0): None}


def test_arithmetic(spark):
    line = "array<struct<quantity:double,unit_price:double,discount:double,tax_rate:double,line_total:double>>"
    totals = "struct<subtotal:double,tax_total:double,shipping:double,round_off:double,grand_total:double>"
    rows = spark.createDataFrame(
        [
            (1, [(2.0, 500.0, None, None, 1000.0)], [(90.0,), (90.0,)], (1000.0, 180.0, None, None, 1180.0)),
            (2, [(2.0, 500.0, None, None, 1500.0)], [(90.0,)], (1000.0, 180.0, None, None, 1300.0)),
            (3, None, None, (None, None, None, None, None)),
        ],
        f"doc_id long, line_items {line}, tax_lines array<struct<amount:double>>, totals {totals}",
    )
    got = {r[0]: r[1] for r in rows.select("doc_id", quality.arithmetic_problems(F.col("line_items"), F.col("tax_lines"), F.col("totals"))).collect()}
    assert got[1] == [] and sorted(got[2]) == ["grand_total", "line", "subtotal", "tax_total"]


def test_conformance(spark):
    whole = {"schema_version": "1.0.0", "doc_id": "x", "source": {}, "document_type": "invoice", "pages": [], "parties": {}, "invoice_meta": {"invoice_date": None}, "line_items": [], "totals": {}}
    rows = [json.dumps(whole), json.dumps(whole | {"zz": 1}), json.dumps({k: v for k, v in whole.items() if k != "totals"}), "{oops", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "raw string").select(quality.schema_problems(F.col("raw"))).collect()]
    assert got == [[], ["unknown zz"], ["missing totals"], ["unreadable"], ["unreadable"]]


def test_golden_fields(spark):
    kind = "doc_id string, path string, value string"
    gold = spark.createDataFrame([("a", "totals.grand_total", "100"), ("a", "parties.vendor.name", "Meera & Co"), ("a", "invoice_meta.invoice_date", None), ("b", "totals.grand_total", "5")], kind)
    pred = spark.createDataFrame([("a", "totals.grand_total", "100.5"), ("a", "parties.vendor.name", "Mera & Co"), ("a", "parties.buyer.name", "x"), ("c", "totals.grand_total", "1")], kind)
    got = {(r.doc_id, r.path): r.correct for r in evaluate.compare_fields(gold, pred).collect()}
    assert got == {("a", "totals.grand_total"): True, ("a", "parties.vendor.name"): True, ("a", "invoice_meta.invoice_date"): True, ("a", "parties.buyer.name"): False, ("b", "totals.grand_total"): False}


def test_items_boxes_and_text(spark):
    item = "doc_id long, items array<struct<description:string,line_total:double>>"
    gold = spark.createDataFrame([(1, [("paper", 5.0), ("mouse", 9.0)]), (2, None), (3, [("desk", 1.0)])], item)
    pred = spark.createDataFrame([(1, [("mouse", 9.0), ("papr", 5.0), ("zzzz", 0.0)]), (2, [("x", 1.0)])], item)
    got = {r.doc_id: (r.n_gold, r.n_pred, r.n_matched) for r in evaluate.match_items(gold, pred).collect()}
    assert got == {1: (2, 3, 2), 2: (0, 1, 0), 3: (1, 0, 0)}
    box = "doc_id long, pos int, text string, bbox array<double>"
    g = spark.createDataFrame([(1, 0, "a", [0.0, 0.0, 2.0, 2.0]), (1, 1, "b", [5.0, 5.0, 6.0, 6.0])], box)
    p = spark.createDataFrame([(1, 0, "a", [0.0, 0.0, 2.0, 2.0]), (1, 1, "a", [0.0, 0.0, 2.0, 1.9])], box)
    r = evaluate.match_boxes(g, p).first()
    assert (r.n_gold, r.n_pred, r.n_matched, r.n_text) == (2, 2, 1, 1)
    pages = spark.createDataFrame([(1, "Ab c", "ab c"), (2, "", "x")], "doc_id long, gold string, pred string")
    e = {r.doc_id: r for r in evaluate.text_errors(pages).collect()}
    assert e[1].cer == 0.25 and e[1].ncer == 0 and e[2].wer == 1


def test_vote(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    m = spark.createDataFrame(
        [(1, 1, 0.8, "5010", "v"), (1, 2, 0.5, "5020", "v"), (2, 1, 0.3, "5010", "v"), (3, 1, 0.6, "5010", "v"), (3, 2, 0.6, "5020", "v"), (4, 1, 0.1, "5010", "v")],
        "query_id long, rank int, score double, category string, vendor string",
    )
    got = {r.query_id: (r.category, r.reason) for r in retrieval.vote(q, m).collect()}
    assert got == {1: ("5010", "voted"), 2: (None, "weak neighbours"), 3: ("5010", "voted"), 4: (None, "no neighbour")}
    usual = spark.createDataFrame([("v", "5020")], "vendor string, category string")
    assert {r.query_id: r.category for r in retrieval.vote(q, m, usual).collect()}[3] == "5020"
    with pytest.raises(ValueError):
        retrieval.retriever("none")


def test_grams(spark):
    got = spark.createDataFrame([("A bc",), ("",), (None,)], "t string").select(retrieval.char_grams(F.col("t"))).collect()
    assert sorted(got[0][0]) == sorted([" a ", " bc", "bc ", " bc "]) and got[1][0] == []


def test_router(spark):
    fields = spark.createDataFrame([("rules", "d", "p", "1"), ("model", "d", "p", "2"), ("rules", "e", "p", "3")], "extractor string, doc_id string, path string, value string")
    policy = spark.createDataFrame([("p", "model")], "path string, winner string")
    assert {r.doc_id: r.value for r in evaluate.routed(fields, policy, "rules").collect()} == {"d": "2", "e": "3"}


def test_review_guards(spark):
    items = spark.createDataFrame([(1, "d", "5010"), (2, "d", None)], "item_id int, doc_id string, category string")
    log = spark.createDataFrame([(9, 9)], "decision_id int, item_id int")
    asked = spark.createDataFrame(
        [(1, 1, "ann", "accept", None), (2, 1, "bob", "accept", None), (3, 2, "ann", "accept", None), (4, 7, "ann", "accept", None), (5, 2, "", "correct", "5010")],
        "request_id int, item_id int, reviewer string, action string, category string",
    )
    got = {r.request_id: r.error for r in review.judged(asked, items, log, ["5010"]).collect()}
    assert got == {1: None, 2: "already decided", 3: "nothing to accept", 4: "unknown item", 5: "no reviewer"}
    documents = spark.createDataFrame([("d", "FAIL", "blocked"), ("e", "PASS", "review"), ("f", "PASS", "accepted")], "doc_id string, verdict string, status string")
    asked = spark.createDataFrame([("d", "accept", None), ("e", "accept", None), ("f", "accept", None), ("g", "accept", None)], "doc_id string, action string, reason string")
    got = {r.doc_id: r.error for r in review.document_decisions(asked, documents, spark.createDataFrame([("e", 2)], "doc_id string, item_id int")).collect()}
    assert got == {"d": "needs an override", "e": "open lines", "f": "already decided", "g": "unknown document"}


def test_last_line_of_a_document_counts(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"doc_id":"a","currency":"INR"}\n\n{"doc_id":"b"}\n{"doc_id":"a","currency":"USD"}\n')
    assert {r.doc_id: r.currency for r in files.read_documents(spark, str(tmp_path / "d.jsonl")).collect()} == {"a": "USD", "b": None}


def test_converters(spark):
    menu = spark.createDataFrame([('[{"nm":"tea","cnt":"2","price":"1,000"},{"nm":"cake"}]',), ('{"nm":"tea","price":"5"}',), (None,)], "m string").select(converters.receipt_items(F.col("m")).alias("i")).collect()
    assert [(x["line_no"], x["description"], x["line_total"]) for x in menu[0].i] == [(1, "tea", 1000.0), (2, "cake", None)] and menu[1].i[0]["line_total"] == 5.0
    tokens = spark.createDataFrame([("d", "description", 10.0, 2.0, "tea"), ("d", "amount", 10.2, 2.0, "5"), ("d", "description", 14.0, 2.0, "cake")], "doc_id string, kind string, y double, h double, text string")
    assert [(r.description, r.amount) for r in converters.zone_amounts(tokens).orderBy("line_no").collect()] == [("tea", "5"), ("cake", None)]


def test_intake_restarts_where_it_was(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    judge = lambda batch, before: batch.withColumn("status", F.lit("accepted")).withColumn("known", F.lit(0 if before is None else before.count()))
    for k in range(2):
        (source / f"{k}.json").write_text(json.dumps({"doc_id": str(k), "vendor": "v", "total": 1.0}))
        intake.process_folder(spark, str(source), "doc_id string, vendor string, total double", store, str(tmp_path / "cp"), judge).awaitTermination()
    assert {r.doc_id: r.known for r in spark.read.parquet(store).collect()} == {"0": 0, "1": 1}
