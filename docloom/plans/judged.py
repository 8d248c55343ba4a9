"""Queries over whole judgements, the supplier master, accounts, receipts, reports and review, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import parse
from docloom.operators import accounts, judge, knowledge, master, quality, reports, review
from docloom.plans.adapter import invoice_vendor, invoices, lines, table
from docloom.plans.queries import _INVOICES, _LINES, query
from docloom.sources import converters, files

_DOCS = f"""{_INVOICES}, {_LINES}, v AS (SELECT doc_id, min(vendor) AS vendor FROM lines GROUP BY doc_id), due AS (SELECT l_orderkey AS doc_id, min(CAST(l_shipdate AS DATE)) AS due FROM lineitem GROUP BY 1),
f1 AS (SELECT number, arg_min(doc_id, {{'d': invoice_date, 'i': doc_id}}) AS first_doc FROM invoices GROUP BY number),
docs AS (SELECT doc_id, vendor, floor(total / 500) * 500 AS total, day, due, first_doc FROM invoices JOIN v USING (doc_id) JOIN due USING (doc_id) JOIN f1 USING (number)),
s AS (SELECT vendor, count(*) AS n, avg(total) AS mean, stddev_pop(total) AS std FROM docs GROUP BY vendor),
z AS (SELECT docs.*, CASE WHEN n >= 4 THEN (total - mean) / std END AS z FROM docs JOIN s USING (vendor)),
f AS (SELECT doc_id, 'future_invoice_date' AS code, 2 AS sev, 'rule' AS signal, 1 AS place FROM docs WHERE day > DATE '1998-06-30' UNION ALL
  SELECT doc_id, 'due_before_invoice', 1, 'rule', 2 FROM docs WHERE due < day UNION ALL
  SELECT doc_id, 'duplicate_invoice_number', 2, 'rule', 3 FROM docs WHERE first_doc <> doc_id UNION ALL
  SELECT doc_id, 'invalid_gst_rate', 1, 'rule', 4 FROM lines WHERE line_no = 1 AND tax_rate NOT IN (0, 0.125, 0.25, 1.5, 2.5, 3, 5, 6, 9, 12, 14, 18, 28) UNION ALL
  SELECT doc_id, 'invalid_gstin', 2, 'rule', 5 FROM docs WHERE vendor % 7 = 0 UNION ALL
  SELECT doc_id, 'arithmetic_mismatch', 2, 'rule', 6 FROM docs WHERE doc_id % 9 = 0 AND total > 0 UNION ALL
  SELECT doc_id, 'unusual_amount_for_vendor', CASE WHEN abs(z) > 5 THEN 2 ELSE 1 END, 'statistical', 7 FROM z WHERE abs(z) > 3 UNION ALL
  SELECT doc_id, 'suspiciously_round_total', 0, 'statistical', 8 FROM docs WHERE total >= 10000 AND total % 1000 = 0 UNION ALL
  SELECT doc_id, 'unknown_vendor', 0, 'semantic', 9 FROM docs WHERE vendor % 5 = 0 UNION ALL
  SELECT doc_id, 'novel_line_item', 0, 'semantic', 10 FROM lines WHERE line_no = 1 AND quantity = 1),
u AS (SELECT DISTINCT doc_id FROM f WHERE code = 'unknown_vendor'),
g AS (SELECT * FROM f UNION ALL SELECT DISTINCT doc_id, 'combined_unknown_vendor_' || code, 1, 'semantic', 11 FROM f JOIN u USING (doc_id) WHERE code IN ('suspiciously_round_total', 'unusual_amount_for_vendor', 'novel_line_item'))"""


def _all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of every invoice; suppliers by number stand for bad tax numbers and strangers, small first lines for novel ones."""
    li = lines(spark, sf_dir)
    due = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("due_date"))
    base = invoices(spark, sf_dir).withColumn("number", parse.normalize_invoice_number(F.col("invoice_number")))
    docs = base.join(knowledge.first_seen_numbers(base, ["invoice_date", "doc_id"]), "number").join(invoice_vendor(spark, sf_dir), "doc_id").join(due, "doc_id")
    docs = docs.withColumn("total", (F.floor(F.col("total") / 500) * 500).cast("double")).withColumn("gstin", F.when(F.col("vendor") % 7 == 0, "no such number"))
    none = F.lit(None).cast("double")
    row = F.array(F.struct(none.alias("quantity"), none.alias("unit_price"), none.alias("discount"), none.alias("tax_rate"), F.col("total").alias("line_total")))
    totals = F.struct(F.when(F.col("doc_id") % 9 == 0, F.col("total") * 2).otherwise(F.col("total")).alias("subtotal"), none.alias("tax_total"), none.alias("shipping"), none.alias("round_off"), none.alias("grand_total"))
    docs = docs.withColumn("arithmetic_problems", F.size(quality.arithmetic_problems(row, F.array().cast("array<struct<amount:double>>"), totals)))
    firsts = li.where("line_no = 1")
    best = firsts.select("doc_id", F.when(F.col("quantity") == 1, 0.1).otherwise(0.9).alias("top"))
    taxes = firsts.select("doc_id", F.col("tax_rate").alias("rate"))
    return judge.detect_anomalies(docs, taxes, knowledge.vendor_amounts(docs), docs.where("vendor % 5 <> 0").select("vendor"), best, F.lit("1998-06-30").cast("date"))


@query(f"WITH {_DOCS} SELECT doc_id, string_agg(code, ',' ORDER BY sev DESC, place, code) AS codes, CASE max(sev) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM g GROUP BY doc_id")
def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of every flagged document, worst first."""
    flags = _all_flags(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "code", "severity")))
    return flags.groupBy("doc_id").agg(ordered.alias("f")).select("doc_id", F.array_join(F.transform("f", lambda x: x["code"]), ",").alias("codes"), F.col("f")[0]["severity"].alias("severity"))


@query(f"WITH {_DOCS} SELECT doc_id, signal, string_agg(code, ',' ORDER BY sev DESC, place, code) AS codes FROM g GROUP BY doc_id, signal")
def flags_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.by_signal(_all_flags(spark, sf_dir)).withColumn("codes", F.array_join("codes", ","))


_PLACES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_CASES = "CASE {x} % 5 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PLACES)) + " END"
_HISTORY = f"""a AS (SELECT o_orderkey AS doc_id, o_custkey % 50 AS vendor, floor(o_totalprice / 100) * 100 AS total, CAST(o_orderdate AS DATE) AS day, o_custkey AS c FROM orders),
h AS (SELECT *, 'acc' || CAST(c % 3 AS VARCHAR) AS account, 'G' || CAST(c % 2 AS VARCHAR) AS gstin, {_CASES.format(x="c")} AS address FROM a WHERE doc_id % 4 <> 0),
q0 AS (SELECT *, 'acc' || CAST(c % 4 AS VARCHAR) AS account, 'G' || CAST(c % 5 AS VARCHAR) AS gstin, {_CASES.format(x="doc_id")} AS address, CASE WHEN doc_id % 13 = 0 THEN 'unresolved' WHEN doc_id % 17 = 0 THEN 'conflict' ELSE 'exact_name' END AS method FROM a WHERE doc_id % 4 = 0),
q AS (SELECT * FROM q0 WHERE method <> 'unresolved' AND vendor IN (SELECT vendor FROM h GROUP BY vendor HAVING count(*) >= 2)), r AS (SELECT * FROM q0 WHERE method <> 'unresolved'),
k AS (SELECT doc_id, 'unknown_vendor' AS code, 1 AS v FROM q0 WHERE method = 'unresolved' UNION ALL SELECT doc_id, 'gstin_conflict', 2 FROM r WHERE method = 'conflict' UNION ALL
  SELECT doc_id, 'bank_account_changed', 2 FROM q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.vendor = q.vendor AND h.account = q.account) UNION ALL
  SELECT doc_id, 'gstin_mismatch', 2 FROM q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.vendor = q.vendor AND h.gstin = q.gstin) UNION ALL
  SELECT doc_id, 'address_mismatch', 1 FROM r WHERE EXISTS (SELECT 1 FROM h WHERE h.vendor = r.vendor) AND NOT EXISTS (SELECT 1 FROM h WHERE h.vendor = r.vendor AND (h.address = r.address OR (h.address LIKE 'A%RICA' AND r.address LIKE 'A%RICA'))) UNION ALL
  SELECT doc_id, 'price_deviation', CASE WHEN l_quantity = 50 THEN 2 ELSE 1 END FROM lineitem JOIN r ON doc_id = l_orderkey WHERE l_linenumber = 1 AND l_quantity >= 49 UNION ALL
  SELECT doc_id, 'possible_duplicate_payment', 2 FROM r WHERE EXISTS (SELECT 1 FROM h WHERE h.vendor = r.vendor AND abs(h.total - r.total) <= 0.01 AND abs(date_diff('day', h.day, r.day)) <= 45))"""


def _master_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 50).alias("vendor"), (F.floor(F.col("o_totalprice") / 100) * 100).cast("double").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"), F.col("o_custkey").alias("c"))


def _identified(docs: DataFrame, account: int, gstin: int, place: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col(place) % 5 + 1).cast("int"))
    return docs.withColumns({"account": F.concat(F.lit("acc"), (F.col("c") % account).cast("string")), "gstin": F.concat(F.lit("G"), (F.col("c") % gstin).cast("string")), "address": name})


@query(f"WITH {_HISTORY} SELECT q0.doc_id, CASE coalesce(max(v), 0) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS verdict, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM q0 LEFT JOIN k USING (doc_id) GROUP BY q0.doc_id")
def validated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order against the master of the others: all checks and the verdict."""
    docs = _master_docs(spark, sf_dir)
    history = _identified(docs.where("doc_id % 4 <> 0"), 3, 2, "c")
    method = F.when(F.col("doc_id") % 13 == 0, "unresolved").when(F.col("doc_id") % 17 == 0, "conflict").otherwise("exact_name")
    asked = _identified(docs.where("doc_id % 4 = 0"), 4, 5, "doc_id").withColumn("method", method)
    priced = lines(spark, sf_dir).where("line_no = 1").select("doc_id", F.when(F.col("quantity") == 50, "FAIL").when(F.col("quantity") == 49, "REVIEW").otherwise("PASS").alias("verdict"))
    checks = judge.validate_against_master(asked, history, priced)
    codes = checks.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return judge.verdicts(asked, checks).join(codes, "doc_id", "left").withColumn("codes", F.coalesce("codes", F.lit("")))


@query("""WITH d AS (SELECT o_orderkey AS pos, o_custkey % 50 AS vendor, floor(o_totalprice / 100) * 100 AS total, 'acc' || CAST(o_custkey % 3 AS VARCHAR) AS account FROM orders)
SELECT vendor, CAST(count(*) AS BIGINT) AS invoices, min(pos) AS first_seen, avg(total) AS mean, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts FROM d GROUP BY vendor""")
def supplier_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master of all orders, saved, loaded and read as records."""
    docs = _identified(_master_docs(spark, sf_dir), 3, 2, "c")
    items = lines(spark, sf_dir).select((F.col("vendor") % 50).alias("vendor"), F.col("part").cast("string").alias("description"), "unit_price")
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/docloom/master-{uuid.uuid4().hex}"
    master.build_master(docs, items, ["account"]).save(path)
    return master.SupplierMaster.load(spark, path).records().select("vendor", "invoices", "first_seen", "mean", F.array_join(F.col("values")["account"], ",").alias("accounts"))


@query("""WITH c AS (SELECT DISTINCT p_name AS description, CAST(5000 + length(p_name) AS VARCHAR) AS code FROM part WHERE length(p_name) % 2 = 0)
SELECT coalesce(code, '9999') AS code, CASE WHEN code IS NULL THEN 'Unknown' ELSE 'Account ' || code END AS name, code IS NOT NULL AS assignable, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN c ON trim(p_name) = description GROUP BY ALL""")
def line_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    code = (5000 + F.length("p_name")).cast("string")
    chart = part.where(F.length("p_name") % 2 == 0).select(F.col("p_name").alias("description"), code.alias("code"), F.concat(F.lit("Account "), code).alias("name")).distinct()
    li = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit(" "), "p_name").alias("description"))
    return accounts.with_account(li, chart).withColumn("assignable", accounts.is_real(F.col("code"), chart)).groupBy("code", "name", "assignable").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc_id, strftime(CASE WHEN o_orderkey % 4 = 3 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS date, o_totalprice AS total FROM orders""")
def receipt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four spellings and totals with marks; month-first dates are read day-first where they can be."""
    o = table(spark, sf_dir, "orders")
    spelled = [F.date_format("o_orderdate", f) for f in ("'DATE: 'yyyy-MM-dd HH:mm", "dd/MM/yy", "d MMM yyyy", "MM-dd-yyyy")]
    line = F.element_at(F.array(*spelled), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("doc_id"), converters.receipt_date(line).alias("date"), converters.receipt_total(F.concat(F.lit("RM "), F.format_number("o_totalprice", 2))).alias("total"))


@query("""WITH p AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 10 END AS blur, o_custkey % 13 AS skew FROM orders)
SELECT doc_id, concat_ws(',', CASE WHEN blur < 3 THEN 'blur' END, CASE WHEN skew > 6 THEN 'skew' END) AS gates FROM p""")
def page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 14 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 != 0, (c % 10).cast("double")).alias("blur"), (c % 13).cast("double").alias("skew"), c.cast("double").alias("noise"))
    gates = {"blur": (3.0, "below"), "skew": (6.0, "above"), "noise": (None, "above")}
    return reports.triage(pages, gates).select("doc_id", F.array_join("gates", ",").alias("gates"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM documents ORDER BY CASE doc_id % 4 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END, doc_id LIMIT 300""")
def manifest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 rows of a manifest in the order of splits: the limit is the operator's own."""
    manifest = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 4 + 1).cast("int"))
    splits = manifest.where("doc_id % 4 <> 3").select("doc_id", split.alias("split"))
    return files.select_slice(manifest, splits, 300).select("doc_id", "split")


@query("""WITH r AS (SELECT l_returnflag AS run, 'f' || CAST(l_linenumber AS VARCHAR) AS path, avg(l_discount) AS accuracy FROM lineitem GROUP BY ALL),
m AS (SELECT l_returnflag AS run, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1)
SELECT run, avg(accuracy) AS header_accuracy, CAST(count(*) AS BIGINT) AS fields, any_value(upper_median) AS upper_median FROM r JOIN m USING (run) WHERE path IN ('f1', 'f2', 'f3') GROUP BY run""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("run", F.col("l_returnflag"))
    report = li.groupBy("run", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path")).agg(F.avg("l_discount").alias("accuracy"))
    return reports.header_accuracy(report, ["f1", "f2", "f3", "not there"], ["run"]).join(reports.upper_median(li, ["run"], "l_quantity"), "run")


@query("""SELECT user_id AS doc_id, CAST(event_id % 3 AS INTEGER) AS line_index, arg_max(event_type, event_id) AS category FROM events GROUP BY ALL""")
def line_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    field = F.concat(F.lit("line_items["), (F.col("event_id") % 3).cast("string"), F.lit("].category"))
    return review.reviewed_categories(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("decision_id"), field.alias("field"), F.col("event_type").alias("new_value")))


@query("""SELECT l_orderkey AS doc_id, avg(l_discount) FILTER (l_linenumber <> 2) AS mean_confidence, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_ms FROM lineitem GROUP BY 1""")
def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    words = li.select("doc_id", F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("confidence"))
    out = reports.page_figures(words, li.select("doc_id", F.col("l_quantity").cast("decimal(18,2)").alias("ms")))
    return out.withColumn("total_ms", F.col("total_ms").cast("double"))
