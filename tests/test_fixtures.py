import pytest
from pyspark.sql import functions as F

from docloom.functions.parse import gstin_problems
from docloom.operators import fixtures, providers, quality, rules


def test_made_invoices_are_sound_and_faults_show(spark):
    clean = fixtures.invoices(spark, 120)
    problems = quality.arithmetic_problems(F.col("line_items"), F.col("tax_lines"), F.col("totals"))
    assert clean.where(F.size(problems) > 0).count() == 0 and clean.where(F.size(gstin_problems(F.col("gstin"))) > 0).count() == 0
    docs = fixtures.with_faults(clean, share=0.8).withColumn("arithmetic_problems", F.size(problems)).withColumn("first_doc", F.lit(None).cast("long"))
    flags = rules.findings(docs, rules.rule_conditions(F.lit("2026-12-31").cast("date")))
    rates = rules.tax_rate_flags(docs.select("doc_id", F.explode("tax_lines").alias("t")).select("doc_id", "t.rate"))
    seen = {(r.fault, r.code) for r in flags.unionByName(rates).join(docs.select("doc_id", "fault"), "doc_id").select("fault", "code").distinct().collect()}
    assert {("future_date", "future_invoice_date"), ("due_first", "due_before_invoice"), ("bad_tax_rate", "invalid_gst_rate"), ("bad_gstin", "invalid_gstin"), ("bad_sum", "arithmetic_mismatch")} <= seen
    assert not any(fault in ("none", "padded_line") for fault, _ in seen)


def test_replies(spark):
    rows = [('{"a": 1,}',), ('Sure:\n```json\n{"a": 1}\n```',), ('x {"a": {"b": 2}} y',), ('[{"a": 1}]',), ("no json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw_response string").select(F.get_json_object(providers.parsed_reply(), "$.a")).collect()]
    assert got == ["1", "1", '{"b":2}', "1", None, None]
    rows = [("5010",), ("5010 or 5020",), ("ABSTAIN 5010",), ("1234",), ("5010, 5010",)]
    assert [r[0] for r in spark.createDataFrame(rows, "reply string").select(providers.chosen_code("reply", ["5010", "5020"])).collect()] == ["5010", None, None, None, "5010"]
    with pytest.raises(ValueError):
        providers.provider("ocr", "live")
