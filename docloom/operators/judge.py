"""A document's judgement as a whole: its anomaly flags, and its checks against the supplier master.

Both work on tables of documents at once. Findings are long (doc_id, code, ...); `pos` says in which order a document's
findings were raised, so equal ranks keep that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import token_sort_ratio
from docloom.operators import rules
from docloom.operators.knowledge import amount_zscore, identities

SIGNALS = ["rule", "statistical", "semantic"]
#: Findings in the order in which they are raised.
FLAG_ORDER = ["future_invoice_date", "due_before_invoice", "duplicate_invoice_number", "invalid_gst_rate", "invalid_gstin", "arithmetic_mismatch", "unusual_amount_for_vendor", "suspiciously_round_total", "unknown_vendor", "novel_line_item"]
CHECK_ORDER = ["unknown_vendor", "gstin_conflict", "bank_account_changed", "gstin_mismatch", "address_mismatch", "price_deviation", "possible_duplicate_payment"]


def _place(codes: list[str]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, codes)), F.col("code")), F.lit(0)), F.lit(len(codes) + 1))


def rule_flags(docs: DataFrame, taxes: DataFrame, today: Column) -> DataFrame:
    """Flags by rule; docs has invoice_date, due_date, first_doc, gstin, arithmetic_problems, taxes doc_id, rate."""
    return rules.findings(docs, rules.rule_conditions(today)).unionByName(rules.tax_rate_flags(taxes))


def statistical_flags(docs: DataFrame, amounts: DataFrame) -> DataFrame:
    """Flags by the supplier's earlier amounts; docs has vendor, total, amounts vendor, n, mean, std."""
    scored = docs.select("doc_id", "vendor", "total").join(amounts, "vendor", "left").withColumn("z", amount_zscore(*(F.col(c) for c in ("total", "n", "mean", "std"))))
    return rules.findings(scored, rules.statistical_conditions())


def detect_anomalies(docs: DataFrame, taxes: DataFrame, amounts: DataFrame, known: DataFrame, best: DataFrame, today: Column) -> DataFrame:
    """All flags of all documents with their combinations: doc_id, code, severity, signal, rank, worst first.

    `known` are the suppliers of the ledger, `best` the top similarity of each line.
    """
    flags = rule_flags(docs, taxes, today).unionByName(statistical_flags(docs, amounts)).unionByName(rules.semantic_flags(docs, known, best))
    found = rules.escalated(flags)
    order = Window.partitionBy("doc_id").orderBy(F.desc(rules.rank_of("severity", rules.SEVERITY)), _place(FLAG_ORDER), "code")
    return found.withColumn("rank", F.row_number().over(order))


def by_signal(flags: DataFrame) -> DataFrame:
    """doc_id, signal, codes: a document's flags of one family, worst first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "code")))
    return flags.groupBy("doc_id", "signal").agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))


def address_checks(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose address is none of the supplier's and resembles none; known has vendor, kind, value.

    Distinct addresses are compared, so a supplier's many documents with one address cost one comparison.
    """
    has = known.where("kind = 'address'").select("vendor", "value")
    asked = docs.select("vendor", F.trim("address").alias("address")).where("vendor is not null and address <> ''").distinct()
    near = asked.join(has, "vendor").groupBy("vendor", "address").agg(F.max(token_sort_ratio(F.col("address"), F.col("value"))).alias("best"), F.max(F.col("address") == F.col("value")).alias("same"))
    strange = near.where((F.col("best") < rules.ADDRESS_SAME) & ~F.col("same")).select("vendor", "address")
    return docs.withColumn("address", F.trim("address")).join(strange, ["vendor", "address"], "left_semi").select("doc_id", F.lit("address_mismatch").alias("code"), F.lit("REVIEW").alias("verdict"))


def validate_against_master(docs: DataFrame, history: DataFrame, priced: DataFrame) -> DataFrame:
    """All checks of resolved documents: doc_id, code, verdict, pos.

    docs has vendor and method (of `resolve`), account, gstin, address, total, invoice_date; history the same columns and
    pos for earlier documents; priced doc_id, verdict of each line. An unresolved supplier ends a document's checks.
    """
    unknown = docs.where("method = 'unresolved'").select("doc_id", F.lit("unknown_vendor").alias("code"), F.lit("REVIEW").alias("verdict"))
    docs = docs.where("method <> 'unresolved'")
    conflict = docs.where("method = 'conflict'").select("doc_id", F.lit("gstin_conflict").alias("code"), F.lit("FAIL").alias("verdict"))
    known = identities(history, ["account", "gstin", "address"])
    counts = history.where("vendor is not null").groupBy("vendor").agg(F.count("*").alias("invoices"))
    identity = rules.identity_checks(docs.select("doc_id", "vendor", "account", "gstin"), known, counts)
    prices = priced.join(docs.select("doc_id"), "doc_id", "left_semi").where("verdict in ('REVIEW', 'FAIL')").select("doc_id", F.lit("price_deviation").alias("code"), "verdict")
    twice = rules.duplicate_payments(docs.select("doc_id", "vendor", "total", "invoice_date"), history.select("doc_id", "vendor", "total", "invoice_date", "pos"))
    twice = twice.select("doc_id", F.lit("possible_duplicate_payment").alias("code"), F.lit("FAIL").alias("verdict"))
    found = unknown.unionByName(conflict).unionByName(identity).unionByName(address_checks(docs, known)).unionByName(prices).unionByName(twice)
    return found.withColumn("pos", _place(CHECK_ORDER))


def verdicts(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """doc_id, verdict: PASS, or the worst of a document's checks."""
    return rules.worst(docs, checks.select("doc_id", "verdict"), "verdict", rules.VERDICT, "PASS")
