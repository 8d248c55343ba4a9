"""Anomaly flags and validation checks as condition tables over one row per document, and what follows from them.

Findings are long: doc_id, code, severity or verdict, signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.parse import gstin_problems, iso_date
from docloom.operators.knowledge import band, deviation, spread

# Tax rates that the slabs and their halves allow.
SPLIT_RATES = [0.0, 0.125, 0.25, 1.5, 2.5, 3.0, 5.0, 6.0, 9.0, 12.0, 14.0, 18.0, 28.0]
# Flags that mean more together.
ESCALATIONS = [("unknown_vendor", "suspiciously_round_total"), ("unknown_vendor", "unusual_amount_for_vendor"), ("unknown_vendor", "novel_line_item")]
SEVERITY = {"low": 0, "medium": 1, "high": 2}
VERDICT = {"PASS": 0, "REVIEW": 1, "FAIL": 2}

Z_FLAG, Z_HIGH = 3.0, 5.0
ROUND_FROM, ROUND_TO = 10_000.0, 1_000.0
NOVEL_BELOW = 0.25
TOLERANCE = 0.02
HISTORY_ENOUGH = 2
DUPLICATE_DAYS, DUPLICATE_CENTS = 45, 0.01
CELL_REACH = 6
VENDOR_REVIEW, VENDOR_FAIL = 0.25, 1.00
MARKET_REVIEW, MARKET_FAIL = 0.60, 1.50
ADDRESS_SAME = 75.0


def findings(docs: DataFrame, conditions: list[tuple[str, Column, Column | str, str]]) -> DataFrame:
    """One row for each condition that holds: (code, condition, severity, signal) over a document row."""
    rows = [F.when(held, F.struct(F.lit(code).alias("code"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"), F.lit(signal).alias("signal"))) for code, held, sev, signal in conditions]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("doc_id", "f.*")


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Within the tolerance of the larger of the two, or of one."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def rule_conditions(today: Column) -> list[tuple[str, Column, Column | str, str]]:
    """Flags on invoice_date, due_date, first_doc, gstin and arithmetic_problems of a document row."""
    date, due = iso_date(F.col("invoice_date")), iso_date(F.col("due_date"))
    return [
        ("future_invoice_date", date > today, "high", "rule"),
        ("due_before_invoice", due < date, "medium", "rule"),
        ("duplicate_invoice_number", F.col("first_doc").isNotNull() & (F.col("first_doc") != F.col("doc_id")), "high", "rule"),
        ("invalid_gstin", F.col("gstin").isNotNull() & (F.size(gstin_problems(F.col("gstin"))) > 0), "high", "rule"),
        ("arithmetic_mismatch", F.col("arithmetic_problems") > 0, "high", "rule"),
    ]


def tax_rate_flags(taxes: DataFrame) -> DataFrame:
    """One flag for each tax line whose rate is no slab or half slab; taxes has doc_id, rate."""
    return taxes.where(F.col("rate").isNotNull() & ~F.col("rate").isin(SPLIT_RATES)).select("doc_id", F.lit("invalid_gst_rate").alias("code"), F.lit("medium").alias("severity"), F.lit("rule").alias("signal"))


def statistical_conditions() -> list[tuple[str, Column, Column | str, str]]:
    """Flags on z and total of a document row."""
    z = F.abs(F.col("z"))
    step = F.col("total") % ROUND_TO
    return [
        ("unusual_amount_for_vendor", z > Z_FLAG, F.when(z > Z_HIGH, "high").otherwise("medium"), "statistical"),
        ("suspiciously_round_total", (F.col("total") >= ROUND_FROM) & (F.least(step, F.lit(ROUND_TO) - step) < 1e-6), "low", "statistical"),
    ]


def semantic_flags(docs: DataFrame, known: DataFrame, best: DataFrame) -> DataFrame:
    """Unknown suppliers, and lines that resemble nothing in the ledger; known has vendor, best doc_id, line_no, top."""
    stranger = docs.where("vendor is not null").join(known.select("vendor").distinct(), "vendor", "left_anti").select("doc_id", F.lit("unknown_vendor").alias("code"))
    novel = best.where(F.coalesce("top", F.lit(0.0)) < NOVEL_BELOW).select("doc_id", F.lit("novel_line_item").alias("code"))
    return stranger.unionByName(novel).select("doc_id", "code", F.lit("low").alias("severity"), F.lit("semantic").alias("signal"))


def escalated(flags: DataFrame) -> DataFrame:
    """`flags` and one more of medium severity for each pair that a document has."""
    codes = flags.groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    both = [F.when(F.array_contains("codes", a) & F.array_contains("codes", b), F.lit(f"combined_{a}_{b}")) for a, b in ESCALATIONS]
    more = codes.select("doc_id", F.explode(F.array_compact(F.array(*both))).alias("code"), F.lit("medium").alias("severity"), F.lit("semantic").alias("signal"))
    return flags.unionByName(more)


def rank_of(column: str, ranks: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), F.col(column))


def worst(docs: DataFrame, found: DataFrame, column: str, ranks: dict[str, int], default: str | None) -> DataFrame:
    """doc_id and the worst of its findings; `default` for a document without any."""
    top = found.groupBy("doc_id").agg(F.max_by(column, rank_of(column, ranks)).alias(column))
    return docs.select("doc_id").join(top, "doc_id", "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def price_verdicts(rated: DataFrame) -> DataFrame:
    """Lines with deviation and verdict (PASS, REVIEW, FAIL; null without a rate).

    A supplier's own rate has tight bands; the market's, and a thin own one, have wide ones that grow with the spread.
    """
    move = F.abs(deviation(F.col("unit_price"), F.col("median")))
    wide = band(MARKET_REVIEW, F.col("observations"), spread(*(F.col(c) for c in ("observations", "median", "low", "high"))))
    own = F.col("rate_source") == "vendor"
    review, fail = F.when(own, VENDOR_REVIEW).otherwise(wide), F.when(own, VENDOR_FAIL).otherwise(F.greatest(F.lit(MARKET_FAIL), wide * 2.5))
    verdict = F.when(F.col("rate_source") == "none", F.lit(None).cast("string")).when(move > fail, "FAIL").when(move > review, "REVIEW").otherwise("PASS")
    return rated.withColumn("deviation", deviation(F.col("unit_price"), F.col("median"))).withColumn("verdict", verdict)


def identity_checks(docs: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """Account or tax number that a supplier with enough history has not been seen with.

    docs has doc_id, vendor (resolved), account, gstin; known vendor, kind, value; counts vendor, invoices.
    """
    out = None
    for kind, code in (("account", "bank_account_changed"), ("gstin", "gstin_mismatch")):
        has = known.where(F.col("kind") == kind)
        rows = docs.select("doc_id", "vendor", F.trim(kind).alias("value")).where("vendor is not null and value is not null and value <> ''")
        rows = rows.join(counts.where(F.col("invoices") >= HISTORY_ENOUGH), "vendor", "left_semi").join(has.select("vendor").distinct(), "vendor", "left_semi")
        new = rows.join(has.select("vendor", "value"), ["vendor", "value"], "left_anti").select("doc_id", F.lit(code).alias("code"), F.lit("FAIL").alias("verdict"))
        out = new if out is None else out.unionByName(new)
    return out


def _cell_sizes(days: int, cents: float) -> tuple[float, int]:
    return max(cents * CELL_REACH, 0.01), max(days * CELL_REACH, 1)


def duplicate_cells(entries: DataFrame, days: int, cents: float) -> DataFrame:
    """Entries (total, date) once for each cell of amounts and days that a match reaches: cell, span.

    Rounding keeps the order of amounts, so a match lies between the two ends, which are next to each other.
    """
    step, width = _cell_sizes(days, cents)
    cells = lambda x, reach, wide: F.explode(F.sequence(F.floor((x - reach) / wide), F.floor((x + reach) / wide)))
    return entries.withColumn("cell", cells(F.col("total"), cents * (1 + 1e-9) + 1e-6, step)).withColumn("span", cells(F.unix_date("date"), days, width))


def duplicate_payments(docs: DataFrame, history: DataFrame, days: int = DUPLICATE_DAYS, cents: float = DUPLICATE_CENTS) -> DataFrame:
    """The first document of history, by pos, of the same supplier, amount and time: doc_id, other_doc.

    The plane of amounts and days is cut into cells CELL_REACH times as wide as the match reaches, and an entry of the
    history goes to those that it reaches: to one as a rule, to two at an edge and to four at a corner. So the join is
    on equal keys, and a supplier with very many documents spreads over its amounts and times.
    """
    step, width = _cell_sizes(days, cents)
    q = docs.select("doc_id", "vendor", "total", iso_date(F.col("invoice_date")).alias("date"))
    h = history.select(F.col("doc_id").alias("other_doc"), F.col("vendor").alias("other_vendor"), "total", iso_date(F.col("invoice_date")).alias("date"), "pos")
    h = duplicate_cells(h, days, cents).withColumnsRenamed({"total": "other_total", "date": "other_date"})
    same = (F.col("vendor") == F.col("other_vendor")) & (F.floor(F.col("total") / step) == F.col("cell")) & (F.floor(F.unix_date("date") / width) == F.col("span"))
    near = (F.abs(F.col("total") - F.col("other_total")) <= cents + 1e-9) & (F.abs(F.datediff("date", "other_date")) <= days) & (F.col("doc_id") != F.col("other_doc"))
    return q.join(h, same & near).groupBy("doc_id").agg(F.min_by("other_doc", F.struct("pos", "other_doc")).alias("other_doc"))


def route(docs: DataFrame) -> DataFrame:
    """Where a document goes: blocked on a FAIL, review on REVIEW, a high flag or an abstained line, else accepted.

    docs has doc_id, verdict, severity (the worst flag's, or null), abstained (lines).
    """
    status = F.when(F.col("verdict") == "FAIL", "blocked").when((F.col("verdict") == "REVIEW") | (F.coalesce("severity", F.lit("")) == "high") | (F.coalesce("abstained", F.lit(0)) > 0), "review").otherwise("accepted")
    reasons = F.array_compact(F.array(F.when(F.col("verdict") != "PASS", F.concat(F.lit("verdict "), F.col("verdict"))), F.when(F.coalesce("severity", F.lit("")) == "high", "high anomaly"), F.when(F.coalesce("abstained", F.lit(0)) > 0, "abstained lines")))
    return docs.withColumn("status", status).withColumn("reasons", reasons)


def explained(found: DataFrame) -> DataFrame:
    """The first three messages of a document's worst verdict: doc_id, messages; found has verdict, message, pos."""
    ranked = found.withColumn("rank", rank_of("verdict", VERDICT))
    top = ranked.withColumn("top", F.max("rank").over(Window.partitionBy("doc_id"))).where("rank = top")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "message")))
    return top.groupBy("doc_id").agg(F.transform(F.slice(ordered, 1, 3), lambda x: x["message"]).alias("messages"))


