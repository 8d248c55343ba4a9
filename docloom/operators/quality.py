"""Structure and arithmetic of documents: conformance of raw JSON, totals, and coercion to the canonical shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.parse import GSTIN_LAYOUT, clean_text, normalize_date, normalize_gstin, parse_amount, parse_quantity, parse_rate
from docloom.operators.rules import close
from docloom.sources.schema import PARTY_FIELDS, REQUIRED_KEYS, SCHEMA_VERSION, TAX_TYPES

TOLERANCE = 0.02


def schema_problems(raw: Column) -> Column:
    """Sorted problems of a raw JSON document: unreadable, missing and unknown top keys, wrong version, type and date.

    A key that is there with null and one that is absent are told apart, so this reads the text, not a struct.
    """
    keys = F.json_object_keys(raw)
    known = [*REQUIRED_KEYS, "language", "currency", "tax_lines", "payment_info", "grounding", "annotator"]
    value = lambda path: F.get_json_object(raw, path)
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED_KEYS)), keys), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, known))), lambda k: F.concat(F.lit("unknown "), k))
    version = F.when(value("$.schema_version") != SCHEMA_VERSION, F.array(F.lit("version"))).otherwise(F.array())
    kind = F.when(~value("$.document_type").isin("invoice", "receipt"), F.array(F.lit("document_type"))).otherwise(F.array())
    date = F.when(~value("$.invoice_meta.invoice_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.array(F.lit("invoice_date"))).otherwise(F.array())
    return F.when(keys.isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_sort(F.concat(missing, unknown, version, kind, date)))


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x[field], F.lit(0.0)))


def total_problems(line_items: Column, tax_lines: Column, totals: Column) -> Column:
    """Soft check of the sums against the totals; the tolerance is a share of the expected value, sums of 0 are skipped."""
    out = []
    for items, field, total in ((line_items, "line_total", "subtotal"), (tax_lines, "amount", "tax_total")):
        got, want = _sum(items, field), totals[total]
        out.append(F.when((got != 0) & (F.abs(got - want) > TOLERANCE * F.greatest(F.abs(want), F.lit(1.0))), F.lit(total)))
    return F.array_compact(F.array(*out))


def arithmetic_problems(line_items: Column, tax_lines: Column, totals: Column) -> Column:
    """Codes of sums that do not hold: subtotal, tax_total, grand_total, and line for each line that does not multiply out.

    A line may state its net, gross or tax-inclusive total; without a stated discount any lower total passes.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    lines, taxes = F.filter(line_items, lambda x: x["line_total"].isNotNull()), F.filter(tax_lines, lambda x: x["amount"].isNotNull())
    checks = [
        F.when((F.size(lines) > 0) & ~close(_sum(lines, "line_total"), totals["subtotal"]), F.lit("subtotal")),
        F.when((F.size(taxes) > 0) & ~close(_sum(taxes, "amount"), totals["tax_total"]), F.lit("tax_total")),
        F.when(~close(totals["subtotal"] + zero(totals["tax_total"]) + zero(totals["shipping"]) + zero(totals["round_off"]), totals["grand_total"]), F.lit("grand_total")),
    ]

    def wrong(x: Column) -> Column:
        gross = x["quantity"] * x["unit_price"]
        net = gross - zero(x["discount"])
        taxed = net * (1 + zero(x["tax_rate"]) / 100)
        fits = close(x["line_total"], net) | close(x["line_total"], gross) | close(x["line_total"], taxed) | (x["discount"].isNull() & (x["line_total"] < gross))
        return F.coalesce(~fits, F.lit(False))

    return F.concat(F.array_compact(F.array(*checks)), F.transform(F.filter(line_items, wrong), lambda _: F.lit("line")))


def coerced_party(raw: Column) -> Column:
    """A party with clean text; a tax number only where it has the right layout, whatever its check digit."""
    number = normalize_gstin(raw["gstin"])
    return F.struct(*((F.when(number.rlike(GSTIN_LAYOUT), number) if f == "gstin" else clean_text(raw[f])).alias(f) for f in PARTY_FIELDS))


def coerced_lines(raw: Column) -> Column:
    """Typed line items from text ones; rows with no description and no amount go."""
    item = F.transform(
        raw,
        lambda x, i: F.struct(
            (i + 1).alias("line_no"), clean_text(x["description"]).alias("description"), parse_quantity(x["quantity"]).alias("quantity"), parse_amount(x["unit_price"]).alias("unit_price"),
            parse_amount(x["discount"]).alias("discount"), parse_rate(x["tax_rate"]).alias("tax_rate"), parse_amount(x["line_total"]).alias("line_total"),
        ),
    )
    return F.filter(item, lambda x: x["description"].isNotNull() | x["line_total"].isNotNull())


def coerced_taxes(raw: Column) -> Column:
    """Typed tax lines; those without an amount go, an unknown kind is OTHER."""
    kind = lambda x: F.upper(F.trim(x["type"]))
    rows = F.transform(raw, lambda x: F.struct(F.when(kind(x).isin(TAX_TYPES), kind(x)).otherwise("OTHER").alias("type"), parse_rate(x["rate"]).alias("rate"), parse_amount(x["amount"]).alias("amount")))
    return F.filter(rows, lambda x: x["amount"].isNotNull())


def coerced(raw: DataFrame, day_first: bool = True) -> DataFrame:
    """Raw predictions (all leaves text) in canonical types; the tax total is summed only where none was given."""
    taxes = coerced_taxes(F.col("tax_lines"))
    given = parse_amount(F.col("totals.tax_total"))
    summed = F.when(F.size(taxes) > 0, F.round(_sum(taxes, "amount"), 2))
    return raw.select(
        "doc_id",
        F.struct(coerced_party(F.col("parties.vendor")).alias("vendor"), coerced_party(F.col("parties.buyer")).alias("buyer")).alias("parties"),
        F.struct(clean_text(F.col("invoice_meta.invoice_number")).alias("invoice_number"), normalize_date(F.col("invoice_meta.invoice_date"), day_first).alias("invoice_date"), normalize_date(F.col("invoice_meta.due_date"), day_first).alias("due_date")).alias("invoice_meta"),
        coerced_lines(F.col("line_items")).alias("line_items"),
        taxes.alias("tax_lines"),
        F.struct(*(parse_amount(F.col(f"totals.{f}")).alias(f) for f in ("subtotal", "shipping", "round_off", "grand_total")), F.coalesce(given, summed).alias("tax_total")).alias("totals"),
    )
