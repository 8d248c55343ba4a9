"""Made-up invoices and planted faults for evaluation, drawn by hashes of (seed, key) so every task draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.parse import gstin_check_digit

FAULTS = ["none", "future_date", "due_first", "bad_tax_rate", "bad_gstin", "bad_sum", "round_total", "padded_line"]
NAME_FAULTS = ["upper", "no_suffix", "doubled_letter", "ocr_glyphs", "swapped_words", "extra_blank"]


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / (1 << 30)


def tax_number(seed: int, key: Column | str) -> Column:
    """A tax number with a valid check digit."""
    n = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000))
    head = F.concat(F.lpad((1 + n % 38).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad(n.cast("string"), 4, "0"), F.lit("F1Z"))
    return F.concat(head, gstin_check_digit(head))


def suppliers(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """vendor, gstin, account, trading_name (of a third): identities are minted once and reused."""
    ids = spark.range(n).withColumnRenamed("id", "k")
    name = F.concat(F.lit("Supplier "), F.col("k").cast("string"), F.lit(" Pvt Ltd"))
    trading = F.when(uniform(seed + 1, "k") < 0.35, F.concat(F.lit("Traders "), F.col("k").cast("string")))
    return ids.select("k", name.alias("vendor"), tax_number(seed, "k").alias("gstin"), F.concat(F.lit("AC"), F.lpad(F.pmod(F.xxhash64(F.lit(seed + 2), "k"), F.lit(10**9)).cast("string"), 9, "0")).alias("account"), trading.alias("trading_name"))


def invoices(spark: SparkSession, n: int, vendors: int = 20, seed: int = 0) -> DataFrame:
    """Invoices of one to five lines that add up, with tax halves or one tax by state."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.floor(uniform(seed, "id") * vendors).alias("k"))
    docs = docs.join(F.broadcast(suppliers(spark, vendors, seed)), "k")
    count = (1 + F.floor(uniform(seed + 3, "doc_id") * 5)).cast("int")

    def line(i: Column) -> Column:
        price = F.round(100 + 900 * F.pmod(F.xxhash64(F.lit(seed + 4), F.col("k"), i % 7), F.lit(1000)) / 1000 * (0.96 + 0.08 * F.pmod(F.xxhash64(F.lit(seed + 5), F.col("doc_id"), i), F.lit(1000)) / 1000), 2)
        quantity = (1 + F.pmod(F.xxhash64(F.lit(seed + 6), F.col("doc_id"), i), F.lit(20))).cast("double")
        return F.struct(i.alias("line_no"), F.concat(F.lit("Item "), (i % 7).cast("string")).alias("description"), quantity.alias("quantity"), price.alias("unit_price"), F.lit(None).cast("double").alias("discount"), F.lit(18.0).alias("tax_rate"), F.round(quantity * price, 2).alias("line_total"))

    lines = F.transform(F.sequence(F.lit(1), count), line)
    made = docs.withColumn("line_items", lines).withColumn("subtotal", F.round(F.aggregate("line_items", F.lit(0.0), lambda a, x: a + x["line_total"]), 2)).withColumn("tax", F.round(F.col("subtotal") * 0.18, 2))
    half = F.round(F.col("tax") / 2, 2)
    kind = lambda t, r, a: F.struct(F.lit(t).alias("type"), F.lit(r).alias("rate"), a.alias("amount"))
    taxes = F.when(F.col("k") % 2 == 0, F.array(kind("CGST", 9.0, half), kind("SGST", 9.0, F.round(F.col("tax") - half, 2)))).otherwise(F.array(kind("IGST", 18.0, F.col("tax"))))
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.floor(uniform(seed + 7, "doc_id") * 240).cast("int"))
    zero = F.lit(None).cast("double")
    totals = F.struct("subtotal", F.col("tax").alias("tax_total"), zero.alias("shipping"), zero.alias("round_off"), F.round(F.col("subtotal") + F.col("tax"), 2).alias("grand_total"))
    return made.select("doc_id", "vendor", "gstin", "account", F.date_format(day, "yyyy-MM-dd").alias("invoice_date"), F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("due_date"), "line_items", taxes.alias("tax_lines"), totals.alias("totals"))


def with_faults(docs: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """`docs` with one kind of fault in a share of them, named in `fault`."""
    which = F.when(uniform(seed + 11, "doc_id") < share, F.element_at(F.array(*map(F.lit, FAULTS[1:])), (1 + F.floor(uniform(seed + 12, "doc_id") * (len(FAULTS) - 1))).cast("int"))).otherwise("none")
    f = docs.withColumn("fault", which)
    on = lambda name: F.col("fault") == name
    first = F.transform("tax_lines", lambda t, i: F.when(i == 0, t.withField("rate", F.lit(17.0))).otherwise(t))
    return (
        f.withColumn("invoice_date", F.when(on("future_date"), "2099-01-01").otherwise(F.col("invoice_date")))
        .withColumn("due_date", F.when(on("due_first"), "2020-01-01").otherwise(F.col("due_date")))
        .withColumn("tax_lines", F.when(on("bad_tax_rate"), first).otherwise(F.col("tax_lines")))
        .withColumn("gstin", F.when(on("bad_gstin"), F.concat(F.substring("gstin", 1, 14), F.lit("?"))).otherwise(F.col("gstin")))
        .withColumn("totals", F.when(on("bad_sum"), F.col("totals").withField("grand_total", F.col("totals.grand_total") * 1.4)).when(on("round_total"), F.col("totals").withField("grand_total", F.lit(50_000.0))).otherwise(F.col("totals")))
    )


def worn_name(name: Column, fault: Column) -> Column:
    """A supplier's name as it may be printed or scanned."""
    return (
        F.when(fault == "upper", F.upper(name))
        .when(fault == "no_suffix", F.regexp_replace(name, r"(?i)\s+(pvt|private)?\s*(ltd|limited)$", ""))
        .when(fault == "doubled_letter", F.concat(F.substring(name, 1, 3), F.substring(name, 3, 1000)))
        .when(fault == "ocr_glyphs", F.translate(name, "lo", "10"))
        .when(fault == "swapped_words", F.regexp_replace(name, r"^(\S+)\s+(\S+)", "$2 $1"))
        .when(fault == "extra_blank", F.regexp_replace(name, " ", "  "))
        .otherwise(name)
    )
