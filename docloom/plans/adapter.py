"""The star-schema tables as invoices, lines, suppliers and page texts: one place says what stands for what.

Order = invoice, line item = line, supplier = vendor, customer = buyer, part name = description, part type = category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, vendor, part, quantity, unit_price, discount_rate, tax_rate, gross."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_rate"), F.round(F.col("l_tax") * 100, 2).alias("tax_rate"), F.col("l_extendedprice").alias("gross"),
    )


def named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the item's description and category."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("description"), F.col("p_type").alias("category"))
    return lines(spark, sf_dir).join(parts, "part")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, buyer, total, invoice_date (ISO text), invoice_number."""
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.lit("inv "), F.col("o_custkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("buyer"), F.col("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"), number.alias("invoice_number"))


def invoice_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, vendor: each invoice's first supplier by number."""
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.min("vendor").alias("vendor"))
