"""Accounts for line items: a chart (description, code, name) says what a description belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import retrieval

# The code and name of what belongs to no account.
NO_ACCOUNT, NO_NAME = "9999", "Unknown"


def is_real(code: Column, chart: DataFrame) -> Column:
    """Whether a code column's value is in the chart and stands for an account; the chart is one table of a few codes."""
    return F.coalesce(code.isin([r["code"] for r in assignable(chart).collect()]), F.lit(False))


def assignable(chart: DataFrame) -> DataFrame:
    """The codes that a line may be given."""
    return chart.where(F.col("code") != NO_ACCOUNT).select("code").distinct()


def with_account(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """`lines` with code and account name by their trimmed description; what the chart lacks has no account."""
    known = chart.select(F.col("description").alias("of"), "code").distinct()
    names = chart.select("code", "name").distinct()
    coded = lines.join(known, F.trim("description") == F.col("of"), "left").drop("of").withColumn("code", F.coalesce("code", F.lit(NO_ACCOUNT)))
    return coded.join(names, "code", "left").withColumn("name", F.coalesce("name", F.lit(NO_NAME)))


def categorize_documents(lines: DataFrame, matches: DataFrame, usual: DataFrame | None = None) -> DataFrame:
    """A decision for each line (doc_id, line_no, query_id) of its document from its neighbours, with a line that explains it."""
    decided = lines.select("doc_id", "line_no", "query_id").join(retrieval.vote(lines, matches, usual), "query_id")
    said = F.when(F.col("category").isNotNull(), F.format_string("%s with %.2f of the votes", "category", "share")).otherwise(F.concat(F.lit("abstained: "), F.col("reason")))
    return decided.withColumn("explanation", said)
