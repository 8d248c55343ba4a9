"""Figures and texts of evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def header_accuracy(report: DataFrame, header: list[str], by: list[str]) -> DataFrame:
    """Mean accuracy over the header fields that a report (by, path, accuracy) has."""
    return report.where(F.col("path").isin(header)).groupBy(*by).agg(F.avg("accuracy").alias("header_accuracy"), F.count("*").alias("fields"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, upper_median: the middle value, of two middle ones the larger. Equal values are counted before they are ranked."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    group = Window.partitionBy(*by)
    upto = F.sum("times").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("n", F.sum("times").over(group))
    return placed.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))


def page_figures(words: DataFrame, stages: DataFrame) -> DataFrame:
    """doc_id, mean_confidence of the words that have one, total_ms of all stages."""
    confidence = words.groupBy("doc_id").agg(F.avg("confidence").alias("mean_confidence"))
    return confidence.join(stages.groupBy("doc_id").agg(F.sum("ms").alias("total_ms")), "doc_id", "full")


def serialized(report: DataFrame, undefined: dict[str, str] | None = None) -> DataFrame:
    """Each row as JSON; a figure of `undefined` (column to its count) is null where the count is 0."""
    fixed = {c: F.when(F.col(n) > 0, F.col(c)) for c, n in (undefined or {}).items()}
    return report.withColumns(fixed).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def markdown(row: list[Column]) -> Column:
    """A table row in Markdown."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("n/a")) for c in row)), F.lit(" |"))


def triage(pages: DataFrame, gates: dict[str, tuple[float | None, str]]) -> DataFrame:
    """`pages` with the signals whose gate is open: beyond the threshold, `above` or `below` it.

    A signal that is null or NaN, or a gate without a threshold, is off.
    """
    held = []
    for signal, (threshold, side) in gates.items():
        if threshold is not None:
            beyond = F.col(signal) > threshold if side == "above" else F.col(signal) < threshold
            held.append(F.when(~F.isnan(signal) & beyond, F.lit(signal)))
    return pages.withColumn("gates", F.array_compact(F.array(*held)))
