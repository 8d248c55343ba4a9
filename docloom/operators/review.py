"""Human review as an append-only log: state is what the last event says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED = ["accepted", "auto_accepted", "corrected", "overridden"]


def current(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def open_items(items: DataFrame, resolved: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Items that no event has resolved, in order."""
    left = items.join(resolved.select("item_id"), "item_id", "left_anti")
    return (left if doc_id is None else left.where(F.col("doc_id") == doc_id)).orderBy("item_id")


def judged(requests: DataFrame, items: DataFrame, decisions: DataFrame, chart: list[str]) -> DataFrame:
    """Line decisions with an error for each that is refused, and null for each that may be appended.

    requests has request_id, item_id, reviewer, action, category; items item_id, doc_id, category (null: abstained).
    Of several requests for one item the first is taken; all see the log as it was before the batch.
    """
    known = items.select("item_id", "doc_id", F.col("category").alias("machine"), F.lit(True).alias("known"))
    done = decisions.select("item_id").distinct().withColumn("done", F.lit(True))
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("request_id"))
    rows = requests.join(known, "item_id", "left").join(done, "item_id", "left").withColumn("turn", first)
    error = (
        F.when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "no reviewer")
        .when(F.col("known").isNull(), "unknown item")
        .when(F.col("done").isNotNull() | (F.col("turn") > 1), "already decided")
        .when((F.col("action") == "accept") & F.col("machine").isNull(), "nothing to accept")
        .when((F.col("action") == "correct") & ~F.coalesce(F.col("category").isin(chart), F.lit(False)), "not in the chart")
    )
    return rows.withColumn("error", error).drop("known", "done", "turn")


def document_decisions(requests: DataFrame, documents: DataFrame, open_: DataFrame) -> DataFrame:
    """Document decisions with an error or null: FAIL needs an override with a reason, open lines block acceptance."""
    waiting = open_.groupBy("doc_id").agg(F.count("*").alias("waiting"))
    rows = requests.join(documents.select("doc_id", "verdict", "status"), "doc_id", "left").join(waiting, "doc_id", "left")
    error = (
        F.when(F.col("status").isNull(), "unknown document")
        .when(F.col("status").isin(ACCEPTED + ["rejected"]), "already decided")
        .when((F.col("verdict") == "FAIL") & (F.col("action") == "accept"), "needs an override")
        .when((F.col("action") == "override") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "needs a reason")
        .when(F.col("action").isin("accept", "override") & (F.coalesce("waiting", F.lit(0)) > 0), "open lines")
    )
    return rows.withColumn("error", error).drop("waiting")


def accepted_documents(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accepted documents in the order they were decided; those never decided by hand come first."""
    last = decisions.groupBy("doc_id").agg(F.max("decision_id").alias("last_decision"))
    return documents.where(F.col("status").isin(ACCEPTED)).join(last, "doc_id", "left").orderBy(F.asc_nulls_first("last_decision"), "created_at")


def reviewed_categories(decisions: DataFrame) -> DataFrame:
    """doc_id, line_index, category: the last category that a reviewer gave each line."""
    line = F.regexp_extract("field", r"^line_items\[(\d+)\]\.category$", 1).try_cast("int")
    rows = decisions.withColumn("line_index", line).where("line_index is not null")
    return rows.groupBy("doc_id", "line_index").agg(F.max_by("new_value", "decision_id").alias("category"))


def reviewer_of(principal: DataFrame) -> DataFrame:
    """The name a decision is logged under: the credential's, or the claimed one of an anonymous caller."""
    mismatch = F.col("credential").isNotNull() & F.col("claimed").isNotNull() & (F.col("credential") != F.col("claimed"))
    return principal.withColumn("reviewer", F.when(~mismatch, F.coalesce("credential", "claimed"))).withColumn("error", F.when(mismatch, "claimed name differs"))


def permitted(scopes: str, wanted: str):
    return F.array_contains(F.col(scopes), wanted)
