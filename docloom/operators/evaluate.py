"""Predictions against gold: fields, tax lines, line items, boxes, text, routers and classes.

Undefined ratios are null, never NaN.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.geometry import iou
from docloom.functions.text import anls, cer, normalize_text, wer
from docloom.sources.schema import CRITICAL_PATHS, DATE_LEAVES, NUMERIC_LEAVES, SCALAR_PATHS

TEXT_RIGHT = 0.5
TOLERANCE = 0.01
ITEM_FIELDS = ["description", "hsn_sac_code", "quantity", "unit", "unit_price", "tax_rate", "tax_amount", "line_total"]
PAIR_LIMIT = 0.6
IOU_LIMIT = 0.5
MIN_MARGIN = 0.05


def flatten(docs: DataFrame, paths: list[str] = SCALAR_PATHS) -> DataFrame:
    """doc_id, path, value: the scalars of canonical documents as text."""
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in paths))
    return docs.select("doc_id", F.explode(pairs).alias("f")).select("doc_id", "f.path", "f.value")


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def field_score(path: Column, gold: Column, pred: Column, tolerance: float = TOLERANCE) -> tuple[Column, Column]:
    """(correct, score) of one field: numbers within a share of the gold, dates equal, text by edit distance."""
    g, p = gold.try_cast("double"), pred.try_cast("double")
    number = F.coalesce(F.abs(g - p) <= tolerance * F.greatest(F.abs(g), F.lit(1.0)), F.lit(False))
    date = F.trim(gold) == F.trim(pred)
    text = anls(gold, pred)
    numeric, dated = leaf(path).isin(NUMERIC_LEAVES), leaf(path).isin(DATE_LEAVES)
    score = F.when(gold.isNull() & pred.isNull(), 1.0).when(gold.isNull() | pred.isNull(), 0.0).when(numeric, number.cast("double")).when(dated, date.cast("double")).otherwise(text)
    return F.when(numeric | dated | gold.isNull() | pred.isNull(), score == 1.0).otherwise(score >= TEXT_RIGHT), score


def compare_fields(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, path, correct, score over every path of either side; gold documents without a prediction count as empty.

    Both sides are long: doc_id, path, value.
    """
    known = gold.select("doc_id").distinct()
    p = pred.join(known, "doc_id", "left_semi").select("doc_id", "path", F.col("value").alias("pred"))
    both = gold.select("doc_id", "path", F.col("value").alias("gold")).join(p, ["doc_id", "path"], "full")
    correct, score = field_score(F.col("path"), F.col("gold"), F.col("pred"))
    return both.select("doc_id", "path", correct.alias("correct"), score.alias("score"))


def id_gaps(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id and problem: missing from the predictions, or extra in them."""
    g, p = gold.select("doc_id").distinct(), pred.select("doc_id").distinct()
    return g.join(p, "doc_id", "left_anti").withColumn("problem", F.lit("missing")).unionByName(p.join(g, "doc_id", "left_anti").withColumn("problem", F.lit("extra")))


def critical_documents(fields: DataFrame, critical: list[str] = CRITICAL_PATHS) -> DataFrame:
    """doc_id, critical: whether all critical fields are right; a path that is not there is wrong."""
    hits = F.count_distinct(F.when(F.col("path").isin(critical) & F.col("correct"), F.col("path")))
    return fields.groupBy("doc_id").agg((hits == len(critical)).alias("critical"))


def field_report(fields: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro (mean of the fields' accuracies) and micro (all fields together) accuracy, over all or by columns."""
    by = by or []
    per = fields.groupBy(*by, "path").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"), F.sum("score").alias("score"))
    return per.groupBy(*by).agg(F.avg(F.col("right") / F.col("n")).alias("macro"), F.try_divide(F.sum("right"), F.sum("n")).alias("micro"), F.try_divide(F.sum("score"), F.sum("n")).alias("mean_score"), F.sum("n").alias("n"))


def tax_accuracy(gold: DataFrame, pred: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, n, right: gold tax lines met by the last predicted line of their type; rows doc_id, type, amount, pos."""
    last = pred.groupBy("doc_id", "type").agg(F.max_by("amount", "pos").alias("found"))
    near = F.abs(F.col("amount") - F.col("found")) <= tolerance * F.greatest(F.abs("amount"), F.lit(1.0))
    return gold.join(last, ["doc_id", "type"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(near).alias("right"))


def item_cost(gold: Column, pred: Column) -> Column:
    """Cost of pairing two line items: descriptions weigh 0.7 and totals 0.3."""
    a, b = gold["line_total"], pred["line_total"]
    amount = F.when(a.isNull() | b.isNull(), 0.5).when(F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.lit(1.0)), 1.0).otherwise(0.0)
    return 1 - (0.7 * anls(gold["description"], pred["description"]) + 0.3 * amount)


def assignment(cost) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost: shortest augmenting paths with potentials."""
    import numpy as np

    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for r in range(n):
        owner[m], j = r, m
        least, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            done[j] = True
            i = owner[j]
            slack = c[i] - row_price[i] - col_price[:m]
            better = ~done[:m] & (slack < least)
            least[better], before[better] = slack[better], j
            open_ = np.where(done[:m], np.inf, least)
            nxt = int(open_.argmin())
            step = open_[nxt]
            row_price[owner[done]] += step
            col_price[done] -= step
            least[~done[:m]] -= step
            j = nxt
        while j != m:
            owner[j] = owner[before[j]]
            j = int(before[j])
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return [(j, i) for i, j in pairs] if turned else pairs


def match_items(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, n_gold, n_pred, n_matched, cost: line items of each document paired at least cost, pairs over the limit dropped.

    Both have doc_id and items, an array of structs with description and line_total. Costs are expressions over the
    two arrays of one document; the solver sees one small matrix at a time.
    """
    empty = F.array().cast(gold.schema["items"].dataType)
    both = gold.select("doc_id", F.coalesce("items", empty).alias("g")).join(pred.select("doc_id", F.coalesce("items", empty).alias("p")), "doc_id", "left").withColumn("p", F.coalesce("p", empty))
    costs = both.select("doc_id", F.size("g").alias("n_gold"), F.size("p").alias("n_pred"), F.transform("g", lambda g: F.transform("p", lambda p: item_cost(g, p))).alias("cost"))

    def solve(frames):
        for f in frames:
            rows = []
            for doc, n_gold, n_pred, cost in zip(f.doc_id, f.n_gold, f.n_pred, f.cost, strict=True):
                matrix = [list(r) for r in cost] if n_gold and n_pred else []
                kept = [matrix[i][j] for i, j in assignment(matrix) if matrix[i][j] <= PAIR_LIMIT] if matrix else []
                rows.append((doc, n_gold, n_pred, len(kept), float(sum(kept))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_gold", "n_pred", "n_matched", "cost"])

    kind = gold.schema["doc_id"].dataType.simpleString()
    return costs.mapInPandas(solve, f"doc_id {kind}, n_gold int, n_pred int, n_matched int, cost double")


def precision_recall(matched: Column, n_gold: Column, n_pred: Column) -> tuple[Column, Column, Column]:
    p, r = F.try_divide(matched, n_pred), F.try_divide(matched, n_gold)
    return p, r, F.try_divide(2 * p * r, p + r)


def match_boxes(gold: DataFrame, pred: DataFrame, limit: float = IOU_LIMIT) -> DataFrame:
    """Greedy pairing in gold order: doc_id, n_gold, n_pred, n_matched, n_text, iou_sum.

    Rows doc_id, pos, text, bbox. Overlapping pairs are found by a join on the page; consuming them is sequential.
    """
    g = gold.select("doc_id", F.col("pos").alias("gp"), F.col("text").alias("gt"), F.col("bbox").alias("gb"))
    p = pred.select("doc_id", F.col("pos").alias("pp"), F.col("text").alias("pt"), F.col("bbox").alias("pb"))
    pairs = g.join(p, "doc_id").where((F.col("gb")[0] < F.col("pb")[2]) & (F.col("pb")[0] < F.col("gb")[2]) & (F.col("gb")[1] < F.col("pb")[3]) & (F.col("pb")[1] < F.col("gb")[3]))
    near = pairs.withColumn("iou", iou(F.col("gb"), F.col("pb"))).where(F.col("iou") >= limit).select("doc_id", "gp", "pp", "iou", (F.col("gt") == F.col("pt")).alias("same"))

    def consume(page: pd.DataFrame) -> pd.DataFrame:
        used, n, same, total = set(), 0, 0, 0.0
        for _, rows in page.sort_values(["gp", "iou", "pp"], ascending=[True, False, True]).groupby("gp", sort=True):
            free = rows[~rows.pp.isin(used)]
            if len(free):
                hit = free.iloc[0]
                used.add(hit.pp)
                n, same, total = n + 1, same + bool(hit.same), total + float(hit.iou)
        return pd.DataFrame([(page.doc_id.iloc[0], n, same, total)], columns=["doc_id", "n_matched", "n_text", "iou_sum"])

    kind = gold.schema["doc_id"].dataType.simpleString()
    matched = near.groupBy("doc_id").applyInPandas(consume, f"doc_id {kind}, n_matched int, n_text int, iou_sum double")
    counts = gold.groupBy("doc_id").agg(F.count("*").alias("n_gold")).join(pred.groupBy("doc_id").agg(F.count("*").alias("n_pred")), "doc_id", "full")
    return counts.join(matched, "doc_id", "left").na.fill(0)


def text_errors(pages: DataFrame) -> DataFrame:
    """doc_id, cer, wer, ncer, nwer of pages with gold and pred texts, raw and normalised."""
    g, p = F.col("gold_plain"), F.col("pred_plain")
    plain = pages.select("doc_id", "gold", "pred", normalize_text(F.col("gold")).alias("gold_plain"), normalize_text(F.col("pred")).alias("pred_plain"))
    return plain.select("doc_id", cer(F.col("gold"), F.col("pred")).alias("cer"), wer(F.col("gold"), F.col("pred")).alias("wer"), cer(g, p).alias("ncer"), wer(g, p).alias("nwer"))


def ocr_report(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median and ninth decile of error rates over pages; detection from summed counts; IoU over pages with matches."""
    p, r, f = precision_recall(F.sum("n_matched"), F.sum("n_gold"), F.sum("n_pred"))
    return pages.groupBy(*(by or [])).agg(
        F.count("*").alias("pages"), F.avg("cer").alias("cer"), F.median("cer").alias("cer_median"), F.percentile("cer", F.lit(0.9)).alias("cer_p90"), F.avg("wer").alias("wer"),
        p.alias("precision"), r.alias("recall"), f.alias("f1"), F.try_divide(F.sum("n_text"), F.sum("n_gold")).alias("word_accuracy"), F.avg(F.when(F.col("n_matched") > 0, F.col("iou_sum") / F.col("n_matched"))).alias("mean_iou"),
    )


def fit_router(scores: DataFrame, order: list[str], default: str, margin: float = MIN_MARGIN) -> DataFrame:
    """path, winner, margin: the extractor with the best mean score of a field, if it beats the default by the margin.

    scores has extractor, path, score; an extractor without the field scores 0; ties go to the first in `order`.
    """
    means = scores.groupBy("path").pivot("extractor", order).agg(F.avg("score")).na.fill(0.0)
    best = F.array_max(F.array(*(F.struct(F.col(f"`{x}`").alias("score"), F.lit(-i).alias("place"), F.lit(x).alias("name")) for i, x in enumerate(order))))
    lead = best["score"] - F.col(f"`{default}`")
    return means.select("path", F.when(lead >= margin, best["name"]).otherwise(default).alias("winner"), lead.alias("margin"))


def routed(fields: DataFrame, policy: DataFrame, default: str) -> DataFrame:
    """doc_id, path, value: each field from its winner, or from the default where the winner lacks the document.

    fields has extractor, doc_id, path, value.
    """
    base = fields.where(F.col("extractor") == default).select("doc_id", "path", F.col("value").alias("base"))
    donors = fields.select("extractor", "doc_id").distinct()
    want = base.join(policy.select("path", "winner"), "path", "left").withColumn("extractor", F.coalesce("winner", F.lit(default)))
    there = want.join(donors.withColumn("has", F.lit(True)), ["extractor", "doc_id"], "left")
    value = there.join(fields.select("extractor", "doc_id", "path", F.col("value").alias("donor")), ["extractor", "doc_id", "path"], "left")
    return value.select("doc_id", "path", F.when(F.col("has"), F.col("donor")).otherwise(F.col("base")).alias("value"))


def class_report(pairs: DataFrame, keep_unseen: bool = False) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 over rows (truth, pred); pred null is an abstention.

    Classes that are only ever predicted are left out unless `keep_unseen`.
    """
    truth = pairs.groupBy(F.col("truth").alias("label")).agg(F.count_if(F.col("truth") == F.col("pred")).alias("tp"), F.count_if(~F.col("truth").eqNullSafe(F.col("pred"))).alias("fn"))
    wrong = pairs.where("pred is not null and pred <> truth").groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("fp"))
    both = truth.join(wrong, "label", "full" if keep_unseen else "left").na.fill(0, ["tp", "fn", "fp"])
    p, r, f = precision_recall(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"))
    return both.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def macro_f1(report: DataFrame) -> DataFrame:
    """Undefined F1 is left out of the sum but stays in the divisor."""
    return report.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / F.count("*")).alias("macro_f1"))


def calibrate(signals: DataFrame, least: float = 0.8) -> DataFrame:
    """signal, threshold, separation, accuracy, kept over rows (signal, value, target): midpoint gates between two means.

    Signals whose means are nearer than `least` pooled deviations are not kept.
    """
    m = signals.groupBy("signal").agg(F.avg(F.when(F.col("target"), F.col("value"))).alias("on"), F.avg(F.when(~F.col("target"), F.col("value"))).alias("off"), F.var_pop(F.when(F.col("target"), F.col("value"))).alias("von"), F.var_pop(F.when(~F.col("target"), F.col("value"))).alias("voff"))
    m = m.select("signal", ((F.col("on") + F.col("off")) / 2).alias("threshold"), F.try_divide(F.abs(F.col("on") - F.col("off")), F.sqrt((F.col("von") + F.col("voff")) / 2)).alias("separation"), (F.col("on") > F.col("off")).alias("above"))
    hit = F.when(F.col("above"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")) == F.col("target")
    return signals.join(F.broadcast(m), "signal").groupBy("signal", "threshold", "separation").agg(F.avg(hit.cast("double")).alias("accuracy")).withColumn("kept", F.coalesce(F.col("separation") >= least, F.lit(False)))


def ladder_delta(cells: DataFrame) -> DataFrame:
    """cells (profile, ladder_pos, config, value) with each config's change from the one above it."""
    w = Window.partitionBy("profile").orderBy("ladder_pos")
    return cells.withColumn("delta", F.col("value") - F.lag("value").over(w))


def grid(cells: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A table of means, one row for each `row`, one column for each of `columns`."""
    return cells.groupBy(row).pivot(column, columns).agg(F.avg(value))
