"""What accepted history says: suppliers, their amounts, prices, categories and invoice numbers.

Every table is a grouped aggregate over long line or document tables, so it is partially aggregated before the one
shuffle on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.parse import normalize_gstin, normalize_invoice_number
from docloom.functions.text import rate_key

#: Fewest totals that give a score, and fewest prices of a supplier's own and of the market.
MIN_TOTALS, MIN_VENDOR_RATES, MIN_MARKET_RATES = 4, 2, 3


def vendor_amounts(totals: DataFrame) -> DataFrame:
    """vendor, n, mean, std (of the population) over rows (vendor, total)."""
    return totals.where("vendor is not null and total is not null").groupBy("vendor").agg(F.count("*").alias("n"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"))


def amount_zscore(total: Column, n: Column, mean: Column, std: Column) -> Column:
    """Null with too little history; with no spread, 0 at the mean and infinity elsewhere."""
    gap = total - mean
    flat = F.when(F.abs(gap) < 1e-6, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(n < MIN_TOTALS, F.lit(None).cast("double")).when(std < 1e-6, flat).otherwise(gap / std)


def vendor_categories(entries: DataFrame) -> DataFrame:
    """vendor, category, n."""
    return entries.where("vendor is not null").groupBy("vendor", "category").agg(F.count("*").alias("n"))


def folded_names(docs: DataFrame, aliases: DataFrame | None = None, column: str = "vendor") -> DataFrame:
    """`docs` with trading names replaced by legal ones; `aliases` has alias, legal."""
    if aliases is None:
        return docs
    return docs.join(aliases, docs[column] == aliases["alias"], "left").withColumn(column, F.coalesce("legal", column)).drop("alias", "legal")


def identities(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """vendor, kind, value: every identifier each supplier has been seen with, trimmed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.nullif(F.trim(F.col(k)), F.lit("")).alias("value")) for k in kinds)))
    return docs.select("vendor", pairs.alias("p")).select("vendor", "p.kind", "p.value").where("vendor is not null and value is not null").distinct()


def identity_sets(known: DataFrame) -> DataFrame:
    """vendor, kind, values: sorted."""
    return known.groupBy("vendor", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))


def price_rates(lines: DataFrame, by: list[str]) -> DataFrame:
    """Observations, median, least and greatest unit price over rows (vendor, item_key, unit_price)."""
    priced = lines.where("item_key <> '' and unit_price > 0")
    return priced.groupBy(*by).agg(F.count("*").alias("observations"), F.median("unit_price").alias("median"), F.min("unit_price").alias("low"), F.max("unit_price").alias("high"))


def with_item_key(lines: DataFrame, description: str = "description") -> DataFrame:
    return lines.withColumn("item_key", rate_key(F.col(description)))


def spread(observations: Column, median: Column, low: Column, high: Column) -> Column:
    """Half the range over the median; 0 where a single price or none is known."""
    return F.when((median <= 0) | (observations < 2), 0.0).otherwise((high - low) / 2 / median)


def band(floor: float, observations: Column, spread_: Column, slack: float = 1.5, enough: int = 3) -> Column:
    """How far a price may move: the floor, or more where prices are known to vary."""
    return F.when(observations < enough, F.lit(floor)).otherwise(F.greatest(F.lit(floor), spread_ * slack))


def deviation(price: Column, median: Column) -> Column:
    return F.when(median <= 0, 0.0).otherwise((price - median) / median)


def with_rates(lines: DataFrame, vendor_rates: DataFrame, market_rates: DataFrame) -> DataFrame:
    """Lines with the rate that judges them: the supplier's own, the market's, the supplier's thin one, or none.

    Adds rate_source and observations, median, low, high of the chosen rate.
    """
    own = vendor_rates.select("vendor", "item_key", F.struct("observations", "median", "low", "high").alias("own"))
    market = market_rates.select("item_key", F.struct("observations", "median", "low", "high").alias("market"))
    joined = lines.join(own, ["vendor", "item_key"], "left").join(market, "item_key", "left")
    source = F.when(F.col("own.observations") >= MIN_VENDOR_RATES, "vendor").when(F.col("market.observations") >= MIN_MARKET_RATES, "market").when(F.col("own").isNotNull(), "vendor_thin").otherwise("none")
    rate = F.when(source == "market", F.col("market")).when(source != "none", F.col("own"))
    return joined.withColumn("rate_source", source).withColumn("rate", rate).drop("own", "market").select("*", "rate.*").drop("rate")


def first_seen_numbers(docs: DataFrame, order: list[str]) -> DataFrame:
    """number, first_doc: who had an invoice number first, in history order, whatever the supplier."""
    rows = docs.withColumn("number", normalize_invoice_number(F.col("invoice_number"))).where("number is not null")
    return rows.groupBy("number").agg(F.min_by("doc_id", F.struct(*order)).alias("first_doc"))


def known_names(legal: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, legal, is_alias: legal names, and aliases that are no legal name themselves."""
    own = legal.select(F.col("vendor").alias("name"), F.col("vendor").alias("legal"), F.lit(False).alias("is_alias")).distinct()
    other = aliases.join(own.select("name"), aliases["alias"] == F.col("name"), "left_anti").select(F.col("alias").alias("name"), "legal", F.lit(True).alias("is_alias"))
    return own.unionByName(other)


def by_gstin(queries: DataFrame, master: DataFrame) -> DataFrame:
    """Queries with the first supplier seen with their tax number; master has vendor, gstin, first_seen."""
    owner = master.where("gstin is not null").groupBy(F.trim("gstin").alias("key")).agg(F.min_by("vendor", F.struct("first_seen", "vendor")).alias("gstin_vendor"))
    return queries.withColumn("key", normalize_gstin(F.col("gstin"))).join(owner, "key", "left").drop("key")


def running_rank(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
