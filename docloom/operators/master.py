"""The supplier master: what earlier documents say of each supplier, as one set of tables to build, keep and ask."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import knowledge


@dataclass
class SupplierMaster:
    """invoices (vendor, invoices, first_seen), identities (vendor, kind, value), amounts (vendor, n, mean, std), rates
    (vendor, item_key, observations, median, low, high) and market, the same over all suppliers."""

    invoices: DataFrame
    identities: DataFrame
    amounts: DataFrame
    rates: DataFrame
    market: DataFrame

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SupplierMaster:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})

    def record(self, vendor) -> DataFrame:
        """All that is known of one supplier as one row; none if it is unknown."""
        return self.records().where(F.col("vendor") == vendor)

    def records(self) -> DataFrame:
        """One row for each supplier: invoices, first_seen, n, mean, std, values by kind."""
        seen = knowledge.identity_sets(self.identities).groupBy("vendor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values")))).alias("values"))
        return self.invoices.join(self.amounts, "vendor", "left").join(seen, "vendor", "left")


def build_master(docs: DataFrame, lines: DataFrame, kinds: list[str], aliases: DataFrame | None = None) -> SupplierMaster:
    """The master of documents (doc_id, vendor, total, pos and the columns `kinds`) and lines (vendor, description, unit_price).

    Trading names count as the legal names that `aliases` (alias, legal) gives them; `pos` is the order of history.
    """
    docs = knowledge.folded_names(docs, aliases).where("vendor is not null")
    keyed = knowledge.with_item_key(knowledge.folded_names(lines, aliases))
    invoices = docs.groupBy("vendor").agg(F.count("*").alias("invoices"), F.min("pos").alias("first_seen"))
    rates, market = (knowledge.price_rates(keyed, by) for by in (["vendor", "item_key"], ["item_key"]))
    return SupplierMaster(invoices, knowledge.identities(docs, kinds), knowledge.vendor_amounts(docs), rates, market)
