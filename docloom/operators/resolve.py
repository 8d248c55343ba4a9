"""Which known supplier a document is from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import name_similarity, normalize_company_name
from docloom.operators.knowledge import by_gstin

ACCEPT = 88.0


def fuzzy_names(queries: DataFrame, names: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """name, match, score: the most similar known name of each distinct query name, if similar enough.

    A score of `accept` bounds how far the two lengths can differ, and every pair that reaches it shares a character
    pair unless a name is very short, so distinct names meet in buckets of length and letter pairs, not in all pairs.
    The known names come with `pos`, the tie-break.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substr(c, i, F.lit(2))))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        plain = F.array_join(F.array_sort(F.split(normalize_company_name(F.col(name)), " ")), " ")
        return df.withColumn("norm", plain).withColumn("len", F.length("norm")).where("len > 0")

    q = keyed(queries.select("name").where("name is not null").distinct(), "name")
    m = keyed(names.select(F.col("name").alias("match"), "pos"), "match")
    left = q.select("name", "len", F.explode(grams(F.col("norm"))).alias("gram"))
    right = m.select("match", "pos", F.col("len").alias("match_len"), F.explode(grams(F.col("norm"))).alias("gram"))
    reach = accept / (200 - accept)
    pairs = left.join(right, "gram").where((F.col("match_len") >= F.floor(F.col("len") * reach)) & (F.col("len") >= F.floor(F.col("match_len") * reach))).select("name", "match", "pos").distinct()
    scored = pairs.withColumn("score", name_similarity(F.col("name"), F.col("match"))).where(F.col("score") >= accept)
    best = Window.partitionBy("name").orderBy(F.desc("score"), "pos")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "match", "score")


def resolve(docs: DataFrame, master: DataFrame, names: DataFrame) -> DataFrame:
    """docs with resolved vendor and method: gstin, conflict, exact_name, fuzzy_name or unresolved.

    `docs` has doc_id, name, gstin; `master` vendor, gstin, first_seen; `names` name, legal, is_alias, pos. A tax number
    decides unless the name is that of another supplier, which is a conflict that goes to the name's supplier.
    """
    legal = names.where(~F.col("is_alias")).select("name", F.col("legal").alias("exact"))
    found = fuzzy_names(docs, names).join(names.select(F.col("name").alias("match"), F.col("legal").alias("fuzzy")), "match").select("name", "fuzzy", "score")
    joined = by_gstin(docs, master).join(legal, "name", "left").join(found, "name", "left")
    by_name = F.coalesce("exact", "fuzzy")
    conflict = F.col("gstin_vendor").isNotNull() & by_name.isNotNull() & (by_name != F.col("gstin_vendor"))
    method = F.when(conflict, "conflict").when(F.col("gstin_vendor").isNotNull(), "gstin").when(F.col("exact").isNotNull(), "exact_name").when(F.col("fuzzy").isNotNull(), "fuzzy_name").otherwise("unresolved")
    return joined.withColumn("method", method).withColumn("vendor", F.when(conflict, by_name).otherwise(F.coalesce("gstin_vendor", by_name))).drop("exact", "fuzzy")
