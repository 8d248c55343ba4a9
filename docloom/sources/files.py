"""Readers and sinks of documents, manifests, ledgers and word-level gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.schema import DOCUMENT, LEDGER_ENTRY, MANIFEST

SPLIT_ORDER = {"test": 0, "val": 1, "train": 2}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents from JSON lines. Blank lines are skipped; of documents with one id the last line counts.
    A line that is no document with an id is an error.

    A line's place is its file and offset, so the outcome does not depend on how the files are split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).where(F.trim("value") != "")
    docs = lines.select("file", "block", "pos", F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), "value")
    unread = F.raise_error(F.concat(F.lit("not a document with an id: "), F.substring("value", 1, 80)))
    docs = docs.withColumn("d", F.when(F.col("d.doc_id").isNotNull(), F.col("d")).otherwise(unread))
    last = Window.partitionBy("d.doc_id").orderBy(F.desc("file"), F.desc("block"), F.desc("pos"))
    return docs.withColumn("r", F.row_number().over(last)).where("r = 1").select("d.*")


def read_manifest(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """Manifest rows with their place `pos`, of one profile if given; an empty outcome is an error that names the profiles there are."""
    rows = spark.read.schema(MANIFEST).json(path).withColumn("pos", F.monotonically_increasing_id())
    if profile is None:
        return rows
    chosen = rows.where(F.col("profile") == profile)
    if chosen.isEmpty():
        there = sorted(r[0] for r in rows.select("profile").distinct().collect())
        raise ValueError(f"no rows of profile {profile!r}; there are {there}")
    return chosen


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ledger entries and the totals of the documents they came from."""
    ledger = spark.read.schema(f"entries array<struct<{LEDGER_ENTRY.replace(' ', ':').replace(',:', ',')}>>, doc_totals array<struct<vendor:string,grand_total:double>>").json(path, multiLine=True)
    return ledger.select(F.inline("entries")), ledger.select(F.inline("doc_totals"))


def history_documents(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """The documents that the ledger was built from."""
    return docs.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")


def select_slice(manifest: DataFrame, splits: DataFrame, limit: int) -> DataFrame:
    """The first `limit` manifest rows, test before val before train, then in manifest order."""
    order = F.create_map(*(F.lit(v) for pair in SPLIT_ORDER.items() for v in pair))
    rank = F.coalesce(F.try_element_at(order, F.col("split")), F.lit(len(SPLIT_ORDER)))
    return manifest.join(splits, "doc_id", "left").orderBy(rank, "pos").limit(limit)


def selected(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted documents; one that the corpus lacks is an error."""
    missing = wanted.join(corpus, "doc_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"not in the corpus: {[r['doc_id'] for r in missing]}")
    return corpus.join(wanted, "doc_id", "left_semi")


def assign_split(key: Column, train: float, val: float) -> Column:
    """train, val or test by a hash of the key, so a document keeps its split whatever else there is."""
    u = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000
    return F.when(u <= train, "train").when(u <= train + val, "val").otherwise("test")


def write_word_gold(words: DataFrame, path: str) -> None:
    """One JSON line for each page, by profile; boxes have two decimals."""
    word = F.struct("text", F.transform("bbox", lambda v: F.round(v, 2)).alias("bbox"), "field_path", "line_id")
    pages = words.groupBy("doc_id", "profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]).alias("words"))
    pages.write.mode("overwrite").partitionBy("profile").json(path)


def attach_replies(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents with a stored model reply each; a document without one stays, its reply null."""
    return docs.join(replies.select("doc_id", "raw_response", "elapsed_ms", "error"), "doc_id", "left")


def merge_replies(cache: DataFrame, replies: DataFrame) -> DataFrame:
    """Update cached rows by id; replies for documents that are not cached are left out."""
    fresh = replies.select("doc_id", F.col("parsed").alias("fresh"))
    return cache.join(fresh, "doc_id", "left").withColumn("parsed", F.coalesce("fresh", "parsed")).drop("fresh")


def tag_audit(tokens: DataFrame, evidence: dict[str, list[str]], first: int = 12) -> DataFrame:
    """Tags whose first tokens hold none of the words expected of them: tag, seen."""
    order = Window.partitionBy("tag").orderBy("pos")
    expected = F.create_map(*(x for k, v in evidence.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    head = tokens.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first)
    seen = head.groupBy("tag").agg(F.collect_set(F.lower("token")).alias("seen"))
    return seen.where(F.map_contains_key(expected, F.col("tag")) & ~F.arrays_overlap("seen", F.try_element_at(expected, F.col("tag")))).select("tag", F.array_sort("seen").alias("seen"))
