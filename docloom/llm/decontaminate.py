"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Every run of `WINDOW` words of a benchmark item is a phrase; an item of fewer words is one phrase. A phrase's rarest
words by corpus count are its anchors. The index stores the training postings (term, document, position) of anchor
terms. Postings moved back by their offset in a phrase meet where the phrase may begin; a place at which all anchors
meet is compared with the document's own words, so matches are exact. `proximity` returns the places where terms
stand within a span in any order.

A document with null or empty text has no words and is clean. A null or wordless item has no phrase; a match of an
item with a null id marks words but is not listed. Repeated rows each get their result; rows that share a doc_id are
told apart by their text. Empty tables give clean documents or none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

WINDOW = 13
#: Rarest words of a phrase whose postings must meet.
ANCHORS = 3
#: Bytes of a written term or phrase table that is broadcast; beyond that Spark merges, and splits hot terms.
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and what is beyond ASCII, with A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), lambda w: w != "")


def _bounded(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if Spark's own estimate, for written tables the size of their files, allows it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct phrases: phrase (joined words), n, items (the ids that have it)."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (window - 1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    return cut.groupBy(F.concat_ws(" ", "words").alias("phrase")).agg(F.first(F.size("words")).alias("n"), F.collect_set(F.col("item_id").cast("string")).alias("items"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("text_hash"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of `terms` stands in the corpus: term, count; terms that never do are left out."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(_bounded(terms), "term").groupBy("term").count()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of `terms`: term, doc_id, text_hash, pos (from 0)."""
    tokens = keyed(docs).select("doc_id", "text_hash", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(_bounded(terms), "term").select("term", "doc_id", "text_hash", "pos")


def rarest_terms(phrases: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """The anchors of each phrase that can occur: phrase_hash, term, offset, needed."""
    terms = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    known = terms.join(counts, "term")
    whole = Window.partitionBy("phrase")
    rare = Window.partitionBy("phrase").orderBy("count", "offset")
    picked = known.withColumn("found", F.count("*").over(whole)).where(F.col("found") == F.col("n")).withColumn("r", F.row_number().over(rare)).where(F.col("r") <= anchors)
    return picked.select(F.xxhash64("phrase").alias("phrase_hash"), "term", "offset", F.least(F.col("n"), F.lit(anchors)).alias("needed"))


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places at which all anchors of a phrase meet: doc_id, text_hash, start, phrase_hash."""
    moved = index.join(_bounded(anchors), "term").select("doc_id", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "phrase_hash", "needed").where("start >= 0")
    return moved.groupBy("doc_id", "text_hash", "start", "phrase_hash").agg(F.count("*").alias("met"), F.first("needed").alias("needed")).where("met >= needed").drop("met", "needed")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    return _judged(docs, items, window).drop("text")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, whole and with all their columns, that are not contaminated."""
    judged = _judged(docs, items, window).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.xxhash64("text").alias("hit_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(judged["hit_id"]) & (F.xxhash64(docs["text"]) == judged["hit_hash"])
    return docs.join(judged, same, "left_anti")


def _judged(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    phrases = written(phrases_of(items, window), "phrases")
    vocabulary = written(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "terms")
    counts = written(term_counts(docs, vocabulary), "term-counts")
    anchors = written(rarest_terms(phrases, counts), "anchors")
    index = written(postings(docs, anchors.select("term").distinct()), "postings")
    places = candidates(index, anchors)
    found = places.join(_bounded(phrases.withColumn("phrase_hash", F.xxhash64("phrase"))), "phrase_hash").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "n", "phrase", "items"))).alias("places"))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "places")

    rows = keyed(docs)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["hit_id"]) & (rows["text_hash"] == found["hit_hash"]), "left").select("doc_id", "text", words_of(F.col("text")).alias("words"), "places")
    exact = F.filter(F.coalesce("places", F.array().cast(found.schema["places"].dataType)), lambda p: F.concat_ws(" ", F.slice("words", p["start"] + 1, p["n"])) == p["phrase"])
    checked = joined.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), exact.alias("places"))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def cover(acc: Column, p: Column) -> Column:
        end = p["start"] + p["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["start"]))).alias("hit"))

    listed = F.sort_array(F.array_distinct(F.flatten(F.transform("places", lambda p: p["items"]))))
    out = checked.select("doc_id", "text", "n_words", F.aggregate("places", nothing, cover)["hit"].alias("n_hit"), listed.alias("listed"))
    return out.select("doc_id", "text", "n_words", "n_hit", F.size("listed").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "listed"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def proximity(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """Where all `terms` stand within `span` words, in any order: doc_id, text_hash, pos of the rarest term.

    The rarest term's list leads; each further term's list is joined to the places that are left, by document and
    position block, and a place stays if the term is there within the span.
    """
    wanted = sorted(set(terms))
    counts = {r["term"]: r["count"] for r in index.where(F.col("term").isin(wanted)).groupBy("term").count().collect()}
    order = sorted(wanted, key=lambda t: (counts.get(t, 0), t))
    left = index.where(F.col("term") == order[0]).select("doc_id", "text_hash", "pos").distinct()
    for term in order[1:]:
        other = index.where(F.col("term") == term).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("p"))
        other = other.withColumn("block", F.explode(F.array(*[F.floor(F.col("p") / span) + k for k in (-1, 0, 1)])))
        near = left["doc_id"].eqNullSafe(other["d"]) & (left["text_hash"] == other["h"]) & (F.floor(left["pos"] / span) == other["block"]) & (F.abs(left["pos"] - other["p"]) < span)
        left = left.join(other, near, "left_semi")
    return left
