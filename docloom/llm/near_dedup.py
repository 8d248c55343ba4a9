"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

A document's set holds its distinct runs of `SHINGLE` words in lower case (A-Z); a text of fewer words is one run.
SuperMinHash gives every element one permutation of the signature's places and a rank in each, so the elements of a
set cover the places evenly; a set stops as soon as no later rank can lower any place. Bands of the signature are
bucket keys. Documents with equal sets are one class; classes that meet in a bucket are compared on full sets and
linked at a similarity of `PERCENT` / 100 or more. Links join into components.

No bucket is expanded into its pairs. First each member is compared with one centre, the weightiest of its buckets;
what links is one group. That settles a bucket whose members all link with its centre. Verification of the others, whose
members may link in any other way, goes by full sets and not by bands: a crowded bucket would have to be expanded into
all its pairs, while two sets that are similar enough must share one of their rarest elements. So members of buckets
that still span several groups meet again by those elements, in rounds: a few centres of each element's members are
compared with those of other groups that can have enough in common. A centre leaves, having met every member, and the
number of centres grows fourfold each round, until each element is within one group or has no pair left.

Hot buckets and elements: what is known of a key is aggregated on the map side and written, and its members join that
one row, a join that AQE splits when a key is hot. Full sets are written once, in buckets of the id, so no round moves
sets other than those of its own pairs.

A document with null or empty text, or without words, has an empty set and stands alone. A null doc_id stands alone
too: its component is null and it is kept. The doc_id is the node: rows that share one are one document, which links with
whatever any of their texts links with. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import exchange, hashing, workers
from docloom.llm.batches import slices, string_buffers
from docloom.llm.components import components
from docloom.llm.shared import Workspace

SHINGLE = 5
PERCENT = 85
BANDS = 24
BAND_ROWS = 6
SLICE_BYTES = 1 << 19
#: Members that one task compares with a centre.
GROUP_MEMBERS = 256

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _steps(n: int) -> np.uint64:
    return np.uint64((int(_STEP) * n) & (2**64 - 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of several texts, sorted within each, and where each text's begin and end."""
    low = hashing.LOWER[data]
    starts, ends, upto = hashing.words(low, offsets)
    rolling = hashing.Rolling(hashing.word_hashes(low, starts, ends), hashing.WORD_BASE)
    n_words = np.diff(upto)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + upto[:-1][doc]
    values = rolling.runs(first, first + np.minimum(size, n_words[doc]))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    return values, np.searchsorted(doc, np.arange(len(n) + 1))


def super_minhash(values: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash signatures of several sets as a matrix; an empty set has all ones.

    In step j each element draws a rank between j and j + 1 and the j-th place of its own permutation. A set is done
    when all its places hold ranks below j + 1.
    """
    n_sets = len(bounds) - 1
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    best = np.full(n_sets * places, np.iinfo(np.uint64).max, np.uint64)
    live, draws = np.arange(len(values)), []
    for j in range(places):
        if not len(live):
            break
        x = hashing.mixed(values[live] + _steps(j + 1))
        pick = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        draws.append(pick)
        place = pick.copy()
        for s in range(j - 1, -1, -1):  # undo the swaps (s, draws[s]) of earlier steps
            d = draws[s]
            at_s, at_d = place == s, place == d
            place[at_s] = d[at_s]
            place[at_d & ~at_s] = s
        np.minimum.at(best, owner[live] * places + place, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        worst = best.reshape(n_sets, places).max(axis=1) >> np.uint64(32)
        go_on = (worst > j)[owner[live]]
        if not go_on.all():
            live = live[go_on]
            draws = [d[go_on] for d in draws]
    return best.reshape(n_sets, places)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, cut.shape[:2])
    for r in range(rows):
        key = hashing.mixed(key * np.uint64(0xD6E8FEB86659FD93) + cut[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                values, bounds = shingle_sets(*string_buffers(part.column("text")))
                size = np.diff(bounds)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mixed(values * np.uint64(2 * salt + 1) + _steps(salt)))])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                keys = band_keys(super_minhash(values, bounds, bands * rows), bands, rows)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), listed], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id, items: the sorted shingle hashes of each text as packed uint64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                values, bounds = shingle_sets(*string_buffers(part.column("text")))
                items = [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(items, pa.binary())], ["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (centre, member, with their labels) whose full sets are similar enough.

    A centre's members are dealt to groups of bounded size; the centre's set goes to each of its groups.
    """
    crowd = pairs.groupBy("centre").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("groups"))
    dealt = pairs.join(crowd, "centre").withColumn("g", F.pmod(F.xxhash64("member"), F.col("groups")).cast("int")).drop("groups")
    members = dealt.join(sets, dealt["member"] == sets["id"]).select("centre", "g", "member", "centre_label", "member_label", "items")
    whole = sets.select(F.col("id").alias("of"), F.col("items").alias("own"))
    centres = dealt.select(F.col("centre").alias("of"), F.col("g").alias("h")).distinct().join(whole, "of")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in right.column("own").to_pylist()]
        keep = []
        for raw in left.column("items").to_pylist():
            other = np.frombuffer(raw, np.uint64)
            keep.append(any(100 * (both := int(hashing.within(other, c).sum())) >= percent * (len(c) + len(other) - both) for c in own))
        return left.select(["centre", "member", "centre_label", "member_label"]).filter(pa.array(keep, pa.bool_()))

    return members.groupBy("centre", "g").cogroup(centres.groupBy("of", "h")).applyInArrow(compare, "centre long, member long, centre_label long, member_label long")


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, rep, pos: the rarest elements of each set, by their count over all `sets`, that a linked set must share.

    With the elements of all sets in one order, rarest first, two sets that are similar enough share one among their
    first n - ceil(n * percent / 100) + 1. An element that no other set has is of no use and left out.
    """
    size = sets.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    n = max(1, -(-size // exchange.CHUNK_BYTES))
    chunks = sets.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("chunk"), "id", "items")

    def question(chunk: int, table: pa.Table) -> pa.Table:
        return exchange.tally(chunk, np.frombuffer(b"".join(table.column("items").to_pylist()), np.uint64), n)

    def use(_: int, table: pa.Table, sent: list[bytes]) -> pa.Table:
        parts = [exchange.tallied(p) for p in sent]
        known = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.uint32)
        order = np.argsort(known, kind="stable")
        known, counts = known[order], counts[order]
        out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for rep, raw in zip(table.column("id").to_pylist(), table.column("items").to_pylist(), strict=True):
            items = np.frombuffer(raw, np.uint64)
            often = np.ones(len(items), np.int64)
            there = hashing.within(items, known)
            often[there] = counts[np.searchsorted(known, items[there])]
            head = np.lexsort((items, often))[: len(items) + (-percent * len(items) // 100) + 1]
            pos = np.flatnonzero(often[head] > 1)
            for x, v in zip(out, (items[head[pos]], np.full(len(pos), rep), pos), strict=True):
                x.append(v)
        key, rep, pos = (np.concatenate(x) for x in out)
        return pa.table({"key": pa.array(key.view(np.int64)), "rep": pa.array(rep), "pos": pa.array(pos)})

    answers = exchange.frequencies(exchange.ask(chunks, question))
    return exchange.with_answers(chunks, answers, use, "key long, rep long, pos long")


def _moved(labelled: DataFrame, linked: DataFrame) -> DataFrame:
    """`labelled` with the label of each group after the links between labels."""
    groups = components(linked.select(F.col("centre_label").alias("u"), F.col("member_label").alias("v")))
    groups = groups.select(F.col("node").alias("label"), F.col("component").alias("low"))
    return labelled.join(groups, "label", "left").withColumn("label", F.coalesce("low", "label")).drop("low")


def _able(work: Workspace, members: DataFrame, percent: int) -> DataFrame:
    """Members of elements that span several groups, without those that can link with no one there.

    Sets of n and m that first share their elements at p and q have at most min(n - p, m - q) in common and need
    (n + m) * percent / (100 + percent). Seen from one set that bounds what the element's smallest set, and the one
    with most left, must offer.
    """
    reach = 100 * F.col("n_shingles") - (100 + percent) * F.col("pos")
    rows = members.withColumn("reach", reach)
    spans = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("reach").alias("far"), F.min("n_shingles").alias("small")).where("a < b").drop("a", "b")
    spans = work.written(spans, "spans")
    kept = rows.join(spans.hint("merge"), "key").where((F.col("reach") >= percent * F.col("small")) & (F.col("far") >= percent * F.col("n_shingles")))
    able = work.written(kept.select(*members.columns), "live-members")
    work.clear(spans)
    return able


def links(work: Workspace, docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links that connect what is linked: u, v over class representatives."""
    keys = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    crowds = work.written(keys.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1"), "bucket-sizes")
    met = work.written(keys.join(crowds.hint("merge"), "key"), "bucket-members")
    weight = work.written(met.groupBy("rep", "n_shingles").agg(F.sum("crowd").alias("weight")), "bucket-weights")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(weight.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi")
    sets = work.written(full_sets(texts), "full-sets", by="id")

    # each member with one centre, the weightiest of its buckets
    heavy = F.struct("weight", -F.col("rep"))
    weighed = met.select("key", "rep").join(weight, "rep")
    centres = work.written(weighed.groupBy("key").agg(F.max_by(F.struct("rep", "n_shingles", "weight"), heavy).alias("c")), "bucket-centres")
    size = F.col("n_shingles"), F.col("c.n_shingles")
    near = met.select("key", "rep", "n_shingles").join(centres.hint("merge"), "key").where((F.col("rep") != F.col("c.rep")) & (100 * F.least(*size) >= percent * F.greatest(*size)))
    first = near.groupBy("rep").agg(F.max_by("c.rep", F.struct("c.weight", -F.col("c.rep"))).alias("centre")).select("centre", F.col("rep").alias("member"), F.col("centre").alias("centre_label"), F.col("rep").alias("member_label"))
    linked = work.written(verified(work.written(first, "candidate-pairs"), sets, percent), "links-found")
    found = linked.select(F.col("centre").alias("u"), F.col("member").alias("v"))

    # members of buckets that still span groups meet again, by the rare elements of their sets
    labelled = work.written(_moved(weight.withColumn("label", F.col("rep")), linked), "labels")
    spans = met.select("key", "rep").join(labelled.select("rep", "label"), "rep").groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    spans = work.written(spans, "bucket-spans")
    apart = work.written(met.select("key", "rep").join(spans.hint("merge"), "key", "left_semi").select(F.col("rep").alias("id")).distinct(), "open-ids")
    rare = prefixes(work.written(sets.join(apart, "id", "left_semi"), "open-sets"), percent)
    open_ = work.written(rare.join(labelled, "rep").select("key", "rep", "pos", "n_shingles", "weight", "label"), "open-members")
    work.clear(crowds, met, centres, spans)
    once = _able(work, open_, percent)
    work.clear(open_)
    open_, centres_each = once, 1
    while True:
        live = _able(work, open_, percent)
        work.clear(open_)
        if live.isEmpty():
            return found
        share = F.pmod(F.xxhash64("rep", F.lit(centres_each)), F.lit(centres_each))
        chosen = work.written(live.groupBy("key", share.alias("share")).agg(F.max_by(F.struct("rep", "n_shingles", "pos", "label"), heavy).alias("c")).select("key", "c"), "centres")
        # the first element that two sets share bounds what they can have in common
        common = F.least(F.col("n_shingles") - F.col("pos"), F.col("c.n_shingles") - F.col("c.pos"))
        close = (F.col("label") != F.col("c.label")) & ((100 + percent) * common >= percent * (F.col("n_shingles") + F.col("c.n_shingles")))
        pairs = live.join(chosen.hint("merge"), "key").where(close).select(F.col("c.rep").alias("centre"), F.col("rep").alias("member"), F.col("c.label").alias("centre_label"), F.col("label").alias("member_label")).distinct()
        pairs = work.written(pairs, "candidate-pairs")
        linked = work.written(verified(pairs, sets, percent), "links-found")
        found = found.unionByName(linked.select(F.col("centre").alias("u"), F.col("member").alias("v")))
        left = live.join(chosen.select("key", F.col("c.rep").alias("rep")), ["key", "rep"], "left_anti")
        open_ = work.written(_moved(left, linked), "open-members")
        work.clear(live, chosen, pairs)
        centres_each *= 4


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    work, result = Workspace(docs.sparkSession), Workspace(docs.sparkSession)
    rows = work.written(signatures(docs), "signatures")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = work.written(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "set-classes")
    joined = rows.drop("keys").join(classes.drop("keys"), ["f1", "f2", "n_shingles"], "left")
    rep = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    joined = result.written(joined.select("doc_id", "n_shingles", rep.alias("rep")), "documents-by-class")
    # a doc_id whose rows have several sets is one node
    several = joined.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).where("u < w").drop("w")
    same = joined.join(several, "doc_id").select("u", F.col("rep").alias("v"))
    groups = components(links(work, docs, classes, percent).unionByName(same))
    work.clear()
    out = joined.join(groups, joined["rep"] == groups["node"], "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates; of rows that share its doc_id the least text.

    Rows without a doc_id stand alone and stay.
    """
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where(docs["doc_id"].isNotNull())
    named = named.join(kept, named["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = named.groupBy(F.col("doc_id").alias("of")).agg(F.min_by(whole, F.struct(F.col("text").isNull(), "text")).alias("row"))
    return one.select("row.*").unionByName(docs.where(docs["doc_id"].isNull()))
