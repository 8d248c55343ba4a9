"""Queries over the fixture tables, one for each operator family, each beside the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import geometry, parse, text
from docloom.operators import evaluate, extract, knowledge, quality, retrieval, review, rules
from docloom.plans.adapter import invoice_vendor, invoices, lines, named_lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can state it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


_LINES = """lines AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_suppkey AS vendor, l_partkey AS part, l_quantity AS quantity,
  l_extendedprice / l_quantity AS unit_price, l_discount AS discount_rate, round(l_tax * 100, 2) AS tax_rate, l_extendedprice AS gross FROM lineitem)"""
_NAMED = _LINES + """, named AS (SELECT lines.*, p_name AS description, p_type AS category, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS item_key FROM lines JOIN part ON part = p_partkey)"""
_INVOICES = """invoices AS (SELECT o_orderkey AS doc_id, o_custkey AS buyer, o_totalprice AS total, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CAST(o_orderdate AS DATE) AS day,
  'INV' || CAST(o_custkey AS VARCHAR) || strftime(o_orderdate, '%Y') AS number FROM orders)"""
_RATES = """own AS (SELECT vendor, item_key, count(*) AS n, median(unit_price) AS med, min(unit_price) AS low, max(unit_price) AS high FROM named GROUP BY ALL),
market AS (SELECT item_key, count(*) AS n, median(unit_price) AS med, min(unit_price) AS low, max(unit_price) AS high FROM named GROUP BY ALL)"""


def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.with_item_key(named_lines(spark, sf_dir))


# ---- prices, suppliers and history


@query(f"WITH {_NAMED}, {_RATES} SELECT vendor, item_key, CAST(n AS BIGINT) AS observations, med AS median, low, high FROM own")
def vendor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.price_rates(keyed_lines(spark, sf_dir), ["vendor", "item_key"])


@query(f"""WITH {_NAMED}, {_RATES} SELECT item_key, CAST(n AS BIGINT) AS observations, med AS median, CASE WHEN med <= 0 OR n < 2 THEN 0 ELSE (high - low) / 2 / med END AS spread,
CASE WHEN n < 3 THEN 0.6 ELSE greatest(0.6, CASE WHEN med <= 0 THEN 0 ELSE (high - low) / 2 / med END * 1.5) END AS band FROM market""")
def market_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = knowledge.price_rates(keyed_lines(spark, sf_dir), ["item_key"])
    s = knowledge.spread(*(F.col(c) for c in ("observations", "median", "low", "high")))
    return r.select("item_key", "observations", "median", s.alias("spread"), knowledge.band(0.6, F.col("observations"), s).alias("band"))


_VERDICT = """judged AS (SELECT rate_source, CASE WHEN rate_source = 'none' THEN NULL WHEN dev > fail THEN 'FAIL' WHEN dev > rev THEN 'REVIEW' ELSE 'PASS' END AS verdict, vendor FROM (
  SELECT *, abs(CASE WHEN med <= 0 THEN 0 ELSE (unit_price - med) / med END) AS dev, CASE WHEN rate_source = 'vendor' THEN 0.25 ELSE wide END AS rev, CASE WHEN rate_source = 'vendor' THEN 1.0 ELSE greatest(1.5, wide * 2.5) END AS fail FROM (
    SELECT *, CASE WHEN n < 3 THEN 0.6 ELSE greatest(0.6, 1.5 * CASE WHEN med <= 0 OR n < 2 THEN 0 ELSE (high - low) / 2 / med END) END AS wide FROM rated)))"""


@query(f"""WITH {_NAMED}, {_RATES}, rated AS (SELECT named.vendor, unit_price, CASE WHEN o.n >= 2 THEN 'vendor' WHEN m.n >= 3 THEN 'market' WHEN o.n IS NOT NULL THEN 'vendor_thin' ELSE 'none' END AS rate_source,
  CASE WHEN o.n >= 2 THEN o.n WHEN m.n >= 3 THEN m.n ELSE o.n END AS n, CASE WHEN o.n >= 2 THEN o.med WHEN m.n >= 3 THEN m.med ELSE o.med END AS med,
  CASE WHEN o.n >= 2 THEN o.low WHEN m.n >= 3 THEN m.low ELSE o.low END AS low, CASE WHEN o.n >= 2 THEN o.high WHEN m.n >= 3 THEN m.high ELSE o.high END AS high
  FROM named LEFT JOIN own o USING (vendor, item_key) LEFT JOIN market m ON m.item_key = named.item_key), {_VERDICT}
SELECT vendor, rate_source, verdict, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY ALL""")
def price_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counts by supplier and source of the rate; the rates are by supplier and item name."""
    all_lines = keyed_lines(spark, sf_dir)
    rated = knowledge.with_rates(all_lines, knowledge.price_rates(all_lines, ["vendor", "item_key"]), knowledge.price_rates(all_lines, ["item_key"]))
    return rules.price_verdicts(rated).groupBy("vendor", "rate_source", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES}, own AS (SELECT vendor, part, count(*) AS n, median(unit_price) AS med, min(unit_price) AS low, max(unit_price) AS high FROM lines GROUP BY ALL),
market AS (SELECT part, count(*) AS n, median(unit_price) AS med, min(unit_price) AS low, max(unit_price) AS high FROM lines GROUP BY ALL),
rated AS (SELECT lines.vendor, unit_price, CASE WHEN o.n >= 2 THEN 'vendor' WHEN m.n >= 3 THEN 'market' ELSE 'vendor_thin' END AS rate_source,
  CASE WHEN o.n >= 2 THEN o.n WHEN m.n >= 3 THEN m.n ELSE o.n END AS n, CASE WHEN o.n >= 2 THEN o.med WHEN m.n >= 3 THEN m.med ELSE o.med END AS med,
  CASE WHEN o.n >= 2 THEN o.low WHEN m.n >= 3 THEN m.low ELSE o.low END AS low, CASE WHEN o.n >= 2 THEN o.high WHEN m.n >= 3 THEN m.high ELSE o.high END AS high
  FROM lines LEFT JOIN own o USING (vendor, part) LEFT JOIN market m ON m.part = lines.part), {_VERDICT}
SELECT rate_source, verdict, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY ALL""")
def price_deviation_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As price_deviation with rates by part number, where most suppliers have one observation."""
    all_lines = lines(spark, sf_dir).withColumn("item_key", F.col("part").cast("string"))
    rated = knowledge.with_rates(all_lines, knowledge.price_rates(all_lines, ["vendor", "item_key"]), knowledge.price_rates(all_lines, ["item_key"]))
    return rules.price_verdicts(rated).groupBy("rate_source", "verdict").agg(F.count("*").alias("n"))


_TOTALS = f"{_INVOICES}, {_LINES}, firsts AS (SELECT doc_id, min(vendor) AS vendor FROM lines GROUP BY doc_id), vt AS (SELECT invoices.*, vendor FROM invoices JOIN firsts USING (doc_id))"


@query(f"""WITH {_TOTALS}, s AS (SELECT vendor, count(*) AS n, avg(total) AS mean, stddev_pop(total) AS std FROM vt GROUP BY vendor)
SELECT vendor, CAST(count(*) FILTER (abs(z) > 3) AS BIGINT) AS unusual, CAST(count(*) FILTER (abs(z) > 1.5) AS BIGINT) AS wide, CAST(count(z) AS BIGINT) AS scored FROM (SELECT vt.vendor, CASE WHEN n < 4 THEN NULL WHEN std < 1e-6 THEN 0 ELSE (total - mean) / std END AS z FROM vt JOIN s USING (vendor)) GROUP BY vendor""")
def vendor_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = invoices(spark, sf_dir).join(invoice_vendor(spark, sf_dir), "doc_id")
    z = docs.join(knowledge.vendor_amounts(docs), "vendor").withColumn("z", knowledge.amount_zscore(*(F.col(c) for c in ("total", "n", "mean", "std"))))
    return z.groupBy("vendor").agg(F.count_if(F.abs("z") > rules.Z_FLAG).alias("unusual"), F.count_if(F.abs("z") > 1.5).alias("wide"), F.count("z").alias("scored"))


@query(f"WITH {_NAMED} SELECT vendor, category, CAST(count(*) AS BIGINT) AS n FROM named GROUP BY ALL")
def vendor_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.vendor_categories(named_lines(spark, sf_dir))


@query(f"WITH {_INVOICES} SELECT number, arg_min(doc_id, {{'d': invoice_date, 'i': doc_id}}) AS first_doc FROM invoices GROUP BY number")
def first_seen_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.first_seen_numbers(invoices(spark, sf_dir), ["invoice_date", "doc_id"])


@query(f"WITH {_INVOICES}, f AS (SELECT number, arg_min(doc_id, {{'d': invoice_date, 'i': doc_id}}) AS first_doc FROM invoices GROUP BY number) SELECT doc_id, first_doc FROM invoices JOIN f USING (number) WHERE doc_id <> first_doc")
def duplicate_invoice_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = invoices(spark, sf_dir).withColumn("number", parse.normalize_invoice_number(F.col("invoice_number")))
    seen = knowledge.first_seen_numbers(docs, ["invoice_date", "doc_id"])
    return docs.join(seen, "number").where("doc_id <> first_doc").select("doc_id", "first_doc")


@query(f"""WITH {_INVOICES} SELECT a.doc_id, arg_min(b.doc_id, b.doc_id) AS other_doc FROM invoices a JOIN invoices b ON a.buyer = b.buyer AND a.doc_id <> b.doc_id AND abs(a.total - b.total) <= 2500 + 1e-9 AND abs(date_diff('day', a.day, b.day)) <= 45 GROUP BY a.doc_id""")
def duplicate_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = invoices(spark, sf_dir).withColumnRenamed("buyer", "vendor").withColumn("pos", F.col("doc_id"))
    return rules.duplicate_payments(docs, docs, cents=2500.0)


@query("SELECT s_name AS name, s_nationkey AS nation, CAST(dense_rank() OVER (ORDER BY s_nationkey) AS INT) AS nation_rank, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS seq FROM supplier")
def issuer_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running number within each group, as invoice numbers are minted."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), "s_suppkey")
    groups = knowledge.running_rank(s.select("nation").distinct().withColumn("all", F.lit(1)), ["all"], [F.col("nation")], "nation_rank").drop("all")
    return knowledge.running_rank(s, ["nation"], [F.col("s_suppkey")], "seq").join(groups, "nation").select("name", "nation", "nation_rank", "seq")


@query("""SELECT n_name AS vendor, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS values, CAST(count(DISTINCT c_mktsegment) AS INT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def identity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("vendor"), F.col("c_mktsegment").alias("segment"))
    sets = knowledge.identity_sets(knowledge.identities(docs, ["segment"]))
    return sets.select("vendor", F.array_join("values", ",").alias("values"), F.size("values").alias("n"))


@query("""WITH s AS (SELECT s_name AS name FROM supplier), a AS (SELECT 'Alias ' || s_name AS alias, s_name AS legal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_name, s_name FROM supplier WHERE s_suppkey % 7 = 0)
SELECT name, name AS legal, false AS is_alias FROM s UNION ALL SELECT alias, legal, true FROM a WHERE alias NOT IN (SELECT name FROM s)""")
def master_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    aliases = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("Alias "), "s_name").alias("alias"), F.col("s_name").alias("legal")).unionByName(s.where("s_suppkey % 7 = 0").select(F.col("s_name").alias("alias"), F.col("s_name").alias("legal")))
    return knowledge.known_names(s.select(F.col("s_name").alias("vendor")), aliases)


# ---- flags, checks and routing


@query(f"WITH {_LINES} SELECT tax_rate, CAST(count(*) AS BIGINT) AS n FROM lines WHERE tax_rate NOT IN (0, 0.125, 0.25, 1.5, 2.5, 3, 5, 6, 9, 12, 14, 18, 28) GROUP BY tax_rate")
def invalid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxes = lines(spark, sf_dir).select("doc_id", F.col("tax_rate").alias("rate"))
    flagged = rules.tax_rate_flags(taxes).groupBy("doc_id").agg(F.count("*").alias("flags"))
    # by rate, to hold each rate's lines against SQL
    bad = taxes.where(~F.col("rate").isin(rules.SPLIT_RATES)).join(flagged, "doc_id", "left_semi")
    return bad.groupBy(F.col("rate").alias("tax_rate")).agg(F.count("*").alias("n"))


@query(f"WITH {_INVOICES}, r AS (SELECT doc_id, floor(total / 500) * 500 AS total FROM invoices) SELECT doc_id FROM r WHERE total >= 10000 AND least(total % 1000, 1000 - total % 1000) < 1e-6")
def round_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = invoices(spark, sf_dir).select("doc_id", (F.floor(F.col("total") / 500) * 500).cast("double").alias("total"), F.lit(0.0).alias("z"))
    return rules.findings(docs, rules.statistical_conditions()).select("doc_id")


@query(f"""WITH {_INVOICES}, due AS (SELECT l_orderkey AS doc_id, min(CAST(l_shipdate AS DATE)) AS due FROM lineitem GROUP BY 1)
SELECT doc_id, 'due_before_invoice' AS code FROM invoices JOIN due USING (doc_id) WHERE due < day UNION ALL SELECT doc_id, 'future_invoice_date' FROM invoices JOIN due USING (doc_id) WHERE day > DATE '1998-06-30'""")
def date_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("due_date"))
    docs = invoices(spark, sf_dir).join(due, "doc_id").withColumns({"first_doc": F.lit(None).cast("long"), "gstin": F.lit(None).cast("string"), "arithmetic_problems": F.lit(0)})
    return rules.findings(docs, rules.rule_conditions(F.lit("1998-06-30").cast("date"))).select("doc_id", "code")


def _money(x: Column) -> Column:
    """Sums of money are taken as decimals, so the order of rows does not matter."""
    return x.cast("decimal(18,4)")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, CAST(sum(CAST(gross * (1 - discount_rate) AS DECIMAL(18,4))) AS DOUBLE) AS net, CAST(sum(CAST(gross * (1 - discount_rate) * tax_rate / 100 AS DECIMAL(18,4))) AS DOUBLE) AS tax FROM lines GROUP BY doc_id)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (abs(net + tax - o_totalprice) > 0.02 * greatest(abs(net + tax), abs(o_totalprice), 1)) AS BIGINT) AS mismatched FROM s JOIN orders ON doc_id = o_orderkey""")
def arithmetic_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("gross") * (1 - F.col("discount_rate"))
    sums = lines(spark, sf_dir).groupBy("doc_id").agg(F.sum(_money(net)).cast("double").alias("net"), F.sum(_money(net * F.col("tax_rate") / 100)).cast("double").alias("tax"))
    docs = sums.join(invoices(spark, sf_dir).select("doc_id", "total"), "doc_id")
    return docs.agg(F.count("*").alias("n"), F.count_if(~rules.close(F.col("net") + F.col("tax"), F.col("total"))).alias("mismatched"))


_FLAGS = f"""{_TOTALS}, s AS (SELECT vendor, count(*) AS n, avg(total) AS mean, stddev_pop(total) AS std FROM vt GROUP BY vendor),
z AS (SELECT vt.*, (total - mean) / std AS z FROM vt JOIN s USING (vendor) WHERE n >= 4),
f AS (SELECT doc_id, 'unknown_vendor' AS code, 'low' AS severity FROM vt WHERE vendor % 5 = 0 UNION ALL
  SELECT doc_id, 'unusual_amount_for_vendor', CASE WHEN abs(z) > 5 THEN 'high' ELSE 'medium' END FROM z WHERE abs(z) > 3 UNION ALL
  SELECT doc_id, 'suspiciously_round_total', 'low' FROM (SELECT doc_id, floor(total / 500) * 500 AS t FROM vt) WHERE t >= 10000 AND t % 1000 = 0),
g AS (SELECT * FROM f UNION ALL SELECT doc_id, 'combined_unknown_vendor_' || b.code, 'medium' FROM (SELECT DISTINCT doc_id FROM f WHERE code = 'unknown_vendor') a JOIN (SELECT DISTINCT doc_id, code FROM f WHERE code <> 'unknown_vendor') b USING (doc_id))"""


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = invoices(spark, sf_dir).join(invoice_vendor(spark, sf_dir), "doc_id")
    scored = docs.join(knowledge.vendor_amounts(docs), "vendor").withColumn("z", knowledge.amount_zscore(*(F.col(c) for c in ("total", "n", "mean", "std"))))
    statistical = rules.findings(scored.withColumn("total", (F.floor(F.col("total") / 500) * 500).cast("double")), rules.statistical_conditions())
    known = docs.where("vendor % 5 <> 0").select("vendor")
    nothing = docs.limit(0).select("doc_id", F.lit(1.0).alias("top"))
    return docs, rules.escalated(statistical.unionByName(rules.semantic_flags(docs, known, nothing)))


@query(f"WITH {_FLAGS} SELECT code, severity, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL")
def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical and semantic flags with their combinations, counted; every fifth supplier stands for an unknown one."""
    return _flags(spark, sf_dir)[1].groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {_FLAGS}, w AS (SELECT doc_id, max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS r FROM g GROUP BY doc_id),
d AS (SELECT vt.doc_id, r, CASE doc_id % 11 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS verdict, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS abstained FROM vt LEFT JOIN w USING (doc_id))
SELECT CASE WHEN verdict = 'FAIL' THEN 'blocked' WHEN verdict = 'REVIEW' OR r = 2 OR abstained > 0 THEN 'review' ELSE 'accepted' END AS status, CASE r WHEN 2 THEN 'high' WHEN 1 THEN 'medium' WHEN 0 THEN 'low' END AS severity, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY ALL""")
def routing_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, flags = _flags(spark, sf_dir)
    top = rules.worst(docs, flags, "severity", rules.SEVERITY, None)
    verdict = F.when(F.col("doc_id") % 11 == 0, "FAIL").when(F.col("doc_id") % 11 == 1, "REVIEW").otherwise("PASS")
    routed = rules.route(top.withColumn("verdict", verdict).withColumn("abstained", (F.col("doc_id") % 13 == 0).cast("int")))
    return routed.groupBy("status", "severity").agg(F.count("*").alias("n"))


_IDENTITY = """h AS (SELECT c_nationkey AS vendor, c_mktsegment AS account FROM customer WHERE c_custkey % 4 <> 0), q AS (SELECT c_custkey AS doc_id, c_nationkey AS vendor, c_mktsegment AS account FROM customer WHERE c_custkey % 4 = 0)"""


@query(f"""WITH {_IDENTITY}, c AS (SELECT vendor, count(*) AS n FROM h GROUP BY vendor) SELECT doc_id, 'bank_account_changed' AS code FROM q JOIN c USING (vendor) WHERE n >= 2 AND (vendor, account) NOT IN (SELECT (vendor, account) FROM h)""")
def bank_account_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("vendor"), F.col("c_mktsegment").alias("account"), F.lit(None).cast("string").alias("gstin"))
    past = c.where("doc_id % 4 <> 0")
    counts = past.groupBy("vendor").agg(F.count("*").alias("invoices"))
    return rules.identity_checks(c.where("doc_id % 4 = 0"), knowledge.identities(past, ["account", "gstin"]), counts).select("doc_id", "code")


# ---- retrieval and categories


@query("""WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, t.vec_id AS entry_id, least(1, greatest(0, round(list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v)), 12))) AS score FROM e q JOIN e t ON q.vec_id % 20 = 0)
SELECT query_id, entry_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM p) WHERE rank <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of every twentieth vector among all."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieval.dense_search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("entry_id"), "embedding"))
    return found.select("query_id", "entry_id", "rank")


@query("""WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.label AS truth, t.label AS category, t.vec_id AS entry_id, least(1, greatest(0, round(list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v)), 12))) AS score FROM e q JOIN e t ON q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM p) WHERE rank <= 5 AND score >= 0.25),
v AS (SELECT query_id, category, sum(score) AS weight, min(rank) AS first, max(score) AS top FROM k GROUP BY ALL),
w AS (SELECT query_id, arg_max(category, {'w': weight, 'r': -first}) AS win, max(weight) AS weight, sum(weight) AS total, max(top) AS top FROM v GROUP BY query_id)
SELECT e.vec_id AS query_id, CASE WHEN top >= 0.35 AND weight / total >= 0.5 THEN win END AS category, CASE WHEN total IS NULL THEN 'no neighbour' WHEN top < 0.35 THEN 'weak neighbours' WHEN weight / total < 0.5 THEN 'split vote' ELSE 'voted' END AS reason
FROM e LEFT JOIN w ON e.vec_id = w.query_id WHERE e.vec_id % 20 = 0""")
def dense_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by the vote of exact neighbours; every twentieth vector asks the others."""
    e = table(spark, sf_dir, "embeddings")
    asked, ledger = e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0")
    found = retrieval.dense_search(asked.select(F.col("vec_id").alias("query_id"), "embedding"), ledger.select(F.col("vec_id").alias("entry_id"), "embedding"))
    matches = found.join(ledger.select(F.col("vec_id").alias("entry_id"), F.col("label").cast("string").alias("category")), "entry_id")
    return retrieval.vote(asked.select(F.col("vec_id").alias("query_id")), matches).select("query_id", "category", "reason")


_GRAMS = """w AS (SELECT p_name, ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS word FROM (SELECT DISTINCT p_name FROM part)),
g AS (SELECT p_name, substr(word, CAST(i AS INT), n) AS gram FROM w, (VALUES (3), (4), (5)) s(n), generate_series(1, 60) t(i) WHERE (i <= length(word) - n + 1 OR (i = 1 AND length(word) < n AND n = 3)) AND (n = 3 OR length(word) > n - 1)),
tf AS (SELECT p_name, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram)"""


@query(f"WITH {_GRAMS} SELECT gram, CAST(df AS BIGINT) AS df FROM df")
def tfidf_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many item names have each character gram."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return retrieval.TfidfIndex._counts(names, "p_name", "p_name").groupBy("gram").agg(F.count("*").alias("df"))


@query(f"""WITH {_GRAMS}, n AS (SELECT count(DISTINCT p_name) AS n FROM w), x AS (SELECT p_name, gram, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram), n),
l AS (SELECT p_name, sqrt(sum(w * w)) AS len FROM x GROUP BY p_name), u AS (SELECT p_name, gram, w / len AS w FROM x JOIN l USING (p_name)),
s AS (SELECT a.p_name AS query_id, b.p_name AS entry_id, round(sum(a.w * b.w), 9) AS score FROM u a JOIN u b USING (gram) GROUP BY ALL)
SELECT query_id, entry_id, CAST(score AS DECIMAL(12,6)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s) WHERE rank <= 3""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three item names nearest to each, itself included, by character grams."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("entry_id"), F.col("p_name").alias("text")).distinct()
    index = retrieval.TfidfIndex(names)
    asked = index._weights(index._counts(names.withColumnRenamed("entry_id", "query_id"), "query_id", "text"), "query_id").select("query_id", "gram", F.col("weight").alias("asked"))
    scores = asked.join(index.postings, "gram").groupBy("query_id", "entry_id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), 9).alias("score"))
    return retrieval.top_k(scores, 3).select("query_id", "entry_id", F.col("score").cast("decimal(12,6)").alias("score"))


@query()
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth id: its whole text by grams among all documents, its vector by cosine among all vectors, fused."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    asked_texts, asked_vectors = (x.where("entry_id % 20 = 0").withColumnRenamed("entry_id", "query_id") for x in (texts, vectors))
    return retrieval.fused(retrieval.text_search(asked_texts, texts, 20), retrieval.dense_search(asked_vectors, vectors, 20))


# ---- scalar functions


@query("""WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_extendedprice AS p, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS s FROM lineitem)
SELECT doc_id, CAST(sum(CAST(CASE line_no % 4 WHEN 3 THEN -CAST(s AS DOUBLE) ELSE CAST(s AS DOUBLE) END AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM t GROUP BY doc_id""")
def normalize_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in four ways (currency mark, decimal comma, code, brackets) and read back."""
    s = F.col("gross").cast("decimal(18,2)").cast("string")
    way = F.col("line_no") % 4
    written = F.when(way == 0, F.concat(F.lit("₹ "), s)).when(way == 1, F.translate(s, ".", ",")).when(way == 2, F.concat(s, F.lit(" INR"))).otherwise(F.concat(F.lit("("), s, F.lit(")")))
    return lines(spark, sf_dir).select("doc_id", parse.parse_amount(written).cast("decimal(18,2)").alias("v")).groupBy("doc_id").agg(F.sum("v").alias("total"))


@query("SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, upper(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')) AS number FROM part")
def rate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), text.rate_key(F.col("p_name")).alias("key"), parse.normalize_invoice_number(F.col("p_brand")).alias("number")).distinct()


@query("""SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""")
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five layouts and read back."""
    o = table(spark, sf_dir, "orders")
    way = F.col("o_orderkey") % 5
    shown = F.coalesce(*(F.when(way == k, F.date_format("o_orderdate", layout)) for k, layout in enumerate(("yyyy-MM-dd", "d/M/yyyy", "dd MMM yyyy", "MMMM d, yyyy", "yyyyMMdd"))))
    return o.select(F.col("o_orderkey").alias("doc_id"), parse.normalize_date(shown).alias("date"))


_DIGIT = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""WITH f AS (SELECT s_suppkey AS vendor, lpad(CAST(1 + s_suppkey % 38 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'F1Z' AS head FROM supplier),
c AS (SELECT vendor, head, i, (strpos('{_DIGIT}', substr(head, CAST(15 - i AS INT), 1)) - 1) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END AS p FROM f, generate_series(1, 14) t(i))
SELECT vendor, head || substr('{_DIGIT}', CAST((36 - sum(p // 36 + p % 36) % 36) % 36 + 1 AS INT), 1) AS gstin, CAST(0 AS INT) AS problems FROM c GROUP BY vendor, head""")
def gstin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers minted with their check digit, and how many problems each has."""
    key = F.col("s_suppkey")
    head = F.concat(F.lpad((1 + key % 38).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("F1Z"))
    number = F.concat(head, parse.gstin_check_digit(head))
    return table(spark, sf_dir, "supplier").select(key.alias("vendor"), number.alias("gstin"), F.size(parse.gstin_problems(number)).alias("problems"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, a, b: the texts of each benchmark item and the one with the next id, white space collapsed."""
    b = table(spark, sf_dir, "benchmark")
    p = b.select(F.col("item_id").alias("id"), F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("b")), "id")
    return p.select("id", text.collapse(F.col("a")).alias("a"), text.collapse(F.col("b")).alias("b"))


_ASCII = "regexp_full_match(a, '[ -~]*') AND regexp_full_match(b, '[ -~]*')"


@query("""WITH p AS (SELECT a.item_id AS id, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), q AS (SELECT id, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS b FROM p)
SELECT id, levenshtein(a, b) / length(a) AS cer, 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)) AS anls FROM q WHERE """ + _ASCII)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate and normalised similarity of neighbouring benchmark items in ASCII."""
    q = _neighbours(spark, sf_dir).where(F.col("a").rlike("^[ -~]*$") & F.col("b").rlike("^[ -~]*$"))
    return q.select("id", text.cer(F.col("a"), F.col("b")).alias("cer"), text.anls(F.col("a"), F.col("b")).alias("anls"))


@query()
def text_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all neighbouring benchmark items; the SQL's edit distance counts bytes, so it can't state these."""
    return _neighbours(spark, sf_dir).select("id", text.cer(F.col("a"), F.col("b")).alias("cer"), text.anls(F.col("a"), F.col("b")).alias("anls"))


@query("SELECT page_id, CAST(regexp_matches(lower(url), '^https://') AS BOOLEAN) AS secure, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) < length(html) AS BOOLEAN) AS tagged FROM pages")
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.lower("url").startswith("https://").alias("secure"), (F.length(F.regexp_replace("html", "<[^>]*>", "")) < F.length("html")).alias("tagged"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size * 1.0 AS s FROM part), q AS (SELECT id, [0.0, 0.0, s, 10.0] AS a, [s / 2, 2.0, s * 1.5, 12.0] AS b FROM b),
r AS (SELECT id, a, b, least(a[3], b[3]) - greatest(a[1], b[1]) AS w, least(a[4], b[4]) - greatest(a[2], b[2]) AS h, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) AS t FROM q)
SELECT id, CAST(CASE WHEN w > 0 AND h > 0 THEN w * h / (t - w * h) ELSE 0 END AS DOUBLE) AS iou, CAST(least(a[1], b[1]) AS DOUBLE) AS x0, CAST(greatest(a[3], b[3]) AS DOUBLE) AS x1 FROM r""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    d = F.lit
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(d(0.0), d(0.0), s, d(10.0)).alias("a"), F.array(s / 2, d(2.0), s * 1.5, d(12.0)).alias("b"))
    around = geometry.union_box(F.array("a", "b"))
    return boxes.select("id", geometry.iou(F.col("a"), F.col("b")).alias("iou"), around[0].alias("x0"), around[2].alias("x1"))


# ---- evaluation


_PAIRS = """gold AS (SELECT c_custkey AS doc_id, 'parties.vendor.name' AS path, c_name AS value, c_mktsegment AS grp FROM customer UNION ALL SELECT c_custkey, 'totals.grand_total', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'invoice_meta.invoice_date', '2020-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'), c_mktsegment FROM customer),
pairs AS (SELECT doc_id, path, grp, value AS g, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN path = 'totals.grand_total' AND doc_id % 4 = 0 THEN CAST(CAST(CAST(value AS DOUBLE) * 1.5 AS DECIMAL(18,2)) AS VARCHAR) WHEN path = 'parties.vendor.name' AND doc_id % 5 = 0 THEN substr(value, 1, 7) WHEN path = 'invoice_meta.invoice_date' AND doc_id % 6 = 0 THEN '2020-02-01' ELSE value END AS p FROM gold),
scored AS (SELECT *, CASE WHEN p IS NULL THEN 0.0 WHEN path = 'totals.grand_total' THEN CAST(abs(CAST(g AS DOUBLE) - CAST(p AS DOUBLE)) <= 0.01 * greatest(abs(CAST(g AS DOUBLE)), 1) AS DOUBLE) WHEN path = 'invoice_meta.invoice_date' THEN CAST(g = p AS DOUBLE) ELSE 1 - levenshtein(lower(g), lower(p)) / greatest(length(g), length(p)) END AS score FROM pairs),
cmp AS (SELECT *, CASE WHEN p IS NOT NULL AND path = 'parties.vendor.name' THEN score >= 0.5 ELSE score = 1 END AS correct FROM scored)"""


def _field_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold fields from customers, predictions with planted errors and gaps, and each document's group."""
    c = table(spark, sf_dir, "customer")
    money = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    date = F.concat(F.lit("2020-01-"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0"))
    fields = F.array(*(F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in (("parties.vendor.name", F.col("c_name")), ("totals.grand_total", money), ("invoice_meta.invoice_date", date))))
    gold = c.select(F.col("c_custkey").alias("doc_id"), F.explode(fields).alias("f")).select("doc_id", "f.*")
    key, path = F.col("doc_id"), F.col("path")
    off = (
        F.when((path == "totals.grand_total") & (key % 4 == 0), (F.col("value").cast("double") * 1.5).cast("decimal(18,2)").cast("string"))
        .when((path == "parties.vendor.name") & (key % 5 == 0), F.substring("value", 1, 7))
        .when((path == "invoice_meta.invoice_date") & (key % 6 == 0), F.lit("2020-02-01"))
        .otherwise(F.col("value"))
    )
    pred = gold.where("doc_id % 9 <> 0").withColumn("value", off)
    return gold, pred, c.select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("grp"))


@query(f"WITH {_PAIRS} SELECT path, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (correct) AS BIGINT) AS n_correct, CAST(avg(score) AS DECIMAL(12,6)) AS score FROM cmp GROUP BY path")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, _ = _field_pairs(spark, sf_dir)
    return evaluate.compare_fields(gold, pred).groupBy("path").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg("score").cast("decimal(12,6)").alias("score"))


@query(f"""WITH {_PAIRS}, per AS (SELECT grp, path, count(*) AS n, count(*) FILTER (correct) AS r FROM cmp GROUP BY GROUPING SETS ((path), (grp, path)))
SELECT grp, CAST(avg(r / n) AS DECIMAL(12,6)) AS macro, CAST(sum(r) / sum(n) AS DECIMAL(12,6)) AS micro, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY grp""")
def report_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field report over all documents and for each group of them."""
    gold, pred, groups = _field_pairs(spark, sf_dir)
    fields = evaluate.compare_fields(gold, pred).join(groups, "doc_id")
    both = evaluate.field_report(fields.withColumn("grp", F.lit(None).cast("string")), ["grp"]).unionByName(evaluate.field_report(fields, ["grp"]))
    return both.select("grp", F.col("macro").cast("decimal(12,6)").alias("macro"), F.col("micro").cast("decimal(12,6)").alias("micro"), "n")


@query(f"WITH {_PAIRS} SELECT doc_id, count(*) FILTER (correct) = 3 AS critical FROM cmp GROUP BY doc_id")
def critical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, _ = _field_pairs(spark, sf_dir)
    return evaluate.critical_documents(evaluate.compare_fields(gold, pred), ["parties.vendor.name", "totals.grand_total", "invoice_meta.invoice_date"])


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 0 THEN 'missing' ELSE 'extra' END AS problem FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 10 = 0")
def id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return evaluate.id_gaps(c.where("doc_id % 10 <> 0 or doc_id % 9 = 0"), c.where("doc_id % 9 <> 0"))


@query("""WITH g AS (SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'CGST' WHEN 1 THEN 'SGST' ELSE 'IGST' END AS type, max(l_linenumber) AS pos, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (pos % 5 <> 0) AS BIGINT) AS n_right FROM g GROUP BY doc_id""")
def tax_line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold taxes against predictions of which the last of a type counts."""
    kind = F.element_at(F.array(F.lit("CGST"), F.lit("SGST"), F.lit("IGST")), F.col("line_no") % 3 + 1)
    pred = lines(spark, sf_dir).select("doc_id", kind.alias("type"), F.when(F.col("line_no") % 5 == 0, 50.0).otherwise(100.0).alias("amount"), F.col("line_no").alias("pos"))
    gold = pred.select("doc_id", "type", F.lit(100.0).alias("amount")).distinct()
    return evaluate.tax_accuracy(gold, pred).withColumnRenamed("right", "n_right")


@query()
def line_item_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each invoice against ones with shortened names and a missing last line."""
    item = F.struct("line_no", "description", F.col("gross").alias("line_total"))
    docs = named_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    worse = docs.select("doc_id", F.transform(F.slice("items", 1, F.greatest(F.size("items") - 1, F.lit(1))), lambda x: F.struct(x["line_no"].alias("line_no"), F.substr(x["description"], F.lit(1), F.lit(9)).alias("description"), x["line_total"].alias("line_total"))).alias("items"))
    return evaluate.match_items(docs, worse)


@query("""WITH s AS (SELECT e.vec_id AS id, CAST(label AS VARCHAR) AS truth, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN CAST((label + 1) % 10 AS VARCHAR) ELSE CAST(label AS VARCHAR) END AS pred FROM embeddings e),
t AS (SELECT truth AS label, count(*) FILTER (truth = pred) AS tp, count(*) FILTER (pred IS NULL OR pred <> truth) AS fn FROM s GROUP BY 1), f AS (SELECT pred AS label, count(*) AS fp FROM s WHERE pred <> truth GROUP BY 1)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / nullif(tp + fn, 0) AS recall FROM t LEFT JOIN f USING (label)""")
def confusion_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pred = F.when(F.col("vec_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("vec_id") % 5 == 0, ((F.col("label") + 1) % 10).cast("string")).otherwise(F.col("label").cast("string"))
    return evaluate.class_report(e.select(F.col("label").cast("string").alias("truth"), pred.alias("pred"))).select("label", "tp", "fp", "fn", "recall")


@query("""WITH m AS (SELECT o_orderpriority AS profile, strftime(o_orderdate, '%Y') AS config, CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL), d AS (SELECT profile, config, v - lag(v) OVER (PARTITION BY profile ORDER BY config) AS delta FROM m)
SELECT profile, config, CAST(delta AS DECIMAL(18,4)) AS delta FROM d""")
def ladder_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("profile"), F.date_format("o_orderdate", "yyyy").alias("config"))
    cells = o.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("value")).withColumn("ladder_pos", F.col("config"))
    return evaluate.ladder_delta(cells).select("profile", "config", F.col("delta").cast("decimal(18,4)").alias("delta"))


@query("""WITH s AS (SELECT l_linenumber AS signal, l_quantity AS value, l_returnflag = 'R' AS target FROM lineitem), m AS (SELECT signal, avg(value) FILTER (target) AS a, avg(value) FILTER (NOT target) AS b, var_pop(value) FILTER (target) AS va, var_pop(value) FILTER (NOT target) AS vb FROM s GROUP BY signal)
SELECT signal, CAST((a + b) / 2 AS DECIMAL(12,6)) AS threshold, CAST(abs(a - b) / sqrt((va + vb) / 2) AS DECIMAL(12,6)) AS separation, CAST(avg(CAST((CASE WHEN a > b THEN value >= (a + b) / 2 ELSE value <= (a + b) / 2 END) = target AS DOUBLE)) AS DECIMAL(12,6)) AS accuracy FROM s JOIN m USING (signal) GROUP BY ALL""")
def gate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("signal"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("target"))
    return evaluate.calibrate(s).select("signal", *(F.col(c).cast("decimal(12,6)").alias(c) for c in ("threshold", "separation", "accuracy")))


@query("""WITH s AS (SELECT p_type AS path, CASE p_size % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'model' ELSE 'empty' END AS extractor, p_size / 50.0 AS score FROM part), m AS (SELECT path, coalesce(avg(score) FILTER (extractor = 'rules'), 0) AS r, coalesce(avg(score) FILTER (extractor = 'model'), 0) AS m, coalesce(avg(score) FILTER (extractor = 'empty'), 0) AS e FROM s GROUP BY path)
SELECT path, CASE WHEN greatest(r, m, e) - r < 0.05 THEN 'rules' WHEN r >= m AND r >= e THEN 'rules' WHEN m >= e THEN 'model' ELSE 'empty' END AS winner, CAST(greatest(r, m, e) - r AS DECIMAL(12,6)) AS margin FROM m""")
def router_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(F.lit("rules"), F.lit("model"), F.lit("empty")), F.col("p_size") % 3 + 1)
    scores = table(spark, sf_dir, "part").select(F.col("p_type").alias("path"), names.alias("extractor"), (F.col("p_size") / 50.0).alias("score"))
    return evaluate.fit_router(scores, ["rules", "model", "empty"], "rules").select("path", "winner", F.col("margin").cast("decimal(12,6)").alias("margin"))


@query("""WITH c AS (SELECT l_returnflag AS config, l_linestatus AS profile, avg(CAST(l_quantity AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY ALL) SELECT config, CAST(max(v) FILTER (profile = 'F') AS DECIMAL(12,6)) AS F, CAST(max(v) FILTER (profile = 'O') AS DECIMAL(12,6)) AS O FROM c GROUP BY config""")
def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("profile"), F.col("l_quantity").alias("value"))
    return evaluate.grid(cells, "config", "profile", "value", ["F", "O"]).select("config", *(F.col(c).cast("decimal(12,6)").alias(c) for c in ("F", "O")))


# ---- extraction, review and streams


@query()
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by labels of every conversation turn's text."""
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return extract.extract(t)


@query("SELECT doc_id, CASE WHEN contains(lower(substr(text, 1, 400)), 'receipt') AND NOT contains(lower(substr(text, 1, 400)), 'invoice') THEN 'receipt' ELSE 'invoice' END AS document_type FROM documents")
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.document_type(F.col("text")).alias("document_type"))


@query("""WITH e AS (SELECT user_id AS item, event_id AS pos, event_type AS state FROM events) SELECT item, arg_max(state, pos) AS state FROM e GROUP BY item""")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each item as its last event says."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("pos"), F.col("event_type").alias("state"))
    return review.current(e, "item", "pos").select("item", "state")


@query("""WITH d AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'review' ELSE 'corrected' END AS status, o_orderdate AS created_at FROM orders), l AS (SELECT l_orderkey AS doc_id, max(l_linenumber) AS last_decision FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT doc_id, CAST(last_decision AS INT) AS last_decision FROM d LEFT JOIN l USING (doc_id) WHERE status IN ('accepted', 'corrected')""")
def accepted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "review").otherwise("corrected")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    log = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("decision_id"))
    return review.accepted_documents(docs, log).select("doc_id", "last_decision")


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.streaming.intake import event_windows as windows

    return windows(table(spark, sf_dir, "events"))


@query("""WITH l AS (SELECT o_orderkey AS doc_id, o_totalprice FROM orders) SELECT doc_id, doc_id % 3 = 0 AS no_version, doc_id % 4 = 0 AS extra_key FROM l""")
def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON documents with planted gaps and unknown keys."""
    base = F.struct(F.col("o_orderkey").cast("string").alias("doc_id"), F.struct(F.lit("x").alias("dataset")).alias("source"), F.lit("invoice").alias("document_type"), F.array().alias("pages"), F.struct(F.lit("v").alias("vendor")).alias("parties"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date")).alias("invoice_meta"), F.array().alias("line_items"), F.struct(F.col("o_totalprice").alias("grand_total")).alias("totals"))
    body = F.to_json(base)
    cut = F.expr("substring(body, 2)")
    docs = table(spark, sf_dir, "orders").withColumn("body", body).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("{"), F.when(F.col("o_orderkey") % 3 != 0, '"schema_version":"1.0.0",').otherwise(""), F.when(F.col("o_orderkey") % 4 == 0, '"zz":1,').otherwise(""), cut).alias("raw"))
    found = quality.schema_problems(F.col("raw"))
    return docs.select("doc_id", F.array_contains(found, "missing schema_version").alias("no_version"), F.array_contains(found, "unknown zz").alias("extra_key"))


from docloom.plans import judged  # noqa: E402, F401  its queries register themselves
