"""Foreign annotation shapes to canonical columns, as expressions over typed inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.geometry import polygon_box, union_box
from docloom.functions.parse import clean_text, detect_currency, normalize_date, parse_amount


def tokens_of(tags: Column, values: Column, wanted: int) -> Column:
    """The values whose tag is `wanted`, in order."""
    return F.transform(F.filter(F.arrays_zip(tags.alias("tag"), values.alias("value")), lambda z: z["tag"] == wanted), lambda z: z["value"])


def without_labels(tokens: Column, labels: list[str]) -> Column:
    """Tokens that are no label word and not only punctuation."""
    bare = lambda t: F.lower(F.regexp_replace(t, r"(?U)^[^\w]+|[^\w]+$", ""))
    return F.filter(tokens, lambda t: (bare(t) != "") & ~bare(t).isin(labels))


def tagged_page(rows: DataFrame, tags: dict[str, int], labels: list[str]) -> DataFrame:
    """Header fields of tagged-token pages: number, date, buyer, amount and currency, with the boxes they came from."""
    words = lambda name: without_labels(tokens_of(F.col("ner_tags"), F.col("tokens"), tags[name]), labels)
    box = lambda name: union_box(tokens_of(F.col("ner_tags"), F.transform("bboxes", lambda b: b.cast("array<double>")), tags[name]))
    joined = lambda name: clean_text(F.array_join(words(name), " "))
    dates = F.filter(F.transform(words("date"), normalize_date), lambda d: d.isNotNull())
    amounts = F.filter(F.transform(words("total"), parse_amount), lambda a: a.isNotNull())
    currencies = F.filter(F.transform(words("total"), lambda t: detect_currency(t)), lambda c: c.isNotNull())
    return rows.select(
        "doc_id",
        joined("number").alias("invoice_number"),
        F.coalesce(F.get(dates, F.lit(0)), normalize_date(joined("date"))).alias("invoice_date"),
        joined("buyer").alias("buyer_name"),
        F.get(amounts, F.lit(0)).alias("grand_total"),
        F.try_element_at(currencies, F.lit(-1)).alias("currency"),
        F.create_map(*(x for name in ("number", "date", "buyer", "total") for x in (F.lit(name), box(name)))).alias("boxes"),
    )


def labelled_lines(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Labelled OCR lines to one text for each label, lines joined from top to bottom."""
    lines = rows.select("doc_id", F.transform("ocr", lambda o: F.struct(polygon_box(o["box"]).alias("box"), o["label"].alias("label"), o["text"].alias("text"))).alias("lines"))

    def text(label: str) -> Column:
        mine = F.filter("lines", lambda o: o["label"] == label)
        ordered = F.array_sort(F.transform(mine, lambda o: F.struct(o["box"][1].alias("y"), o["box"][0].alias("x"), o["text"].alias("text"))))
        return clean_text(F.array_join(F.transform(ordered, lambda o: o["text"]), " "))

    return lines.select("doc_id", *(text(x).alias(x) for x in labels))


def receipt_items(menu_json: Column) -> Column:
    """Menu rows of a receipt tree; a receipt of one item has an object where others have a list."""
    kind = "struct<nm:string,cnt:string,unitprice:string,price:string>"
    many, one = F.from_json(menu_json, f"array<{kind}>"), F.from_json(menu_json, kind)
    menu = F.when(F.ltrim(menu_json).startswith("["), many).otherwise(F.array(one))
    number = lambda x: F.translate(x, ",", "").try_cast("double")
    item = lambda m, i: F.struct((i + 1).alias("line_no"), m["nm"].alias("description"), number(m["cnt"]).alias("quantity"), number(m["unitprice"]).alias("unit_price"), number(m["price"]).alias("line_total"))
    return F.transform(menu, item)


def percent_box(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A box in percent of the page, in pixels."""
    return F.array(x * page_width / 100, y * page_height / 100, (x + width) * page_width / 100, (y + height) * page_height / 100)


def zone_amounts(tokens: DataFrame) -> DataFrame:
    """Descriptions with the amount beside each: the first unclaimed one in the zone down to the next description.

    A zone reaches 0.6 line heights above its description, and 1.5 below the last one. Zones overlap, so what is
    claimed depends on the order; a page is one small group. Columns: doc_id, kind (description or amount), y, h, text.
    """
    schema = "doc_id string, line_no int, description string, amount string"

    def claim(page):
        import pandas as pd

        items = page[page.kind == "description"].sort_values(["y", "text"]).reset_index(drop=True)
        amounts = page[page.kind == "amount"].sort_values(["y", "text"]).reset_index(drop=True)
        used, out = set(), []
        for i, d in items.iterrows():
            low = d.y - 0.6 * d.h
            high = items.y[i + 1] if i + 1 < len(items) else d.y + 1.5 * d.h
            hit = next((k for k, a in amounts.iterrows() if k not in used and low <= a.y < high), None)
            used |= {hit} - {None}
            out.append((d.doc_id, i + 1, d.text, None if hit is None else amounts.text[hit]))
        return pd.DataFrame(out, columns=["doc_id", "line_no", "description", "amount"])

    return tokens.groupBy("doc_id").applyInPandas(claim, schema)


def first_of_label(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """The first row of each label within a key."""
    w = Window.partitionBy(key, label).orderBy(order)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def receipt_date(text: Column) -> Column:
    """A date anywhere in a receipt's line as ISO text: year first, with a month's name, or in figures.

    Of figures one over twelve is the day; otherwise the day comes first. Years of two digits from 70 on are of the last
    century. A date that the calendar lacks is null.
    """

    def built(pattern: str, year: int, month: int, day: int) -> Column:
        y, m, d = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in (year, month, day))
        whole = F.when(F.length(y) <= 2, F.when(y.try_cast("int") < 70, 2000).otherwise(1900) + y.try_cast("int")).otherwise(y.try_cast("int"))
        named = F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(MONTH_STEMS, 1) for x in (n, k))), F.lower(F.substring(m, 1, 3)))
        number = F.coalesce(m.try_cast("int"), named)
        first_day = d.try_cast("int")
        swap = (number > 12) & (first_day <= 12)
        padded = [F.lpad(x.cast("string"), width, "0") for x, width in ((whole, 4), (F.when(swap, first_day).otherwise(number), 2), (F.when(swap, number).otherwise(first_day), 2))]
        made = F.concat(padded[0], F.lit("-"), padded[1], F.lit("-"), padded[2])
        return F.date_format(F.try_to_date(made, "yyyy-MM-dd"), "yyyy-MM-dd")

    stem = "(" + "|".join(MONTH_STEMS) + r")[a-z]*"
    return F.coalesce(
        built(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3),
        built(rf"(?i)(\d{{1,2}})[ \-/]*{stem}[ \-/,.]*(\d{{4}}|\d{{2}})", 3, 2, 1),
        built(rf"(?i){stem}[ .]*(\d{{1,2}})[ ,]+(\d{{4}}|\d{{2}})", 3, 1, 2),
        built(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", 3, 2, 1),
    )


def receipt_total(text: Column) -> Column:
    """The digits and the dot of a receipt's total; signs and commas are lost, as on the receipts themselves."""
    return F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double")


MONTH_STEMS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
