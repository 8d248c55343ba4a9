import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import geometry, parse, text


def values(spark, expression, rows, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(expression).collect()]


def test_amounts(spark):
    given_ = ["1,234.56", "1.234,56", "₹ 1,00,000.00", "Rs. 250", "(45.10)", "-12", "1,50", "1,500", "USD 9", "", "abc", None, "1.2.3", "12d", "$5"]
    want = [1234.56, 1234.56, 100000.0, 0.25, -45.10, -12.0, 1.5, 1500.0, 9.0, None, None, None, None, 12.0, 5.0]
    want[3] = 250.0
    assert values(spark, parse.parse_amount(F.col("x")), given_) == want


def test_quantities_rates_and_currencies(spark):
    assert values(spark, parse.parse_quantity(F.col("x")), ["12 nos", "2.5 kg", "none", None, "-3 x"]) == [12.0, 2.5, None, None, -3.0]
    assert values(spark, parse.parse_rate(F.col("x")), ["18%", "@18 %", "", None]) == [18.0, 18.0, None, None]
    assert values(spark, parse.detect_currency(F.col("x")), ["€ 5", "5 inr", "Rs. 4", "none", None]) == ["EUR", "INR", "INR", None, None]


def test_dates(spark):
    shown = ["2026-01-05", "5-1-2026", "05/01/2026", "5 Jan 2026", "January 5, 2026", "20260105", "13/25/2026", "01/25/2026", "5.1.26", "nonsense", None, ""]
    want = ["2026-01-05"] * 6 + [None, "2026-01-25", "2026-01-05", None, None, None]
    assert values(spark, parse.normalize_date(F.col("x")), shown) == want
    assert values(spark, parse.normalize_date(F.col("x"), day_first=False), ["03/04/2026"]) == ["2026-03-04"]


def test_tax_numbers(spark):
    heads = ["29AAAAA0000A1Z", "27ABCDE1234F1Z", "07AABCU9603R1Z", "short", None]
    assert values(spark, parse.gstin_check_digit(F.col("x")), heads) == ["Y", "0", "P", None, None]
    assert values(spark, parse.gstin_problems(F.col("x")), ["29aaaaa0000a1zy", "29AAAAA0000A1ZX", "99", None, "00AAAAA0000A1Z0"])[:4] == [[], ["checksum"], ["length"], ["empty"]]


def test_edit_distances(spark):
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("", "x"), ("Invoice", "invoice ")], "a string, b string")
    got = rows.select(text.wer(F.col("a"), F.col("b")), text.cer(F.col("a"), F.col("b")), text.anls(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 0.5 and tuple(got[1]) == (0.0, 0.0, 1.0) and tuple(got[2][:2]) == (1.0, 1.0) and got[3][2] == 1.0


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_common_subsequence_is_that_of_the_table(a, b):
    assert text.lcs_length(a, b) == lcs_by_table(a, b)
    assert 0 <= text.indel_ratio(a, b) <= 100 and text.indel_ratio(a, b) == text.indel_ratio(b, a)


def test_names(spark):
    rows = spark.createDataFrame([("Acme & Sons", "acme and sons"), ("Sons Acme", "Acme Sons"), ("", "x"), ("Arjun & Co", "Arjun Pvt Ltd")], "a string, b string")
    got = [r[0] for r in rows.select(text.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == got[1] == 100.0 and got[2] == 0.0 and got[3] < 88
    assert values(spark, text.normalize_text(F.col("x")), ["Ｆｕｌｌ, width!", "ÄÖ  ü", None]) == ["full width", "äö ü", None]
    assert values(spark, text.fold_glyphs(F.col("x")), ["lnv0ice 5|!"]) == ["invoice sii"]


@pytest.mark.parametrize("shift", [0.0, 0.5, 1.0, 2.0])
def test_overlap(spark, shift):
    a, b = [0.0, 0.0, 1.0, 1.0], [shift, 0.0, 1.0 + shift, 1.0]
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(geometry.iou(F.col("a"), F.col("b")), geometry.union_box(F.array("a", "b"))).first()
    inner = max(0.0, 1 - shift)
    assert got[0] == pytest.approx(inner / (2 - inner)) and got[1] == [0.0, 0.0, 1.0 + shift, 1.0]


def test_homography(spark):
    box = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "b array<double>")
    move = F.array(*map(F.lit, [2.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]))
    assert box.select(geometry.through_homography(F.col("b"), move)).first()[0] == [3.0, 2.0, 7.0, 4.0]


def test_every_assignment_is_cheapest():
    import numpy as np

    from docloom.operators.evaluate import assignment

    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.integers(0, 9, (n, m)).astype(float)
        pairs = assignment(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(cost[i, j] for i, j in pairs) == best
