"""Text, number, date and country rules on literal values."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolake.functions import text, values
from cargolake.functions.fuzzy import best_match, part_ratio, ratio, weighted_ratio


def column(spark, items, change, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(change(F.col(name))).collect()]


def test_dates(spark):
    cases = {
        "202512": dt.date(2025, 12, 1), "202513": None, "2024-02-29": dt.date(2024, 2, 29),
        "2023-02-29": None, "2024-01-05 10:11": dt.date(2024, 1, 5),
        "2024-01-05T10:11:12.5": dt.date(2024, 1, 5), "28-02-2026 00:00": dt.date(2026, 2, 28),
        "1/2/2025": dt.date(2025, 2, 1), "31/4/2025": None, "2025/3/9": dt.date(2025, 3, 9),
        "2025-3-9": dt.date(2025, 3, 9), "05-Mar-2024": dt.date(2024, 3, 5),
        "5 mar 2024": dt.date(2024, 3, 5), " 2024-01-05 ": dt.date(2024, 1, 5), "n/a": None,
        "01/02/25": None, "March 5, 2024": None, "20240105": None, "": None, "05-xyz-2024": None,
        "2024-01-05 junk": None,
    }
    assert column(spark, list(cases), values.date) == list(cases.values())
    assert column(spark, [None], values.date) == [None]


def test_numbers(spark):
    cases = {"1,234.5": 1234.5, "-3": -3.0, "+.5": 0.5, "5.": 5.0, "1e3": 1000.0, "12.5d": None,
             "NaN": None, "abc": None, "": None, "1 2": None, "0x1F": None}
    assert column(spark, list(cases), values.number) == list(cases.values())


def test_countries(spark):
    cases = {" usa ": "UNITED STATES", "U.K.": "UNITED KINGDOM", "Vietnam": "VIET NAM",
             "india": "INDIA", "None": None, "-": None, "": None, "nil": "NIL"}
    assert column(spark, list(cases), values.country) == list(cases.values())


def test_product_codes(spark):
    assert column(spark, ["2930.40.00.10", "29", "n.a.", None], values.hsn) == [
        "29304000", "29", None, None]
    assert column(spark, ["29304000", "2", None], values.chapter_of) == ["29", None, None]


def test_clean_text(spark):
    cases = {" a ": "a", " x\t": "x", "N/A": None, " NIL ": None, "-": None, "": None, "nilx": "nilx"}
    assert column(spark, list(cases), text.clean_text) == list(cases.values())


def test_accent_fold_matches_unicode_rule(spark):
    samples = ["Ingrédient Æ ñ", "ﬁnal ½ ™ № ５", "日本 plain", "é", "Œuvre ß ø", "", "ascii"]
    assert column(spark, samples, text.fold_accents) == [text.ascii_fold_text(s) for s in samples]
    assert column(spark, ["2,4-D É"], text.folded_key) == [text.key_text("2,4-D É")] == ["24de"]


def test_backslash_and_wildcards_in_patterns(spark):
    names = ["a\\b", "axb", "a_b", "50% off"]
    assert column(spark, names, lambda c: text.contains(c, "a\\b")) == [True, False, False, False]
    assert column(spark, names, lambda c: text.contains(c, "A_B")) == [True, True, True, False]
    assert column(spark, names, lambda c: text.contains(c, "%o")) == [False, False, False, True]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("a,b", [("relianse", "reliance"), ("abc", "xyz"), ("a" * 70, "ab" * 40),
                                 ("basf se", "basf india limited"), ("x", "")])
def test_ratio_against_brute_force(a, b):
    assert ratio(a, b) == pytest.approx(200 * _lcs(a, b) / (len(a) + len(b)))
    short, long = sorted((a, b), key=len)
    if short and short not in long:
        n = len(short)
        windows = [long[max(0, e - n):e] for e in range(1, len(long) + n)]
        best = max(200 * _lcs(short, w) / (n + len(w)) for w in windows if w)
        assert part_ratio(a, b) == pytest.approx(best)


def test_weighted_ratio():
    assert ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(95)
    assert weighted_ratio("abc", "abc") == 100 and weighted_ratio("", "abc") == 0
    assert weighted_ratio("relianse", "reliance industries limited") > 70
    assert best_match("productdescriptin", ["quantity", "productdescription"], 88) == (
        "productdescription", 97)
    assert best_match("zzzz", ["quantity"], 88) is None


def test_accent_fold_agrees_with_unicode_everywhere(spark):
    import pandas as pd
    codes = [*range(0x80, 0xD800), *range(0xE000, 0x110000)]
    chars = spark.createDataFrame(pd.DataFrame({"id": codes, "c": list(map(chr, codes))}))
    got = chars.select("id", text.fold_accents(F.concat(F.lit("<"), "c", F.lit(">"))).alias("f")).filter("f <> '<>'")
    found = {r["id"]: r["f"][1:-1] for r in got.collect()}
    want = {i: f for i in codes if (f := text.ascii_fold_text(chr(i)))}
    assert found == want
