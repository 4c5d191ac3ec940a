"""Cleaning, de-duplication, roll-ups and names."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cargolake.operators import advanced, analytics as a, cleaning as c, entities
from cargolake.schema import SHIPMENT_COLUMNS, SHIPMENT_SCHEMA
from support import plan


def rows(spark, *items):
    return spark.createDataFrame([tuple(i.get(n) for n in SHIPMENT_COLUMNS) for i in items], SHIPMENT_SCHEMA)


def test_clean_types_and_order(spark):
    text = spark.createDataFrame([tuple({"Date": "31/12/2024", "Value": "1,5", "HSN": "2930.4", "Mode": " air ",
                                         "Country": "usa", "Source File": "f", "Importer": "nil"}.get(n)
                                        for n in SHIPMENT_COLUMNS)] * 2,
                                 ", ".join(f"`{n}` string" for n in SHIPMENT_COLUMNS))
    df = c.clean(text)
    assert {f.name: f.dataType for f in df.schema} == {f.name: f.dataType for f in SHIPMENT_SCHEMA}
    row, = df.collect()
    assert (row["Date"], row["Value"], row["HSN"], row["HS Chapter"], row["Mode"], row["Country"],
            row["Importer"]) == (dt.date(2024, 12, 31), 15.0, "29304", "29", "AIR", "UNITED STATES", None)


def test_drop_empty(spark):
    df = rows(spark, {"Source File": "f", "Trade Type": "IMPORT"}, {"Reporting Country": "INDIA"},
              {"Port": "p"})
    assert c.drop_empty(df).count() == 2
    assert c.drop_empty(df, c.ALL_STAMPED_COLUMNS).count() == 1


def test_dedupe_across_files_keeps_first_file(spark):
    base = {"Importer": "A", "Value": 1.0, "Date": dt.date(2024, 1, 1)}
    items = [{**base, "Source File": f, "Port": p} for f, p in
             (("b.csv", "x"), ("a.csv", "z"), ("a.csv", "y"))] + [{"Importer": None}, {"Importer": None}]
    for _ in range(3):
        random.shuffle(items)
        got = {(r["Source File"], r["Port"]) for r in c.dedupe_across_files(rows(spark, *items)).collect()}
        assert got == {("a.csv", "y"), (None, None)}


def test_dedupe_limits_a_hot_key_before_the_shuffle(shipments):
    text = plan(c.dedupe_across_files(shipments))
    before = text[text.rindex("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_duplicates_after_dedupe_are_none(shipments):
    twice = shipments.unionByName(shipments.withColumn("Source File", F.lit("again")))
    found = advanced.duplicates(twice, limit=5).collect()
    assert len(found) == 10 and {r["occurrences"] for r in found} == {2}
    assert sum(r["Source File"] == "again" for r in found) == 5
    assert advanced.duplicates(c.dedupe_across_files(twice)).count() == 0


def test_overlap(spark):
    df = rows(spark, {"HSN": "2901", "Date": dt.date(2025, 3, 1)}, {"HSN": "2901", "Date": dt.date(2025, 2, 28)},
              {"HSN": "3001", "Date": dt.date(2025, 3, 1)}, {"HSN": "3801"}, {"HSN": "30"})
    kept, audit = c.exclude_overlap(df)
    assert kept.count() == 3 and [tuple(r) for r in audit.collect()] == [("29", 1)]


def test_top_parties_are_ordered(shipments):
    got = a.top_parties(shipments, "Importer", 10).collect()
    values = [r["total_value"] for r in got]
    assert len(got) == 10 and values == sorted(values, reverse=True) and all(r["name"] for r in got)
    with pytest.raises(ValueError):
        a.top_parties(shipments, "Port")


def test_hhi_and_shares(spark):
    df = rows(spark, *({"Importer": "Acme", "Supplier": s, "Value": v} for s, v in
                       (("S1", 50.0), ("S2", 25.0), (None, 25.0), ("S3", None))), {"Importer": "Other", "Value": 9.0})
    row = advanced.concentration(df, "acme").first()
    assert (row["total_suppliers"], row["total_value"], row["hhi"]) == (3, 100.0, 3125.0)
    shares = {r["supplier"]: r["share_pct"] for r in advanced.supplier_shares(df, "acme").collect()}
    assert shares == {"S1": 50.0, "S2": 25.0, None: 0.0, "S3": 0.0}
    empty = advanced.concentration(df, "nobody").first()
    assert empty["hhi"] == 0.0 and empty["total_value"] is None


def test_hsn_roll_up(spark):
    df = rows(spark, {"HSN": "1", "Importer": "A", "Value": 5.0}, {"HSN": "1", "Importer": "B", "Value": 7.0},
              {"HSN": "1", "Importer": None, "Value": 9.0}, {"HSN": "1", "Importer": "C"}, {"HSN": "2", "Exporter": "E"},
              {"Value": 100.0})
    got = [r.asDict() for r in a.by_hsn(df).collect()]
    assert [(r["hsn"], r["shipments"], r["top_importer"], r["top_exporter"]) for r in got] == [
        ("1", 4, "B", None), ("2", 1, None, None)]


def test_month_change(spark):
    df = rows(spark, {"Date": dt.date(2024, 1, 3), "Value": 10.0}, {"Date": dt.date(2024, 3, 3), "Value": 15.0},
              {"Value": 99.0})
    assert a.month_change(df).first()["change_pct"] == 50.0
    assert a.month_change(df.filter("Value = 10")).first()["change_pct"] is None
    assert [r["change_pct"] for r in a.month_changes(df).orderBy("month").collect()] == [None, 50.0]


def test_trend_pivot_names_the_missing_series(spark):
    df = rows(spark, {"Date": dt.date(2024, 1, 3), "Value": 10.0, "Trade Type": "IMPORT"},
              {"Date": dt.date(2024, 1, 4), "Value": 4.0})
    assert a.trend_pivot(df, "Trade Type").first().asDict() == {
        "month": dt.date(2024, 1, 1), "IMPORT": 10.0, "—": 4.0}


def test_keywords(spark):
    df = rows(spark, {"Product Description": "Acid ACID-free, for use in x9 of 2nd GRADE"}, {"Product Description": None})
    assert {r["keyword"]: r["occurrences"] for r in advanced.keywords(df).collect()} == {"acid": 1, "acid-free": 1}
    assert advanced.keywords(df, sample_size=10).count() == 2


def test_suggest(spark):
    df = rows(spark, *({"Importer": n} for n in ("Zeta", "Alpha Beta", "Beta", "beta two", "Gamma", None)))
    assert [r[0] for r in entities.suggest(df, "Importer", "be").collect()] == ["Beta", "beta two", "Alpha Beta"]
    assert entities.suggest(df, "Importer", "b").count() == 0


def test_similar_finds_a_typo(spark):
    names = ["RELIANCE INDUSTRIES LIMITED", "BASF SE", "RELIANCE LTD", "SYNGENTA"]
    counts = entities.entity_counts(rows(spark, *({"Supplier": n} for n in names)), "Supplier")
    found = entities.similar(counts, "relianse")
    assert {r["name"] for r in found.collect()} == {"RELIANCE INDUSTRIES LIMITED", "RELIANCE LTD"}
    assert all(70 <= r["score"] <= 100 for r in found.collect())
    assert entities.similar(counts, "").count() == 0


def test_similar_equals_brute_force(shipments):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def close(a, b):
        return 1 - distance(a, b) / max(len(a), len(b), 1)

    def score(name, q):
        n = name.lower()
        return round(100 * max(close(n, q), 0.95 * close(" ".join(sorted(n.split(" "))), " ".join(sorted(q.split(" ")))),
                               0.9 * max(close(w, q) for w in n.split(" ")), 0.9 * (q in n)), 6)
    counts = entities.entity_counts(shipments, "Importer")
    query = "Custmer#000000042"
    want = sorted((-score(r["name"], query.lower()), r["name"]) for r in counts.collect())[:10]
    got = [r["name"] for r in entities.similar(counts, query).collect()]
    assert got == [n for _, n in want]


def test_results_do_not_depend_on_the_partitions(shipments):
    for fn in (a.by_hsn, a.by_country, advanced.keywords, lambda d: a.top_parties(d, "Buyer")):
        def norm(df):
            return [tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.collect()]
        assert norm(fn(shipments)) == norm(fn(shipments.repartition(13)))


def test_nothing_needs_python(shipments):
    for df in (c.dedupe_across_files(shipments), a.by_hsn(shipments), advanced.keywords(shipments),
               advanced.duplicates(shipments), a.dataset_stats(shipments),
               entities.similar(entities.entity_counts(shipments, "Importer"), "acme")):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)


def test_dataset_stats_copies_no_rows(shipments):
    assert "Expand" not in plan(a.dataset_stats(shipments))
    exact, near = a.dataset_stats(shipments).first(), a.dataset_stats(shipments, approximate=True).first()
    assert abs(exact["distinct_importers"] / near["distinct_importers"] - 1) < 0.2
