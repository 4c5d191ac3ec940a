"""Filters and predicate trees: errors, NULL rules and invariants of the results."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from cargolake.operators import predicates as p
from cargolake.operators.cleaning import add_search_columns
from cargolake.operators.filters import ShipmentFilter, shortcut
from cargolake.operators.paging import first_rows, list_by_tree, list_shipments, page_meta, sample_rows
from support import plan


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "`Product Description` string")


def kept(df):
    return sorted(str(r[0]) for r in df.select("Product Description").collect())


def test_product_negatives_keep_nulls_and_tree_negatives_do_not(spark):
    df = frame(spark, ["Acid", "Base", None])
    assert kept(ShipmentFilter(pd="notcontains|acid").apply(df)) == ["Base", "None"]
    assert kept(ShipmentFilter(pd="notequals|ACID").apply(df)) == ["Base", "None"]
    not_acid = p.Group([p.Condition("product_description", "not_contains", "acid")])
    assert kept(p.apply_tree(df, not_acid)) == ["Base"]


def test_stored_product_key_ignores_punctuation(spark):
    df = frame(spark, ["2,4-D amine", "24D", "2-4", None])
    columns = ("Importer", "Exporter", "Supplier", "Buyer", "HSN")
    df = add_search_columns(df.select("*", *(F.lit(None).cast("string").alias(c) for c in columns)))
    assert kept(ShipmentFilter(pd="contains|2,4 d", use_pd_search=True).apply(df)) == ["2,4-D amine", "24D"]
    assert kept(ShipmentFilter(pd="notcontains|24-d", use_pd_search=True).apply(df)) == ["2-4", "None"]


def test_empty_and_unknown_product_conditions_do_nothing(spark):
    df = frame(spark, ["Acid"])
    assert kept(ShipmentFilter(pd="contains|;;odd|x").apply(df)) == ["Acid"]


@pytest.mark.parametrize("bad", [
    {"sort_by": "Port"}, {"sort_order": "up"}, {"trade_type": "BOTH"}, {"page": 0}, {"page_size": 2000},
    {"date_from": date(2020, 2, 1), "date_to": date(2020, 1, 1)}, {"min_value": 2, "max_value": 1},
    {"min_quantity": 2, "max_quantity": 1}])
def test_filter_validation(bad):
    with pytest.raises(ValueError):
        ShipmentFilter(**bad)


def test_applied_and_shortcuts():
    f = shortcut("product", "acid", trade_type="IMPORT")
    assert f.applied() == {"q": "acid", "trade_type": "IMPORT"}
    assert shortcut("hsn", "29").applied() == {"hsn": "29"}
    with pytest.raises(ValueError):
        shortcut("port", "x")


@pytest.mark.parametrize("condition", [
    p.Condition("nope", "equals", 1), p.Condition("importer", "between", values=[1, 2]),
    p.Condition("value", "contains", "1"), p.Condition("value", "between", values=[1]),
    p.Condition("importer", "in_list", values=[]), p.Condition("importer", "contains"),
    p.Condition("trade_type", "contains", "x")])
def test_tree_errors(condition):
    with pytest.raises(p.PredicateError):
        condition.column()


def test_tree_shapes(spark):
    assert p.Group([]).column() is None
    assert p.Group([p.Group([]), p.Group([p.Group([])])]).column() is None
    assert p.explain(None) == "" and p.summary(None) == {}
    root = p.tree({"type": "group", "logic": "OR", "conditions": [
        {"type": "condition", "field": "importer", "operator": "equals", "value": "A"},
        {"type": "group", "negate": True, "conditions": [
            {"type": "condition", "field": "hsn", "operator": "starts_with", "value": "3808"}]}]})
    assert p.summary(root) == {"conditions": 2, "groups": 2, "root_logic": "OR"}
    text = p.explain(root)
    assert "lower(Importer)" in text and "or(" in text and "!(" in text
    with pytest.raises(TypeError):
        p.tree({"type": "condition", "field": "hsn", "operator": "equals", "oops": 1})
    fields = {r["name"]: r for r in p.field_listing(spark).collect()}
    assert len(fields) == 21 and fields["trade_type"]["enum_values"] == ["IMPORT", "EXPORT"]


def test_sanitise():
    root = p.Group([p.Condition("hsn", "is_empty"), p.Condition("", "equals", "x"),
                    p.Condition("port", "equals", ""), p.Group([p.Condition("value", "between", values=[1, ""])])])
    assert p.sanitise(root) == p.Group([p.Condition("hsn", "is_empty")])
    assert p.sanitise(p.Group([p.Condition("port", "in_list", values=[])])) is None


def test_filter_invariants(shipments):
    rows = ShipmentFilter(trade_type="IMPORT", hs_chapter="29", min_value=50000).apply(shipments).collect()
    assert rows and all(r["Trade Type"] == "IMPORT" and r["HS Chapter"] == "29" and r["Value"] >= 50000
                        for r in rows)


def test_pages_do_not_overlap(shipments):
    first, second = (list_shipments(shipments, ShipmentFilter(page=n)).collect() for n in (1, 2))
    assert len(first) == len(second) == 50 and not set(first) & set(second)
    again = list_shipments(shipments.repartition(7), ShipmentFilter(page=2)).collect()
    assert again == second
    meta = page_meta(shipments, 2, 50).first()
    assert meta["total"] == shipments.count() and meta["total_pages"] == -(-meta["total"] // 50)


def stored_filters(df):
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return text[text.index("PushedFilters"):]


def test_page_is_a_top_k_and_prefix_reaches_the_scan(spark, tmp_path, shipments):
    path = str(tmp_path / "t")
    shipments.write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(list_shipments(stored, ShipmentFilter(hsn="3800", trade_type="IMPORT", date_from=date(1997, 1, 1))))
    assert "TakeOrderedAndProject" in text
    pushed = stored_filters(list_shipments(stored, ShipmentFilter(
        hsn="3800", trade_type="IMPORT", date_from=date(1997, 1, 1))))
    assert "StringStartsWith(HSN,3800)" in pushed and "EqualTo(`Trade Type`,IMPORT)" in pushed
    assert "GreaterThanOrEqual(Date" in pushed


def test_tree_page_checks_its_sort(shipments):
    with pytest.raises(p.PredicateError):
        list_by_tree(shipments, None, sort_by="port")
    assert list_by_tree(shipments, None, "value", "asc", size=3).count() == 3


@pytest.mark.parametrize("sort_by,order", [("Date", "desc"), ("Value", "asc"), ("Importer", "desc"),
                                           ("Product Description", "asc"), ("Trade Type", "asc")])
def test_capped_export_equals_full_sort(shipments, monkeypatch, sort_by, order):
    from cargolake.operators import paging
    monkeypatch.setattr(paging, "CUT_SAMPLE", 900)
    for cap in (700, 10 ** 6):
        got = first_rows(shipments, sort_by, order, cap).collect()
        want = shipments.orderBy(*paging.ordering(shipments.columns, sort_by, order)).limit(cap).collect()
        assert got == want


def test_sample_is_exact_and_filtered(shipments):
    imports = ShipmentFilter(trade_type="IMPORT").apply(shipments)
    rows = sample_rows(imports, 200).collect()
    assert len(rows) == 200 and all(r["Trade Type"] == "IMPORT" for r in rows)
    assert sample_rows(imports, 10 ** 6).count() == imports.count()
    assert sample_rows(imports.filter("false"), 5).count() == 0


def test_capped_export_cuts_by_a_literal_of_the_column(spark, shipments, tmp_path):
    import re
    from cargolake.operators import paging
    path = str(tmp_path / "t")
    shipments.write.parquet(path)
    stored = spark.read.parquet(path)
    value = paging.cut_value(stored, "Date", "desc", 100)
    assert isinstance(value, date) and paging.cut_value(stored, "Date", "desc", 10 ** 7) is None
    from support import plan
    pushed = re.search(r"PushedFilters: \[([^]]*)", plan(stored.filter(paging._reaches(F.col("Date"), value, "desc"))))
    assert "GreaterThanOrEqual(Date" in pushed[1]


def test_capped_export_of_a_hot_value_stays_spread(shipments):
    got = first_rows(shipments.repartition(6), "Trade Type", "asc", 2000)
    assert got.count() == 2000


def test_keyset_pages_follow_each_other(shipments):
    from cargolake.operators import paging
    rows = shipments.select("Date", "Importer", "Value", "BE/SB Number", "HSN", "Product Description").distinct()
    for sort_by, order in (("Date", "desc"), ("Importer", "asc")):
        want = rows.orderBy(*paging.ordering(rows.columns, sort_by, order)).limit(90).collect()
        got, last = [], None
        for _ in range(3):
            part = paging.page_after(rows, last, sort_by, order, 30).collect()
            got, last = got + part, part[-1].asDict()
        assert got == want
    tail = rows.orderBy(*paging.ordering(rows.columns, "Date", "desc")).collect()[-5:]
    assert paging.page_after(rows, tail[0].asDict(), "Date", "desc").collect() == tail[1:]


def test_pages_by_key_show_repeated_rows(spark):
    from cargolake.operators import paging
    rows = spark.createDataFrame([(1, "a")] * 2 + [(2, None)] * 7 + [(3, "b")] + [(None, "c")] * 4, "n int, s string")
    whole = rows.orderBy(*paging.ordering(rows.columns, "n", "asc")).collect()
    seen, last, shown = [], None, 0
    while part := paging.page_after(rows, last, "n", "asc", 3, shown).collect():
        seen += part
        last, shown = seen[-1].asDict(), seen.count(seen[-1])
    assert seen == whole
