"""Deep pages, name indexes, roll-ups and sketches against the plain operators."""
import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cargolake.operators import analytics, entities, name_index, rank_pages, rollups
from cargolake.operators.filters import ShipmentFilter
from cargolake.operators.paging import listed, page
from support import plan


def rows(df):
    return [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    values = [(i, None if i % 11 == 0 else (7 if i % 3 else i % 40), ["a", "b", None][i % 3], float(i % 5)) for i in range(900)]
    values += [(5000, 7, "b", float("nan"))] * 60 + [(5001, None, None, None)] * 60
    return spark.createDataFrame(values, "id int, v int, s string, x double").repartition(5).cache()


@pytest.mark.parametrize("sort_by", ["id", "v", "s", "x"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_page_at_any_depth(mixed, sort_by, order):
    for number, size in ((1, 10), (7, 50), (50, 20), (17, 60), (21, 50), (200, 10)):
        want = page(mixed, sort_by, order, number, size)
        assert repr(rows(rank_pages.page_at(mixed, sort_by, order, number, size, range_rows=40))) == repr(rows(want))


def test_page_at_of_nothing(mixed):
    assert rank_pages.page_at(mixed.limit(0), "v", "asc", 3, 10, 5).collect() == []


def test_page_at_sorts_one_range(mixed):
    """No slice holds more rows than a range, but for rows that agree in every column."""
    parts = list(rank_pages.slices(mixed, "v", "asc", 300, 25, 40))
    assert sum(p.take for p in parts) == 25
    assert all(p.rows <= 40 or p.at == 4 for p in parts)


def test_listed_takes_the_deep_way(mixed, monkeypatch):
    from cargolake.operators import paging
    monkeypatch.setattr(paging, "RANGE_ROWS", 100)
    got = listed(mixed, ["v", "id"], "v", "desc", 30, 20)
    assert rows(got) == rows(page(mixed.select("v", "id"), "v", "desc", 30, 20))


NAMES = ["Acme Ltd", "ACME LTD.", "Acme Trading Ltd", "Ltd Acme", "Beta Chem", "Béta Chem", "Chem", "Chemical Beta GmbH",
         "a", "ab", "x y z", "x  y", "", " lead", "Delta-Agro S.A.", "Agro Delta", "DELTA AGRO", "Zeta", "Zetta", "zeta zeta",
         "Ünal Tarım", "unal tarim", "100% Agro", "under_score", "long name of a firm that trades in crop protection goods"]


@pytest.fixture(scope="module")
def firms(spark):
    many = [(n, i + 1) for i, n in enumerate(NAMES)] + [(f"Firm {i:04d} Ltd", i) for i in range(400)]
    return spark.createDataFrame(many, "name string, shipments long").cache()


@pytest.fixture(scope="module")
def index(firms):
    return name_index.similar_index(firms).cached()


@pytest.mark.parametrize("query", ["acme ltd", "Acme", "beta chem", "ltd", "firm 0123 ltd", "ltd 0123 firm", "delta agro", "a", "ab",
                                   "zeta", "x y", " ", "tarım ünal", "no such name at all", "long name of a firm that trade", ""])
@pytest.mark.parametrize("cutoff", [70, 92, 50, 30])
def test_similar_by_grams_loses_no_name(firms, index, query, cutoff):
    assert rows(name_index.similar(index, query, 12, cutoff)) == rows(entities.similar(firms, query, 12, cutoff))


def test_similar_reads_few_lists(index, firms):
    some = name_index._candidates(index, "delta agro", 85)
    assert some.count() < firms.count() / 4
    assert name_index._candidates(index, "acme ltd", 30) is None  # too low for grams to decide


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", min_size=1, max_size=12), st.sampled_from([.7, .78, .85, .95]))
def test_close_texts_share_a_deciding_gram(a, b, closeness):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        return row[-1]
    grams = name_index.deciding_grams(a, closeness, {})
    if grams is not None and 1 - distance(a, b) / max(len(a), len(b)) >= closeness:
        assert set(grams) & {g for g, _ in name_index.query_grams(b)}


@pytest.mark.parametrize("query", ["acme", "LTD", "eta", "firm 00", "0 ", "a", "", "100%", "er_s", "ünal", " agro", "zz", "long name of a firm that trades in crop protection goods"])
def test_suggest_by_rotations(spark, firms, tmp_path_factory, query):
    shipments = firms.select(F.col("name").alias("Importer"))
    path = str(tmp_path_factory.mktemp("rotations"))
    name_index.rotations(firms).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    found = name_index.suggest(table, query, 15)
    assert rows(found) == rows(entities.suggest(shipments, "Importer", query, 15))
    if query == "LTD":
        assert "PushedFilters: [IsNotNull(rotation), StringStartsWith(rotation,ltd)" in plan(found)


@pytest.fixture(scope="module")
def stored(shipments):
    return rollups.Rollups(shipments, rollups.key_rollup(shipments).cache(), rollups.party_rollup(shipments).cache(),
                           rollups.sketches(shipments).cache())


FILTERS = [ShipmentFilter(), ShipmentFilter(trade_type="EXPORT", hs_chapter="38"), ShipmentFilter(country="NATION_1"),
           ShipmentFilter(date_from=dt.date(1996, 2, 1), date_to=dt.date(1996, 2, 29)), ShipmentFilter(date_from=dt.date(1996, 2, 2)),
           ShipmentFilter(importer="0001"), ShipmentFilter(hsn="2900"), ShipmentFilter(hs_chapter="99")]


@pytest.mark.parametrize("f", FILTERS, ids=range(len(FILTERS)))
def test_rollups_answer_as_the_table_does(shipments, stored, f):
    df = f.apply(shipments)
    assert rows(stored.monthly(f, ("Trade Type", "Origin Country"))) == rows(analytics.monthly(df, ("Trade Type", "Origin Country")))
    assert rows(stored.totals(f)) == rows(analytics.totals(df))
    for party in ("Importer", "Buyer"):
        assert rows(stored.top_parties(f, party)) == rows(analytics.top_parties(df, party))


def test_which_rollup_answers(stored):
    assert rollups.answers(FILTERS[3], rollups.KEY_FIELDS) and not rollups.answers(FILTERS[4], rollups.KEY_FIELDS)
    assert not rollups.answers(FILTERS[5], rollups.KEY_FIELDS) and not rollups.answers(FILTERS[6], rollups.KEY_FIELDS)
    assert "month_" not in stored.keys.columns and stored.keys.count() < stored.shipments.count()


@pytest.mark.parametrize("f", [ShipmentFilter(), ShipmentFilter(trade_type="IMPORT"), ShipmentFilter(hs_chapter="99")], ids=["all", "imports", "none"])
def test_sketches_within_their_error(shipments, stored, f):
    exact, near = (x.first().asDict() for x in (analytics.dataset_stats(f.apply(shipments)), stored.dataset_stats(f)))
    for name, value in exact.items():
        if name.startswith("distinct"):
            assert abs(near[name] - value) <= max(1, 4 * rollups.ERROR * value)
        else:
            assert near[name] == value
    universe = stored.party_universe(f, "Buyer").first()[0]
    assert abs(universe - analytics.party_universe(f.apply(shipments), "Buyer").first()[0]) <= max(1, 4 * rollups.ERROR * universe)


def test_distinct_counts_copy_no_rows(shipments):
    from cargolake.operators import argentina
    ledger = shipments.select(F.col("Importer").alias("importer"), F.col("Origin Country").alias("origin_country"),
                              F.col("Date").alias("date"), F.col("Value").alias("cif_total_usd"))
    for df in (analytics.by_country(shipments), argentina.stats(ledger), analytics.party_universe(shipments, "Importer")):
        assert "Expand" not in plan(df)
