"""The build and the headline queries over its table; prints one JSON line.

``BENCH_SF_DIR`` names the sample tables, ``BENCH_CPUS`` the local cores. Feeds are written as CSV
(not timed), the build runs once from them in its default layout (``build`` and its stages), then
each query runs twice unmeasured and ``REPEATS`` times measured; its figure is the median. The
value is the sum of the build and of the medians. Every result is brought to the driver in full.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from datetime import date

from cargolake.catalog.feeds import write_named
from cargolake.catalog.views import Views
from cargolake.operators import advanced, analytics, argentina, entities, name_index
from cargolake.operators.filters import ShipmentFilter
from cargolake.operators.paging import list_shipments
from cargolake.operators.predicates import Condition, Group, apply_tree
from cargolake.plans.build import build_shipments, read_rollups
from cargolake.session import local_session
from cargolake.sources.writers import export_shipments, read_table

WARM_UP, REPEATS = 2, 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cores) if cores.isdigit() else 8
    spark = local_session("bench", cores, partitions, "8g",
                          **{"spark.ui.showConsoleProgress": "false"})
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    views, stages = Views(spark, folder), {}
    for name in ("raw_import", "raw_export"):
        write_named(views[name], f"{work}/feeds/{name}", f"{work}/unnamed/{name}")
    start = time.perf_counter()
    build_shipments(spark, f"{work}/feeds", f"{work}/out", ports=views["ports"], seconds=stages)
    timings = {"build": time.perf_counter() - start, **{f"build_{k}": v for k, v in stages.items()}}
    table = read_table(spark, f"{work}/out/shipments")
    shards = spark.read.parquet(f"{work}/out/shards").filter("_told").drop("_copies", "_told")
    views["ledger"].write.parquet(f"{work}/ledger")
    ledger = spark.read.parquet(f"{work}/ledger")

    def export():
        export_shipments(table, ShipmentFilter(trade_type="IMPORT"), f"{work}/export", cap=100_000)
        return table.limit(0)

    entity_counts = entities.entity_counts(table, "Importer").cache()
    stored = read_rollups(spark, f"{work}/out")
    index = name_index.similar_index(entity_counts).cached()
    rotations = name_index.rotations(entities.entity_counts(table, "Supplier")).cache()
    rotations.count()
    queries = {
        "search_stored": lambda: list_shipments(table, ShipmentFilter(q="brand#1", use_search_column=True)),
        "search_six_columns": lambda: list_shipments(table, ShipmentFilter(q="brand#1")),
        "search_count": lambda: analytics.count_rows(
            ShipmentFilter(q="brand#1", use_search_column=True).apply(table)),
        "search_by_code_and_date": lambda: list_shipments(
            table, ShipmentFilter(hsn="380001", date_from=date(1998, 1, 1))),
        "aggregate": lambda: analytics.totals(ShipmentFilter(importer="0001").apply(table)),
        "tree_query": lambda: analytics.totals(apply_tree(table, Group([
            Group([Condition("importer", "contains", "00005"), Condition("importer", "contains", "00007")], "OR"),
            Condition("hs_chapter", "equals", "38"), Condition("value", "between", values=[1e4, 9e4])]))),
        "top_importers": lambda: analytics.top_parties(table, "Importer"),
        "monthly_trend": lambda: analytics.monthly(table),
        "country_analysis": lambda: analytics.by_country(table),
        "hsn_analysis": lambda: analytics.by_hsn(table),
        "duplicates": lambda: advanced.duplicates(shards),
        "supplier_concentration": lambda: advanced.concentration(table, "00001"),
        "keywords": lambda: advanced.keywords(table),
        "keywords_sample_100k": lambda: advanced.keywords(table, sample_size=100_000),
        "suggest": lambda: entities.suggest(table, "Supplier", "supplier#00000"),
        "similar_cold": lambda: entities.similar(entities.entity_counts(table, "Importer"), "custmer#000000042"),
        "similar_warm": lambda: entities.similar(entity_counts, "custmer#000000042"),
        "suggest_rotations": lambda: name_index.suggest(rotations, "supplier#00000"),
        "similar_grams": lambda: name_index.similar(index, "custmer#000000042"),
        "dataset_stats": lambda: analytics.dataset_stats(table),
        "top_importers_rollup": lambda: stored.top_parties(ShipmentFilter(), "Importer"),
        "monthly_trend_rollup": lambda: stored.monthly(ShipmentFilter()),
        "dataset_stats_sketch": lambda: stored.dataset_stats(ShipmentFilter()),
        "page_10000": lambda: list_shipments(table, ShipmentFilter(page=10_000)),
        "ledger_page": lambda: argentina.list_rows(ledger, "cif_total_usd", number=3),
        "export_100k": export,
    }
    for name, query in queries.items():
        runs = []
        for _ in range(WARM_UP + REPEATS):
            start = time.perf_counter()
            query().collect()
            runs.append(time.perf_counter() - start)
        timings[name] = statistics.median(runs[WARM_UP:])
    spark.stop()
    total = sum(v for k, v in timings.items() if not k.startswith("build_"))
    print(json.dumps({"metric": "seconds of the build and the warm medians of the headline queries",
                      "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in timings.items()},
                      "sf": os.path.basename(os.path.normpath(folder))}))


if __name__ == "__main__":
    main()
