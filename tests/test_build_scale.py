"""What keeps the build and its neighbours within time and disk on large tables."""
import gzip
import zlib

from pyspark.sql import functions as F

from cargolake import catalog
from cargolake.catalog.feeds import write_named
from cargolake.catalog.views import Views
from cargolake.functions.text import clean_text, strip
from cargolake.operators import cleaning
from cargolake.plans.build import build_shipments
from cargolake.session import METHOD_LIMIT, compiled
from cargolake.sources import writers
from support import DATA, plan


def test_feeds_are_not_shuffled_by_their_ports(spark, tmp_path, monkeypatch):
    """Ports that are still to be worked out look large; the feeds must not be sorted by them."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "29 import.csv").write_text("BE_NO,ImporterName,Port of Destination\n1,ACME,Santos\n2,B Co,p7\n")
    ports = spark.range(5_000_000).groupBy((F.col("id") % 9).alias("k")).count().select(
        F.concat(F.lit("P"), "k").alias("port"), F.lit("BRAZIL").alias("country"))
    plans = {}

    def watched(df, path, write=writers.write_stage):
        plans[path.rsplit("/", 1)[-1]] = plan(df)
        write(df, path)
    monkeypatch.setattr(writers, "write_stage", watched)
    build_shipments(spark, str(source), str(tmp_path / "out"), ports=ports, rollups=False)
    assert "BroadcastHashJoin" in plans["shards"] and "SortMergeJoin" not in plans["shards"]
    table = {r["BE/SB Number"]: r["Origin Country"] for r in writers.read_table(spark, str(tmp_path / "out/shipments")).collect()}
    assert table == {"1": None, "2": "BRAZIL"}


def test_cells_are_trimmed_by_generated_code(spark):
    rows = spark.createDataFrame([(" a ", "N/A", 1)], "x string, y string, n int")
    trimmed = cleaning.trim_and_nullify(rows)
    assert "lambda" not in plan(trimmed)
    assert [tuple(r) for r in trimmed.collect()] == [("a", None, 1)]


def test_trim_at_edges_that_are_no_white_space(spark):
    texts = ["é", "é ", " \U0001f600", "\x01a\x7f", "\x01", "!~", "NILK", "KKKK", "NULL\xa0", "ÑILÑILÑILÑIL", "N/A" + " " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", strip(F.col("t")).alias("s"), clean_text(F.col("t")).alias("c")).collect()
    assert [r["s"] for r in got] == [t.strip(" \xa0") for t in texts]
    assert [r["c"] for r in got] == [None if t.strip(" \xa0") in ("NULL", "N/A") else t.strip(" \xa0") for t in texts]


def test_steps_run_compiled_code(spark, tmp_path, monkeypatch):
    before = spark.conf.get(METHOD_LIMIT, "65535")
    with compiled(spark):
        assert spark.conf.get(METHOD_LIMIT) == "8000"
    assert spark.conf.get(METHOD_LIMIT) == before


def test_sinks_that_shuffle_whole_rows_do_not_hold_the_joins(spark):
    """The shuffle files of the joins are gone before the whole rows are sent."""
    made = catalog.queries()["snk_run_summary"](spark, DATA)
    assert "l_orderkey" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_merged_rows_are_a_stage_before_their_layout(spark, monkeypatch):
    """Neither the joins' shuffle files nor those of the de-duplication add to the layout's."""
    plans = []

    def watched(df, path, *more, write=writers.write_shards):
        plans.append(plan(df))
        write(df, path, *more)
    monkeypatch.setattr(writers, "write_shards", watched)
    catalog.queries()["snk_merged_parquet"](spark, DATA)
    assert len(plans) == 1 and not any(word in plans[0] for word in ("Join", "Exchange", "Window"))


def test_stored_repeats_are_the_view(spark):
    v = Views(spark, DATA)
    stored, view = v.stored_repeated(), v["repeated"]
    assert stored.dtypes == view.dtypes
    assert stored.exceptAll(view).count() == view.exceptAll(stored).count() == 0


def test_feeds_are_packed_for_speed(spark, tmp_path):
    """Their size is that of the fastest level, and the rows come back."""
    rows = spark.range(0, 20_000, 1, 1).select(
        F.sha2(F.col("id").cast("string"), 256).alias("a"), F.concat(F.lit("Customer "), F.col("id") % 977).alias("b"),
        F.lit("29 import.csv").alias("file_name"))
    write_named(rows, str(tmp_path / "feeds"), str(tmp_path / "work"))
    (packed,) = (tmp_path / "feeds").rglob("*.csv.gz")
    text = gzip.decompress(packed.read_bytes())
    size, fast, usual = packed.stat().st_size, len(zlib.compress(text, 1)), len(zlib.compress(text, 6))
    assert abs(size - fast) < abs(size - usual) and text.count(b"\n") == 20_001
