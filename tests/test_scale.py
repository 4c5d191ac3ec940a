"""Shape of the plans that larger tables depend on, and the rows of the lighter ways."""
import gzip

from pyspark.sql import functions as F

from cargolake import catalog
from cargolake.catalog import analytics
from cargolake.catalog.views import VIEWS, Views, _NAMED
from cargolake.functions.text import WHITESPACE, _fold_tables, ascii_fold_text, clean_text, fold_accents, strip
from cargolake.functions.vocabulary import default_vocabulary, name_pattern, to_english
from cargolake.operators.cleaning import add_search_columns
from cargolake.session import CLEANUP, step
from cargolake.sources import feeds, writers
from support import DATA


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def as_written(spark, name):
    """The view by its SQL alone."""
    if name not in VIEWS:
        return spark.read.parquet(f"{DATA}/{name}.parquet")
    text = VIEWS[name].replace('"', "`")
    return spark.sql(text, **{n: as_written(spark, n) for n in set(_NAMED.findall(text))})


def test_lighter_views_have_the_rows_of_their_sql(spark):
    v = Views(spark, DATA)
    for name in ("shipments", "repeated", "ledger"):
        assert v[name].dtypes == as_written(spark, name).dtypes
        assert rows(v[name]) == rows(as_written(spark, name))


def test_repeats_read_the_lines_once(spark):
    assert optimized(Views(spark, DATA)["repeated"]).count("Relation [l_orderkey") == 1


def test_orders_bring_their_customers_along(spark):
    """Joined after the lines, the customers cost a shuffle of all lines."""
    lines = Views(spark, DATA)["ledger"].select("importer", "quantity")
    plan = [line for line in optimized(lines).splitlines() if "Relation [" in line]
    depth = {line.split("Relation [")[1][0]: len(line.split("Relation [")[0]) for line in plan}
    assert depth["o"] == depth["c"] > depth["l"] - 1


def test_deep_pages_and_rollups_read_a_stored_table(spark):
    assert "Join" not in optimized(catalog.queries()["srt_page_deep_nulls"](spark, DATA))
    assert "Join" not in optimized(analytics._rollups(Views(spark, DATA)).shipments)
    index = analytics._index(Views(spark, DATA))
    assert "Join" not in optimized(index.names) + optimized(index.grams)


def test_fold_lists_no_characters_in_maps(spark):
    longer = list(_fold_tables()[2])
    texts = ["", "plain", "é", "a" + "".join(longer) + "z", "㎏x⑩", "ｂ\U00010000ﬃ\U0001f600"] + longer
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_accents(F.col("t")).alias("f"))
    assert all(r["f"] == ascii_fold_text(r["t"]) for r in df.collect())
    assert "map(" not in str(fold_accents(F.col("t")))


def test_trim_of_any_white_space(spark):
    texts = [None, "", " ", "a", " a", "a ", *(f"{w}a b{w}" for w in WHITESPACE), *WHITESPACE, "N/A", " nil　", "NILS"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", strip(F.col("t")).alias("s"), clean_text(F.col("t")).alias("c")).collect()
    assert [r["s"] for r in got] == [t if t is None else t.strip(WHITESPACE) for t in texts]
    assert [r["c"] for r in got] == [None if t is None or t.strip(WHITESPACE).lower() in ("", "n/a", "nil")
                                     else t.strip(WHITESPACE) for t in texts]


def test_names_share_their_beginnings_in_the_pattern(spark):
    names = list(default_vocabulary())
    assert name_pattern(default_vocabulary()).count("|") < len(names)
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = df.select("n", F.regexp_extract("n", name_pattern(default_vocabulary()), 1).alias("f"))
    assert found.filter("n <> f").count() == 0
    table = {"a b": "One", "a b c": "Two", "a": "Three"}
    text = spark.createDataFrame([("x a b c, a b cd a + ab",)], "n string")
    assert text.select(to_english(F.col("n"), table)).first()[0] == "x Two, One cd Three + ab"
    assert text.select(to_english(F.lit("none"), table)).first()[0] is None


def test_packed_feeds_keep_the_name_of_the_file_inside(spark, tmp_path):
    for name in ("x import.csv.gz", "y.CSV.GZ"):
        with gzip.open(tmp_path / name, "wt") as out:
            out.write("a,b\n1,2\n")
    listed = feeds.scan_folder(spark, str(tmp_path)).collect()
    assert [(r["name"], r["suffix"]) for r in listed] == [("x import.csv", "csv"), ("y.CSV", "csv")]
    groups, failed = feeds.group_by_layout(spark, [(r["path"], r["suffix"]) for r in listed[:1]])
    (layout, paths), = groups.items()
    df, names = feeds.read_group(spark, layout, paths)
    assert not failed and [tuple(r) for r in df.collect()] == [("1", "2", "x import.csv")]


def test_columns_derived_behind_the_shuffle(spark, tmp_path, shipments):
    some = shipments.limit(500)
    writers.write_shards(some, str(tmp_path / "t"), derive=add_search_columns)
    got = writers.read_table(spark, str(tmp_path / "t"))
    assert rows(got) == rows(add_search_columns(some))


def test_a_step_removes_its_shuffle_files(spark):
    before = spark.conf.get(CLEANUP, "false")
    with step(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == before
