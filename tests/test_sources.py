"""Files in, files out, and the whole build."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cargolake.operators.filters import ShipmentFilter
from cargolake.plans.build import build_shipments, read_rollups
from cargolake.sources import feeds, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scan_folder(spark, tmp_path):
    for name in ("b.csv", "sub/A one.CSV", "sub/~$lock.csv", "c.txt", "50% [x] a+b.csv"):
        write(tmp_path / name, "a,b\n1,2\n")
    found = feeds.scan_folder(spark, str(tmp_path)).collect()
    assert [r["name"] for r in found] == ["50% [x] a+b.csv", "A one.CSV", "b.csv"]
    assert {r["suffix"] for r in found} == {"csv"} and found[0]["length"] == 8
    first = feeds.first_files(feeds.scan_folder(spark, str(tmp_path)), 1).first()
    groups, failed = feeds.group_by_layout(spark, [(r["path"], r["suffix"]) for r in found])
    assert not failed and len(groups) == 1
    layout, paths = next(iter(groups.items()))
    df, names = feeds.read_group(spark, layout, paths)
    assert names == ["a", "b"] and {r["_file"] for r in df.collect()} == {r["name"] for r in found}
    assert first["name"] == found[0]["name"]


def test_parquet_files_of_other_types_are_read_apart(spark, tmp_path):
    for name, kind in (("a", "int"), ("b", "string"), ("c", "int")):
        spark.range(3).select(F.col("id").cast(kind).alias("Qty")).coalesce(1).write.parquet(
            str(tmp_path / name))
    files = [(r["path"], r["suffix"]) for r in feeds.scan_folder(spark, str(tmp_path)).collect()]
    groups, _ = feeds.group_by_layout(spark, files)
    assert sorted(len(v) for v in groups.values()) == [1, 2]
    frames = [feeds.read_group(spark, layout, paths)[0] for layout, paths in groups.items()]
    assert all(dict(f.dtypes)["Qty"] == "string" for f in frames) and sum(f.count() for f in frames) == 9


def test_csv_is_text_and_tolerant(spark, tmp_path):
    path = write(tmp_path / "f.csv", '﻿Name,Value,VALUE\n"a ""q"", b",1,2\nshort\nlong,1,2,3,4\n')
    df = feeds.read_csv(spark, [path])
    assert df.columns == ["Name", "Value", "VALUE~"] and set(dict(df.dtypes).values()) == {"string"}
    assert [tuple(r) for r in df.collect()] == [('a "q", b', "1", "2"), ("short", None, None), ("long", "1", "2")]


def test_union_parts(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    b = spark.createDataFrame([("3", "4")], "y string, z string")
    got = feeds.union_parts({"29": a, "38": b, "Sheet2": a, "one": a.select("x"), "none": a.filter("false")})
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        got.sparkSession.createDataFrame([("1", "2", None)], got.schema).first(),
        got.sparkSession.createDataFrame([(None, "3", "4")], got.schema).first()]))
    assert feeds.union_parts({"notes": a}).count() == 1


def test_positional_header(spark, tmp_path):
    path = write(tmp_path / "m.csv", "g1,g2\nAI,Type\n" + "".join(f"p{i},t\n" for i in range(50)))
    assert feeds.read_positional(spark, path, ("product", "type")).count() == 50
    with pytest.raises(ValueError):
        feeds.read_positional(spark, path, ("product",))


def test_ports_document(spark, tmp_path):
    path = write(tmp_path / "p.json", json.dumps({"_comment": "x", "Santos": "BRAZIL", "Lima ": "PERU"}, indent=1))
    assert sorted(map(tuple, feeds.read_ports(spark, path).collect())) == [("Lima ", "PERU"), ("Santos", "BRAZIL")]


def test_export_file(spark, tmp_path, shipments):
    path = str(tmp_path / "export")
    writers.export_shipments(shipments, ShipmentFilter(sort_by="Value"), path, cap=20)
    parts = [p.read_text(encoding="utf-8").splitlines() for p in sorted((tmp_path / "export").glob("*.csv"))]
    assert all(p[0].startswith("﻿Date,Importer") for p in parts)
    assert sum(len(p) - 1 for p in parts) == 20 and ",,," in parts[0][1]
    writers.export_shipments(shipments, ShipmentFilter(sort_by="Value"), path, cap=20, single_file=True)
    assert len(list((tmp_path / "export").glob("*.csv"))) == 1
    assert feeds.read_csv(spark, [path]).columns[0] == "Date"


def test_export_ledger_writes_all_rows_by_default(spark, tmp_path):
    from cargolake.operators import argentina as ar
    df = spark.range(70).select(*(F.col("id").cast("string").alias(c) for c in ar.EXPORT_COLUMNS))
    writers.export_ledger(df, str(tmp_path / "ledger"))
    assert feeds.read_csv(spark, [str(tmp_path / "ledger")]).count() == 70
    writers.export_ledger(df, str(tmp_path / "few"), cap=9)
    assert feeds.read_csv(spark, [str(tmp_path / "few")]).count() == 9


def test_csv_files_with_other_headers(spark, tmp_path):
    a = write(tmp_path / "a.csv", "x,y\n1,2\n")
    b = write(tmp_path / "b.csv", "y,x\n20,10\n")
    c = write(tmp_path / "c.csv", 'x,"z\nlong"\n5,6\n')
    df = feeds.read_csv(spark, [a, b])
    assert sorted(map(tuple, df.select("x", "y").collect())) == [("1", "2"), ("10", "20")]
    assert feeds.read_csv(spark, [a, c], multi_line=True).columns == ["x", "y", "z\nlong"]
    assert feeds.csv_header(spark, c) == ("x", "z\nlong")


def test_headers_are_read_without_jobs(spark, tmp_path):
    for i in range(60):
        write(tmp_path / f"f{i}.csv", "a,b\n1,2\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    groups, failed = feeds.group_by_layout(spark, [(str(tmp_path / f"f{i}.csv"), "csv") for i in range(60)])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not failed and len(groups) == 1
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) == 0


def test_stored_table_keeps_its_rows(spark, tmp_path, shipments):
    path = str(tmp_path / "t")
    writers.write_shards(shipments, path)
    back = writers.read_table(spark, path)
    assert back.columns == shipments.columns and dict(back.dtypes) == dict(shipments.dtypes)
    assert back.exceptAll(shipments).count() == 0 and back.count() == shipments.count()


def test_build(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    head = "BE_Date,BE_NO,ImporterName,SupplierName,Country_of_Origin,HS Code,Quantity,Total Value,Port of Destination\n"
    line = "01-02-2024,{},ACME,Far Co,{},2930.40,2,10,Santos\n"
    write(source / "29 import jan.csv", head + line.format(1, "China") + line.format(1, "China") + line.format(2, "India"))
    write(source / "29 import feb.csv", head + line.format(1, "China") + line.format(3, "n/a"))
    write(source / "x" / "Peru export.csv", "Exporter,Buyer,Foreign Country,Qty,Date\nP Co,B Co,USA,1,202403\n")
    write(source / "broken import.parquet", "no parquet")
    ports = spark.createDataFrame([("santos", "BRAZIL")], "port string, country string")
    summary = {r["file"]: r for r in build_shipments(spark, str(source), target, ports=ports).collect()}
    assert {f: (r["success"], r["rows_in"], r["rows_out"]) for f, r in summary.items()} == {
        "29 import jan.csv": (True, 3, 2), "29 import feb.csv": (True, 2, 2),
        "Peru export.csv": (True, 1, 1), "broken import.parquet": (False, 0, 0)}
    table = writers.read_table(spark, target + "/shipments")
    rows = {(r["BE/SB Number"], r["Source File"]): r for r in table.collect()}
    assert set(rows) == {("1", "29 import feb.csv"), ("2", "29 import jan.csv"),
                         ("3", "29 import feb.csv"), (None, "Peru export.csv")}
    one = rows[("1", "29 import feb.csv")]
    assert one["Date"] == dt.date(2024, 2, 1) and one["HSN"] == "293040" and one["Value"] == 10.0
    assert one["_search"] == "acme | far co | 293040" and one["Port"] == "Santos"
    assert rows[("2", "29 import jan.csv")]["Origin Country"] == "BRAZIL"
    peru = rows[(None, "Peru export.csv")]
    assert (peru["Reporting Country"], peru["Destination Country"], peru["Origin Country"]) == (
        "PERU", "UNITED STATES", "PERU")
    assert spark.read.parquet(target + "/mapping_report").filter("strategy = 'ignored'").count() == 2
    assert {tuple(r) for r in spark.read.parquet(target + "/directions").collect()} == {("IMPORT", 3), ("EXPORT", 1)}
    assert writers.read_direction(spark, target + "/shipments", "EXPORT").count() == 1
    assert read_rollups(spark, target).totals(ShipmentFilter(trade_type="IMPORT")).first()["count"] == 3
    assert feeds.read_csv(spark, [target + "/sample"]).count() == 4
    totals = writers.run_totals(spark.read.parquet(target + "/summary")).first()
    assert tuple(totals) == (4, 3, 1, 6, 5)


def test_build_without_feeds(spark, tmp_path):
    write(tmp_path / "in" / "bad.parquet", "no parquet")
    with pytest.raises(RuntimeError):
        build_shipments(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_replace_table(spark, tmp_path):
    for n in (3, 2):
        writers.replace_table(spark.range(n), "side", str(tmp_path / "side"))
    assert spark.table("side").count() == 2
    assert spark.table("side").agg(F.max("id")).first()[0] == 1


def test_replace_table_keeps_the_old_rows_when_a_write_fails(spark, tmp_path):
    root = str(tmp_path / "kept")
    writers.replace_table(spark.range(5), "kept", root)
    reader = spark.table("kept")
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 90, F.raise_error(F.lit("half-way")).cast("long"))
                                              .otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        writers.replace_table(broken, "kept", root)
    assert spark.table("kept").count() == reader.count() == 5
    # from its own rows, twice, while a reader still has the first version
    for n in (10, 20):
        writers.replace_table(spark.table("kept").union(spark.range(5)), "kept", root)
        assert spark.table("kept").count() == n - (5 if n == 20 else 0)
    assert reader.count() == 5
    versions = writers.versions(spark, root)
    assert len(versions) == 4 and writers.drop_old_versions(spark, root, 1) == versions[:-1]
    assert spark.table("kept").count() == 15 and writers.versions(spark, root) == versions[-1:]


def test_replace_table_with_other_columns(spark, tmp_path):
    root = str(tmp_path / "wider")
    writers.replace_table(spark.range(5), "wider", root)
    writers.replace_table(spark.range(4).select("id", F.lit("x").alias("note")), "wider", root)
    assert spark.table("wider").columns == ["id", "note"] and spark.table("wider").count() == 4
    writers.replace_table(spark.range(3).select("id", F.lit("y").alias("note")), "wider")
    assert {tuple(r) for r in spark.table("wider").collect()} == {(0, "y"), (1, "y"), (2, "y")}
