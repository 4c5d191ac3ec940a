"""Feeds as frames of text columns, whatever the files hold."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import col

# File kinds that are read, ending of packed CSV files, prefix of editors' lock files, sheet names that
# never hold data.
SUFFIXES = ("csv", "parquet")
PACKED = ".gz"
LOCK_PREFIX = "~$"
JUNK_PARTS = ("sheet2", "sheet3", "sheet4", "readme", "notes", "info")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name, suffix and size of every supported file below a folder, by name.

    Only the file listing is used; no content is read. Spark leaves out files without any
    content and those whose name starts with ``_`` or ``.``. CSV files may be packed (``x.csv.gz``);
    their name is that of the file inside.
    """
    kinds = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in (*SUFFIXES, "csv" + PACKED))
    name = unpacked(F.element_at(F.split("path", "/"), -1))
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*.{{{kinds}}}").load(folder)
            .select("path", name.alias("name"),
                    F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"), "length")
            .filter(~F.col("name").startswith(LOCK_PREFIX))
            .orderBy(F.lower("name"), "path"))


def first_files(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.lower("name"), "path").limit(n)


def literal_path(path: str) -> str:
    """A listed path as a reader takes it: characters of a pattern stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def plain_path(path: str) -> str:
    """The listed path again."""
    return re.sub(r"\\(.)", r"\1", path)


def unpacked(name: Column) -> Column:
    """Name of a file without the ending of packed ones."""
    return F.regexp_replace(name, r"(?i)(\.csv)\.gz$", "$1")


def base_name(path: str) -> str:
    """The same of a listed path, on the driver."""
    return re.sub(r"(?i)(\.csv)\.gz$", r"\1", path.rsplit("/", 1)[-1])


def file_name() -> Column:
    """Name of each row's file. The metadata column holds it in URL form."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return unpacked(F.url_decode(encoded))


def _unique(headers: Iterable[str]) -> list[str]:
    """Headers made unique for Spark, which ignores case; the added marks do not count
    when headers are normalised."""
    seen: set[str] = set()
    out = []
    for header in headers:
        name = header
        while name.lower() in seen or not name:
            name += "~"
        seen.add(name.lower())
        out.append(name)
    return out


def _part_files(spark: SparkSession, path: str) -> list:
    """The files of a path, which may be a folder or a pattern; no job runs."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], list(system.globStatus(root) or [])
    while todo:
        status = todo.pop(0)
        if status.isDirectory():
            todo += [x for x in system.listStatus(status.getPath())
                     if not x.getPath().getName().startswith(("_", "."))]
        elif status.getLen():
            found.append(status.getPath())
    return sorted(found, key=lambda x: x.toString())


def csv_header(spark: SparkSession, path) -> tuple[str, ...]:
    """Header of one file. Opens the file, reads as many lines as the header has, and runs
    no job; a quoted name may hold line breaks."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path) if isinstance(path, str) else path
    conf = spark._jsc.hadoopConfiguration()
    if isinstance(path, str):
        files = _part_files(spark, path)
        if not files:
            raise ValueError(f"{path} is empty")
        file = files[0]
    stream = file.getFileSystem(conf).open(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
        codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        text = reader.readLine()
        if text is None:
            raise ValueError(f"{path} is empty")
        while text.count('"') % 2 and (more := reader.readLine()) is not None:
            text += "\n" + more
    finally:
        reader.close()
    return tuple(next(csv.reader([text.removeprefix("\ufeff")])))


def _csv(spark: SparkSession, paths: list[str], columns: list[str], header: bool,
         multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
            .option("escape", '"').option("multiLine", multi_line)
            .option("enforceSchema", "true").csv(paths))


def read_csv(spark: SparkSession, paths: list[str], header: tuple[str, ...] | None = None,
             multi_line: bool = False, threads: int = 16) -> DataFrame:
    """Text columns of CSV files.

    Files are grouped by their headers and the groups united by column name; with
    ``header`` the caller states that all have that one. Short lines are filled with NULL,
    surplus cells are dropped. Files stay splittable unless ``multi_line`` says that quoted
    cells hold line breaks.
    """
    if header is not None:
        return _csv(spark, paths, _unique(header), True, multi_line)
    files = [f for path in paths for f in _part_files(spark, path)]
    if not files:
        raise ValueError(f"nothing to read in {paths}")
    with ThreadPoolExecutor(threads) as pool:
        headers = list(pool.map(lambda f: csv_header(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, own in zip(files, headers):
        groups.setdefault(own, []).append(literal_path(file.toString()))
    frames = [_csv(spark, own, _unique(names), True, multi_line) for names, own in groups.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files with every column as text."""
    df = spark.read.parquet(*paths)
    return df.select(*(col(c).cast("string").alias(c) for c in df.columns))


class Layout(NamedTuple):
    """What files must share to be read in one scan."""

    suffix: str
    names: tuple[str, ...]
    types: tuple[str, ...]


def _layout(spark: SparkSession, path: str, suffix: str) -> Layout:
    if suffix == "csv":
        names = csv_header(spark, path)
        return Layout(suffix, names, ("string",) * len(names))
    return Layout(suffix, *zip(*spark.read.parquet(path).dtypes))


def group_by_layout(spark: SparkSession, files: list[tuple[str, str]], threads: int = 16
                    ) -> tuple[dict[Layout, list[str]], dict[str, str]]:
    """Paths by layout, and the error text of the files that cannot be opened.

    Files of one layout become one scan, so a plan has a branch per layout and not one per
    file. Headers are metadata; nothing else of a file is read here.
    """
    def look(item: tuple[str, str]) -> Layout | Exception:
        try:
            return _layout(spark, literal_path(item[0]), item[1])
        except Exception as error:  # noqa: BLE001 - one bad file must not stop the others
            return error

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(look, files))
    groups: dict[Layout, list[str]] = {}
    failed: dict[str, str] = {}
    for (path, _), result in zip(files, found):
        if isinstance(result, Exception):
            failed[path] = f"{type(result).__name__}: {str(result).splitlines()[0]}"
        else:
            groups.setdefault(result, []).append(literal_path(path))
    return groups, failed


def read_group(spark: SparkSession, layout: Layout, paths: list[str], multi_line: bool = False
               ) -> tuple[DataFrame, list[str]]:
    """One layout's files as text with their file name in ``_file``, and their own columns."""
    df = (read_csv(spark, paths, layout.names, multi_line) if layout.suffix == "csv"
          else spark.read.parquet(*paths))
    names = df.columns
    return df.select(*(col(c).cast("string").alias(c) for c in names),
                     file_name().alias("_file")), names


def union_parts(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of one dataset under each other, columns matched by name.

    Junk names, parts of a single column and empty parts are left out, unless nothing else
    is there.
    """
    if not parts:
        raise ValueError("no parts to read")
    wanted = [df for name, df in parts.items()
              if name.strip().lower() not in JUNK_PARTS and len(df.columns) > 1]
    # one job for all parts: an empty part among others adds columns only
    filled = [df.limit(1).select(F.lit(i).alias("part")) for i, df in enumerate(wanted)]
    seen = {r["part"] for r in reduce(DataFrame.union, filled).collect()} if filled else set()
    kept = [df for i, df in enumerate(wanted) if i in seen]
    frames = kept or [next(iter(parts.values()))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet shards of a folder, columns united by name."""
    return spark.read.option("mergeSchema", "true").parquet(folder)


def read_positional(spark: SparkSession, path: str, columns: tuple[str, ...],
                    skip: int = 2) -> DataFrame:
    """CSV files without usable headers: the first ``skip`` lines of each go, names are given.

    Lines are counted inside each file's first split, which comes first in its task, so a
    file is read in parallel. The source delivers a few large files, each a branch of the plan.
    """
    files = _part_files(spark, path)
    width = len(csv_header(spark, files[0])) if files else 0
    if width != len(columns):
        raise ValueError(f"expected {len(columns)} columns, {path} has {width}")
    frames = [_skipped(spark, literal_path(f.toString()), columns, skip) for f in files]
    return reduce(DataFrame.union, frames)


def _skipped(spark: SparkSession, path: str, columns: tuple[str, ...], skip: int) -> DataFrame:
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = (_csv(spark, [path], list(columns), False, False)
                .select("*", line.alias("_line"),
                        F.col("_metadata.file_block_start").alias("_start")))
    return (numbered.filter((F.col("_start") > 0) | (F.col("_line") >= skip))
            .drop("_line", "_start"))


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """Port to country pairs of a JSON object; keys that start with ``_`` are remarks."""
    pairs = F.from_json(F.col("value"), "map<string,string>")
    return (spark.read.text(path, wholetext=True).select(F.explode(pairs).alias("port", "country"))
            .filter(~F.col("port").startswith("_")))
