"""Duplicate groups, supplier concentration and product keywords."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains
from ..schema import DEDUPE_KEY, col
from .paging import sample_rows

# Words that say nothing about a product.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "for", "in", "on", "to", "with", "from", "by",
    "as", "at", "is", "are", "be", "this", "that", "it", "not", "no", "&", "+", "/", "-",
    "x", "kg", "kgs", "gms", "mts", "ltr", "l", "ml", "pcs", "pc", "nos", "qty", "use",
    "used", "other", "others", "material", "product", "products", "grade", "type",
    "model", "size", "color", "pack", "set", "free", "sample", "samples", "lot", "batch",
    "fob", "cif", "per", "incoterms", "n/a", "na", "null", "none", "company", "ltd",
    "limited", "inc", "co", "purpose", "industrial", "purpose:", "make",
)
# What counts as a word of a description, and how long it must be.
WORD = r"[a-zA-Z][a-zA-Z\-]+"
SHORTEST_WORD = 3


def duplicates(df: DataFrame, min_occurrences: int = 2, limit: int = 100,
               key: tuple[str, ...] = DEDUPE_KEY) -> DataFrame:
    """The largest groups of rows that agree on the key: a row for each group and file.

    One grouping by the key and a hash of it ranks the groups; equal rows combine before its
    shuffle and the hash settles nearly every comparison. Only the files of the at most
    ``limit`` groups reported are looked up in a second pass, each task sending a file once
    a group, so a group in very many files is never one value.
    """
    names = list(map(col, key))
    order = [F.desc("occurrences"), *(c.asc_nulls_last() for c in names)]
    hashed = df.withColumn("_hash", F.xxhash64(*names))
    groups = (hashed.groupBy("_hash", *names).agg(F.count("*").alias("occurrences"))
              .filter(F.col("occurrences") >= min_occurrences).orderBy(*order).limit(limit))
    wanted = groups.select("occurrences", F.col("_hash").alias("_wanted"),
                           *(col(c).alias(f"_{i}") for i, c in enumerate(key)))
    same = reduce(and_, (col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(key)),
                  F.col("_hash") == F.col("_wanted"))
    return (hashed.join(wanted, same).select(*names, "occurrences", "Source File").distinct()
            .orderBy(*order, "Source File"))


def _of_importer(df: DataFrame, importer: str) -> DataFrame:
    return df.filter(contains(F.col("Importer"), importer))


def _by_supplier(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.col("Supplier").alias("supplier"))
            .agg(F.count("*").alias("shipments"), F.sum("Value").alias("total_value")))


def _named() -> Column:
    return F.col("supplier").isNotNull() & (F.col("supplier") != "")


def supplier_shares(df: DataFrame, importer: str, top_n: int = 10) -> DataFrame:
    """Suppliers of the matching importers with their share of the value in percent.

    Value without a named supplier stays in the whole but has no share itself. The whole
    is a scalar subquery, so no window gathers the suppliers in one task.
    """
    rows = _of_importer(df, importer)
    whole = rows.agg(F.sum("Value")).scalar()
    share = F.coalesce(F.col("total_value"), F.lit(0.0)) / F.nullif(whole, F.lit(0.0)) * 100
    return (_by_supplier(rows)
            .withColumn("share_pct", F.coalesce(F.when(_named(), share), F.lit(0.0)))
            .orderBy(F.coalesce("total_value", F.lit(0.0)).desc(),
                     F.col("supplier").asc_nulls_last()).limit(top_n))


def concentration(df: DataFrame, importer: str) -> DataFrame:
    """Herfindahl index (0 to 10000) of the matching importers' suppliers.

    Sum of squares and square of the sum come from one roll-up, so the shares themselves
    are never needed.
    """
    value = F.coalesce("total_value", F.lit(0.0))
    squares = F.sum(F.when(_named(), value * value))
    whole = F.sum(value)
    return (_by_supplier(_of_importer(df, importer))
            .agg(F.count_if(_named()).alias("total_suppliers"),
                 F.nullif(whole, F.lit(0.0)).alias("total_value"),
                 F.coalesce(squares / F.nullif(whole * whole, F.lit(0.0)) * 10000,
                            F.lit(0.0)).alias("hhi")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def keyword_counts(df: DataFrame, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Occurrences of every word of the product descriptions that is not a stop word.

    Without ``sample_size`` all rows count. A sample is drawn after the filter.
    """
    texts = df.select("Product Description").filter(F.col("Product Description").isNotNull())
    if sample_size is not None:
        texts = sample_rows(texts, sample_size, seed)
    return (texts.select(F.explode(words(F.col("Product Description"))).alias("keyword"))
            .filter((F.length("keyword") >= SHORTEST_WORD) & ~F.col("keyword").isin(*STOPWORDS))
            .groupBy("keyword").agg(F.count("*").alias("occurrences")))


def keywords(df: DataFrame, limit: int = 50, sample_size: int | None = None,
             seed: int = 42) -> DataFrame:
    return (keyword_counts(df, sample_size, seed)
            .orderBy(F.desc("occurrences"), "keyword").limit(limit))


def keyword_total(df: DataFrame, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    return keyword_counts(df, sample_size, seed).agg(F.count("*").alias("total_keywords"))
