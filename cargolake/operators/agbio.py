"""Crop-protection market values by product, country and crop."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains, strip
from ..functions.values import number
from .filters import any_contains
from .analytics import distinct_count
from .paging import listed

TABLE = "ag_bio_market"

# Crop columns in the order of the source.
CROPS = (
    "cereals", "cotton", "maize", "oilseed_rape", "other_crops", "other_fv",
    "pome_stone_fruit", "potato", "rice", "soybean", "sugar_beet", "sugarcane",
    "sunflower", "vine",
)
KEYS = ("product", "type", "country")
COLUMNS = (*KEYS, *CROPS, "total_usd_m")
SORTABLE = (*KEYS, "total_usd_m")


def load(raw: DataFrame, source_file: Column) -> DataFrame:
    """Market rows of a positional text feed with the columns of ``COLUMNS``."""
    return raw.select(*(strip(F.col(k)).alias(k) for k in KEYS),
                      *(number(F.col(c), thousands=False).alias(c)
                        for c in (*CROPS, "total_usd_m")),
                      source_file.alias("source_file"))


@dataclass(frozen=True)
class MarketFilter:
    q: str | None = None
    product: str | None = None
    country: str | None = None
    type: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        parts = [any_contains(KEYS, self.q)] if self.q else []
        parts += [contains(F.col(n), v) for n in KEYS if (v := getattr(self, n))]
        return df.filter(reduce(and_, parts)) if parts else df


def list_rows(df: DataFrame, sort_by: str = "total_usd_m", sort_order: str = "desc",
              number: int = 1, size: int = 50) -> DataFrame:
    chosen = sort_by if sort_by in SORTABLE else "total_usd_m"
    return listed(df, COLUMNS, chosen, sort_order, number, size)


def stats(df: DataFrame) -> DataFrame:
    counts = {f"distinct_{n}": distinct_count(df, F.col(c))
              for n, c in (("products", "product"), ("countries", "country"))}
    totals = df.agg(F.count("*").alias("total_rows"),
                    F.coalesce(F.sum("total_usd_m"), F.lit(0.0)).alias("total_value_usd_m"))
    return totals.select("*", *(c.alias(n) for n, c in counts.items()))


def top_by(df: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Largest products or countries by value."""
    return (df.groupBy(F.col(name).alias("name")).agg(F.sum("total_usd_m").alias("total_usd_m"))
            .orderBy(F.col("total_usd_m").desc_nulls_last(), F.col("name").asc_nulls_last())
            .limit(limit).withColumn("total_usd_m", F.coalesce("total_usd_m", F.lit(0.0))))


def type_breakdown(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.col("type").alias("code")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), F.col("code").asc_nulls_last()))


def breakdown(df: DataFrame, limit: int = 10) -> DataFrame:
    """Top products and top countries of the filtered rows in one frame."""
    tops = [top_by(df, n, limit).select(F.lit(n).alias("ranking"), "name", "total_usd_m")
            for n in ("product", "country")]
    return tops[0].unionByName(tops[1])
