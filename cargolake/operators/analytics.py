"""Roll-ups of shipments. Each takes an already filtered frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import PARTY_COLUMNS, col

TREND_KEYS = ("Trade Type", "HS Chapter", "Origin Country", "Destination Country")


def _volume(prefix: str = "total_") -> list[Column]:
    return [F.count("*").alias("shipments"), F.sum("Value").alias(f"{prefix}value"),
            F.sum("Quantity").alias(f"{prefix}quantity")]


def _party(name: str) -> Column:
    if name not in PARTY_COLUMNS:
        raise ValueError(f"party must be one of {PARTY_COLUMNS}")
    return col(name)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def totals(df: DataFrame) -> DataFrame:
    """Count, sums and mean unit price; sums over nothing are NULL."""
    return df.agg(F.count("*").alias("count"), F.sum("Quantity").alias("total_quantity"),
                  F.sum("Value").alias("total_value"),
                  F.avg("Unit Price USD").alias("avg_unit_price_usd"))


def top_parties(df: DataFrame, party: str, limit: int = 25) -> DataFrame:
    name = _party(party)
    return (df.filter(name.isNotNull()).groupBy(name.alias("name")).agg(*_volume())
            .orderBy(F.col("total_value").desc_nulls_last(), "name").limit(limit))


def party_universe(df: DataFrame, party: str, approximate: bool = False) -> DataFrame:
    """Number of distinct parties; the approximate form needs no shuffle of names."""
    name = _party(party)
    if approximate:
        return df.agg(F.approx_count_distinct(name).alias("total"))
    return df.select(name).filter(name.isNotNull()).distinct().agg(F.count("*").alias("total"))


def monthly(df: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Volume by month and any of the trend keys; other keys are ignored."""
    keys = [k for k in by if k in TREND_KEYS]
    return (df.filter(F.col("Date").isNotNull())
            .groupBy(F.trunc("Date", "MM").alias("month"), *map(col, keys)).agg(*_volume())
            .orderBy("month", *(col(k).asc_nulls_last() for k in keys)))


def trend_pivot(df: DataFrame, key: str, values: list[str] | None = None) -> DataFrame:
    """Value by month with one column per series; a missing key is the series ``—``."""
    if key not in TREND_KEYS:
        raise ValueError(f"key must be one of {TREND_KEYS}")
    dated = (df.filter(F.col("Date").isNotNull())
             .select(F.trunc("Date", "MM").alias("month"), "Value",
                     F.coalesce(col(key), F.lit("—")).alias("series")))
    return (dated.groupBy("month").pivot("series", values).agg(F.sum("Value"))
            .orderBy("month"))


def month_change(df: DataFrame) -> DataFrame:
    """Change of the last month's value against the month before it, in percent.

    Months without a value count as zero; the change is NULL when there is no earlier
    month or its value is zero.
    """
    last_two = (monthly(df).select("month", F.coalesce("total_value", F.lit(0.0)).alias("value"))
                .orderBy(F.desc("month")).limit(2))
    newer, older = F.max_by("value", "month"), F.min_by("value", "month")
    return (last_two.agg(F.max("month").alias("month"), newer.alias("value"),
                         F.when(F.count("*") > 1, older).alias("previous_value"))
            .withColumn("change_pct", _change(F.col("value"), F.col("previous_value"))))


def month_changes(df: DataFrame) -> DataFrame:
    """The same for every month. The window runs over the roll-up: one row per month."""
    value = F.coalesce("total_value", F.lit(0.0)).alias("value")
    before = F.lag("value").over(W.orderBy("month"))
    return (monthly(df).select("month", value).withColumn("previous_value", before)
            .withColumn("change_pct", _change(F.col("value"), F.col("previous_value"))))


def _change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / F.nullif(before, F.lit(0.0)) * 100)


def distinct_by(df: DataFrame, keys: list[Column], value: Column, name: str) -> DataFrame:
    """Distinct values by keys: one grouping over keys and value, then a count of its rows.

    Several distinct counts in one aggregate would copy every row for each of them; these are
    groupings of their own, which combine before their shuffle, joined by their few results.
    """
    pairs = df.select(*keys, value.alias("v_")).filter("v_ IS NOT NULL").distinct()
    return pairs.groupBy(*(c for c in pairs.columns if c != "v_")).agg(F.count("*").alias(name))


def distinct_count(df: DataFrame, value: Column) -> Column:
    """Number of distinct values as a scalar, to stand beside other aggregates."""
    return df.select(value.alias("v_")).filter("v_ IS NOT NULL").distinct().agg(F.count("*")).scalar()


def by_country(df: DataFrame, limit: int = 50, counterparty: bool = False) -> DataFrame:
    """Volume by country and trade type.

    The country is the first stated of origin, destination and partner. On exports that is
    the reporting country itself; ``counterparty`` takes the partner instead. Parties are
    counted for the countries that are reported alone.
    """
    place = (F.col("Country") if counterparty
             else F.coalesce("Origin Country", "Destination Country", "Country"))
    keys = [place.alias("country"), F.col("Trade Type").alias("trade_type")]
    order = [F.col("total_value").desc_nulls_last(), "country", F.col("trade_type").asc_nulls_last()]
    placed = df.filter(place.isNotNull())
    found = placed.groupBy(*keys).agg(*_volume()).orderBy(*order).limit(limit)
    for party in ("Importer", "Exporter"):
        name = f"unique_{party.lower()}s"
        counts = distinct_by(placed, keys, F.col(party), name).toDF("c_", "t_", name)
        same = (F.col("country") == F.col("c_")) & F.col("trade_type").eqNullSafe(F.col("t_"))
        found = (found.join(counts, same, "left").drop("c_", "t_")
                 .withColumn(name, F.coalesce(name, F.lit(0))))
    return found.orderBy(*order)


def heat(countries: DataFrame) -> DataFrame:
    """Map shading of the ranked countries: the share of the largest, to the power 0.7.

    Meant for the limited result of ``by_country``, so the window has that many rows.
    """
    share = F.coalesce("total_value", F.lit(0.0)) / F.nullif(
        F.max(F.coalesce("total_value", F.lit(0.0))).over(W.partitionBy()), F.lit(0.0))
    return countries.withColumn("intensity", F.least(F.lit(1.0), F.pow(share, F.lit(0.7))))


def by_hsn(df: DataFrame, limit: int = 50) -> DataFrame:
    """Volume by product code with the importer and exporter of the largest single value.

    The codes are ranked on sums, which combine in hash maps before the shuffle. Texts are
    only compared for the at most ``limit`` codes reported: that many rows are broadcast
    and the other rows leave before the second shuffle. Ties between parties go to the
    later name.
    """
    order = [F.col("total_value").desc_nulls_last(), "hsn"]
    ranked = (df.filter(F.col("HSN").isNotNull()).groupBy(F.col("HSN").alias("hsn"))
              .agg(*_volume()).orderBy(*order).limit(limit))

    def biggest(party: str) -> Column:
        pair = F.when(col(party).isNotNull() & F.col("Value").isNotNull(),
                      F.struct("Value", col(party).alias("name")))
        return F.max(pair)["name"]

    volume = [F.col(c) for c in ("shipments", "total_value", "total_quantity")]
    keyed = df.select("HSN", "HS Chapter", "Trade Type", "Importer", "Exporter", "Value")
    return (keyed.join(ranked.withColumnRenamed("hsn", "_hsn"),
                       F.col("HSN") == F.col("_hsn"))
            .groupBy(F.col("_hsn").alias("hsn"), *volume)
            .agg(F.max("HS Chapter").alias("hs_chapter"), F.max("Trade Type").alias("trade_type"),
                 biggest("Importer").alias("top_importer"),
                 biggest("Exporter").alias("top_exporter"))
            .orderBy(*order))


def dataset_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, date range and numbers of distinct values.

    Each exact count is a grouping of its own over one column, which combines before its
    shuffle; counting several distinct columns at once would copy every row for each. The
    approximate form is one pass with sketches of fixed size.
    """
    places = F.coalesce("Origin Country", "Destination Country")
    wanted = {"importers": F.col("Importer"), "exporters": F.col("Exporter"),
              "suppliers": F.col("Supplier"), "hsn": F.col("HSN"), "countries": places}
    base = [F.count("*").alias("total_rows"), F.min("Date").alias("date_min"),
            F.max("Date").alias("date_max")]
    if approximate:
        return df.agg(*base, *(F.approx_count_distinct(c).alias(f"distinct_{n}")
                               for n, c in wanted.items()))
    counts = {f"distinct_{n}": distinct_count(df, c) for n, c in wanted.items()}
    return df.agg(*base).select("*", *(c.alias(n) for n, c in counts.items()))


def counts_by(df: DataFrame, name: str) -> DataFrame:
    """Rows per value of a column; a missing or empty value counts as ``unknown``."""
    key = F.coalesce(F.nullif(col(name), F.lit("")), F.lit("unknown"))
    return df.groupBy(key.alias("name")).agg(F.count("*").alias("count"))


def market_coverage(df: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.col("Reporting Country"), F.lit("")), F.lit("unknown"))
    return (df.groupBy(key.alias("reporting_country"))
            .agg(F.count("*").alias("rows"), F.min("Date").alias("date_min"),
                 F.max("Date").alias("date_max"))
            .orderBy(F.desc("rows"), "reporting_country"))
