"""Name completion and look-alike names over the party columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains, starts_with
from ..schema import PARTY_COLUMNS, col

SCORE_CUTOFF = 70
SHORTEST_QUERY = 2


def _check(party: str) -> None:
    if party not in PARTY_COLUMNS:
        raise ValueError(f"party must be one of {PARTY_COLUMNS}")


def entity_counts(df: DataFrame, party: str) -> DataFrame:
    """Distinct names with their shipments; cache it to score many queries."""
    _check(party)
    return (df.filter(col(party).isNotNull()).groupBy(col(party).alias("name"))
            .agg(F.count("*").alias("shipments")))


def suggest(df: DataFrame, party: str, query: str, limit: int = 10) -> DataFrame:
    """Names that start with the query in order, then those that only contain it."""
    _check(party)
    name = col(party)
    found = df.select(name.alias("name")).filter(contains(name, query) & (name != ""))
    if len(query or "") < SHORTEST_QUERY:
        found = found.limit(0)
    rank = F.when(starts_with(F.col("name"), query), 0).otherwise(1)
    return found.distinct().orderBy(rank, "name").limit(limit)


def _closeness(a: Column, b: Column) -> Column:
    """1 for equal texts, less the share of the longer one that has to be edited."""
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest


def similarity(name: Column, query: str) -> Column:
    """Score of 0 to 100 by edit distance, both sides in lower case.

    The best of: the whole texts; their words in order (times 0.95); the query against any
    word of the name, and the query found inside the name (times 0.9).
    """
    wanted, text = query.lower(), F.lower(name)
    words = F.split(text, " ")
    ordered = F.lit(" ".join(sorted(wanted.split(" "))))
    q = F.lit(wanted)
    best = F.greatest(
        _closeness(text, q),
        0.95 * _closeness(F.array_join(F.array_sort(words), " "), ordered),
        0.9 * F.array_max(F.transform(words, lambda w: _closeness(w, q))),
        F.when(F.contains(text, q), F.lit(0.9)).otherwise(F.lit(0.0)))
    return F.round(100 * best, 6)


def similar(entities: DataFrame, query: str, limit: int = 10,
            cutoff: float = SCORE_CUTOFF) -> DataFrame:
    """Best scoring names of ``entity_counts`` against the query, by a top-k.

    Scores are Column expressions over the distinct names; nothing runs in Python.
    """
    if not query:
        return entities.limit(0).select("name", F.lit(0).alias("score"), "shipments")
    ranked = entities.withColumn("raw", similarity(F.col("name"), query))
    return (ranked.filter(F.col("raw") >= cutoff)
            .orderBy(F.desc("raw"), "name").limit(limit)
            .select("name", F.floor("raw").cast("int").alias("score"), "shipments"))
