"""Stored indexes over the distinct party names: look-alikes by q-grams, completion by rotations.

Both are built once from ``entity_counts`` and then answer with a few range reads instead of
scanning and scoring every name. They give the same rows as ``entities.similar`` and
``entities.suggest``.

**Look-alikes.** A name's score is the best of four (see ``entities.similarity``), three of them
an edit distance between the query and a form of the name: the whole text, its ordered words,
one word. Two texts within k edits share at least ``longest + Q - 1 - k * Q`` of their padded
Q-grams, so a form that reaches a score has at least one of the query's rarest grams, all but
that many less one. Only the lists of these grams are read, within the lengths that can reach the
score; a name that contains the query has the rarest of its inner grams. Names found are scored
in full. High scores are tried first, as most often the best ten are there.

**Completion.** Every rotation of a name, its start marked, is a row of a table sorted by
rotation, so all names that contain a text are one range, found by statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains, starts_with
from . import entities

Q = 3
START, END = "\u0001", "\u0002"  # pads of a form; no part of a name
#: Grams in at least one of so many names are known to the driver, at most so many times the mean
#: number of grams of a name; all others count as rare.
FREQUENT = 1_000
#: Scores tried in turn before the caller's own cutoff.
LADDER = (85.0,)
#: Longest part of a rotation that is stored; longer queries are checked on the name itself.
ROTATION = 48
#: Weight of each form's edit distance in the score.
FORMS = {"whole": 1.0, "ordered": 0.95, "word": 0.9}


def _padded(form: Column) -> Column:
    return F.concat(F.lit(START * (Q - 1)), form, F.lit(END * (Q - 1)))


def _grams(form: Column) -> Column:
    whole = _padded(form)
    return F.transform(F.sequence(F.lit(1), F.char_length(form) + F.lit(Q - 1)),
                       lambda i: F.substr(whole, i, F.lit(Q)))


def query_grams(text: str) -> list[tuple[str, int]]:
    """Padded grams of a text; the second of equal ones has number 1, and so on."""
    whole = START * (Q - 1) + text + END * (Q - 1)
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) + Q - 1):
        gram = whole[i:i + Q]
        out.append((gram, seen.setdefault(gram, 0)))
        seen[gram] += 1
    return out


def least_shared(length: int, closeness: float) -> int:
    """Grams that any text of that closeness shares with one of that length; 0: none for sure."""
    return max(0, math.ceil(length * (1 - Q * (1 - closeness)) + Q - 1 - 1e-9))


def deciding_grams(text: str, closeness: float, counts: dict[str, int]) -> list[str] | None:
    """Grams of which every form that close has at least one, the rarest; None when it need not."""
    grams = sorted(query_grams(text), key=lambda g: (counts.get(g[0], 0), g))
    shared = least_shared(len(text), closeness)
    if not shared:
        return None
    return sorted({g for g, _ in grams[:len(grams) - shared + 1]})


@dataclass
class SimilarIndex:
    """``grams``: gram, kind, length, name, shipments, in ranges of grams; ``frequent``: rows of the
    frequent (kind, gram)."""
    names: DataFrame
    grams: DataFrame
    frequent: dict[tuple[str, str], int]

    def cached(self) -> SimilarIndex:
        for df in (self.names, self.grams):
            df.persist(StorageLevel.MEMORY_AND_DISK).count()
        return self


def gram_rows(names: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of the index of ``entity_counts``, to be written or cached; ``partitions`` ranges of
    grams (default: as the session shuffles).

    A frequent gram is spread over several ranges by the name, so none gathers in one task."""
    text = F.lower("name")
    words = F.split(text, " ")
    forms = F.array_append(F.array_append(
        F.transform(F.array_distinct(words), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("form"))),
        F.struct(F.lit("ordered").alias("kind"), F.array_join(F.array_sort(words), " ").alias("form"))),
        F.struct(F.lit("whole").alias("kind"), text.alias("form")))
    every = names.select("name", "shipments", F.inline(forms))
    rows = every.select(F.explode(F.array_distinct(_grams(F.col("form")))).alias("gram"), "kind",
                        F.char_length("form").alias("length"), "name", "shipments")
    keys = ["gram", "kind", "name"]
    return rows.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)


def similar_index(names: DataFrame, grams: DataFrame | None = None) -> SimilarIndex:
    """Index of ``entity_counts``; ``grams`` are its ``gram_rows`` where they have been stored."""
    grams = gram_rows(names) if grams is None else grams
    counts = grams.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    least = names.count() / FREQUENT
    found = counts.filter(F.col("n") >= F.lit(least)).collect()
    return SimilarIndex(names, grams, {(r["kind"], r["gram"]): r["n"] for r in found})


def _forms_of_query(query: str) -> dict[str, str]:
    wanted = query.lower()
    return {"whole": wanted, "ordered": " ".join(sorted(wanted.split(" "))), "word": wanted}


def _candidates(index: SimilarIndex, query: str, cutoff: float) -> DataFrame | None:
    """(name, shipments) that hold every name of at least the cutoff; None when grams cannot say."""
    chosen = None
    for kind, text in _forms_of_query(query).items():
        closeness = cutoff / 100 / FORMS[kind] - 1e-9
        own = {g: n for (k, g), n in index.frequent.items() if k == kind}
        part = None
        if closeness <= 1:
            deciding = deciding_grams(text, closeness, own)
            if deciding is None:
                return None
            fits = F.col("length").between(math.ceil(len(text) * closeness - 1e-9), math.floor(len(text) / closeness + 1e-9))
            part = F.col("gram").isin(deciding) & fits
        if kind == "whole" and cutoff <= 90:
            inner = [g for g, _ in query_grams(text)[Q - 1:len(text)]]
            if not inner:
                return None  # too short for an inner gram
            rarest = min(inner, key=lambda g: (own.get(g, 0), g))
            contains = F.col("gram") == F.lit(rarest)
            part = contains if part is None else part | contains
        if part is not None:
            part = (F.col("kind") == kind) & part
            chosen = part if chosen is None else chosen | part
    if chosen is None:
        return index.names.limit(0)
    return index.grams.filter(chosen).select("name", "shipments").distinct()


def similar(index: SimilarIndex, query: str, limit: int = 10, cutoff: float = entities.SCORE_CUTOFF) -> DataFrame:
    """Best scoring names against the query, as ``entities.similar`` over all names gives them.

    Runs at most one query for each step of ``LADDER`` before the last plan, which is returned
    unrun. Below the score at which grams decide, all names are scored.
    """
    if not query:
        return entities.similar(index.names, query, limit, cutoff)
    for step in [x for x in LADDER if x > cutoff]:
        some = _candidates(index, query, step)
        if some is not None:
            best = entities.similar(some, query, limit, step).toArrow()
            if best.num_rows >= limit:  # all others score less than the step
                return index.names.sparkSession.createDataFrame(best)
    some = _candidates(index, query, cutoff)
    return entities.similar(index.names if some is None else some, query, limit, cutoff)


def rotations(names: DataFrame, partitions: int | None = None) -> DataFrame:
    """rotation, at, name: every rotation of each name in lower case, sorted by rotation.

    ``at`` is where in the name it starts. Write it with ``writers`` or cache it: a range read
    then prunes by statistics. Names that share a text are spread by the name too."""
    text = F.lower("name")
    around = F.concat(text, F.lit(END), text)
    each = names.filter((F.col("name") != "") & F.col("name").isNotNull()).select(
        "name", F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length(text)),
                                         lambda i: F.substr(around, i, F.lit(ROTATION)))).alias("at", "rotation"))
    keys = ["rotation", "name"]
    dealt = each.repartitionByRange(*([partitions] if partitions else []), *keys)
    return dealt.select("rotation", "at", "name").sortWithinPartitions(*keys)


def suggest(table: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Names that start with the query in order, then those that only contain it.

    The same rows as ``entities.suggest`` for a query without wildcards; one with ``%`` or ``_``
    is matched against the names of the table's first rotations."""
    text = (query or "").lower()
    if len(text) < entities.SHORTEST_QUERY:
        return table.select("name").limit(0)
    if any(c in text for c in "%_"):
        names = table.filter("at = 0").select("name").distinct()
        found = names.filter(contains(F.col("name"), query))
        return found.orderBy(F.when(starts_with(F.col("name"), query), 0).otherwise(1), "name").limit(limit)
    hits = table.filter(F.col("rotation").startswith(text[:ROTATION]))
    if len(text) > ROTATION:
        hits = hits.filter(F.contains(F.lower("name"), F.lit(text)))
    # one row a name: the least place decides, so a name that starts with the text comes first
    first = hits.groupBy("name").agg(F.min("at").alias("at"))
    return first.orderBy(F.when(F.col("at") == 0, 0).otherwise(1), "name").limit(limit).select("name")
