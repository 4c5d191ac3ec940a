"""Vector code compression: product codes learnt and assigned in whole numbers.

A vector's components become integers and its four parts are replaced by the number of the
nearest of 256 entries each. Parts and entries, padded with zeros to a power of two, go through
an integer Walsh-Hadamard transform, which multiplies every squared distance by the padded
length. Squared differences of the coefficients are added in sequency order (slowest varying
first, where most of a distance tends to lie); an entry whose sum so far is over the full
distance to a good entry is out, so most are dropped after a few coefficients. All is integer
arithmetic of the narrowest width that the largest component allows, unbounded where it is
beyond 64 bits, so results do not depend on order or machine.

Every round is one pass over the vectors; a task sends the sums of its parts by entry, and the
driver holds codebooks only. Nothing is grouped by vector, so common vectors cost nothing extra.

A vector that is null or holds a null or non-finite component is dropped. Vectors of differing
lengths are padded with zeros to the longest, and that to a multiple of the parts. Rows are not
told apart by vec_id: repeated and null ones count as rows of their own, null ranking last and
ties going by the vector. With fewer than 256 rows the codebooks are smaller. An error or sum of
errors beyond 64 bits is null. An empty table has no codes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared with a codebook at a time, and coefficients added between two eliminations.
ROWS, STEP = 256, 4
#: Pairs go on by themselves when at most one in so many is left.
MANY = 8
#: Labels with at least this share of the rows (so at most so many) are joined by broadcast.
HOT_LABELS = 1_000
LIMB = 40
LARGEST = (1 << 63) - 1


def sequency_order(n: int) -> np.ndarray:
    """Row of the natural Hadamard matrix that has 0, 1, 2 ... changes of sign; n a power of two."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    return sum((((gray >> k) & 1) << (bits - 1 - k) for k in range(bits)), np.zeros(n, np.int64))


def walsh(x: np.ndarray) -> np.ndarray:
    """Coefficients of every row in sequency order; rows are padded to a power of two."""
    rows, size = x.shape
    n = 1 << (size - 1).bit_length()
    x = np.concatenate((x, np.zeros((rows, n - size), x.dtype)), 1)
    h = 1
    while h < n:
        pair = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(rows, n)
        h *= 2
    return x[:, sequency_order(n)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed rows the nearest transformed entry (of equals the first) and the distance.

    While many entries are left their sums grow side by side as a matrix; once most are out, the
    pairs that are left go on by themselves.
    """
    n = x.shape[1]
    chosen, distance = [np.zeros(0, np.int64)], [np.zeros(0, x.dtype)]
    columns = np.ascontiguousarray(entries.T)
    for k in range(0, len(x), ROWS):
        own = x[k:k + ROWS]
        total = np.zeros((len(own), len(entries)), x.dtype)
        d = np.empty_like(total)
        bound = left = None
        for at in range(0, n, STEP):
            for c in range(at, min(n, at + STEP)):
                np.subtract(own[:, c, None], columns[c], out=d)
                np.multiply(d, d, out=d)
                np.add(total, d, out=total)
            at += STEP
            if at >= n:
                break
            if bound is None:
                bound = ((own - entries[total.argmin(1)]) ** 2).sum(1, dtype=x.dtype)
            left = total <= bound[:, None]
            if np.count_nonzero(left) * MANY <= left.size:
                break
        if at >= n:
            best = total.argmin(1)
            chosen.append(best)
            distance.append(total[np.arange(len(own)), best])
            continue
        row, entry = np.nonzero(left)
        total = total[row, entry]
        for c in range(at, n, STEP):
            part = own[row, c:c + STEP] - entries[entry, c:c + STEP]
            total = total + (part * part).sum(1, dtype=x.dtype)
            on = total <= bound[row]
            row, entry, total = row[on], entry[on], total[on]
        starts = np.searchsorted(row, np.arange(len(own)))
        hit = np.flatnonzero(total == np.minimum.reduceat(total, starts)[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(own)))]
        chosen.append(entry[hit])
        distance.append(total[hit])
    return np.concatenate(chosen), np.concatenate(distance)


@dataclass
class Codebooks:
    """Entries of every part, and the width and number type that vectors are read with."""
    entries: list[np.ndarray]
    width: int
    kind: str

    def digest(self) -> str:
        numbers = (str(int(v)) for part in self.entries for v in part.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def kept(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id and vector of the rows whose vector is whole, and the columns named."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), *more)
    return rows.where(F.col("embedding").isNotNull()).where(~broken)


def integers(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """floor(SCALE * component) of every vector, exactly, as rows of ``width`` numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat)
    rest = np.floor((flat - whole) * SCALE).astype(np.int64)
    if kind == "object":
        out = np.array([int(w) for w in whole], object) * SCALE + rest
    else:
        out = (whole.astype(np.int64) * SCALE + rest).astype(kind)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return out.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), out.dtype)
    full[np.arange(width) < sizes[:, None]] = out
    return full


def number_kind(largest: float, part: int) -> str:
    """Narrowest type that holds every sum of scaled squared differences."""
    n = 1 << (part - 1).bit_length()
    if not math.isfinite(largest * SCALE):
        return "object"
    bound = 4 * n * n * (math.ceil(largest * SCALE) + 1) ** 2
    return "int32" if bound < 1 << 31 else "int64" if bound < LARGEST else "object"


def _by_part(x: np.ndarray, k: int) -> np.ndarray:
    size = x.shape[1] // PARTS
    return x[:, k * size:(k + 1) * size]


def _sums(books: Codebooks):
    """A mapInArrow function: sums of the parts nearest to each entry, over all of a task."""
    def run(batches):
        coded = [walsh(e) for e in books.entries]
        wide = object if books.kind == "object" else np.int64
        sums = [np.zeros(e.shape, wide) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for b in batches:
            x = integers(b.column(0), books.width, books.kind)
            for k in range(PARTS):
                own = _by_part(x, k)
                entry, _ = nearest(walsh(own), coded[k])
                order = np.argsort(entry, kind="stable")
                used, starts, n = np.unique(entry[order], return_index=True, return_counts=True)
                if len(used):
                    sums[k][used] += np.add.reduceat(own[order].astype(wide), starts)
                    counts[k][used] += n
        rows = []
        for k in range(PARTS):
            limbs = 1
            if wide is object:
                limbs += max([int(abs(v)).bit_length() for v in sums[k].ravel()], default=0) // LIMB
            for e in np.flatnonzero(counts[k]).tolist():
                for limb in range(limbs):  # the last one has the sign
                    v = sums[k][e] if limbs == 1 else sums[k][e] >> (LIMB * limb)
                    if limb < limbs - 1:
                        v = v & ((1 << LIMB) - 1)
                    rows.append((k, e, limb, int(counts[k][e]), [int(u) for u in v]))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(),
                                                             pa.list_(pa.int64())))],
                ["part", "entry", "limb", "n", "sums"])
    return run


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the mean of its parts, rounded down; unused ones stay."""
    found = rows.select("embedding").mapInArrow(
        _sums(books), "part int, entry int, limb int, n long, sums array<long>")
    each = found.select("part", "entry", "limb", "n", F.posexplode("sums").alias("place", "v"))
    # as many rows as the codebooks have components come to the driver
    totals = (each.groupBy("part", "entry", "limb", "place")
              .agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"), F.sum("n").alias("n")).collect())
    entries = [e.copy() for e in books.entries]
    values: dict[tuple[int, int, int], list[int]] = {}
    for r in totals:
        one = values.setdefault((r["part"], r["entry"], r["place"]), [0, 0])
        one[0] += int(r["v"]) << (LIMB * r["limb"])
        if r["limb"] == 0:
            one[1] = r["n"]
    for (part, entry, place), (v, n) in values.items():
        entries[part][entry, place] = v // n
    return Codebooks(entries, books.width, books.kind)


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks that start as the parts of the rows with the least identifiers."""
    rows = kept(vectors)
    size = F.max(F.size("embedding")).alias("size")
    largest = F.max(F.array_max(F.transform("embedding", F.abs))).alias("largest")
    known = rows.agg(size, largest).first()
    part = max(1, -(-(known["size"] or 1) // PARTS))
    kind = number_kind(known["largest"] or 0.0, part)
    start = (rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
             .select("embedding").toArrow().column(0).combine_chunks())
    x = integers(start, part * PARTS, kind)
    books = Codebooks([_by_part(x, k) for k in range(PARTS)], part * PARTS, kind)
    for _ in range(rounds if len(x) else 0):
        books = improved(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, *more: str) -> DataFrame:
    """vec_id, the columns named, code (two hexadecimal digits for each part) and squared error."""
    def run(batches):
        coded = [walsh(e) for e in books.entries]
        n = coded[0].shape[1]
        digits = np.array([f"{i:02x}" for i in range(ENTRIES)], object)
        for b in batches:
            x = integers(b.column(1), books.width, books.kind)
            found = [nearest(walsh(_by_part(x, k)), coded[k]) for k in range(PARTS)]
            code = sum((digits[e] for e, _ in found[1:]), digits[found[0][0]])
            total = sum(d.astype(object if books.kind == "object" else np.int64) for _, d in found) // n
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(code, pa.string()),
                 pa.array([v if v <= LARGEST else None for v in total.tolist()], pa.int64())],
                ["vec_id", *more, "code", "error"])
    rows = kept(vectors, *more)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInArrow(run, f"vec_id long{kinds}, code string, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that a code stands for; a null code gives none."""
    def run(batches):
        for b in batches:
            rows = [None if c is None else [float(v) / SCALE for k in range(PARTS)
                                            for v in books.entries[k][int(c[2 * k:2 * k + 2], 16)]]
                    for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             ["vec_id", "embedding"])
    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over equal labels, null ones together.

    Labels are summed before the shuffle. Frequent ones, of which there are at most
    ``HOT_LABELS``, reach the rows by broadcast, all others by a merge join.
    """
    coded = stored(coded, "coded")
    sums = stored(coded.groupBy(F.col("label").alias("of_label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("error").alias("known"),
        F.sum(F.col("error").cast("decimal(20,0)")).alias("total")), "label_errors")
    total = coded.count()
    value = F.expr("try_cast(CASE WHEN known = n THEN total END AS long)").alias("label_error")
    hot = F.broadcast(sums.where(F.col("n") * HOT_LABELS >= total).select("of_label", value))
    cold = sums.where(F.col("n") * HOT_LABELS < total).select("of_label", value).hint("merge")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    rest = coded.join(hot, same, "left_anti")
    return coded.join(hot, same).drop("of_label").unionByName(rest.join(cold, same).drop("of_label"))


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks of every row kept."""
    books = train(vectors)
    return with_label_errors(encode(vectors, books, "label")).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
