"""Small tables with nulls, repeated rows, ties, empty and very long texts and clashing columns."""
import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("row", T.StringType()), T.StructField("node", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("rank", T.StringType()), T.StructField("block", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("bucket", T.StringType())])


def make_rows():
    rng = random.Random(4)
    words = ["the", "of", "thonre", "Eringing", "andea", "ouen", "ÉAUX", "straße", "tion", "l'eau", "2024", "x"]
    words += ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [prose(rng.randint(4, 12)) for _ in range(12)]
    passage = prose(60)
    out = []
    for i in range(110):
        text = "\n".join([prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))] + rng.sample(lines, rng.randint(0, 3)))
        if i % 7 == 0:
            text += "\n" + passage
        out.append((i, text))
    base = prose(120)
    for i in range(200, 225):  # near copies, more and more edited
        w = base.split(" ")
        for _ in range(i - 200):
            w[rng.randrange(len(w))] = prose(1)
        out.append((i, " ".join(w)))
    out += [(300 + i, base.upper() if i % 2 else base) for i in range(6)]
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    out += [
        (400, None), (401, ""), (402, ""), (403, "\n\n"), (404, " \t "), (405, "a b"), (406, "A  B"),
        (407, "one two three four five"), (408, "one two three four five"), (409, "x" * 5000),
        (410, "ab" * 3000 + "\n" + "x" * 300), (411, f'password="{key[:12]}" and token: short {key}'),
        (412, f"é AKIA{key[:3].upper()}ABCDEFGHIJKLM secret = {key} {key}"), (413, "token: token: abcdefghij ſecret=12345678"),
        (414, "\n".join(lines) + "\r\n  " + lines[0].upper() + "\t\n" + lines[1]),
        (415, "a\x0b\x0cb c d don't 've 's''s \n's  'll!'re"), (416, "𝔘𝔫𝔦 漢字かな 😀😀 é"),
        (420, prose(8000)), (421, passage), (422, passage[:49]), (423, passage[:50]), (424, passage[1:51] + "?"),
        (None, None), (None, passage), (None, passage), (5, out[5][1]), (5, out[5][1]), (6, "another text of document six"),
        (500, out[3][1]), (501, out[3][1].swapcase()), (-3, out[4][1]),
    ]
    src = ["hot"] * 6 + ["a", "b", None]
    return [(d, t, "en", src[k % len(src)], None if t is None else len(t), *["clash"] * 8) for k, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(110)] + [(None, 1), (1, None)], "doc_id long, quality int")
