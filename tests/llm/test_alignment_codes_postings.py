"""Contamination, cross-tokenizer alignment and vector codes against brute force."""
import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cargolake.llm import alignment, codes, postings  # noqa: E402

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(df, want):
    assert Counter(map(repr, (tuple(r) for r in df.collect()))) == Counter(map(repr, want))


# 11
def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def item_rows(rows):
    whole = {r[0]: split(r[1]) for r in rows if r[0] is not None}
    passage = whole[421]
    return [(1, " ".join(passage[5:30])), (1, "of the " + " ".join(passage[40:52])), (22, " ".join(passage[:9]).upper()),
            (3, "the"), (4, ""), (5, None), (6, "?! ;"), (7, "words that stand in no document xyzzyq at all here now"),
            (8, " ".join(whole[420][100:140])), (9, " ".join(whole[420][100:140])), (None, " ".join(whole[420][300:315])),
            (10, "one two three four five"), (11, "漢字かな é"), (12, "x" * 5000), (100, " ".join(whole[207][:20])),
            (13, "the of the of the of the of the of the of"), (14, " ".join(passage[-4:] + whole[8][:6]))]


@pytest.fixture(scope="module")
def items(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in item_rows(rows)],
                                 "item_id long, text string, doc_id string, phrase string")


def spots(w, phrase):
    n = len(phrase)
    return [i for i in range(len(w) - n + 1) if w[i:i + n] == phrase]


def contaminated(rows, items):
    wins = []
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        wins += [(item, w[i:i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        joined = " " + " ".join(w) + " "
        for item, phrase in wins:
            if " " + " ".join(phrase) + " " in joined:
                for i in spots(w, phrase):
                    hit.update(range(i, i + len(phrase)))
                found.add(item)
        named = sorted(str(x) for x in found if x is not None)
        out.append((r[0], len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return out


@pytest.mark.parametrize("block,starts", [(8 << 20, 2_000_000), (3000, 200)])
def test_contamination(docs, rows, items, monkeypatch, block, starts):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "STARTS", starts)
    same(postings.digests(postings.contamination(docs, items)), contaminated(rows, item_rows(rows)))


def test_contamination_of_nothing(docs, rows, empty, items):
    assert postings.contamination(empty, items).collect() == []
    found = postings.contamination(docs, items.where("false")).collect()
    assert len(found) == len(rows) and not any(r["n_hit"] or r["items"] for r in found)


def wanted_phrases(spark, texts):
    return spark.createDataFrame([(t.encode(), split(t)) for t in texts], "phrase binary, terms array<string>")


def test_phrases_are_found_where_they_stand(spark, docs, rows):
    texts = ["one two three", "don t", "the of", "no such word"]
    want = [(r[0], t.encode(), i, len(split(t))) for r in rows for t in texts for i in spots(split(r[1]), split(t))]
    same(postings.phrases(postings.build(docs), wanted_phrases(spark, texts)), want)


def test_words_close_together(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") * 2 for _ in range(60))) for k in range(8)] + [(8, "aa"), (9, "bb cc"), (10, None)]
    texts = ["aa bb cc", "dd aa", "jj jj ii"]
    want = []
    for d, t in rows:
        w = split(t)
        for p in texts:
            need = set(split(p))
            for s in range(len(w)):
                if w[s] in need:
                    ends = [w.index(x, s) if x in w[s:] else 10**6 for x in need]
                    if max(ends) - s < 6:
                        want.append((d, p.encode(), s, max(ends) - s + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(postings.proximity(postings.build(docs), wanted_phrases(spark, texts), 6), want)


# 12
def groups(text, tokenizer, pieces):
    if not text:
        return None
    whole, letters = (" " + text).encode(), alignment.byte_letters()
    ids = [tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)]
    shown = [[bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in ids[0]],
             [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
              else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
    if any(b"".join(x) != whole for x in shown):
        return None
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in shown]
    out, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(cut) + 1 for e in ends]
        out.append(tuple(x[a:z] for x, a, z in zip(ids, at, to)))
        at = to
    return out


def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    found = [(r[0], groups(r[1], tokenizer, pieces)) for r in rows]
    pairs = lambda g: [(a, b) for x, y in g for a in x for b in y]
    count, best = Counter(), defaultdict(int)
    for _, g in found:
        count.update(set(pairs(g or [])))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d, g in found:
        links = pairs(g or [])
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((d, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(text) if g else ""))
    return out


ODD = [(900, "a <|endoftext|> b <s> </s> <0x41> <unk>"), (901, "tab\tand  double   blanks"), (902, " led by a blank"),
       (903, "1234567890" * 9), (904, "ﬁ ligature and ｆｕｌｌ width"), (905, "é combined"), (906, "▁ mark"), (907, "\u0000 nul"),
       (908, "".join(chr(0x4E00 + 37 * k) for k in range(300)))]


@pytest.mark.parametrize("block,batch,wide", [(8 << 20, 1 << 20, 64), (5000, 1500, 2)])
def test_alignment(spark, docs, rows, monkeypatch, block, batch, wide):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("WIDE", wide)):
        monkeypatch.setattr(alignment, name, value)
    odd = [(*r, "en", "a", None, *["clash"] * 8) for r in ODD]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    same(alignment.digests(both, A, B), aligned([*rows, *ODD]))


def test_alignment_of_nothing(empty, spark):
    assert alignment.digests(empty, A, B).collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    same(alignment.digests(none, A, B), [(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2, None)])


def test_groups_are_returned(docs, rows):
    import sentencepiece
    from tokenizers import Tokenizer
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] >= 400}
    for r in alignment.align(docs.where("doc_id >= 400"), A, B).collect():
        own = groups(texts[r["doc_id"]], tokenizer, pieces) or []
        assert r["a"] == [i for x, _ in own for i in x] and r["b"] == [i for _, y in own for i in y]
        assert r["a_ends"] == np.cumsum([len(x) for x, _ in own]).tolist()
        assert r["b_ends"] == np.cumsum([len(y) for _, y in own]).tolist()


def test_runs_against_common_ends():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randint(1, 60)
        ends = [sorted(rng.sample(range(1, n), rng.randint(0, n - 1)) + [n]) for _ in range(2)]
        if rng.random() < .5:
            ends[1] = sorted(set(ends[0][rng.randint(0, 5):]) | {n})
        got = [(i + k, j + k) for i, j, size in alignment.runs(*ends) for k in range(size)]
        assert got == [(ends[0].index(x), ends[1].index(x)) for x in sorted(set(ends[0]) & set(ends[1]))]


# 13
def coded(rows, width, entries=256):
    """Brute force in Python's own integers; rows: (vec_id, vector, label)."""
    whole = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(v) * 1024 + math.floor((v - math.floor(v)) * 1024) for v in r[1]] for r in whole]
    x = [v + [0] * (width - len(v)) for v in x]
    size, books, codes_of, error = width // 4, [], [""] * len(x), [0] * len(x)
    for k in range(4):
        own = [v[k * size:(k + 1) * size] for v in x]
        book = own[:entries]

        def assign(book):
            out = []
            for p in own:
                d = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in book]
                out.append((d.index(min(d)), min(d)))
            return out
        for _ in range(4):
            near = assign(book)
            for e in range(len(book)):
                mine = [p for p, (a, _) in zip(own, near) if a == e]
                if mine:
                    book[e:e + 1] = [[sum(c) // len(mine) for c in zip(*mine)]]
        for i, (a, d) in enumerate(assign(book)):
            codes_of[i] += f"{a:02x}"
            error[i] += d
        books.append(book)
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    fit = lambda v: v if v < 1 << 63 else None
    sums = defaultdict(int)
    for r, e in zip(whole, error):
        sums[r[2]] += e
    over = {r[2] for r, e in zip(whole, error) if fit(e) is None}
    return [(r[0], c, fit(e), None if r[2] in over else fit(sums[r[2]]), digest) for r, c, e in zip(whole, codes_of, error)]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows],
                                 f"vec_id long, embedding array<{kind}>, label int, code string, error string").repartition(3)


def some_vectors(n, width, scale=1.0, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, .3, (n, width)) * scale).astype(np.float32)
    return [(i, [float(v) for v in x[i]], None if i % 5 == 0 else int(i % 3)) for i in range(n)]


def test_codes(spark):
    rows = some_vectors(330, 12)
    rows += [(500 + i, rows[3][1], 1) for i in range(40)]  # one very common vector
    rows += [(None, rows[7][1], 1), (None, rows[8][1], None), (2, rows[9][1], 2), (2, rows[9][1], 2), (600, None, 1),
             (601, [0.5] * 11 + [float("nan")], 1), (602, [float("inf")] * 12, 1), (603, [None] + [0.25] * 11, 0),
             (604, [0.25] * 5, 0), (605, [], 0), (-4, [-0.0001] * 12, None)]
    same(codes.digests(vectors(spark, rows)), coded(rows, 12))


@pytest.mark.parametrize("hot", [1, 1000])
def test_codes_of_few_vectors_with_an_odd_length(spark, monkeypatch, hot):
    monkeypatch.setattr(codes, "HOT_LABELS", hot)
    rows = some_vectors(20, 7)
    same(codes.digests(vectors(spark, rows)), coded(rows, 8))
    assert codes.digests(vectors(spark, rows).where("false")).collect() == []


@pytest.mark.parametrize("scale,kind,type_", [(3000.0, "int64", "float"), (1e17, "object", "float"), (1e300, "object", "double")])
def test_codes_of_large_components(spark, scale, kind, type_):
    rows = some_vectors(270, 8, 1.0)
    rows = [(i, [v * scale if type_ == "double" else float(np.float32(v * scale)) for v in x], n) for i, x, n in rows]
    found = vectors(spark, rows, type_)
    assert codes.train(found, 0).kind == kind
    same(codes.digests(found), coded(rows, 8))


def test_codes_are_near_what_they_stand_for(spark):
    rows = some_vectors(600, 8)
    found = vectors(spark, rows)
    books = codes.train(found)
    whole = codes.encode(found, books)
    error = {r["vec_id"]: r["error"] for r in whole.collect()}
    back = {r["vec_id"]: r["embedding"] for r in codes.decode(whole, books).collect()}
    for i, x, _ in rows:
        assert sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(x, back[i])) == error[i]


@pytest.mark.parametrize("n", [1, 2, 4, 16, 64])
def test_walsh_in_sequency_order(n):
    h = np.array([[1]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    order = codes.sequency_order(n)
    assert [(np.diff(r) != 0).sum() for r in h[order]] == list(range(n))
    x = np.random.default_rng(n).integers(-99, 99, (5, n))
    assert (codes.walsh(x) == x @ h[order].T).all()
    assert ((codes.walsh(x) ** 2).sum(1) == n * (x ** 2).sum(1)).all()


@pytest.mark.parametrize("kind", ["int32", "int64", "object"])
def test_nearest_keeps_ties_to_the_first(kind):
    rng = np.random.default_rng(9)
    x, entries = rng.integers(-2, 3, (2500, 5)).astype(kind), rng.integers(-2, 3, (40, 5)).astype(kind)
    found, distance = codes.nearest(codes.walsh(x), codes.walsh(entries))
    d = ((x[:, None] - entries) ** 2).sum(2)
    first = np.array([r.tolist().index(min(r.tolist())) for r in d])
    assert found.tolist() == first.tolist()
    assert distance.tolist() == [8 * int(v) for v in d[np.arange(len(x)), first]]


def test_words_of_texts_that_touch():
    found, firsts = postings.words(pa.array(["ab", "Cd e", "", "é1"]))
    assert found.to_pylist() == ["ab", "cd", "e", "é1"] and firsts.tolist() == [0, 1, 3, 3, 4]
