"""Every operator against a brute-force version on the small tables."""
import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cargolake.llm import bpe, exact, lines, merkle, minhash, packing, quality, secrets, sharding, suffix  # noqa: E402
from cargolake.llm.shingles import sets, word_hashes  # noqa: E402

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def plain(rows):
    return [(r[0], r[1] or "") for r in rows]


# 1
def test_bpe(docs, rows):
    import base64
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in plain(rows):
        ids = own.encode_ordinary(t)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t)))
    same(bpe.digests(docs, path), want)
    back = bpe.decode(bpe.encode(docs, path), path)
    same(back, [(d, t.encode()) for d, t in plain(rows)])


def test_bpe_trees_agree():
    ranks = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    rng = np.random.default_rng(1)
    pieces = [bytes(rng.choice(list(b"abcdeth \xc3\xa9"), rng.integers(1, 64)).tolist()) for _ in range(400)]
    many = bpe.merge_many(pieces, 64, ranks)
    assert [np.frombuffer(x, "<u4").tolist() for x in many] == [bpe.merge_one(p, ranks) for p in pieces]


def test_bpe_other_vocabulary(docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    same(bpe.decode(bpe.encode(docs, path), path), [(d, t.encode()) for d, t in plain(rows)])


# 2
def brute_suffix(rows):
    least, n = {}, suffix.MATCH
    order = lambda d: suffix.LAST if d is None else d
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - n + 1):
            s = b[i:i + n]
            least[s] = min(least.get(s, suffix.LAST), order(d))
    out = []
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - n + 1):
            if least[b[i:i + n]] < order(d):
                gone[i + 1:i + n + 1] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone[1:-1]) if not g))))
    return out


@pytest.mark.parametrize("piece,block", [(1 << 20, 4 << 20), (700, 8000)])
def test_suffix(docs, rows, monkeypatch, piece, block):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "PART_BYTES", block)
    found = suffix.removals(docs, kept=False)
    same(found.selectExpr("doc_id", "n_bytes", "n_removed", "bigint(size(spans))", "kept_sha256"), brute_suffix(plain(rows)))


def test_suffix_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (9000, 40, 5000)]
    table = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": texts})

    def found(piece):
        monkeypatch.setattr(suffix, "PIECE", piece)
        b = suffix.Block(table)
        b.anchors()
        return b.place.tolist(), b.gram.tolist(), b.context.tolist(), b.matches(b.place)[2].tolist()
    assert found(1 << 20) == found(600)


def test_suffix_anchors_need_little_memory():
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(1000)]
    b = suffix.Block(pa.table({"doc_id": pa.array(range(1000), pa.int64()), "text": texts}))
    tracemalloc.start()
    try:
        b.anchors()
        assert tracemalloc.get_traced_memory()[1] < 8 * len(b.raw)
    finally:
        tracemalloc.stop()


def test_index_family():
    rng = np.random.default_rng(3)
    family, want = suffix.Family(np.minimum), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 3000, rng.integers(1, 300)).astype(np.uint64))
        owners = rng.integers(0, 99, len(keys))
        family.add(keys, owners)
        for k, o in zip(keys.tolist(), owners.tolist()):
            want[k] = min(want.get(k, 99), o)
    sizes = [len(k) for k, _ in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 9
    every = np.arange(3000, dtype=np.uint64)
    assert family.scan(every, 99).tolist() == [want.get(k, 99) for k in range(3000)]


# 3
def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_near(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        c = min(known) if known and sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def test_minhash(docs, rows):
    want = brute_near(plain(rows))
    same(minhash.near_duplicates(docs).drop("text_row"), want)
    kept = Counter(r["doc_id"] for r in minhash.dedup(docs).collect())
    assert kept == Counter(w[0] for w in want if w[3])


def test_minhash_without_tables(docs, rows, monkeypatch):
    # few tables: what they bring together is still linked exactly
    monkeypatch.setattr(minhash, "SLOTS", 6)
    monkeypatch.setattr(minhash, "ROWS", 1)
    same(minhash.near_duplicates(docs).drop("text_row"), brute_near(plain(rows)))


@pytest.mark.parametrize("words,copies,edits,vocabulary", [(150, 70, 7, 8), (60, 50, 3, 3), (90, 60, 5, 400)])
def test_minhash_of_edited_copies_without_their_source(spark, words, copies, edits, vocabulary):
    """Copies that lie just within or beyond the likeness of one another and of every middle."""
    import random
    rng = random.Random(words)
    source = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(copies):
        text = list(source)
        for _ in range(rng.randint(1, edits)):
            at = rng.randrange(len(text))
            if rng.random() < .2:
                del text[at]
            else:
                text[at] = f"e{rng.randrange(vocabulary)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_near(rows)
    assert 1 < len({w[2] for w in want}) < copies
    same(minhash.near_duplicates(docs).drop("text_row"), want)


def test_apart_links_by_differences_alone(spark):
    """All that differ in label and are similar, given any middle that both are compared with."""
    import random
    rng = random.Random(8)
    source = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(60):
        texts[i] = list(source)
        for at in rng.sample(range(80), 2 if i == 0 else rng.randint(0, 4)):
            texts[i][at] = f"e{rng.randrange(6)}"
    own = {i: shingle_set(" ".join(t)) for i, t in texts.items()}

    def alike(i, j):
        both = len(own[i] & own[j])
        return 100 * both >= 75 * (len(own[i]) + len(own[j]) - both)
    label = {i: 0 if alike(0, i) else i for i in texts}
    want = {(i, j) for i in texts for j in texts if i < j and label[i] != label[j] and alike(i, j) and i > 0}
    around = spark.createDataFrame([(0, i, x) for i, x in label.items()], "a long, b long, label long")
    node_texts = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "node long, text string")
    got = [tuple(r) for r in minhash.apart(around, node_texts).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_shingles_of_words_that_a_polynomial_confuses():
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    one, two = sets(pa.array([f"w1 w2 w3 w4 {morse}", f"w1 w2 w3 w4 {other}"]))
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_word_hashes_tell_words_apart():
    words = sorted({"".join("ab\u00e9z"[(i >> (2 * k)) & 3] for k in range(i % 11 + 1)) + "x" * (i % 23) for i in range(40_000)})
    line = " ".join(words).encode()
    raw = np.frombuffer(line, np.uint8)
    ends = np.flatnonzero(np.append(raw, 0x20) == 0x20)
    starts = np.concatenate(([0], ends[:-1] + 1))
    found = word_hashes(raw, starts, ends)
    assert len(set(found.tolist())) == len(words)
    again = word_hashes(np.frombuffer(b"  " + line, np.uint8), starts + 2, ends + 2)
    assert (found == again).all()


# 4
@pytest.mark.parametrize("bucket", [50_000, 20])
def test_packing(spark, docs, rows, monkeypatch, bucket):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "BUCKET", bucket)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    odd = (930, "ends <|endoftext|> here<|endoftext|>", "en", "a", None, *["clash"] * 8)
    docs, rows = docs.union(spark.createDataFrame([odd], docs.schema)), [*rows, odd]
    ids = [own.encode(t, add_special_tokens=False).ids + [0] for _, t in plain(rows)]
    assert ids[-1].count(50256) == 2
    size = 512
    want, lengths = Counter(), []
    for (d, _), x in zip(plain(rows), ids):
        first = len(x) if len(x) <= size else len(x) % size or size
        cuts = [(0, first)] + [(a, size) for a in range(first, len(x), size)]
        for k, (a, n) in enumerate(cuts):
            want[d, k, a, n, zlib.crc32(np.array(x[a:a + n], "<u4").tobytes())] += 1
            lengths.append(n)
    got = packing.pack_digests(docs, path, size).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x)])[:-1].tolist()
        assert sum(n for _, n in x) <= size
    # one best-fit over all, whatever the buckets
    assert len(by) == 1 + max(at for at, _ in packing.best_fit(sorted(lengths, reverse=True), size)) == 1 + max(by)
    full = packing.sequences(packing.pack(docs, path, size)).collect()
    assert sum(len(r["ids"]) for r in full) == 4 * sum(map(len, ids))
    plain_ids = packing.tokenizer(path, True).ids(pa.array([odd[1]]))[0]
    assert 50256 not in plain_ids.tolist() and bytes(own.decode(plain_ids.tolist()), "utf-8").decode() == odd[1]


@pytest.mark.parametrize("seed,size,most", [(1, 100, 100), (2, 64, 9), (3, 512, 512), (4, 2048, 300)])
def test_runs_are_best_fit_piece_by_piece(seed, size, most):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, most + 1, 4000).tolist(), reverse=True)
    want = packing.best_fit(lengths, size)
    runs = packing.packed_runs(Counter(lengths), size)
    room, seen = defaultdict(int), defaultdict(set)
    for n, first, taken, low, each, offset in runs.tolist():
        seen[n].update(range(first, first + taken))
        for k in range(taken):
            at, inside = divmod(k, each)
            assert room[low + at] == offset + inside * n
            room[low + at] += n
    assert max(room.values()) <= size and {n: len(x) for n, x in seen.items()} == Counter(lengths)
    used = Counter()
    for (at, _), n in zip(want, lengths):
        used[at] += n
    assert sorted(used.values()) == sorted(room.values())  # the same sequences, filled alike
    assert len(packing.packed_runs({n: c * 10**9 for n, c in Counter(lengths).items()}, size)) < 40 * most


def test_rows_without_identifier_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    pieces = spark.createDataFrame([(None, 0, 100, i) for i in range(1000)], "doc_id long, piece int, length int, ids_crc32 long")
    got = packing.placed(pieces, 512).groupBy("sequence_id").count().collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(200)) and {r["count"] for r in got} == {5}
    assert {r["_rank"] for r in packing.ranked(pieces).collect()} == set(range(1000))
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 1000)
    seen = []
    monkeypatch.setattr(suffix, "_sends", lambda *a: (_ for _ in ()).throw(StopAsyncIteration))
    real = type(pieces).select
    monkeypatch.setattr(type(pieces), "select", lambda self, *c: seen.append(real(self, *c)) or seen[-1])
    rows = spark.createDataFrame([(None, f"text {i} " * 10, str(i)) for i in range(200)], "doc_id long, text string, row string")
    with pytest.raises(StopAsyncIteration):
        suffix._steps(rows)
    assert next(x for x in seen if "block" in x.columns).groupBy("block").count().count() > 10


def test_best_fit_takes_the_tightest():
    lengths = sorted(np.random.default_rng(5).integers(1, 100, 500).tolist(), reverse=True)
    got, open_bins = packing.best_fit(lengths, 100), []
    for n, (at, offset) in zip(lengths, got):
        fits = [r for r in open_bins if r >= n]
        if fits:
            assert 100 - offset == min(fits)
            open_bins[at] -= n
        else:
            assert (at, offset) == (len(open_bins), 0)
            open_bins.append(100 - n)


# 5
def brute_base(text):
    spans = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(spans)


def test_secrets(docs, rows):
    got = secrets.digests(secrets.find(docs)).collect()
    want = Counter()
    for d, t in plain(rows):
        base = brute_base(t)
        n = Counter(k for _, k, _ in base)
        want[d, n[0], n[1], n[2], sha(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base))] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}
    assert masked[400] is None and masked[401] == ""
    for d, t in rows_by_id(rows).items():
        if t and not brute_base(t) and "AKIA" not in t:
            assert masked[d] == t or "<secret>" in masked[d]
    assert not brute_base(masked[412]) and masked[412].startswith("é <secret>")


def rows_by_id(rows):
    return {r[0]: r[1] for r in rows if r[0] is not None and r[0] not in (5, 6)}


def test_secret_network_learns_and_adds(spark):
    rng = np.random.default_rng(8)
    token = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJK0123456789"), n))
    data = [(i, f"text password={token(20)} more") for i in range(150)]
    data += [(1000 + i, f"call {rng.integers(10**16, 10**17)} or see mail{i % 9}.example.com at noon") for i in range(300)]
    data += [(5000, f"text passwort={token(24)} more")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.digests(secrets.find(df)).collect()}
    assert sum(r["n_model"] for d, r in found.items() if 1000 <= d < 5000) <= 3
    assert found[5000]["n_model"] == 1 and found[5000]["spans"].startswith("model:")


def test_secret_network_learns_from_every_labelled_run(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    data = [(i, f"text password={pick('abcdefghKLMNOP0123456789', 20)} more {pick('aeioustrn', 9)} {rng.integers(10**9, 10**10)}")
            for i in range(160)] + [(None, "ordinary sentence"), (7, None), (8, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    views = [r["hashed"] for r in secrets.scan(df, 16).where("class = 0").distinct().collect()]
    assert len(views) == 160
    seen = Counter()
    real = secrets.pulls

    def pulls(docs, network):
        for r in real(docs, network).collect():
            seen[r["class"]] += r["seen"]
        return real(docs, network)
    monkeypatch.setattr(secrets, "pulls", pulls)
    network = secrets.learned(df.repartition(3))
    assert seen == {secrets.FIGURE: 160, secrets.LETTERS: 162}
    assert network.secrets.sum() == secrets.COPIES * sum(h % secrets.APART == 0 for h in views) > 0
    assert network.recall >= secrets.RECALL
    monkeypatch.setattr(secrets, "pulls", real)
    other = secrets.learned(df.repartition(7))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(network.parameters(), other.parameters()))
    assert network.cut == other.cut
    # the held-out runs that are none are counted while all candidates are scored
    counts = secrets.judged(df, network, True).where("place is not null").agg({"n": "sum"}).first()[0]
    scanned = secrets.Scanned(pa.array([t or "" for _, t in data]))
    apart = secrets.hashes(scanned.windows(scanned.starts)) % secrets.APART == 0
    assert counts == (apart & scanned.plain(scanned.starts, scanned.ends)).sum() > 0


def test_secret_pull_is_the_gradient():
    rng = np.random.default_rng(1)
    codes, sizes = rng.integers(0, secrets._CODES, (30, secrets.LENGTH)).astype(np.uint8), rng.integers(8, 60, 30)
    network = secrets.Network()
    for sign, secret in ((1, True), (-1, False)):
        loss = lambda: (np.maximum(0, 1 - sign * network.forward(codes, sizes)[-1]) ** 2).sum()  # noqa: B023, E731
        got, at = network.pull(codes, sizes, secret), 0
        for p in network.parameters():
            flat = p.reshape(-1)
            k = int(np.abs(got[at:at + p.size]).argmax())
            flat[k] += 1e-6
            more = loss()
            flat[k] -= 2e-6
            assert np.isclose((more - loss()) / 2e-6, got[at + k], rtol=1e-4)
            flat[k] += 1e-6
            at += p.size


def test_every_token_is_a_secret_candidate():
    import pyarrow as pa
    text = "é pwd: Zx9!kQ2m passwort=Geheim24 QwErTzUiOpKl short AB" + "0123456789abcdef" * 2 + "XYZ"
    scanned = secrets.Scanned(pa.array(["", text, "x" * 8]))
    got = [(k, scanned.texts[k][s - scanned.bounds[k]:e - scanned.bounds[k]])
           for k, s, e in zip(scanned.row(scanned.starts), scanned.starts, scanned.ends)]
    assert got == [(1, "Zx9!kQ2m"), (1, "passwort=Geheim24"), (1, "QwErTzUiOpKl"), (1, "AB"), (1, "XYZ"), (2, "x" * 8)]


def test_secret_network_scores_as_it_was_fitted():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcXYZ019= \n!é"), n)) for n in (0, 3, 9, 700, 9000)] + ["q" * 200]
    scanned, network = secrets.Scanned(pa.array(texts)), secrets.Network()
    sizes = scanned.ends - scanned.starts
    want = network.forward(scanned.windows(scanned.starts), sizes)[-1]
    assert np.allclose(network.logits(scanned.codes, scanned.place(scanned.starts), sizes), want, atol=1e-4)
    spans = scanned.judged(network)
    assert all(0 <= p <= 1 for x in spans for *_, p in x)


def test_secret_network_finds_short_passwords(spark):
    rng = np.random.default_rng(8)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    data = [(i, f'text token = "{pick("0123456789abcdef", 40)}" more') for i in range(150)]
    data += [(1000 + i, " ".join(pick("aeioustrn", rng.integers(3, 13)) for _ in range(20))) for i in range(300)]
    data += [(5000, "please use pwd: Zx9!kQ2m for it"), (5001, "login passwort=Geheim24 now"),
             (5002, "cred = XbTrKqWvZpLmNdFg")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(df).collect()}
    assert masked[5000] == "please use pwd: <secret> for it"
    assert "Geheim24" not in masked[5001] and "XbTrKqWvZpLmNdFg" not in masked[5002]
    assert sum("<secret>" in masked[1000 + i] for i in range(300)) <= 15


def test_secret_threshold_keeps_the_recall(monkeypatch, spark):
    rng = np.random.default_rng(2)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    # secrets that look like ordinary words
    data = [(i, f"{pick('abcdefgh', 9)} secret {pick('abcdefgh', 9)} secret = {pick('abcdefgh', 9)}") for i in range(200)]
    monkeypatch.setattr(secrets, "disguised", lambda v, n, *a: ("\0" * 24 + v[24:24 + n].ljust(48, "\0"), n))
    df = spark.createDataFrame(data, "doc_id long, text string")
    network = secrets.trained(secrets.scan(df))
    assert network.recall >= 0.98
    found = secrets.judged(df, network).collect()
    assert any(s["probability"] < 1 for r in found for s in r["spans"] if s["kind"] < 3)


# 6
def brute_shards(rows, count):
    by = defaultdict(list)
    for r in rows:
        h = hashlib.md5(f"{sharding.SEED}:{'-' if r[0] is None else r[0]}".encode()).hexdigest()
        t = (r[1] or "").encode()
        by[r[3] or "", r[3] is None].append((h, r[0] if r[0] is not None else -10**9, zlib.crc32(t), len(t) + 8, r[0]))
    line = []
    for source, x in by.items():
        for k, y in enumerate(sorted(x, key=lambda v: v[:4])):
            line.append(((2 * k + 1) / (2 * len(x)), *source, *y))
    line.sort(key=lambda v: v[:7])
    n, out = len(line), []
    for at, x in enumerate(line):
        shard = at * count // n
        out.append((x[7], x[6], x[5], x[1] if not x[2] else None, shard, at - -(-shard * n // count)))
    return out


@pytest.mark.parametrize("bucket", [1000, 10])
def test_sharding(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    got = sharding.shards(docs, 7)
    same(got, brute_shards(rows, 7))
    by = defaultdict(Counter)
    for r in got.collect():
        by[r["shard"]][r["source"]] += 1
    sizes = [sum(c.values()) for c in by.values()]
    assert max(sizes) - min(sizes) <= 1
    total = Counter(r[3] for r in rows)
    for c in by.values():
        for s in total:
            assert abs(c[s] - total[s] / 7) <= len(total)


# 7
def brute_lines(rows):
    where, last = defaultdict(set), {}
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    for d, t in rows:
        for x in t.split("\n"):
            where[key(x)].add(d)
    for k, ds in where.items():
        if len(k) >= 20 and len(ds) >= 3:
            last[k] = max(ds, key=lambda d: (d is not None, d or 0))
    out = []
    for d, t in rows:
        x = t.split("\n")
        kept = [y for y in x if key(y) not in last or last[key(y)] == d]
        out.append((d, len(x), len(x) - len(kept), sha("\n".join(kept))))
    return out


@pytest.mark.parametrize("heavy", [1000, 1])
def test_lines(docs, rows, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    same(lines.digests(lines.dedup(docs)), brute_lines(plain(rows)))


def test_lines_runs_without_python(docs):
    def plan(df):
        mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        return df._jdf.queryExecution().explainString(mode)
    assert not re.search("Python|Pandas|Arrow", plan(lines.dedup(docs)))
    assert not re.search("Python|Pandas|Arrow", plan(sharding.shards(docs)))


# 8
def brute_exact(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[t.translate(LOWER)].append(d)
    out = []
    for d, t in rows:
        ds = by[t.translate(LOWER)]
        keep = max((x for x in ds if x is not None), default=None)
        out.append((d, keep, len(ds), d == keep, sha(t.translate(LOWER))))
    return out


@pytest.mark.parametrize("budget", [exact.BUDGET, 20_000, 1])
def test_exact(docs, rows, budget):
    same(exact.groups(docs, budget=budget), brute_exact(plain(rows)))


def test_exact_dedup_keeps_columns(docs, rows):
    got = exact.dedup(docs)
    assert got.columns == docs.columns
    want = {(d, t.translate(LOWER)) for (d, t), w in zip(plain(rows), brute_exact(plain(rows))) if w[3]}
    kept = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in got.collect()]
    assert len(kept) == len(want) and set(kept) == want


def test_trie():
    rng = np.random.default_rng(6)
    trie, want = exact.Trie(4000), {}
    out = defaultdict(lambda: [None, None, 0])
    seen = []
    for i in range(3000):
        k = bytes(rng.choice(list(b"ab"), rng.integers(0, 12)).tolist())
        want.setdefault(k, []).append(i)
        trie.add(k, i, i, 1)
        seen += list(trie.spill())
    for k, (a, z, n) in seen + list(trie.drain()):
        e = out[k]
        out[k] = [a if e[0] is None else min(a, e[0]), max(z, e[1] or 0), n + e[2]]
    assert {k: tuple(v) for k, v in out.items()} == {k: (min(v), max(v), len(v)) for k, v in want.items()}


# 9
@pytest.mark.parametrize("size", [16 << 20, 4000])
def test_merkle(docs, rows, monkeypatch, size):
    monkeypatch.setattr(merkle, "RANGE_BYTES", size)
    got = merkle.against_edits(docs).collect()
    prints = {}
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["n_chars"], r["edited_sha256"]))
    line = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    texts = defaultdict(list)
    for d, t in plain(rows):
        texts[d].append(t)
    assert len(got) == len(rows)
    for d, after in zip(line, line[1:]):
        if len(texts[d]) == len(texts[after]) == 1:
            t, n = texts[d][0], len(texts[d][0]) // 3
            assert by_id[d] == {(len(t), sha(t[:len(t) - n] + texts[after][0][:n]))}
    for r in got:
        if len(texts[r["doc_id"]]) == 1:
            t = texts[r["doc_id"]][0]
            assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    assert str(merkle.Tree.parse(got[0]["fingerprint"])) == got[0]["fingerprint"]
    near = [r["near_edited"] for r in got if r["n_chars"] > 60]
    assert np.mean(near) > 0.5
    assert {r["fingerprint"] for r in merkle.fingerprints(docs).collect()} == {r["fingerprint"] for r in got}


def test_merkle_differences():
    text = "\n".join(f"paragraph {i} with some words" for i in range(20))
    a, b = merkle.Tree(text), merkle.Tree(text.replace("paragraph 7", "paragraph x"))
    assert 0.9 < merkle.likeness(a, b) < 1 and len(merkle.differences(a, b)) == 1
    assert merkle.likeness(a, merkle.Tree(text)) == 1
    assert merkle.likeness(merkle.Tree(""), merkle.Tree("x")) == 0
    # lines that move between paragraphs and sections change the root
    assert merkle.Tree("a\nb").root != merkle.Tree("a\n\nb").root != merkle.Tree("a\n\n\nb").root


# 10
def test_quality(docs, rows, labels):
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (400, 401)}) == 1
    keep = quality.accepted(docs, model)
    assert keep.columns == docs.columns
    assert Counter(r["doc_id"] for r in keep.collect()) == Counter(r["doc_id"] for r in got if r["score"] >= 0.3)


def test_chain_against_enumeration():
    rng = np.random.default_rng(9)
    chain = quality.Chain(rng.normal(size=4), rng.normal(size=(2, 2)))
    firsts = np.array([0, 3, 4, 9])
    x = rng.normal(size=(9, 4))
    total, line, pair, at = chain.run(x, firsts)
    emit = np.column_stack((np.zeros(9), x @ chain.weights))
    import itertools
    for a, z, log_z in zip(firsts, firsts[1:], total):
        weight = {}
        for y in itertools.product((0, 1), repeat=z - a):
            weight[y] = np.exp(sum(emit[a + i, s] for i, s in enumerate(y)) + sum(chain.moves[s, t] for s, t in zip(y, y[1:])))
        z_all = sum(weight.values())
        assert np.isclose(log_z, np.log(z_all))
        for i in range(z - a):
            assert np.isclose(line[a + i, 1], sum(w for y, w in weight.items() if y[i]) / z_all)
    assert np.allclose(pair.sum((1, 2)), 1)


def test_quality_held_out_accuracy(spark):
    from pathlib import Path
    from pyspark.sql import functions as F
    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("sample tables are not there")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    rows = scored.collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) > 0.95


def test_quality_fits_whole_rows(monkeypatch, spark):
    docs = spark.createDataFrame([(i, "\n".join(["Fine words here."] * 600 + ["!!! ###"] * (i % 2))) for i in range(12)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Chain, "fit", lambda self, x, firsts, good: seen.append(np.diff(firsts)))
    quality.train(docs, labels)
    assert set(seen[0]) == {600, 601}
    monkeypatch.setattr(quality, "FIT_LINES", 2500)
    quality.train(docs, labels)
    assert set(seen[1]) <= {600, 601} and seen[1].sum() <= 2500


def test_line_features_do_not_see_neighbouring_texts():
    import pyarrow as pa
    texts = ["One two three.\nfour", "", "Zzz\n\nyy yy yy", "é" * 10]
    own, size, firsts = quality.line_features(pa.array(texts))
    assert np.diff(firsts).tolist() == [2, 1, 3, 1]
    for k, t in enumerate(texts):
        alone, one_size, _ = quality.line_features(pa.array([t]))
        assert np.allclose(own[firsts[k]:firsts[k + 1]], alone)
        assert size[firsts[k]:firsts[k + 1]].tolist() == one_size.tolist()


# all
def test_empty_table(empty, labels):
    path, vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    for df in (bpe.digests(empty, path), suffix.removals(empty), minhash.near_duplicates(empty), minhash.dedup(empty),
               packing.pack_digests(empty, vocabulary), secrets.find(empty), secrets.masked(empty), sharding.shards(empty),
               lines.dedup(empty), exact.groups(empty), exact.dedup(empty), merkle.against_edits(empty),
               quality.scored(empty, quality.train(empty, labels))):
        assert df.collect() == []


def test_pipeline(spark, docs, labels, rows, tmp_path):
    import corpus_pipeline
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def pairs(df):
        return Counter((r["doc_id"], r["text"]) for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "exact", "near", "secrets", "pack"]
    good = stage["quality"](spark, docs, str(tmp_path))
    scores = {(r["doc_id"], r["score"]) for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, s in scores if s >= quality.MIN_SCORE}
    # the same rows by brute force, one stage after the other
    before = plain(list(pairs(good).elements()))
    kept = {(d, t.translate(LOWER)) for (d, t), w in zip(before, brute_exact(before)) if w[3]}
    single = stage["exact"](spark, good, str(tmp_path))
    assert Counter((d, (t or "").translate(LOWER)) for d, t in pairs(single).elements()) == Counter(kept)
    before = plain(list(pairs(single).elements()))
    apart = stage["near"](spark, single, str(tmp_path))
    want = Counter(x for x, w in zip(before, brute_near(before)) if w[3])
    assert Counter((d, t or "") for d, t in pairs(apart).elements()) == want
    clean = stage["secrets"](spark, apart, str(tmp_path))
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in want.elements())
    assert not any(brute_base(r["text"] or "") for r in clean.collect())
    for step in (good, single, apart, clean):
        assert step.columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in clean.collect())


def test_quality_stage_batches(spark, tmp_path, monkeypatch):
    """Written by the caller, the stage still sends Python no more than 8 MB and scores 512 KB at once."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    class Spy:
        def score(self, column):
            size = sum(len(x) for x in column.to_pylist())
            return np.full(len(column), float(column.buffers()[2].size <= 9 << 20 and size <= 512 << 10))
    monkeypatch.setattr(quality, "train", lambda docs, labels: Spy())
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == 4000
    finally:
        spark.conf.unset(key)
