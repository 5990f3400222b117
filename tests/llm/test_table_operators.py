import base64
import hashlib
import io
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadtide.llm import blocks, bloom, chroma, common, lattice, minhash, warc
from quadtide.llm.components import components


# --- components and helpers --------------------------------------------------------------------------------

def brute_components(nodes, edges):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(k, (k * 7) % 31) for k in range(31)], [(5, 5)], [], [(1, 2), (1, 2), (2, 1), (8, 9)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["comp"] for r in components(df).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({x for e in real for x in e}, real)


def test_group_min_with_a_hot_key(spark):
    rows = [(1 if k % 3 else k, k) for k in range(2000)] + [(None, 5), (None, None)]
    df = spark.createDataFrame(rows, "key long, v long")
    least = {}
    for k, v in rows:
        if k is not None:
            least[k] = min(v, least.get(k, v))
    got = common.attach_group_min(df, ["key"], "v", "m").collect()
    assert len(got) == len(rows) and all(r["m"] == (least[r["key"]] if r["key"] is not None else None) for r in got)


def test_blocks_meet_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    sizes = {1: 40, 2: 1, 3: 8}
    df = spark.createDataFrame([(k, n, i) for k, n in sizes.items() for i in range(n)], "key long, n long, id long")

    def each(left, right, same):
        a, b = np.asarray(left["id"]), np.asarray(right["id"])
        i, j = np.meshgrid(a, b, indexing="ij")
        keep = i < j if same else np.ones_like(i, bool)
        yield np.full(keep.sum(), left["key"][0]), np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])

    got = Counter(tuple(r) for r in blocks.blocked(df, "key", "n", "id", each, "key long, a long, b long").collect())
    assert got == Counter({(k, a, b): 1 for k, n in sizes.items() for a in range(n) for b in range(a + 1, n)})


# --- MinHash ------------------------------------------------------------------------------------------------

def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_near(rows, width, percent):
    """component and set size of each row; rows that share an id are one node."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    real = [(i, s) for i, s in sets if s and i is not None]
    edges = [(a, b) for k, (a, s) in enumerate(real) for b, t in real[k + 1:] if 100 * len(s & t) >= percent * len(s | t)]
    comp = brute_components({i for i, _ in sets if i is not None}, edges)
    return [(i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets]


def variants(rng, base, n, share):
    for _ in range(n):
        w = base.split(" ")
        for _ in range(int(len(w) * share)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        yield " ".join(w)


def check(spark, rows, width=4, percent=80):
    df = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], "doc_id long, text string, rep long, n long, sig string, component_id string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, width, percent).collect()), key=str)
    assert got == sorted(brute_near(rows, width, percent), key=str)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, texts = make(50), []
    for _ in range(12):
        texts += list(variants(rng, make(rng.randrange(40, 300)), rng.randrange(1, 12), rng.choice((0.01, 0.03, 0.06, 0.1))))
    texts += [passage + " " + make(rng.randrange(10, 90)) for _ in range(40)]
    texts += list(variants(rng, make(120), 120, 0.05))  # a group whose members link with some of the others only
    texts += [None, "", " \n\t", "One two", "one TWO", "one two three", "one\ttwo\vthree", "two one three", "é É", "é é", "a" * 9000, "b " * 9000, "b " * 4000]
    texts += [texts[5]] * 40
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("whole, block, rows, size", [(5, 20, 100, 1 << 20), (2048, 7, 30, 4000), (3, 2048, 4096, 3000)])
def test_small_blocks_change_nothing(spark, monkeypatch, whole, block, rows, size):
    """Buckets by (A_i, B_j), hubs in many blocks and lots of few bytes give the same components, and no
    task group has more than two blocks, or one lot."""
    for name, value in (("WHOLE", whole), ("HUB_BLOCK", block), ("LOT_ROWS", rows), ("HUB_BYTES", size), ("LOT_BYTES", size), ("POOLED", 6)):
        monkeypatch.setattr(minhash, name, value)
    groups, dealt = [], minhash._dealt

    def watched(part, sets):
        out = dealt(part, sets)
        groups.extend(tuple(r) for r in out.groupBy("lot", "lot_i", "lot_j").agg(F.count(F.lit(1)), F.countDistinct("hub", "pool")).collect())
        return out

    monkeypatch.setattr(minhash, "_dealt", watched)
    rng = random.Random(17)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = list(variants(rng, make(120), 150, 0.05)) + list(variants(rng, make(60), 40, 0.08))
    passage = make(60)
    texts += [passage + " " + make(rng.randrange(8, 60)) for _ in range(60)]
    check(spark, list(enumerate(texts)))
    assert len(groups) > 10
    if size > 4000:
        assert max(g[3] for g in groups) <= 4 * max(block, rows)  # blocks and lots are dealt by a hash
        assert all(g[4] == 1 and g[3] <= 4 * block for g in groups if g[1] >= 0)


def test_near_duplicate_edges(spark):
    check(spark, [])
    check(spark, [(5, None)])
    check(spark, [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (9, "q w e r t"), (9, "a b c d e"), (7, "q w e r t"), (None, "a b c d e"), (None, None), (-4, "q w e r t y")], width=3)


def test_tables_meet_similar_pairs():
    """A pair at 0.8 meets in some table about as often as the formula says."""
    rng, met, n = np.random.default_rng(3), 0, 400
    for _ in range(n):
        common_part = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.concatenate([common_part, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for _ in range(2))
        equal = (minhash.minhashes(a) == minhash.minhashes(b)).reshape(2, minhash.M, minhash.K).all(2)
        met += equal[0].any() and equal[1].any()
    assert met / n > 0.99


def test_shingles_are_of_the_whole_text():
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice("ab C\n\té") for _ in range(rng.randrange(0, 200)))
        for width in (1, 4, 5):
            assert len(minhash.shingles(t, width)) == len(shingle_set(t, width))
    long = " ".join(str(k) for k in range(60_000))
    assert len(minhash.shingles(long, 5)) == 59_996


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words are here now", "x"), (3, "other words are here now", "x"), (None, "a b c d e f", "z"), (4, "", "q"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((tuple(r) for r in minhash.keep_one(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f", "x"), (3, "other words are here now", "x"), (None, "a b c d e f", "z"), (4, "", "q"), (5, None, None)], key=str)


def test_keep_one_of_repeated_ids(spark):
    """Different texts under one doc_id are documents of their own; wordless rows stay."""
    rows = [(3, "one two three four five six", "x"), (3, "quite another text stands under it", "x"), (3, None, "n"), (3, "", "e"), (3, " \t", "b"), (3, " \t", "b"), (2, "one two three four five six", "c"),
            (5, "quite another text stands under it", "d"), (7, "a b c d e f g", "z"), (7, "a b c d e f g", "y"), (8, "A b c d e f g", "q"), (None, "a b c d e f g", "m"), (None, "a b c d e f g", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _many string")
    got = sorted((tuple(r) for r in minhash.keep_one(df).collect()), key=str)
    want = [(3, "quite another text stands under it", "x"), (3, None, "n"), (3, "", "e"), (3, " \t", "b"), (3, " \t", "b"), (2, "one two three four five six", "c"), (7, "a b c d e f g", "y"), (None, "a b c d e f g", "m"), (None, "a b c d e f g", "m")]
    assert got == sorted(want, key=str)
    assert minhash.keep_one(df).columns == df.columns


# --- lattice -------------------------------------------------------------------------------------------------

def test_e8_decoding():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    own = lattice.nearest_e8(x)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)
    near = ((x[:, None] - (own[:, None] + lattice.ROOTS)) ** 2).sum(2).min(1)
    assert (((x - own) ** 2).sum(1) <= near + 1e-12).all() and ((x - own) ** 2).sum(1).max() <= 1 + 1e-12
    doubled = 2 * own
    assert (doubled == np.rint(doubled)).all() and ((doubled % 2).std(1) == 0).all() and (own.sum(1) % 2 == 0).all()


def brute_vectors(rows, least=0.98):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            ok.append((k, x / np.sqrt((x * x).sum()), label))
    links, edges = Counter(), []
    for n, (a, x, la) in enumerate(ok):
        for b, y, lb in ok[n + 1:]:
            if la == lb and len(x) == len(y) and x @ y >= least:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    comp = brute_components(range(len(rows)), edges)
    least_id = {}
    for k, (i, *_rest) in enumerate(rows):
        if i is not None:
            least_id[comp[k]] = min(i, least_id.get(comp[k], i))
    out = []
    for k, (i, *_rest) in enumerate(rows):
        c = least_id.get(comp[k]) if links[k] else i
        out.append((i, links[k], c, True if i is None or c is None else i == c))
    return out


def check_vectors(spark, rows):
    df = spark.createDataFrame([(i, v, la, 1) for i, v, la in rows], "vec_id long, embedding array<double>, label int, node int")
    got = sorted((tuple(r) for r in lattice.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute_vectors(rows), key=str)


@pytest.mark.parametrize("block", [2048, 5])
def test_vectors_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(15):
            centre = rng.normal(size=24)
            for _ in range(rng.integers(1, 7)):
                rows.append((len(rows), (centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2]) * np.sqrt(1)).tolist(), label))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(10)]  # equal vectors
    rows += [(1000 + k, rows[0][1], 1 - rows[0][2]) for k in range(2)]  # another label
    rows += [(2000, [2 * x for x in rows[3][1]], rows[3][2])]
    check_vectors(spark, rows)


def test_vector_edges(spark):
    check_vectors(spark, [])
    check_vectors(spark, [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [1.0], 0), (11, [3.0], 0), (12, [-1.0], 0), (None, [1.0, 0.001], 0), (13, [1e300, 0.0], 0), (14, [1e-300, 0.0], 0), (8, [0.0, 1.0], 0),
    ])


def test_lattice_recall():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    b, zero = 0.98 * a + np.sqrt(1 - 0.98**2) * g, np.zeros(2000)
    ca, cb = lattice.cells(a, zero), lattice.cells(b, zero)
    assert ((ca == cb[:, :, :1]).any((1, 2)) | (cb == ca[:, :, :1]).any((1, 2))).mean() > 0.999


# --- WARC ------------------------------------------------------------------------------------------------------

def brute_warc(rows, least):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        origin = first.get(body) if len(body) >= least else None
        origin = None if origin == i else origin
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if origin is None else "revisit", origin))
    return out


@pytest.mark.parametrize("least, few, bits", [(0, 500_000, 1 << 27), (3, 500_000, 1 << 27), (0, 0, 1 << 27), (3, 0, 8)])
def test_warc(spark, least, few, bits, monkeypatch):
    """By broadcast keys, by a Bloom filter, and with more revisits than the filter is good for."""
    monkeypatch.setattr(warc, "BROADCAST_KEYS", few)
    monkeypatch.setattr(bloom, "BITS", bits)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 2000)
    monkeypatch.setattr(warc, "READ_BYTES", 700)
    rows = [(k, f"http://h/{k}?q=é \r\nX: y", ["<p>ü</p>" * (k % 5), None, "same", "x", ""][k % 5]) for k in range(60)]
    rows += [(None, None, "same"), (None, "u", "never elsewhere"), (8, "again", "same"), (3, "u", "\r\n\r\nHTTP/1.1\r\n\r\n"), (2, "twice", "same"), (2, "twice", "same"), (99, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, sha1 string, origin int").repartition(3)
    got = sorted((tuple(r) for r in warc.write_and_read(df, least).collect()), key=str)
    assert got == sorted(brute_warc(rows, least), key=str)


def test_bloom_filter(spark):
    ids = spark.range(0, 3000, 3)
    table = bloom.build(ids, 1000)
    there = bloom.holds(table, np.arange(30_000, dtype=np.int64))
    assert there[0:3000:3].all() and there.sum() < 1000 + 300
    assert not bloom.holds(bloom.build(ids.limit(0), 0), np.arange(10)).any()


def test_warc_payloads_stay_where_they_are(spark):
    """The keys of revisits are broadcast; no join shuffles payloads."""
    df = spark.createDataFrame([(1, "u", "a" * 50), (2, "u", "a" * 50), (3, "u", "b")], "page_id long, url string, html string").repartition(3)
    seen, materialize = [], warc.materialize

    def watched(table, label):
        if label == "warc-manifest":
            seen.append(table._jdf.queryExecution().executedPlan().toString())
        return materialize(table, label)

    try:
        warc.materialize = watched
        warc.write(df, common.scratch(spark, "warc-test"))
    finally:
        warc.materialize = materialize
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]


def test_warc_content_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/ b", "<p>é</p>"), (2, None, None), (3, "http://c", "<p>é</p>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.read(warc.write(df, f"file://{tmp_path}/w"), content=True).collect()}
    assert bytes(rows[1]["payload"]) == "<p>é</p>".encode() and rows[1]["url"] == "http://a/%20b" and rows[3]["payload"] is None and rows[3]["refers_to"] == 1
    assert bytes(rows[2]["payload"]) == b"" and rows[2]["url"].startswith("urn:uuid:")
    assert warc.write_and_read(df.limit(0)).count() == 0
    (package, *_rest) = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".wacz"]
    with zipfile.ZipFile(package) as z:  # other readers agree
        assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX}


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    out = io.BytesIO()
    w = warc.ZipWriter(out, zip64)
    w.member("a/one", [b"hello ", b"world"])
    w.member("é", [b""])
    w.member("big", [bytes(range(256)) * 50])
    w.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a/one") == b"hello world"
    p = warc.ZipPackage(io.BytesIO(out.getvalue()))
    assert p.read("a/one", 6, 99) == b"world" and p.read("é") == b"" and p.read("big", 256, 3) == b"\0\1\2"


def test_zip_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", "abc" * 100)
        z.writestr("packed", "abc" * 100, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("large"), "w", force_zip64=True) as f:
            f.write(b"12345")
        z.comment = b"PK\5\6 a comment that looks like the end"
    p = warc.ZipPackage(io.BytesIO(out.getvalue()))
    assert p.read("stored", 3, 3) == b"abc" and p.read("large") == b"12345"
    with pytest.raises(ValueError):
        p.read("packed")
    for broken in (b"", b"PK\3\4 nothing", out.getvalue()[:-60]):
        with pytest.raises(ValueError):
            warc.ZipPackage(io.BytesIO(broken))


# --- audio -------------------------------------------------------------------------------------------------------

def test_alignment_of_excerpts_and_noise():
    rng = np.random.default_rng(0)
    tune = chroma.melody(rng.normal(size=64))
    whole = chroma.fingerprint(tune)
    assert chroma.align(whole, whole) == (0, len(whole), 0)
    part = chroma.fingerprint(tune[chroma.HOP * 20:])
    assert chroma.align(part, whole)[0] == 20 and chroma.accepts(part, whole, chroma.align(part, whole))
    noisy = chroma.fingerprint(tune + rng.normal(size=len(tune)) * 0.01)
    assert chroma.accepts(noisy, whole, chroma.align(noisy, whole))
    other = chroma.fingerprint(chroma.melody(rng.normal(size=64)))
    found = chroma.align(other, whole)
    assert not chroma.accepts(other, whole, found)


def test_integral_image_equals_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(size=chroma.FRAME + chroma.HOP * 30)
    image, prints = chroma.chroma(x), chroma.fingerprint(x)
    assert len(prints) == len(image) - chroma.WINDOW + 1
    w, cuts = chroma.WINDOW, chroma.cuts()
    for t in (0, 3, len(prints) - 1):
        bits = 0
        for k, (kind, y, h) in enumerate(chroma.FILTERS):
            box = lambda t0, n, y0, m: sum(image[t + t0: t + t0 + n, c % 12].sum() for c in range(y0, y0 + m))
            whole = box(0, w, y, h)
            plus = {0: lambda: box(w // 2, w - w // 2, y, h), 1: lambda: box(0, w, y + h // 2, h - h // 2), 2: lambda: box(0, w // 2, y, h // 2) + box(w // 2, w - w // 2, y + h // 2, h - h // 2), 3: lambda: 2 * box(w // 3, w - 2 * (w // 3), y, h)}[kind]()
            if kind == 3:
                whole += plus / 2
            level = int(np.digitize(np.log((1 + plus) / (1 + max(whole - plus, 0))), cuts[:, k]))
            bits = bits << 2 | level ^ level >> 1
        assert int(prints[t]) == bits


def brute_align(a, b):
    """align() by a plain loop over all offsets."""
    best = None
    for offset in range(-len(a) + 1, len(b)):
        i0, i1 = max(0, -offset), min(len(a), len(b) - offset)
        x, y = a[i0:i1], b[i0 + offset: i1 + offset]
        equal = int(((x == y) & (x != chroma.SILENT)).sum())
        if equal:
            overlap = int(((x != chroma.SILENT) | (y != chroma.SILENT)).sum())
            errors = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(x, y))
            rank = (-equal, errors / overlap, offset)
            if best is None or rank < best[0]:
                best = (rank, (offset, overlap, errors))
    return best and best[1]


def test_unrelated_recordings_differ_and_noisy_ones_match():
    rng = np.random.default_rng(21)
    music = [chroma._made_up(rng, 6.0) for _ in range(60)]
    prints = [chroma.fingerprint(x) for x in music]
    rate = [np.bitwise_count(f ^ g).mean() / 32 for f in prints for g in prints if f is not g]
    assert np.mean(rate) > 0.45 and min(rate) > chroma.MOST_ERROR
    for x, f in zip(music, prints):
        noisy = chroma.fingerprint(chroma.decode_wav(chroma.encode_wav(x + rng.normal(0, 0.1 * x.std(), len(x)))))
        assert chroma.accepts(noisy, f, chroma.align(noisy, f))


def test_every_tied_offset_is_tried():
    """Ten offsets share one integer each; the ninth is the nearest otherwise."""
    rng = np.random.default_rng(9)
    key = rng.integers(1, 1 << 31, 10).astype(np.uint32)
    a = rng.integers(1, 1 << 31, 40).astype(np.uint32)
    a[0] = key[0]
    b = rng.integers(1, 1 << 31, 400).astype(np.uint32)
    for k in range(10):
        b[40 * k] = key[0]
    b[320: 360] = a ^ np.uint32(1)
    b[320] = key[0]
    assert chroma.align(a, b) == brute_align(a, b) == (320, 40, 39)
    assert chroma.accepts(a, b, chroma.align(a, b))


def test_silence_is_no_evidence(spark):
    """Unrelated recordings that begin with the same long silence don't meet; excerpts behind silence do."""
    rng = np.random.default_rng(10)
    quiet, tunes = np.zeros(8000), [chroma.melody(rng.normal(size=64)) for _ in range(3)]
    prints = [chroma.fingerprint(np.r_[quiet, t]) for t in tunes]
    assert (prints[0][:40] == chroma.SILENT).all() and chroma.sounding(prints[0]) < len(prints[0]) - 40
    assert not any(chroma.accepts(f, g, chroma.align(f, g)) for f in prints for g in prints if f is not g)
    late = chroma.fingerprint(np.r_[quiet, quiet, tunes[0]])
    assert chroma.align(prints[0], late) == brute_align(prints[0], late) and chroma.accepts(prints[0], late, chroma.align(prints[0], late))
    mute = chroma.fingerprint(quiet)
    assert len(mute) and chroma.sounding(mute) == 0 and chroma.align(mute, mute) is None
    assert chroma.align(mute, late) is None


def test_wav_forms():
    import wave

    assert len(chroma.decode_wav(None)) == len(chroma.decode_wav(b"")) == len(chroma.decode_wav(b"RIFF junk")) == 0
    x = 0.5 * np.sin(np.arange(8000) / 9)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(1), w.setframerate(8000)
        w.writeframes(np.repeat((x * 127 + 128).astype(np.uint8), 2).tobytes())
    assert len(chroma.decode_wav(out.getvalue())) == 4000
    assert np.abs(chroma.decode_wav(chroma.encode_wav(x)) - x).max() < 1e-3
    for width in (3, 4):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(width), w.setframerate(chroma.RATE)
            w.writeframes(b"".join(int(v * (2 ** (8 * width - 1) - 1)).to_bytes(width, "little", signed=True) for v in x))
        assert np.abs(chroma.decode_wav(out.getvalue()) - x).max() < 1e-6
    t = np.arange(44100) / 44100  # a tone over half of RATE must not fold back; one below it stays
    high, low = (chroma.decode_wav(chroma.encode_wav(0.5 * np.sin(2 * np.pi * f * t), 44100))[200:-200] for f in (3300, 440))
    assert np.abs(high).max() < 0.01 and 0.49 < np.abs(low).max() < 0.51
    assert len(chroma.fingerprint(x[:100])) == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(7)
    tunes = {}
    for k in range(12):
        base = rng.normal(size=64)
        for j in range(6):
            tunes[len(tunes)] = (base + rng.normal(size=64) * (0, 0, 0.03, 0.06, 0.1, 0.2)[j]).tolist()
    rows = [(i, chroma.encode_wav(chroma.melody(v))) for i, v in tunes.items()] + [(500, None), (501, b"junk"), (None, b""), (502, chroma.encode_wav(np.zeros(9000)))]
    media = spark.createDataFrame([(i, None if m is None else bytearray(m), 1) for i, m in rows], "rec_id long, media binary, digest int")
    classes, matches = chroma.search(chroma.fingerprints(media, "rec_id", "media"), "rec_id % 5 = 0")
    prints = {i: chroma.fingerprint(chroma.decode_wav(m)) for i, m in rows}
    first = {}
    for i in sorted(k for k in prints if k is not None):
        if len(prints[i]):
            first.setdefault(prints[i].tobytes(), i)
    owner = {i: first.get(f.tobytes(), i) if i is not None and len(f) else i for i, f in prints.items()}
    assert {r["rec_id"]: r["class_id"] for r in classes.collect()} == owner
    asked = {owner[i] for i, f in prints.items() if i is not None and i % 5 == 0 and len(f)}
    heads = {owner[i] for i, f in prints.items() if i is not None and len(f)}
    want = {(a, b): chroma.align(prints[a], prints[b]) for a in asked for b in heads if a != b}
    want = {k: v for k, v in want.items() if chroma.accepts(prints[k[0]], prints[k[1]], v)}
    got = {(r["class_id"], r["match_id"]): (r["offset"], r["overlap"], r["bit_errors"]) for r in matches.collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got) and len(got) >= 0.9 * len(want) and len(want) > 10
    out = {r["rec_id"]: r for r in chroma.summary(classes, matches).collect()}
    assert len(out) == len(rows) and out[500]["n_matches"] == 0
    for i in heads:
        mine = [(v[2] / v[1], a) for (a, b), v in got.items() if b == i]
        assert out[i]["n_matches"] == len(mine) and (not mine or out[i]["best_match"] == min(mine)[1])
    none = chroma.search(chroma.fingerprints(media.limit(0), "rec_id", "media"), "rec_id % 5 = 0")
    assert chroma.summary(*none).count() == 0


def test_a_fifth_of_differing_bits_is_still_a_match():
    a = np.arange(1, 101, dtype=np.uint32) * np.uint32(2654435761)
    b = a.copy()
    b[1:] ^= np.uint32(0b111111)  # 594 of 3,200 bits
    assert chroma.accepts(a, b, chroma.align(a, b))
    b[1:] ^= np.uint32(0b1000000)  # 693 of 3,200 bits
    assert not chroma.accepts(a, b, chroma.align(a, b))


def test_search_finds_every_match(spark):
    """Tunes of unrelated vectors and copies with noise: all that aligning all pairs accepts, up to MOST_ERROR."""
    rng = np.random.default_rng(3)
    tunes = [chroma.melody(rng.normal(size=64)) for _ in range(150)]
    tunes += [t + rng.normal(size=len(t)) * (0.05 if k % 5 == 0 else 0.17) for k, t in enumerate(tunes[:50])]
    prints = [chroma.fingerprint(t) for t in tunes]
    rows = spark.createDataFrame([(i, f.view(np.int32).tolist()) for i, f in enumerate(prints)], "rec_id long, fingerprint array<int>")
    got = {(r[0], r[1]): tuple(r)[2:] for r in chroma.search(rows, "rec_id % 2 = 0")[1].collect()}
    want = {(a, b): chroma.align(prints[a], prints[b]) for a in range(0, 200, 2) for b in range(200) if a != b}
    want = {k: v for k, v in want.items() if chroma.accepts(prints[k[0]], prints[k[1]], v)}
    assert all(brute_align(prints[a], prints[b]) == v for (a, b), v in want.items())
    assert got == want and sum(v[2] > 0.15 * 32 * v[1] for v in want.values()) > 20


def test_query_lists_every_match(spark, tmp_path):
    """Queries 0, 100 and 200 match each other, 1 and 101: the row of a recording can't hold them all."""
    from quadtide.llm import queries

    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    vectors = {k: (base + rng.normal(size=64) * 0.08).tolist() for k in (0, 100, 200, 1, 101)} | {7: rng.normal(size=64).tolist(), 8: None}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op10_chroma(spark, str(tmp_path)).collect()
    prints = {k: chroma.fingerprint(chroma.decode_wav(chroma.encode_wav(chroma.melody(v)))) for k, v in vectors.items() if v}
    owner = {k: min(j for j, g in prints.items() if g.tobytes() == f.tobytes()) for k, f in prints.items()} | {8: 8}
    assert {r["rec_id"]: r["class_id"] for r in rows if r["match_id"] is None} == owner
    want = {(a, b): chroma.align(prints[a], prints[b]) for a in {owner[k] for k in (0, 100, 200)} for b in set(owner.values()) - {8} if a != b}
    want = {(*k, *v) for k, v in want.items() if chroma.accepts(prints[k[0]], prints[k[1]], v)}
    listed = [(r["rec_id"], r["match_id"], r["offset"], r["overlap"], r["bit_errors"]) for r in rows if r["match_id"] is not None]
    assert len(listed) == len(want) == 12 and set(listed) == want


def test_short_excerpts_in_long_recordings(spark):
    """Exact excerpts of 8 to 24 windows, on both sides of WINDOW, are found in whole recordings, and whole ones by them."""
    rng = np.random.default_rng(6)
    whole = [chroma.fingerprint(chroma.melody(rng.normal(size=64))) for _ in range(10)]
    prints, inside = dict(enumerate(whole)), {}
    for n in (8, 12, 16, 17, 18, 20, 24):
        for k, f in enumerate(whole):
            at = int(rng.integers(0, len(f) - n))
            inside[len(prints)] = k
            prints[len(prints)] = f[at:at + n]
    rows = spark.createDataFrame([(i, f.view(np.int32).tolist()) for i, f in prints.items()], "rec_id long, fingerprint array<int>")
    got = {(r["class_id"], r["match_id"]) for r in chroma.search(rows, "rec_id >= 0")[1].collect()}
    want = {(a, b) for a in prints for b in prints if a != b and chroma.accepts(prints[a], prints[b], chroma.align(prints[a], prints[b]))}
    assert got == want and {(i, k) for i, k in inside.items()} | {(k, i) for i, k in inside.items()} <= got


def test_blocks_align_like_pairs():
    rng = np.random.default_rng(4)
    for _ in range(100):
        asked, others = ([rng.integers(0, 4, rng.integers(0, n)).astype(np.uint32) for _ in range(5)] for n in (12, 30))
        asked, others = ([np.where(f == 3, chroma.SILENT, f) for f in x] for x in (asked, others))
        want = {(x, y): brute_align(f, g) for x, f in enumerate(asked) for y, g in enumerate(others) if len(f) and len(g)}
        assert {(x, y): tuple(v) for x, y, *v in chroma.align_all(asked, others).tolist()} == {k: v for k, v in want.items() if v}


def test_recordings(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, []), (4, [None, 1.0])], "vec_id long, embedding array<double>")
    got = {r["rec_id"]: r["media"] for r in chroma.recordings(df).collect()}
    assert got[2] is None and len(chroma.decode_wav(bytes(got[1]))) == chroma.NOTES * chroma.NOTE_SAMPLES and len(chroma.decode_wav(bytes(got[3]))) == 0
    assert F is not None


def test_written_tables_have_no_checksum_files(spark):
    """Each is a chmod process, or more, of the writing JVM."""
    import os

    df = spark.range(1000).repartition(5)
    out = common.materialize(df, "plain")
    folder = out._quadtide_path.removeprefix("file://")
    names = os.listdir(folder)
    assert sum(n.startswith("part-") for n in names) == 5 and not [n for n in names if n.endswith(".crc")]
    assert out.agg(F.sum("id")).first()[0] == 499500
    common.discard(out)
    assert not os.path.exists(folder)
