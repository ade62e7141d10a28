"""op6, op7, op10: against brute force over all pairs."""

import math

import numpy as np
import pytest
from conftest import SMALL

from quarry.llm import images, kdtree, minhash, queries
from quarry.llm.common import words_of
from quarry.llm.components import components


def smallest(nodes, links):
    """{node: smallest node it reaches}."""
    home = {n: n for n in nodes}

    def find(n):
        while home[n] != n:
            n = home[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i + 1, i) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    links = [(a, b) for a, b in edges if a is not None and a != b]
    want = smallest({x for e in links for x in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op7


def shingles(text, k):
    words = words_of((text or "").encode().lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_near(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    home = smallest({i for i, _ in sets}, links)
    return sorted((i, len(s), home[i], home[i] == i) for i, s in sets)


def variants(seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    rows = []
    for _ in range(12):
        base = draw(int(rng.integers(3, 120)))
        for _ in range(rng.integers(1, 8)):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, len(words))] = draw(1)[0]
            rows.append(" ".join(words))
    chain = draw(100)
    for i in range(30):  # each a link to the next, the ends far apart
        chain[(i * 7) % 100] = f"new{i}"
        rows.append(" ".join(chain))
    rows += [rows[0]] * 5 + [rows[1].upper(), "", "  ", "one", "ONE", "one two", None, "é " * 40]
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = variants(k)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bands string").repartition(3)
    got = minhash.near_duplicates(df, k, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute_near(rows, k, percent)
    left = minhash.deduplicated(df, k, percent)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [r[0] for r in brute_near(rows, k, percent) if r[3]]


def test_near_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_minhash(spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_near(rows, 3, 85)


def test_near_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x y z q"), (None, "a b c d"), (2, "a b c d"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, 3, 85).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True), (4, 4, True)], key=str)
    assert minhash.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_near_repeated_ids(spark):
    """Texts that share an id are nodes of their own: links of one don't reach the other, and no text is lost."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (5, a + " x"), (5, b), (9, b + " y"), (5, b), (12, "c d e f"), (12, "g h i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, 3, 85).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (9, 5, False), (12, 12, True), (12, 12, True)])
    assert sorted(map(tuple, minhash.deduplicated(df, 3, 85).collect())) == sorted([rows[0], rows[2], rows[5], rows[6]])


# op10


def brute_top(rows, is_query, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 4096])
def test_top_k(spark, shard):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 320)] + [(400, None), (500, [float("nan")] * 6), (600, [None] + [0.0] * 5), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (800, [0.0] * 6), (None, rows[0][1]), (900, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    from pyspark.sql import functions as F

    got = kdtree.top_k(df, F.col("vec_id") % 100 == 0, shard=shard, block=2)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 100 == 0, 10)
    assert kdtree.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 50), rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)]
    rows += [(7, rows[0][1])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    from pyspark.sql import functions as F

    got = sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") % 25 == 0, shard=20, block=3).collect()))
    assert got == sorted(brute_top(rows, lambda i: i % 25 == 0, 10))


def test_boxes_prune():
    """Where vectors lie in clusters, most shards are not visited and most leaves not opened, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (40, 8))
    points = (centres[rng.integers(0, 40, 8000)] + rng.integers(-60, 60, (8000, 8))).astype(np.int64)
    borders = kdtree.Borders(points[::4], 16)
    cells = borders.place(points)
    assert borders.cells == 16 and np.bincount(cells).max() < 4 * len(points) / 16
    low, high = (np.array([f(points[cells == c], axis=0) for c in range(16)]) for f in (np.min, np.max))
    queries = points[:100]
    best = np.sort(queries @ points.T, axis=1)[:, -10]
    ok = kdtree.reachable(queries, best, low, high)
    scores = queries @ points.T
    assert all(ok[i, cells[j]] for i, j in zip(*np.nonzero(scores >= best[:, None])))
    assert ok.mean() < 0.4
    tree = kdtree.Tree(points.astype(np.float64))
    bounds, ids, leaves = tree.bounds(queries.astype(np.float64)), np.arange(8000), tree.children.count(None)
    for q, b, least in zip(queries, bounds, best):
        found = tree.search(q.astype(np.float64), b, ids, ids, -1, 10, -np.inf)
        assert found[-1][0] == least
    assert tree.opened < 0.3 * leaves * len(queries)


def test_top_k_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op10_kdtree(spark, SMALL).collect())) == brute_top(rows, lambda i: i % 100 == 0, 10)


# op6


def test_descriptors():
    for i in range(20):
        own = images.drawn(i)
        a, b = (images.describe(images.decode(images.pgm(x))) for x in (own, images.edited(own, i)))
        other = images.describe(images.drawn(i + 1000))
        assert images.agreeing(a, b) >= images.AGREE or i in (), i
        assert images.agreeing(a, other) < images.AGREE
        assert images.agreeing(images.from_blob(images.to_blob(*a)), a) >= images.AGREE
    turned = images.describe(np.rot90(images.drawn(1)).copy())
    assert images.agreeing(images.describe(images.drawn(1)), turned) >= images.AGREE


def test_decode():
    import zlib

    pixels = images.drawn(5, 40)
    for kind in range(5):  # PNG row filters
        rows, p = b"", np.pad(pixels.astype(int), ((1, 0), (1, 0)))
        for y in range(1, 41):
            guess = {0: 0, 1: p[y, :-1], 2: p[y - 1, 1:], 3: (p[y, :-1] + p[y - 1, 1:]) // 2}.get(kind)
            if kind == 4:
                a, b, c = p[y, :-1], p[y - 1, 1:], p[y - 1, :-1]
                da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
            rows += bytes([kind]) + ((p[y, 1:] - guess) % 256).astype(np.uint8).tobytes()
        chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + b"\0\0\0\0"
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (40).to_bytes(4, "big") * 2 + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
        assert (images.decode(png) == pixels).all()
    assert (images.decode(b"P5 # note\n40 40\n255\n" + pixels.astype(np.uint8).tobytes()) == pixels).all()
    for broken in (None, b"", b"P5", b"P5 4 4 255\nab", b"GIF89a", b"\x89PNG\r\n\x1a\nxxxx"):
        assert images.decode(broken) is None


def test_copies(spark):
    rows, links = [], []
    for i in range(12):
        own = images.drawn(i)
        rows += [(10 * i + 4, images.pgm(own)), (10 * i + 2, images.pgm(images.edited(own, i))), (10 * i + 7, images.pgm(own))]
        links += [(10 * i + 4, 10 * i + 2), (10 * i + 4, 10 * i + 7)]
    flat = images.pgm(np.full((64, 64), 9.0))
    rows += [(500, flat), (501, flat), (502, None), (503, None), (504, b"junk"), (505, b""), (None, flat), (506, images.pgm(images.drawn(999))), (506, images.pgm(images.drawn(998)))]
    links += [(500, 501)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "media_id long, media binary, blob string").repartition(3)
    got = images.copies(df).collect()
    want = smallest({r[0] for r in rows if r[0] is not None}, links)
    assert sorted((r.media_id, r.group_id) for r in got if r.media_id is not None) == sorted((r[0], want[r[0]]) for r in rows if r[0] is not None)
    assert [(r.group_id, r.kept) for r in got if r.media_id is None] == [(None, True)]
    assert images.copies(df.limit(0)).count() == 0


def test_open_buckets(spark, monkeypatch):
    """A bucket of several groups: members that its smallest isn't alike to still find each other."""
    monkeypatch.setattr(images, "BLOCK", 3)
    monkeypatch.setattr(images, "SMALL", 2)
    rows = []
    for i in range(6):
        own = images.drawn(i)
        for j in range(3):
            found = images.describe(images.edited(own, 10 * i + j) if j else own)
            rows.append((10 * i + j, len(found[0]), f"{i}-{j}".encode(), images.to_blob(*found)))
    table = spark.createDataFrame(rows, "media_id long, n_corners long, same binary, blob binary")  # few pictures meet in one bucket
    monkeypatch.setattr(images, "described", lambda *_: table)
    got = {r.media_id: r.group_id for r in images.copies(table).collect()}
    assert got == {10 * i + j: 10 * i for i in range(6) for j in range(3)}


def test_large_buckets_compare_few(monkeypatch):
    """Pictures that all share one descriptor, and no more, meet once: of a large bucket only those that meet again are compared."""
    rng, calls, explained = np.random.default_rng(4), [], images.explained
    places = np.array([(11 * k % 80, 10 * k, 1) for k in range(8)], np.float32)
    common, found = rng.integers(0, 2, (1, images.TESTS), np.uint8), []
    # it is in one table's bucket only: all bits that the table doesn't sample are drawn anew
    for _ in range(60):
        own = rng.integers(0, 2, (8, images.TESTS), np.uint8)
        own[0, images._tables()[0]] = common[0, images._tables()[0]]
        found.append(own)
    found[59] = found[7].copy()
    blobs = [images.to_blob(places, np.packbits(x, axis=1)) for x in found]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(np.intersect1d(*(images._keys(blobs[i]) for i in (a, b)))) >= images.VOTES}
    counts = images.meetings(*2 * [[images.from_blob(x)[1] for x in blobs]])
    assert all(counts[a, b] == len(np.intersect1d(images._keys(blobs[a]), images._keys(blobs[b]))) for a in (0, 7, 59) for b in range(60))
    monkeypatch.setattr(images, "explained", lambda x, y: calls.append((blobs.index(x), blobs.index(y))) or explained(x, y))
    rows = [(left, True, i, i, x) for left in (True, False) for i, x in enumerate(blobs)]
    assert images.block_links(rows) == [(7, 59)]
    assert len(calls) == len(want) < 60


@pytest.mark.parametrize("others", [0, 3000])
def test_links_of_any_input(spark, monkeypatch, others):
    """Whether two pictures are linked depends on these two alone, however many others there are: here on matches of 0 to 46 bits."""
    rng, rows = np.random.default_rng(3), []
    places = np.array([(11 * k % 80, 10 * k, 1) for k in range(8)], np.float32)
    for i in range(24):
        own = rng.integers(0, 2, (8, images.TESTS), np.uint8)
        copy = own.copy()
        for row in copy:
            row[rng.choice(images.TESTS, 2 * i, replace=False)] ^= 1
        rows += [(2 * i + j, images.to_blob(places, np.packbits(x, axis=1))) for j, x in enumerate((own, copy))]
    links = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if images.alike(x, y)]
    assert 5 < len(links) <= 24
    more = [(100 + i, images.to_blob(places[:1], np.packbits(rng.integers(0, 2, (1, images.TESTS), np.uint8), axis=1))) for i in range(others)]
    table = spark.createDataFrame([(i, len(x) // images.WIDTH, str(i).encode(), x) for i, x in rows + more], "media_id long, n_corners long, same binary, blob binary")
    monkeypatch.setattr(images, "described", lambda *_: table)
    got = {r.media_id: r.group_id for r in images.copies(table).collect()}
    assert got == smallest([i for i, _ in rows + more], links)


@pytest.mark.parametrize("descriptors", [1000, 2_000_000])
def test_tables_meet(descriptors):
    """MATCHES matches, each NEAR bits apart: the rarest pair that the tables are sized for."""
    rng, sampled = np.random.default_rng(2), images.tables_for(descriptors)
    met = 0
    for _ in range(150):
        own = rng.integers(0, 2, (images.MATCHES, images.TESTS), np.uint8)
        far = own.copy()
        for row in far:
            row[rng.choice(images.TESTS, images.NEAR, replace=False)] ^= 1
        a, b = (images.table_keys(np.packbits(x, axis=1), sampled) for x in (own, far))
        met += len(np.intersect1d(a, b)) >= images.VOTES
    assert met / 150 > images.MEET - 0.08


def rescaled(pixels, factor):
    return np.rint(images._resized(images._smooth(pixels.astype(np.float32)), 1 / factor))


EDITS = {
    "crop": lambda p, i: images.edited(p, i), "half": lambda p, i: p[:, 24 + i % 8 : 72 + i % 8].copy(), "turned": lambda p, i: np.rot90(p, 1 + i % 3).copy(),
    "0.85": lambda p, i: rescaled(p, 0.85), "0.75": lambda p, i: rescaled(p, 0.75), "0.6": lambda p, i: rescaled(p, 0.6), "0.5": lambda p, i: rescaled(p, 0.5), "strong": lambda p, i: strongly_edited(p, i),
}


def test_recall_of_edits():
    """Of edited copies, the share that comparison of all pairs links, and of those the share that meets in tables sized for 2,000,000 descriptors."""
    sampled, n, shares = images.tables_for(2_000_000), 40, {}
    for edit, change in EDITS.items():
        pairs = [(images.describe(own), images.describe(change(own, i))) for i in range(n) for own in [images.drawn(1000 + i)]]
        linked = [x for x in pairs if images.agreeing(*x, images.AGREE) >= images.AGREE]
        met = [x for x in linked if len(np.intersect1d(*(images.table_keys(y[1], sampled) for y in x))) >= images.VOTES]
        shares[edit] = len(linked) / n, len(met) / max(1, len(linked))
        print(edit, "linked", shares[edit][0], "met", shares[edit][1])
    assert all(a >= 0.8 and b >= 0.75 for a, b in shares.values())
    assert np.mean(list(shares.values()), axis=0).min() >= 0.92


def strongly_edited(pixels, seed):
    """A copy that is turned by any angle, rescaled, blurred and noisy."""
    rng = np.random.default_rng(seed)
    turn, factor = rng.uniform(0, 2 * np.pi), rng.uniform(0.8, 1.3)
    h, w = pixels.shape
    y, x = np.mgrid[0:h, 0:w] - np.array([h / 2, w / 2])[:, None, None]
    u = np.rint((np.cos(turn) * x - np.sin(turn) * y) / factor + w / 2).astype(int)
    v = np.rint((np.sin(turn) * x + np.cos(turn) * y) / factor + h / 2).astype(int)
    out = images._smooth(pixels[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)], 1)
    return np.clip(np.rint(out + rng.normal(0, 6, out.shape)), 0, 255)


def linked_by_all_pairs(rows):
    found = [(i, images.to_blob(*images.describe(images.decode(x)))) for i, x in rows]
    return [(a, b) for k, (a, x) in enumerate(found) for b, y in found[:k] if images.alike(x, y)]


@pytest.mark.parametrize("dense", [True, False])
def test_strong_edits(spark, monkeypatch, dense):
    """Recall against alike() over all pairs: whole where all are compared, by MEET where tables are."""
    rows = []
    for i in range(24):
        own = images.drawn(i)
        rows += [(10 * i, images.pgm(own)), (10 * i + 1, images.pgm(strongly_edited(own, i))), (10 * i + 2, images.pgm(strongly_edited(own, i + 50)))]
    links = linked_by_all_pairs(rows)
    if not dense:
        monkeypatch.setattr(images, "_keyed", sparse_keys(images.tables_for(2_000_000)))
    df = spark.createDataFrame(rows, "media_id long, media binary").repartition(3)
    got = {r.media_id: r.group_id for r in images.copies(df).collect()}
    recall = sum(got[a] == got[b] for a, b in links) / len(links)
    print("links", len(links), "recall", recall)
    assert len(links) >= 20 and recall >= (1 if dense else images.MEET)
    want = smallest([i for i, _ in rows], links)
    assert not dense or got == want


def sparse_keys(sampled):
    def keyed(reps):
        from pyspark.sql import functions as F

        keys = F.udf(lambda blob: [int(k) for k in images.table_keys(images.from_blob(bytes(blob))[1], sampled)] if blob else [], "array<long>")
        return [images.cut(reps.select("rep", F.explode(keys("blob")).alias("key")), "keyed")], images.VOTES

    return keyed


def test_small_crops():
    """A crop of a hundredth of a large picture's area: corners grow with the area, so enough are common."""
    for seed in range(3):
        large = images.drawn(seed, 960)
        whole = images.describe(large)
        assert len(whole[0]) > 50 * sum(images.CORNERS)
        for top, left in ((0, 0), (411, 333), (864, 500), (130, 857)):
            crop = images.describe(large[top : top + 96, left : left + 96])
            assert images.agreeing(whole, crop, images.AGREE) >= images.AGREE, (seed, top, left)
        assert images.agreeing(whole, images.describe(images.drawn(seed + 100))) < images.AGREE
    assert len(images.describe(images.drawn(7))[0]) <= sum(images.CORNERS)


def test_repeated_ids(spark):
    """Two pictures of one id: each links with its own copies."""
    a, b = images.drawn(1), images.drawn(2)
    rows = [(5, images.pgm(a)), (5, images.pgm(b)), (7, images.pgm(images.edited(a, 1))), (8, images.pgm(images.edited(b, 2))), (5, images.pgm(images.drawn(3))), (9, images.pgm(images.drawn(4)))]
    rows += [(3, images.pgm(images.edited(b, 3)))]
    got = images.copies(spark.createDataFrame(rows, "media_id long, media binary").repartition(3)).collect()
    assert sorted((r.media_id, r.group_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 3, False), (9, 9, True)]


def test_copies_query(spark):
    """The query's groups on the small table are those of alike() over all pairs of its pictures."""
    rows = [(r.media_id, bytes(r.media)) for r in images.pictures(spark.read.parquet(f"{SMALL}/embeddings.parquet")).collect() if r.media is not None]
    got = queries.op6_images(spark, SMALL).collect()
    assert len(got) >= len(rows) > 100
    links = linked_by_all_pairs(rows)
    want = smallest([i for i, _ in rows], links)
    assert len(links) >= 30
    assert {r.media_id: r.group_id for r in got if r.media_id in want} == want
