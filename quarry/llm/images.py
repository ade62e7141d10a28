"""Edited copies of pictures, found by local descriptors.

Corners at seven scales, four to an octave, are described by binary tests that turn with the corner's
orientation. Descriptors that agree in all bits that a table samples meet in that table. Two
pictures are linked if they meet often enough and one similarity transform explains enough of
their descriptors' matches. The tables are the same for any input, so whether two pictures are
linked depends on these two alone.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import cut, discard, importable, mix, small_batches
from quarry.llm.components import components

#: Corners that are described of each cell of a picture, by scale from the finest; a cell's side in pixels at most; the scales' factor.
CORNERS, CELL, FACTOR = (20, 12, 8, 6, 12, 8, 6), 96, 2**0.25
#: Pixels from a corner to its patch's edge, tests of a descriptor, orientations that tests are turned to, and how often a patch is smoothed for them.
RADIUS, TESTS, TURNS, SOFT = 12, 256, 64, 7
#: Bits in which two descriptors may differ; pixels by which a match may miss; places at which a transform must explain matches, and a place's width.
APART, MISS, AGREE, PLACE = 48, 2.5, 6, 5
#: Least probability that two pictures with so many matches, each so many bits apart, meet in tables so many times; pictures of a block of one bucket.
MEET, MATCHES, NEAR, VOTES, BLOCK = 0.995, 10, 17, 2, 2048
#: Members of a bucket whose pairs are all counted; in larger ones all are compared with the first, then across components.
SMALL = 64
#: Sampled bits for each bit of the number of descriptors, as bits of a descriptor depend on each other; tables that are filled together.
SAMPLED, TOGETHER = 2.3, 5
#: Descriptors that the tables are sized for, whatever the input; tests that tables sample; entries that are sorted, and pairs that are made, in one go.
DESCRIPTORS, ACROSS, SORTED, MADE = 2**25, 192, 2**18, 2**18
#: Descriptors that are compared with others in one go; pictures whose meetings with a block's others are counted in one go.
ROWS, LEFTS = 256, 64


_PNM = re.compile(rb"P[56]" + rb"(?:\s+|#[^\n]*\n)+(\d+)" * 3 + rb"\s")


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM, or an 8-bit PNG that isn't interlaced; None for all else."""
    try:
        if media is None:
            return None
        if media[:2] in (b"P5", b"P6"):
            head = _PNM.match(media)
            if not head:
                return None
            (w, h, top), at = map(int, head.groups()), head.end() - 1
            depth = 1 if media[:2] == b"P5" else 3
            if top > 255 or w * h == 0:
                return None
            pixels = np.frombuffer(media, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
            return pixels.mean(axis=2, dtype=np.float32)
        if media[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(media)
    except (ValueError, IndexError, KeyError, zlib.error):
        pass
    return None


def _png(media: bytes) -> np.ndarray | None:
    at, data, shape = 8, [], None
    while at + 8 <= len(media):
        size, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(body[9])
            if body[8] != 8 or depth is None or body[12] or not w * h:
                return None
            shape = (h, w, depth)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    h, w, depth = shape or (0, 0, 0)
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h + 1, (w + 1) * depth), np.uint8)  # a row and a pixel of zeros before
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y]
        now = out[y + 1]
        if kind == 0:
            now[depth:] = line
        elif kind == 2:
            now[depth:] = line + up[depth:]
        elif kind == 1:
            now[depth:] = np.cumsum(line.reshape(w, depth), axis=0, dtype=np.uint8).reshape(-1)
        else:
            for x in range(depth, len(now)):
                a, b, c = int(now[x - depth]), int(up[x]), int(up[x - depth])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x] = (int(line[x - depth]) + guess) & 255
    pixels = out[1:, depth:].reshape(h, w, depth)
    return pixels[:, :, : 3 if depth >= 3 else 1].mean(axis=2, dtype=np.float32)


def _smooth(x: np.ndarray, times: int = 1) -> np.ndarray:
    """Weights 1, 2, 1 across and down, so many times; pixels beyond an edge are as those at it."""
    for _ in range(times):
        for axis in (0, 1):
            v = x if axis == 0 else x.T
            out = 2 * v
            out[1:] += v[:-1]
            out[:-1] += v[1:]
            out[0] += v[0]
            out[-1] += v[-1]
            out *= 0.25
            x = out if axis == 0 else out.T
    return x


def _resized(x: np.ndarray, factor: float) -> np.ndarray:
    """Smaller by factor, between pixels where need be."""
    h, w = int(x.shape[0] / factor), int(x.shape[1] / factor)
    r, c = np.arange(h) * factor, np.arange(w) * factor
    i, j = r.astype(int), c.astype(int)
    u, v = (r - i)[:, None].astype(np.float32), (c - j)[None, :].astype(np.float32)
    k, m = np.minimum(i + 1, x.shape[0] - 1), np.minimum(j + 1, x.shape[1] - 1)
    return (x[np.ix_(i, j)] * (1 - u) + x[np.ix_(k, j)] * u) * (1 - v) + (x[np.ix_(i, m)] * (1 - u) + x[np.ix_(k, m)] * u) * v


def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of a disc, and the pixel pairs of the tests for each orientation."""
    rng = np.random.default_rng(9)
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = x * x + y * y <= RADIUS * RADIUS
    points = np.clip(rng.normal(0, RADIUS / 1.4, (2, TESTS, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    turned = []
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        turned.append(np.rint(points @ turn).astype(int))
    return x[disc], y[disc], np.array([t[0] for t in turned]), np.array([t[1] for t in turned])


_DX, _DY, _FIRST, _SECOND = _patterns()


def _across() -> np.ndarray:
    """The tests whose two pixels lie most across the orientation: along it most patches grow brighter, so that these tests tell little."""
    x, y = np.abs(_FIRST[0] - _SECOND[0]).T
    return np.sort(np.argsort(x / np.maximum(np.hypot(x, y), 1e-9), kind="stable")[:ACROSS])


def corners(level: np.ndarray, most: int, cells: tuple[int, int] = (1, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, strength) of the strongest local maxima of the corner response, off the edges: most of each of the cells, down and across."""
    edge = RADIUS + 1
    if min(level.shape) <= 2 * edge:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    gx = np.zeros_like(level)
    gy = np.zeros_like(level)
    gx[:, 1:-1] = level[:, 2:] - level[:, :-2]
    gy[1:-1] = level[2:] - level[:-2]
    a, b, c = (_smooth(g, 2) for g in (gx * gx, gy * gy, gx * gy))
    response = a * b - c * c - 0.05 * (a + b) ** 2
    inner = response[edge:-edge, edge:-edge]
    high = np.ones(inner.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dx or dy:
                other = response[edge + dy : response.shape[0] - edge + dy, edge + dx : response.shape[1] - edge + dx]
                high &= inner > other if (dy, dx) < (0, 0) else inner >= other
    y, x = np.nonzero(high & (inner > 1.0))
    strength = inner[y, x]
    cell = (y + edge) * cells[0] // level.shape[0] * cells[1] + (x + edge) * cells[1] // level.shape[1]
    order = np.lexsort((x, y, -strength, cell))
    cell = cell[order]
    order = order[np.arange(len(cell)) - np.searchsorted(cell, cell) < most]
    return x[order] + edge, y[order] + edge, strength[order]


def describe(pixels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, bits): x and y in the picture with the scale, and the 256 tests of each corner."""
    if pixels is None:
        return np.empty((0, 3), np.float32), np.empty((0, TESTS // 8), np.uint8)
    places, bits, level, scale = [], [], pixels.astype(np.float32), 1.0
    cells = tuple(math.ceil(n / CELL) for n in pixels.shape)
    for most in CORNERS:
        smooth = _smooth(level, 2)
        x, y, _ = corners(smooth, most, cells)
        if len(x):
            patch = smooth[y[:, None] + _DY, x[:, None] + _DX]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2(patch @ _DY, patch @ _DX)
            turn = np.rint(angle * TURNS / (2 * np.pi)).astype(int) % TURNS
            p, q = _FIRST[turn], _SECOND[turn]
            soft = _smooth(smooth, SOFT)
            test = soft[y[:, None] + p[:, :, 1], x[:, None] + p[:, :, 0]] < soft[y[:, None] + q[:, :, 1], x[:, None] + q[:, :, 0]]
            places.append(np.stack([x * scale, y * scale, np.full(len(x), scale)], axis=1).astype(np.float32))
            bits.append(np.packbits(test, axis=1))
        scale *= FACTOR
        level = _resized(smooth, FACTOR)
        if min(level.shape) <= 2 * RADIUS + 2:
            break
    if not places:
        return np.empty((0, 3), np.float32), np.empty((0, TESTS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(bits)


#: Bytes of a described corner: its place and its tests.
WIDTH = 12 + TESTS // 8


def to_blob(places: np.ndarray, bits: np.ndarray) -> bytes:
    return np.concatenate([places.astype("<f4").view(np.uint8).reshape(len(places), 12), bits], axis=1).tobytes() if len(places) else b""


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, WIDTH)
    return raw[:, :12].copy().view("<f4"), raw[:, 12:]


def tables_for(descriptors: int) -> np.ndarray:
    """(tables, bits): the bits that each table samples, for so many descriptors in all.

    The sample grows with the logarithm of the descriptors, so that buckets stay small; the
    tables are as many as MEET asks for: a match NEAR bits apart meets in one table with the
    chance that none of the sampled bits is one of those, and VOTES of all must meet.
    """
    size = min(TESTS // 2, max(16, math.ceil(SAMPLED * math.log2(max(2, descriptors)))))
    one = math.comb(TESTS - NEAR, size) / math.comb(TESTS, size)
    fewer = lambda n: sum(math.comb(n, k) * one**k * (1 - one) ** (n - k) for k in range(VOTES))  # noqa: E731  that fewer than VOTES of n meet
    count = next(t for t in range(1, 10 * TESTS) if fewer(t * MATCHES) <= 1 - MEET)
    rng, tests = np.random.default_rng(17), _across()
    return np.array([rng.choice(tests, size, replace=False) for _ in range(count)])


def entries_of(bits: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """(tables, descriptors): the key of each descriptor in each table, a hash of table and sampled bits."""
    tests, out = np.unpackbits(bits, axis=1), np.empty((len(sampled), len(bits)), np.uint64)
    for t, key in zip(sampled, out):
        packed = np.packbits(tests[:, t], axis=1)
        words = np.zeros((len(bits), 8 * math.ceil(packed.shape[1] / 8)), np.uint8)
        words[:, : packed.shape[1]] = packed
        key[:] = zlib.crc32(t.astype("<i8").tobytes())
        for w in words.view("<u8").T:
            key[:] = mix(key ^ w)
    return out.view(np.int64)


def table_keys(bits: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """The distinct entries of a picture's descriptors in the tables."""
    return np.unique(entries_of(bits, sampled))


def words_of_bits(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bits).view("<u8")


def nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first nearest y of each x, how many bits they are apart, and the first nearest x of each y."""
    best, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    back, back_least = np.zeros(len(y), np.int64), np.full(len(y), TESTS + 1)
    for z in range(0, len(x), ROWS):
        some = x[z : z + ROWS]
        apart = sum(np.bitwise_count(some[:, w, None] ^ y[:, w]).astype(np.int16) for w in range(x.shape[1]))
        best[z : z + ROWS], least[z : z + ROWS] = apart.argmin(axis=1), apart.min(axis=1)
        here = apart.min(axis=0)
        closer = here < back_least
        back[closer], back_least[closer] = apart.argmin(axis=0)[closer] + z, here[closer]
    return best, least, back


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], enough: int | None = None) -> int:
    """At how many places the best similarity transform between two pictures explains corner matches.

    Matches are mutual best within APART bits. Every two matches give a transform; the one that
    takes matches within MISS pixels at most places counts: one corner, described at several
    scales, is one place (PLACE pixels wide). The search ends where one takes enough.
    """
    (pa_, ba), (pb, bb) = a, b
    if len(ba) < 2 or len(bb) < 2:
        return 0
    best, least, back = nearest(words_of_bits(ba), words_of_bits(bb))
    i = np.arange(len(ba))
    i = i[(least <= APART) & (back[best] == i)]
    if len(i) < AGREE:
        return 0
    p, q = (x[:, 0] + 1j * x[:, 1] for x in (pa_[i].astype(np.float64), pb[best[i]].astype(np.float64)))
    n, best_yet = len(i), 0
    cell = np.unique(np.stack([p.real // PLACE, p.imag // PLACE]), axis=1, return_inverse=True)[1].ravel()
    if cell.max() + 1 < AGREE:
        return 0
    at = (cell[:, None] == np.arange(cell.max() + 1)).astype(np.float32)
    rows = max(1, 2**17 // (n * n))
    for k in range(0, n - 1, rows):  # the transforms of some matches with each later one
        s, t = np.nonzero(np.arange(k, min(k + rows, n - 1))[:, None] < np.arange(n))
        s = s + k
        with np.errstate(all="ignore"):
            turn = (q[t] - q[s]) / (p[t] - p[s])
        sound = np.isfinite(turn) & (np.abs(turn) > 0.25) & (np.abs(turn) < 4) & (np.abs(p[t] - p[s]) > 3)
        turn, s = turn[sound], s[sound]
        for z in range(0, len(turn), 2**12):
            some, of = turn[z : z + 2**12], s[z : z + 2**12]
            shift = q[of] - some * p[of]
            fits = np.abs(some[:, None] * p + shift[:, None] - q) <= MISS
            fits = fits[fits.sum(axis=1) >= max(AGREE, best_yet + 1)]
            if len(fits):
                best_yet = max(best_yet, int((fits.astype(np.float32) @ at > 0).sum(axis=1).max()))
            if enough and best_yet >= enough:
                return best_yet
    return best_yet


def explained(x: bytes, y: bytes) -> bool:
    """Whether a transform explains enough matches of two described pictures; either may be given first."""
    first, second = sorted((x, y))
    return agreeing(from_blob(first), from_blob(second), AGREE) >= AGREE


@functools.cache
def _tables() -> np.ndarray:
    return tables_for(DESCRIPTORS)


@functools.lru_cache(2048)
def _keys(blob: bytes) -> np.ndarray:
    return table_keys(from_blob(blob)[1], _tables())


def alike(x: bytes, y: bytes) -> bool:
    """Whether two described pictures are copies, and linked: explained(), and VOTES times in one bucket. No other picture has a say."""
    return explained(x, y) and len(np.intersect1d(_keys(bytes(x)), _keys(bytes(y)), assume_unique=True)) >= VOTES


def described(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(media_id, n_corners, same, blob); same: a hash of the picture's bytes."""
    importable(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in range(0, b.num_rows, 100):
                some = b.column(1)[z : z + 100].to_pylist()
                found = [describe(decode(x)) for x in some]
                out = [
                    b.column(0)[z : z + 100], pa.array([len(p) for p, _ in found], pa.int64()), pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in some], pa.binary()),
                    pa.array([to_blob(*x) for x in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(out, ["media_id", "n_corners", "same", "blob"])

    return cut(rows.mapInArrow(run, "media_id long, n_corners long, same binary, blob binary"), "pictures")


def _keyed(reps: DataFrame) -> tuple[list[DataFrame], int]:
    """((rep, key) of reps with corners, some tables at a time; how often two must meet). An entry may come twice."""
    reps, sampled = reps.filter("n_corners > 0"), _tables()

    def entries(some: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for z in range(0, b.num_rows, 100):
                    found = [from_blob(x)[1] for x in b.column(1)[z : z + 100].to_pylist()]
                    rep = np.repeat(b.column(0)[z : z + 100].to_numpy(), [len(x) for x in found])
                    for keys in entries_of(np.concatenate(found), some):
                        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(keys)], ["rep", "key"])

        return reps.select("rep", "blob").mapInArrow(run, "rep long, key long")

    return [entries(sampled[i : i + TOGETHER]) for i in range(0, len(sampled), TOGETHER)], VOTES


def shared_buckets(reps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reps, keys, starts, sizes) of buckets of several reps, in order; each rep once in a bucket."""
    order = np.argsort(keys)
    reps, keys = reps[order], keys[order]
    same = keys[1:] == keys[:-1]
    keep = np.append(same, False) | np.append(False, same)  # most entries are alone
    reps, keys = reps[keep], keys[keep]
    order = np.lexsort((reps, keys))
    reps, keys = reps[order], keys[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (reps[1:] != reps[:-1]))[: len(keys)]
    reps, keys = reps[once], keys[once]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sizes = np.diff(np.append(starts, len(keys)))
    return reps, keys, starts[sizes > 1], sizes[sizes > 1]


def counted_pairs(reps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) of all pairs a < b of buckets' members, n being how often they met; a pair may come in several parts."""
    made, total = [], 0

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*made))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[first], b[first], np.diff(np.append(first, len(a)))

    for m in np.unique(sizes).tolist():
        x, y = np.triu_indices(m, 1)
        at = starts[sizes == m]
        some = max(1, MADE // len(x))
        for z in range(0, len(at), some):
            here = at[z : z + some, None]
            made.append((reps[here + x].ravel(), reps[here + y].ravel()))
            total += len(made[-1][0])
            if total >= MADE:
                yield counted()
                made, total = [], 0
    if made:
        yield counted()


def _met(keyed: DataFrame, small: int, parts: int) -> DataFrame:
    """(key, rep, centre, n) of buckets with several members: of those of at most small members every pair, with a null key and how often it met; of larger ones every member, centre being the first."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            reps, keys = (np.concatenate(x) for x in zip(*held))
            part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            reps, keys = reps[order], keys[order]
            have, at = np.unique(part[order], return_index=True)
            ends = [*at[1:].tolist(), len(reps)]
            cells = [[x[i:j].tobytes() for i, j in zip(at.tolist(), ends)] for x in (reps, keys)]
            return pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), *(pa.array(x, pa.binary()) for x in cells)], ["part", "reps", "keys"])

        for b in batches:
            held.append(tuple(c.to_numpy() for c in b.columns))
            n += b.num_rows
            if n >= SORTED:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        names = ["key", "rep", "centre", "n"]

        def flush() -> Iterator[pa.RecordBatch]:
            reps, keys = (np.concatenate([np.frombuffer(y, np.int64) for y in x]) for x in zip(*held))
            reps, keys, starts, sizes = shared_buckets(reps, keys)
            few = sizes <= small
            for a, b, n in counted_pairs(reps, starts[few], sizes[few]):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(b), pa.array(a), pa.array(n)], names)
            for i, m in zip(starts[~few].tolist(), sizes[~few].tolist()):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + m]), pa.array(reps[i : i + m]), pa.array(np.full(m, reps[i])), pa.array(np.ones(m, np.int64))], names)

        for b in batches:
            for p, reps, keys in zip(*(c.to_pylist() for c in b.columns)):
                if p != part and held:
                    yield from flush()
                    held = []
                part = p
                held.append((reps, keys))
        if held:
            yield from flush()

    cells = keyed.select("rep", "key").mapInArrow(dealt, "part long, reps binary, keys binary")
    return cells.repartition("part").sortWithinPartitions("part").mapInArrow(bucketed, "key long, rep long, centre long, n long")


def _confirmed(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """The (a, b) that are alike; those that are known to have met often enough need only be explained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [explained(x, y) if met else alike(x, y) for met, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(blobs.toDF("a", "blob_a"), "a").join(blobs.toDF("b", "blob_b"), "b")
    return both.select("a", "b", "met", "blob_a", "blob_b").mapInArrow(run, "a long, b long")


def meetings(lefts: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """(lefts, others): in how many buckets two pictures meet, counted table by table with the descriptors' bits as given."""
    met = np.zeros((len(lefts), len(others)), np.int32)

    def distinct(bits: np.ndarray, of: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = entries_of(bits, table)[0]
        order = np.lexsort((of, keys))
        keys, of = keys[order], of[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))
        return keys[once], of[once]

    other_bits, other = np.concatenate(others), np.repeat(np.arange(len(others)), [len(x) for x in others])
    tables = _tables()
    parts = [(z, np.concatenate(lefts[z : z + LEFTS]), np.repeat(np.arange(len(lefts[z : z + LEFTS])), [len(x) for x in lefts[z : z + LEFTS]])) for z in range(0, len(lefts), LEFTS)]
    for i in range(len(tables)):
        keys, of = distinct(other_bits, other, tables[i : i + 1])
        for z, bits, left in parts:
            mine, own = distinct(bits, left, tables[i : i + 1])
            first = np.searchsorted(keys, mine)
            n = np.searchsorted(keys, mine, "right") - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.add.at(met, (z + np.repeat(own, n), of[at]), 1)
    return met


def block_links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links of a block's left pictures with others of other components, one for each such component; only those that meet VOTES times are compared."""
    lefts = [(rep, comp, blob) for left, _, rep, comp, blob in rows if left]
    others = [(also, rep, comp, blob) for left, also, rep, comp, blob in rows if not left]
    if not lefts or not others:
        return []
    met = meetings([from_blob(x[2])[1] for x in lefts], [from_blob(x[3])[1] for x in others]) >= VOTES
    rep, comp = np.array([x[:2] for x in lefts], np.int64).T[:, :, None]
    also, name, other = np.array([x[:3] for x in others], np.int64).T
    met &= (comp != other) & ~((also == 1) & (name < rep))  # two that are both left are compared once
    found = {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(met))):
        (a, _, x), (_, b, c, y) = lefts[i], others[j]
        if (a, c) not in found and explained(x, y):
            found[a, c] = (a, b)
    return list(found.values())


def _block_links(blocks: DataFrame) -> DataFrame:
    """A link for each left picture of a block and each other component that it is alike to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            links = block_links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in batches:
            for *k, left, also, rep, comp, blob in zip(*(c.to_pylist() for c in b.columns)):
                if k != key and rows:
                    yield flush()
                    rows = []
                key = k
                rows.append((left, also, rep, comp, blob))
        if rows:
            yield flush()

    order = ["key", "l", "m"]
    return blocks.repartition(*order).sortWithinPartitions(*order).select(*order, "left", "also", "rep", "comp", "blob").mapInArrow(run, "a long, b long")


def copies(media: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """(media_id, n_corners, group_id, kept) of every row: group_id is the smallest linked media_id.

    Groups are the components of alike() over all pairs, for an input of any size. Equal bytes
    are one class before anything is compared. A class meets others in the tables of its
    descriptors' sampled bits. How often two meet in buckets of at most SMALL is counted pair by
    pair, and those that meet VOTES times are compared. In a larger bucket, all are compared
    with the first; where it then still holds several components, the meetings of the members
    outside the largest with all others are counted, in blocks of bounded size, and those that
    meet VOTES times are compared. So a bucket of any size is dealt with whole, and no pair that
    is alike is left out but within a component.

    Pictures without corners, and media that can't be read, link with equal bytes alone. A null
    medium links with nothing; a null id has a null group and is kept. Rows that repeat an id
    are pictures of their own. An empty table gives no rows; other columns are not looked at.
    """
    all_rows = described(media, id_col, media_col)
    known = all_rows.filter("media_id is not null and same is not null")
    classes = known.groupBy("same").agg(F.min("media_id").alias("first"), F.max("n_corners").alias("n_corners"), F.any_value("blob").alias("blob"))
    # A class has a number of its own, as ids repeat where rows do; the table that is written fixes the numbers.
    reps = cut(classes.select("same", F.monotonically_increasing_id().alias("rep"), "first", "n_corners", "blob"), "classes")
    blobs = reps.select("rep", "blob")
    n, corners = reps.agg(F.count("*"), F.sum("n_corners")).first()
    tables, votes = _keyed(reps)
    parts = max(48, math.ceil((corners or 0) * TOGETHER / SORTED))
    met = [cut(_met(keyed, SMALL, parts), "buckets") for keyed in tables]
    every = functools.reduce(DataFrame.unionByName, met)
    counted = every.filter("key is null").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.sum("n").alias("n")).filter(F.col("n") >= votes).select("a", "b", F.lit(True).alias("met"))
    members = cut(every.filter("key is not null").select("key", "rep", "centre"), "members")
    firsts = members.filter("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), F.lit(False).alias("met"))
    stars = cut(counted.unionByName(firsts).groupBy("a", "b").agg(F.max("met").alias("met")), "stars")
    for x in met:
        discard(x)
    # Pairs take their pictures along: at a time as many as there are pictures.
    slices = math.ceil(stars.count() / max(n, BLOCK))
    with small_batches(media.sparkSession, 2000):
        links = [cut(_confirmed(stars.filter(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i), blobs), "links") for i in range(max(1, slices))]
    links = functools.reduce(DataFrame.unionByName, links)
    comp = components(links)

    placed = members.join(comp.toDF("rep", "comp"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    # Members of a bucket that are alike to none there make a component each.
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter("x < y").select("key", "m")
    open_rows = cut(placed.join(split, "key"), "open")
    tops = open_rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("m").alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("c"), F.max("m").alias("m"))
    plan = tops.select("key", "top", F.ceil((F.col("m") - F.col("c")) / BLOCK).cast("int").alias("nl"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"))
    todo = open_rows.drop("m").join(plan, "key").withColumn("left", F.col("comp") != F.col("top"))
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_left = todo.filter("left").select("key", place("nl", 1).alias("l"), each("nm").alias("m"), F.lit(True).alias("left"), F.lit(True).alias("also"), "rep", "comp")
    as_other = todo.select("key", each("nl").alias("l"), place("nm", 2).alias("m"), F.lit(False).alias("left"), F.col("left").alias("also"), "rep", "comp")
    with small_batches(media.sparkSession, 2000):
        more = cut(_block_links(as_left.unionByName(as_other).join(blobs, "rep")), "more")

    final = components(comp.select("node", "component").union(more))
    named = reps.select("same", "rep", "first").join(final.toDF("rep", "component"), "rep", "left")
    least = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    homes = named.join(least, "component", "left").select("same", F.coalesce("least", "first").alias("component"))
    out = all_rows.select("media_id", "n_corners", "same").join(homes, "same", "left")
    group = F.when(F.col("media_id").isNotNull(), F.coalesce("component", "media_id"))
    return out.select("media_id", "n_corners", group.alias("group_id"), F.coalesce(F.col("media_id") == group, F.lit(True)).alias("kept"))


# Pictures for a table of vectors, which has none of its own


def drawn(seed: int, side: int = 96) -> np.ndarray:
    """A picture of grey blocks that a seed determines."""
    rng = np.random.default_rng(seed & (2**64 - 1))
    blocks = rng.integers(0, 256, (side // 4, side // 4)).astype(np.float32)
    return np.rint(_smooth(np.kron(blocks, np.ones((4, 4), np.float32))))


def edited(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A copy that is cropped, of other brightness and contrast, and slightly noisy."""
    rng = np.random.default_rng((seed + 1) & (2**64 - 1))
    top, left = rng.integers(0, 16, 2)
    part = pixels[top : top + pixels.shape[0] - 18, left : left + pixels.shape[1] - 18]
    return np.clip(np.rint(part * rng.uniform(0.7, 1.0) + rng.uniform(0, 40) + rng.normal(0, 1, part.shape)), 0, 255)


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 4) -> DataFrame:
    """(media_id, media): a picture of each vector, 2 * id, and of every few an edited copy, 2 * id + 1.

    Equal vectors have equal pictures; a null vector has a null medium.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(vector_col).isNotNull(), F.xxhash64(vector_col)).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in range(0, b.num_rows, 500):
                ids, media = [], []
                for i, seed in zip(b.column(0)[z : z + 500].to_pylist(), b.column(1)[z : z + 500].to_pylist()):
                    own = None if seed is None else drawn(seed)
                    ids.append(None if i is None else 2 * i)
                    media.append(None if own is None else pgm(own))
                    if i is not None and i % every == 1:
                        ids.append(2 * i + 1)
                        media.append(None if own is None else pgm(edited(own, i)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["media_id", "media"])

    return rows.mapInArrow(run, "media_id long, media binary")
