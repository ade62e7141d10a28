"""A quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning minimises the non-negative estimate of the classification risk,
``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))``. The share of positives in the unlabelled
text, the prior, is estimated from how the scores of held-back positives and of unlabelled text
compare in their best top bin. A bounded sample gives a first network; the prior and the final
network come from all unlabelled text: every task goes on learning from its own rows, and the
tasks' networks are averaged, each by its rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.llm.common import as_bytes, cut, discard, importable

#: Labelled positives that training draws at most, and unlabelled documents that the first network starts from (about; by a hash of the id).
POSITIVES, START = 4000, 8000
#: Bins of scores by which the prior is told; rows of unlabelled text that a task learns from in one go.
BINS, LOT = 2000, 2000

#: Byte -> one of 16 kinds, for how characters follow each other.
_KINDS = np.full(256, 15, np.int64)
_KINDS[0x80:0xC0], _KINDS[0xC0:] = 13, 14
for _kind, _chars in enumerate([b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"AEIOUY", b"BCDFGHJKLMNPQRSTVWXZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?", b"!", b"'\"", b"()[]{}", b"|", b"#$%&*@^~"]):
    _KINDS[list(_chars)] = _kind

N_FEATURES = 11 + 256 + 256


def features(text: bytes | None) -> np.ndarray:
    """Measures of a whole text: lengths, repetition, bytes and kinds of neighbours."""
    text = text or b""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, w, k = len(text), len(words), len(lines)
    out[0], out[1], out[2] = np.log1p(n), np.log1p(w), np.log1p(k)
    if w:
        kinds = set(words)
        out[3], out[4] = len(kinds) / w, len(kinds) / w**0.5 / 10
        out[5] = sum(map(bytes.__eq__, words, words[1:])) / w
        out[6] = sum(map(bytes.__eq__, words, words[2:])) / w
        out[7] = sum(map(len, words)) / w / 10
        out[8] = max(map(len, words[:100_000])) / 100 if w < 100_000 else max(map(len, words)) / 100
    if k:
        out[9], out[10] = len(set(lines)) / k, np.log1p(n / k)
    if n:
        raw = np.frombuffer(text, np.uint8)
        at = _KINDS[raw]
        out[11:267] = np.sqrt(np.bincount(raw, minlength=256) / n)
        if n > 1:
            out[267:] = np.sqrt(np.bincount(at[:-1] * 16 + at[1:], minlength=256) / (n - 1))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Net:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 24, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def backward(self, z: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        dh = d[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.ready(x))[0])

    def adam(self, gradient, steps: int, rate: float = 0.005, decay: float = 1e-4) -> None:
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for k in range(1, steps + 1):
            for p, g, a, b in zip(self.p, gradient(), m, v):
                g = g + decay * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (1 - k / (steps + 1)) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)


def positive_against_unlabelled(net: Net, p: np.ndarray, u: np.ndarray, steps: int, seed: int) -> None:
    """Logistic regression of positive against unlabelled, each side with half the weight."""
    rng = np.random.default_rng(seed)
    p, u = net.ready(p), net.ready(u)

    def gradient() -> list[np.ndarray]:
        z = np.concatenate([p[rng.integers(len(p), size=256)], u[rng.integers(len(u), size=256)]])
        g, h = net.forward(z)
        return net.backward(z, h, (sigmoid(g) - (np.arange(512) < 256)) / 512)

    net.adam(gradient, steps)


def best_bin_prior(p_scores: np.ndarray, u_counts: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled rows, which are counted by bins of their scores: the least ratio of top-bin shares, chosen by its upper bound."""
    bins, n = len(u_counts), max(1, u_counts.sum())
    top = lambda counts: counts[::-1].cumsum()[::-1]
    p_counts = np.bincount(binned(p_scores, bins), minlength=bins)
    q_p, q_u = top(p_counts) / len(p_scores), top(u_counts) / n
    q_p, q_u = q_p[p_counts > 0], q_u[p_counts > 0]
    slack = np.sqrt(np.log(4 / delta) / 2 / n) + np.sqrt(np.log(4 / delta) / 2 / len(p_scores))
    bound = (q_u + (1 + gamma) / np.maximum(q_p, 1e-9) * slack) / np.maximum(q_p, 1e-9)
    best = int(np.argmin(bound))
    return float(np.clip(q_u[best] / max(q_p[best], 1e-9), 0.01, 0.99))


def binned(scores: np.ndarray, bins: int = BINS) -> np.ndarray:
    return np.minimum((scores * bins).astype(np.int64), bins - 1)


def non_negative(net: Net, p: np.ndarray, u: np.ndarray, prior: float, steps: int, seed: int, rate: float = 0.005) -> None:
    """Minimise the non-negative risk with the sigmoid loss l(y g) = sigmoid(-y g).

    Where a batch's estimate of the negatives' risk falls below zero, the step climbs that part
    instead, so that the network doesn't fit the positives among the unlabelled.
    """
    rng = np.random.default_rng(seed)
    p, u = net.ready(p), net.ready(u)

    def gradient() -> list[np.ndarray]:
        a, b = p[rng.integers(len(p), size=256)], u[rng.integers(len(u), size=512)]
        (g_p, h_p), (g_u, h_u) = net.forward(a), net.forward(b)
        s_p, s_u = sigmoid(g_p), sigmoid(g_u)
        rest = s_u.mean() - prior * s_p.mean()  # loss of calling them positive, of what isn't
        slope_p, slope_u = s_p * (1 - s_p) / len(a), s_u * (1 - s_u) / len(b)
        if rest >= 0:
            d_p, d_u = -prior * slope_p - prior * slope_p, slope_u
        else:
            d_p, d_u = prior * slope_p, -slope_u
        return [x + y for x, y in zip(net.backward(a, h_p, d_p), net.backward(b, h_u, d_u))]

    net.adam(gradient, steps, rate)


def tellers(p: np.ndarray, u: np.ndarray, steps: int, seed: int) -> tuple[list[Net], np.ndarray]:
    """(two networks that tell positives from unlabelled rows, scores of the positives): each half of the positives is scored by what the other half taught."""
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    nets, told = [], np.zeros(len(p))
    for half in (0, 1):
        learn_p, learn_u = np.arange(len(p)) % 2 == half, np.arange(len(u)) % 2 == half
        if learn_p.all() or learn_u.all() or not (learn_p.any() and learn_u.any()):
            learn_p[:], learn_u[:] = True, True
        net = Net(mean, scale, seed=seed)
        positive_against_unlabelled(net, p[learn_p], u[learn_u], steps // 3, seed)
        rest = ~learn_p if not learn_p.all() else learn_p
        told[rest] = net.score(p[rest])
        nets.append(net)
    return nets, told


def fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, seed: int = 2) -> Net:
    """A classifier from features of positives and of unlabelled documents, and the share of positives among these."""
    net = Net(u.mean(axis=0), u.std(axis=0) + 1e-3, seed=seed + 1)
    positive_against_unlabelled(net, p, u, steps // 5, seed + 1)  # a start from which the sigmoid loss has slopes
    net.p[3] += np.log(prior / (1 - prior)) / 2
    non_negative(net, p, u, prior, steps, seed + 2)
    return net


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Features from a column of them, LOT rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, LOT):
            some = b.column(0)[i : i + LOT].to_pylist()
            yield np.frombuffer(b"".join(some), "<f2").reshape(-1, N_FEATURES).astype(np.float64)


def scores_by_bin(rows: DataFrame, nets: list[Net]) -> np.ndarray:
    """How many rows (x: features) score in each bin, by the mean of nets: counted in the tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for x in _matrices(batches):
            counts += np.bincount(binned(np.mean([net.score(x) for net in nets], axis=0)), minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in rows.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        out[r["bin"]] = r["n"]
    return out


def refined(rows: DataFrame, net: Net, p: np.ndarray, prior: float, seed: int) -> Net:
    """net, after every task has gone on from it over all its own rows (x: features), averaged by rows."""
    p = p.astype("<f2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, positives = copy.deepcopy(net), 0, p.astype(np.float64)
        for x in _matrices(batches):
            non_negative(own, positives, x, prior, max(1, len(x) // 128), seed + n, rate=0.0005)
            n += len(x)
        flat = np.concatenate([x.ravel() for x in own.p]) * n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array(np.full(len(flat), n, np.int64))], ["i", "v", "n"])

    got = rows.mapInArrow(run, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # a row for each parameter
    flat = np.array([r["v"] / max(1, r["n"]) for r in sorted(got, key=lambda r: r["i"])])
    out, at = copy.deepcopy(net), 0
    for k, x in enumerate(net.p):
        out.p[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([np.minimum(features(x), 60_000).astype("<f2").tobytes() for x in as_bytes(texts)], pa.binary())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", seed: int = 13) -> Net | None:
    """A classifier from rows of labels that are 1 and all of docs; None without either.

    Both tables are used as they are given: leave out what must not be learnt from. About
    POSITIVES labelled documents are drawn by a hash of the id; other labels than 1 are not
    looked at. All documents take part as unlabelled text; about START of them give the first
    network. Rows of docs without an id are left out.
    """
    importable(docs.sparkSession)
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000_000))
    trusted = labels.filter((F.col(label_col) == 1) & F.col(label_id).isNotNull()).select(F.col(label_id).cast("long").alias("id")).distinct()
    n_p, n_u = trusted.count(), docs.count()
    if not n_p or not n_u:
        return None
    trusted = trusted.filter(draw < int(1e7 * min(1, POSITIVES / n_p))).withColumn("positive", F.lit(True))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(trusted), "id", "left").withColumn("u", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10_000_000)) < int(1e7 * min(1, START / n_u)))
    known = cut(rows.select("id", F.coalesce("positive", F.lit(False)).alias("positive"), "u", _features("text").alias("x")), "features")
    got = known.filter("positive or u").toPandas().sort_values("id", kind="stable")
    p, u = (np.frombuffer(b"".join(got.loc[got[c], "x"]), "<f2").reshape(-1, N_FEATURES).astype(np.float64) for c in ("positive", "u"))
    if not len(p) or not len(u):
        return None
    every, steps = known.select("x"), 1500
    nets, told = tellers(p, u, steps, 2)
    prior = best_bin_prior(told, scores_by_bin(every, nets))
    net = refined(every, fit(p, u, prior, steps), p, prior, seed)
    discard(known)
    return net


def scorer(net: Net | None):
    """A column function: text -> score between 0 and 1; 0.5 without a classifier."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [np.empty(0)]
            for i in range(0, len(column), 500):
                x = np.stack([features(t) for t in as_bytes(column[i : i + 500])])
                out.append(net.score(x) if net else np.full(len(x), 0.5))
            yield pa.array(np.concatenate(out))

    return score.asNondeterministic()  # so that it runs once a row, wherever it is used


def rate(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from whole texts; predicted is score >= 0.5.

    Null and empty texts are scored by the features of nothing. Rows stay as many as they are,
    whatever their id, and equal texts score alike. Other columns are not looked at.
    """
    importable(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), scorer(net)(F.col(text_col)).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, net: Net | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, that score at least least."""
    importable(docs.sparkSession)
    name = "_rated"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, scorer(net)(F.col(text_col))).filter(F.col(name) >= least).drop(name)
